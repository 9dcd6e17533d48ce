"""The operators' inputs, derived from the generated tables, in Spark and in DuckDB SQL.

relations: line items; a scene is a supplier, the truth a price and the
prediction that price after discount and tax.  frames: events; a capture is a
user.  instances: embeddings, twelve to a frame; their leading dimensions give
position and box.  captures: customers.  runs: orders against a perturbed copy.
responses: texts made from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
WIDTH, HEIGHT = 1024, 768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy(*LINE_KEY)
    rows = table(spark, sf_dir, "lineitem").select(*LINE_KEY).withColumn("place", F.row_number().over(order))
    price = F.col("l_extendedprice")
    return rows.select(
        F.col("l_suppkey").alias("scene"), F.when(F.col("place") % 2 == 1, "A").otherwise("B").alias("fold"), "place", price.alias("truth"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("prediction"), F.ln((1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("log_error"), "l_discount", "l_partkey", "l_linenumber", "l_orderkey", "l_quantity",
    )


RELATIONS_SQL = """r as (select l_suppkey as scene, case when row_number() over w % 2 = 1 then 'A' else 'B' end as fold, row_number() over w as place, l_extendedprice as truth,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) as prediction, ln((1 - l_discount) * (1 + l_tax)) as e, l_discount, l_partkey from lineitem
  window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows: counts come from the event's JSON, sharpness is its value."""
    k = F.get_json_object("props", "$.k").cast("int")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("capture_id"), (F.row_number().over(order) - 1).alias("frame_index"), (k % 20).alias("oracle"), (k % 15).alias("natural"), (k % 10).alias("natural_interior"),
        F.col("value").alias("sharpness"), F.format_string("%010d", F.col("event_id")).alias("image_member"), "event_id",
    )


FRAMES_SQL = """f as (select user_id as capture_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_index, k % 20 as oracle, k % 15 as "natural", k % 10 as natural_interior,
  value as sharpness, event_id, count(*) over (partition by user_id) as frames from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)),
b as (select *, least(5, cast(floor(frame_index * 5 / frames) as bigint) + 1) as temporal_bin from f),
ok as (select * from b where oracle >= 8 and "natural" >= 6 and natural_interior >= 3),
cut as (select capture_id, quantile_cont(sharpness, 0.75) as cutoff, count(*) as eligible from ok group by 1),
sharp as (select ok.*, cutoff, eligible, count(*) over (partition by ok.capture_id) as n_sharp from ok join cut using (capture_id) where sharpness >= cutoff),
r1 as (select *, row_number() over (partition by capture_id, temporal_bin order by natural_interior desc, "natural" desc, oracle desc, sharpness desc, frame_index) as k1 from sharp),
r2 as (select *, row_number() over (partition by capture_id order by natural_interior desc, "natural" desc, oracle desc, sharpness desc, frame_index) as candidate_rank from r1 where k1 <= 1),
short as (select * from r2 where candidate_rank <= 5)"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    x, y, w, h = 300 + 500 * e(4), 250 + 500 * e(5), 10 + 800 * F.abs(e(6)), 10 + 800 * F.abs(e(7))
    position = F.array(*(10 * e(k) for k in range(3)))
    box = F.array(x, y, x + w, y + h)
    frame = F.floor(F.col("vec_id") / 12)
    kind = (F.col("label") * 3 + F.col("vec_id")) % 17
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("cap"), F.floor(frame / 5).cast("string")).alias("capture_id"), (frame % 5).alias("frame_index"), (F.col("vec_id") % 12 + 1).alias("instance_index"), F.col("vec_id").alias("instance_id"),
        F.when(kind == 5, " Wall ").when(kind == 11, "FLOOR").otherwise(F.concat(F.lit(" C"), kind.cast("string"), F.lit(" "))).alias("category"), F.when(F.col("label") % 3 != 0, "seen").alias("caption"),
        position.alias("position"), F.array(*(e(k) + 0.3 for k in range(8, 11))).alias("scale"), F.array_repeat(position, 8).alias("corners"),
        box.alias("box_2d_rend"), F.array(x + 5, y + 5, x + w, y + h).alias("box_2d_proj"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
    )


INSTANCES_SQL = """i0 as (select *, floor(vec_id / 12) as fr, embedding[5]::double * 500 + 300 as x, embedding[6]::double * 500 + 250 as y, 10 + 800 * abs(embedding[7]::double) as w, 10 + 800 * abs(embedding[8]::double) as h from embeddings),
i as (select 'cap' || floor(fr / 5)::bigint as capture_id, (fr % 5)::bigint as frame_index, (vec_id % 12 + 1)::bigint as instance_index, vec_id as instance_id,
  case (label * 3 + vec_id) % 17 when 5 then 'wall' when 11 then 'floor' else 'c' || ((label * 3 + vec_id) % 17) end as category, label % 3 <> 0 as captioned, 10 * embedding[1]::double as p0, 10 * embedding[2]::double as p1, 10 * embedding[3]::double as p2, x, y, x + w as x1, y + h as y1, w, h, w * h as area,
  embedding[9]::double + 0.3 > 0 and embedding[10]::double + 0.3 > 0 and embedding[11]::double + 0.3 > 0 as geometric from i0),
o as (select *, geometric and w >= 20 and h >= 20 and area >= 1000 and area / (1024 * 768) <= 0.5 as oracle, x >= 5 and y >= 5 and x1 <= 1019 and y1 <= 763 as interior from i),
n as (select *, oracle and category not in ('baseboard', 'ceiling', 'floor', 'object', 'wall') and count(*) over (partition by capture_id, frame_index, category) = 1 as "natural" from o),
objects as (select *, case when area > 0 then least(greatest(greatest(least(x1, 1024) - least(greatest(x, 0), 1024), 0) * greatest(least(y1, 768) - least(greatest(y, 0), 768), 0) / area, 0), 1) else 0 end as visible,
  area / (1024 * 768) as area_fraction, least(w, h) as side, least(x, y, 1024 - x1, 768 - y1) as margin from n where "natural"),
p0 as (select a.capture_id, a.frame_index, a.instance_index as i1, b.instance_index as i2, sqrt((a.p0 - b.p0) * (a.p0 - b.p0) + (a.p1 - b.p1) * (a.p1 - b.p1) + (a.p2 - b.p2) * (a.p2 - b.p2)) as distance_m,
  least(a.visible, b.visible) as visible, a.interior and b.interior as both_interior, a.area as aa, b.area as ba,
  greatest(least(a.x1, b.x1) - greatest(a.x, b.x), 0) * greatest(least(a.y1, b.y1) - greatest(a.y, b.y), 0) as inter, least(a.area, b.area) as min_area,
  sqrt(power((a.x + a.x1) / 2 - (b.x + b.x1) / 2, 2) + power((a.y + a.y1) / 2 - (b.y + b.y1) / 2, 2)) as center,
  least(a.area_fraction, b.area_fraction) as area_fraction, least(a.side, b.side) as side, least(a.margin, b.margin) as margin
  from objects a join objects b on a.capture_id = b.capture_id and a.frame_index = b.frame_index and a.instance_index < b.instance_index),
p as (select *, case when aa + ba - inter > 0 then inter / (aa + ba - inter) else 0 end as iou, case when min_area > 0 then inter / min_area else 0 end as ios from p0)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven shapes of answers, by event id."""
    v = F.col("value").cast("string")
    shapes = {
        0: F.concat(F.lit('{"distance_m": '), v, F.lit("}")), 1: F.concat(F.lit('```json\n{"distance_m": '), v, F.lit("}\n```")), 2: F.concat(F.lit('About {"distance_m": '), v, F.lit("} I think")),
        3: F.concat(F.lit('{"distance_m": "'), v, F.lit('"}')), 4: F.lit('{"distance_m": true}'), 5: F.concat(F.lit('{"distance_m": -'), v, F.lit("}")), 6: F.lit("no idea"),
        7: F.concat(F.lit('{"a": {}, "distance_m": '), v, F.lit("} tail")), 8: F.concat(F.lit('  {\n "distance_m" : '), v, F.lit("\n}  ")), 9: F.concat(F.lit('```\n{"distance_m": '), v, F.lit("}\n```")), 10: F.lit('[1, 2]'),
    }
    raw = F.coalesce(*(F.when(F.col("event_id") % 11 == k, t) for k, t in shapes.items()))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), (F.col("event_id") % 97 + 1.37).cast("double").alias("truth"))


RESPONSES_SQL = """a0 as (select event_id, (event_id % 97 + 1.37)::double as truth, case event_id % 11 when 0 then '{"distance_m": ' || value || '}' when 1 then '```json' || chr(10) || '{"distance_m": ' || value || '}' || chr(10) || '```'
  when 2 then 'About {"distance_m": ' || value || '} I think' when 3 then '{"distance_m": "' || value || '"}' when 4 then '{"distance_m": true}' when 5 then '{"distance_m": -' || value || '}' when 6 then 'no idea'
  when 7 then '{"a": {}, "distance_m": ' || value || '} tail' when 8 then '  {' || chr(10) || ' "distance_m" : ' || value || chr(10) || '}  ' when 9 then '```' || chr(10) || '{"distance_m": ' || value || '}' || chr(10) || '```' else '[1, 2]' end as raw from events),
a1 as (select *, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) as t from a0),
a2 as (select *, case when starts_with(t, '```') then regexp_replace(regexp_replace(t, '^```(json)?\\s*', '', 'i'), '\\s*```$', '') else t end as u from a1),
a3 as (select *, case when json_valid(u) and starts_with(trim(u), '{') then u end as j1, regexp_extract(u, '\\{.*?\\}', 0, 's') as m from a2),
a4 as (select *, case when json_valid(m) then m end as j2 from a3),
a5 as (select *, case when json_type(j1, '$.distance_m') in ('DOUBLE', 'UBIGINT', 'BIGINT') then try_cast(j1 ->> '$.distance_m' as double) end as d1,
  case when json_type(j2, '$.distance_m') in ('DOUBLE', 'UBIGINT', 'BIGINT') then try_cast(j2 ->> '$.distance_m' as double) end as d2 from a4),
a as (select event_id, truth, coalesce(case when d1 > 0 then d1 end, case when d2 > 0 then d2 end) as predicted from a5)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as recorded captures."""
    k = F.col("c_custkey")
    yes = k % 2 == 0
    return table(spark, sf_dir, "customer").select(
        k.alias("order_index"), F.concat(F.lit("cap"), k.cast("string")).alias("capture_id"), yes.alias("selection_accepted"), F.when(yes, 12 - (k % 50 == 0).cast("int")).otherwise(0).alias("selection_pair_count"),
        F.when(yes, F.when(k % 10 == 0, "fail").otherwise("pass")).when(k % 51 == 0, "pass").otherwise("not_applicable").alias("visual_qc"), F.when(k % 4 == 0, k % 10 != 0).alias("capture_accepted"),
        F.when(k % 3 == 0, "minimum_eligible_pairs").when(k % 3 == 1, "no_frame_candidates").alias("reason"),
    )


LEDGER_SQL = """l as (select c_custkey as order_index, 'cap' || c_custkey as capture_id, c_custkey % 2 = 0 as yes, case when c_custkey % 2 = 0 then 12 - (c_custkey % 50 = 0)::int else 0 end as pairs,
  case when c_custkey % 2 = 0 then case when c_custkey % 10 = 0 then 'fail' else 'pass' end when c_custkey % 51 = 0 then 'pass' else 'not_applicable' end as qc,
  case when c_custkey % 4 = 0 then c_custkey % 10 <> 0 end as stored, case when c_custkey % 3 = 0 then 'minimum_eligible_pairs' when c_custkey % 3 = 1 then 'no_frame_candidates' end as reason from customer)"""
