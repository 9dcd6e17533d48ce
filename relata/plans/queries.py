"""Every operator as a query over the generated tables, with its DuckDB form.

Counts are cast to bigint and floating results rounded on both sides, so that
types agree and the order of a sum does not show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.functions import predicates as P
from relata.functions import responses as R
from relata.functions import variants
from relata.functions.text import archive_capture_id, display_path, pair_id, sha256_text, six_digits, unordered_pair
from relata.operators import audit, compare, ledger, metrics, ordering, pairs, ranking, selection, sketches, sweep, timejoins, validate
from relata.operators.quantiles import exact_quantiles
from relata.params import AuditRules, PairRules, RankRules, SceneRules
from relata.plans import bindings as B
from relata.sources import files
from relata.storage import materialize, shared_dir
from relata.streaming import ledgers
from relata.streaming.commits import CommitLog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SALT = "relata-order-v1"
#: Thresholds that leave the small generated scenes enough pairs.
PAIRS = PairRules(0.25, 0.9, 0.6, 0.9, 0.002, 20.0, 2.0)
PASS = "distance_m >= 0.25 and visible >= 0.9 and iou <= 0.6 and ios <= 0.9 and area_fraction >= 0.002 and side >= 20 and margin >= 2"
SCENE = SceneRules(pairs_per_scene=6, distance_strata=3, minimum_unique_objects=5, maximum_uses_per_object=3, minimum_distance_ratio=2.0)


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns: whole numbers as bigint, fractions rounded to six places."""
    out = []
    for name in columns:
        kind = df.schema[name].dataType.typeName()
        c = F.col(name)
        out.append((F.round(c, 6) if kind in ("double", "float") else c.cast("long") if kind in ("integer", "short", "byte", "decimal") else c).alias(name))
    return df.select(*out)


# ------------------------------------------------------------ metrics

FOLDS_SQL = f"""with {B.RELATIONS_SQL},
m as (select scene, fold, count(*) as n, avg(e) as mu, sum(e * e) as raw, var_pop(e) as spread from r group by 1, 2),
x as (select t.scene, t.fold as test_fold, t.n, -o.mu as log_alpha, exp(-o.mu) as alpha, t.raw as raw_sse, t.n * (t.spread + (t.mu - o.mu) * (t.mu - o.mu)) as corrected_sse
  from m t join m o on t.scene = o.scene and t.fold <> o.fold),
s as (select scene, sum(n) as n, sum(raw_sse) as raw, sum(corrected_sse) as cor, max(alpha) / min(alpha) as alpha_ratio, case when sum(raw_sse) > 0 then 1 - sum(corrected_sse) / sum(raw_sse) end as g_cv from x group by 1)
"""


@query(FOLDS_SQL + "select scene, n::bigint as n, round(g_cv, 6) as g_cv, round(alpha_ratio, 6) as fold_alpha_ratio, round(sqrt(raw / n), 6) as raw_rmse, round(sqrt(cor / n), 6) as corrected_rmse from s")
def scene_gcv(spark, d):
    return shown(metrics.scene_gain(B.relations(spark, d)), "scene", "n", "g_cv", "fold_alpha_ratio", "raw_rmse", "corrected_rmse")


@query(FOLDS_SQL + "select scene, test_fold, n::bigint as n, round(log_alpha, 6) as log_alpha, round(alpha, 6) as alpha, round(raw_sse, 6) as raw_sse, round(corrected_sse, 6) as corrected_sse, round(case when raw_sse > 0 then 1 - corrected_sse / raw_sse end, 6) as g_cv from x")
def fold_metrics(spark, d):
    return shown(metrics.fold_metrics(B.relations(spark, d)), "scene", "test_fold", "n", "log_alpha", "alpha", "raw_sse", "corrected_sse", "g_cv")


@query(f"""with {B.RELATIONS_SQL}, q as (select scene, count(*) as n, avg(e) as mu, var_pop(e) * count(*) as conf from r group by 1)
select scene, n, round(mu, 6) as mean_log_error, round(exp(-mu), 6) as descriptive_alpha, round(n * mu * mu, 6) as ss_scale, round(conf, 6) as ss_configuration,
  round(case when n * mu * mu + conf > 0 then n * mu * mu / (n * mu * mu + conf) else 0 end, 6) as scale_fraction from q""")
def scene_scale_fraction(spark, d):
    return shown(metrics.scale_split(B.relations(spark, d)), "scene", "n", "mean_log_error", "descriptive_alpha", "ss_scale", "ss_configuration", "scale_fraction")


@query(f"""with {B.RELATIONS_SQL} select scene, round(avg(abs(prediction - truth)), 4) as mae, round(avg(abs(prediction - truth) / truth), 6) as mape, min(truth) as truth_min, max(truth) as truth_max, count(distinct l_discount) as n_unique_predictions from r group by 1""")
def scene_mae_mape(spark, d):
    rows = B.relations(spark, d)
    plain = metrics.plain_errors(rows).drop("n_unique_predictions").join(rows.groupBy("scene").agg(F.count_distinct("l_discount").alias("n_unique_predictions")), "scene")
    return plain.withColumns({"mae": F.round("mae", 4), "mape": F.round("mape", 6)}).select("scene", "mae", "mape", "truth_min", "truth_max", "n_unique_predictions")


@query(FOLDS_SQL + "select count(g_cv) as n_scenes, round(avg(g_cv), 6) as mean, round(quantile_cont(g_cv, 0.5), 6) as median, round(min(g_cv), 6) as minimum, round(max(g_cv), 6) as maximum, count_if(g_cv > 0)::bigint as n_positive, count_if(g_cv > 0.5)::bigint as n_above_half from s")
def aggregate_equal_weight(spark, d):
    return shown(metrics.equal_weight(metrics.scene_gain(B.relations(spark, d))), "n_scenes", "mean", "median", "minimum", "maximum", "n_positive", "n_above_half")


@query(FOLDS_SQL + "select sum(n)::bigint as n, round(1 - sum(cor) / sum(raw), 6) as pooled_g_cv, round(sqrt(sum(raw) / sum(n)), 6) as pooled_raw_rmse, round(sqrt(sum(cor) / sum(n)), 6) as pooled_corrected_rmse from s")
def aggregate_pooled(spark, d):
    return shown(metrics.pooled(metrics.scene_gain(B.relations(spark, d))), "n", "pooled_g_cv", "pooled_raw_rmse", "pooled_corrected_rmse")


LEVELS_SQL = FOLDS_SQL + ", d as (select x.*, n_regionkey as region, s_nationkey as nation from x join supplier on s_suppkey = scene join nation on n_nationkey = s_nationkey)"
_LEVEL = "grouping(region, nation, test_fold)::bigint as level, region::bigint as region, nation::bigint as nation, test_fold, count(distinct scene) as scenes, sum(n)::bigint as n, round(1 - sum(corrected_sse) / sum(raw_sse), 6) as g_cv, round(sqrt(sum(raw_sse) / sum(n)), 6) as raw_rmse, round(sqrt(sum(corrected_sse) / sum(n)), 6) as corrected_rmse from d group by"


def _levels(spark, d, sets=None):
    supplier, nation = B.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), B.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("scene"), F.col("n_regionkey").alias("region"), F.col("s_nationkey").alias("nation"))
    return shown(metrics.gain_levels(B.relations(spark, d).join(places, "scene"), ["region", "nation"], sets=sets), "level", "region", "nation", "test_fold", "scenes", "n", "g_cv", "raw_rmse", "corrected_rmse")


@query(f"{LEVELS_SQL} select {_LEVEL} cube (region, nation, test_fold)")
def gain_cube(spark, d):
    return _levels(spark, d)


@query(f"{LEVELS_SQL} select {_LEVEL} grouping sets ((region, nation), (region, test_fold), ())")
def gain_grouping_sets(spark, d):
    return _levels(spark, d, [["region", "nation"], ["region", "test_fold"], []])


@query("""with t as (select l_returnflag, count(*) as n, count(distinct l_partkey) as parts, quantile_cont(l_extendedprice, 0.5) as median from lineitem group by 1)
select l_returnflag, n, true as median_within, true as parts_within, parts > 0.9 * (select count(distinct l_partkey) from lineitem) as most_parts, median > 40000 as dear from t""")
def sketched_verdicts(spark, d):
    """Sketches stored for each supplier and put together by return flag give the exact figures' verdicts, within their stated errors."""
    rows = B.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_extendedprice"), F.col("l_partkey"))
    by_value = {v: materialize(sketches.sketch(rows, ["l_suppkey", "l_returnflag"], v), f"sketches-{v}") for v in ("l_extendedprice", "l_partkey")}
    price, parts = (sketches.estimates(sketches.combine(s, ["l_returnflag"]), {"median": 0.5}) for s in by_value.values())
    every = sketches.estimates(sketches.combine(by_value["l_partkey"], []), {}).select(F.col("n_distinct").alias("every_part"))
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact_parts"))
    found = price.select("l_returnflag", "n", "median").join(parts.select("l_returnflag", F.col("n_distinct").alias("parts")), "l_returnflag").join(exact, "l_returnflag").crossJoin(F.broadcast(every))  # one row is broadcast
    below = rows.join(F.broadcast(found.select("l_returnflag", "median")), "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("median")).cast("double")).alias("rank"))  # a row for each of three flags
    within = (F.abs(F.col("rank") - 0.5) <= sketches.RANK_ERROR + 1 / F.col("n")).alias("median_within")
    return found.join(below, "l_returnflag").select("l_returnflag", "n", within, (F.abs(F.col("parts") - F.col("exact_parts")) <= sketches.DISTINCT_ERROR * F.col("exact_parts") + 1).alias("parts_within"), (F.col("parts") > 0.9 * F.col("every_part")).alias("most_parts"), (F.col("median") > 40000).alias("dear"))


@query(f"with {B.RELATIONS_SQL} select scene, l_discount as value, count(*) as n from r group by 1, 2")
def prediction_histogram(spark, d):
    return metrics.prediction_histogram(B.relations(spark, d), "l_discount", ("scene",))


@query("select count(value) as n, round(avg(value), 6) as mean_seconds, round(quantile_cont(value, 0.5), 6) as median_seconds, round(sum(value), 2) as total_seconds from events")
def elapsed_statistics(spark, d):
    return shown(metrics.timing_summary(B.table(spark, d, "events"), "value"), "n", "mean_seconds", "median_seconds", "total_seconds").withColumn("total_seconds", F.round("total_seconds", 2))


@query(f"""with {B.RELATIONS_SQL}, c as (select scene, count_if(fold = 'A') as n_a, count_if(fold = 'B') as n_b from r group by 1)
select scene, n_a::bigint as n_a, n_b::bigint as n_b, case when n_a = 0 or n_b = 0 then 'folds' else 'balance' end as rule from c where n_a <> n_b""")
def fold_structure(spark, d):
    return shown(metrics.fold_violations(B.relations(spark, d)), "scene", "n_a", "n_b", "rule")


@query("select l_returnflag, l_linestatus, count(*) as n, round(quantile_cont(l_extendedprice, 0.9), 4) as price_90, round(min(l_extendedprice), 4) as price_least from lineitem group by 1, 2")
def group_quantiles(spark, d):
    """Large groups: ranks are found by histograms, whatever the table's size."""
    found = exact_quantiles(B.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9, "price_90", [F.count("*").alias("n"), F.min("l_extendedprice").alias("price_least")], few=500)
    return found.select("l_returnflag", "l_linestatus", "n", F.round("price_90", 4).alias("price_90"), F.round("price_least", 4).alias("price_least"))


@query("select round(quantile_cont(l_extendedprice, 0.123), 4) as low, round(quantile_cont(l_extendedprice, 0.987), 4) as high from lineitem")
def table_quantiles(spark, d):
    rows = B.table(spark, d, "lineitem").select("l_extendedprice")
    low, high = (exact_quantiles(rows, [], "l_extendedprice", q, n, few=500) for q, n in ((0.123, "low"), (0.987, "high")))
    return low.crossJoin(F.broadcast(high)).select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))  # one row is broadcast


# ------------------------------------------------------------ frames


@query(f"with {B.FRAMES_SQL} select capture_id, frame_index::bigint as frame_index, temporal_bin::bigint as temporal_bin from b")
def frame_temporal_bin(spark, d):
    return shown(audit.add_temporal_bin(B.frames(spark, d)), "capture_id", "frame_index", "temporal_bin")


def _binned(spark, d):
    return audit.add_temporal_bin(B.frames(spark, d))


@query(f"with {B.FRAMES_SQL} select capture_id, round(cutoff, 6) as capture_sharpness_cutoff, eligible as capture_eligible_frames from cut")
def frame_quantile_cutoff(spark, d):
    return shown(ranking.cutoffs(_binned(spark, d)), "capture_id", "capture_sharpness_cutoff", "capture_eligible_frames")


@query(f"with {B.FRAMES_SQL} select capture_id, event_id, temporal_bin::bigint as temporal_bin, candidate_rank::bigint as candidate_rank, n_sharp::bigint as capture_high_sharpness_frames, candidate_rank = 1 as selected_by_frame_rule from short")
def frame_shortlist(spark, d):
    return shown(ranking.shortlist(_binned(spark, d)), "capture_id", "event_id", "temporal_bin", "candidate_rank", "capture_high_sharpness_frames", "selected_by_frame_rule")


@query(f"with {B.FRAMES_SQL} select capture_id, event_id, k1::bigint as bin_rank from r1 where k1 <= 2")
def frame_topk_per_bin(spark, d):
    kept = ranking.shortlist(_binned(spark, d), RankRules(per_bin=2, per_capture=None))
    ranked = kept.withColumn("bin_rank", F.row_number().over(Window.partitionBy("capture_id", "temporal_bin").orderBy("candidate_rank")))
    return shown(ranked, "capture_id", "event_id", "bin_rank")


@query(f"with {B.FRAMES_SQL} select capture_id, event_id from short where candidate_rank = 1")
def selected_frames(spark, d):
    return ranking.selected_only(ranking.shortlist(_binned(spark, d))).select("capture_id", "event_id")


@query(f"""with {B.FRAMES_SQL}, a as (select capture_id, count(*) as n from f group by 1), h as (select capture_id, count(*) as n, string_agg(distinct temporal_bin, ',' order by temporal_bin) as bins from sharp group by 1), s as (select capture_id, count(*) as n from short group by 1)
select a.capture_id, a.n as audited_frames, coalesce(eligible, 0) as eligible_frames, round(cutoff, 6) as sharpness_cutoff, coalesce(h.n, 0) as high_sharpness_frames, coalesce(bins, '') as bins, coalesce(s.n, 0) as shortlist_size
from a left join cut using (capture_id) left join h using (capture_id) left join s using (capture_id)""")
def capture_rank_summary(spark, d):
    found = ranking.capture_summary(_binned(spark, d)).withColumn("bins", F.array_join("temporal_bins_represented", ","))
    return shown(found, "capture_id", "audited_frames", "eligible_frames", "sharpness_cutoff", "high_sharpness_frames", "bins", "shortlist_size")


@query("select distinct user_id as capture_id from events where user_id not in (select c_custkey from customer where c_nationkey < 5)")
def exclusion_anti(spark, d):
    excluded = B.table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("capture_id"))
    return ranking.exclude(B.frames(spark, d).select("capture_id").distinct(), excluded)


@query("select c_custkey as capture_id from customer where c_nationkey < 5 and c_custkey not in (select user_id from events)")
def unknown_exclusions(spark, d):
    excluded = B.table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("capture_id"))
    return ranking.unknown_exclusions(B.frames(spark, d), excluded)


ASOF_SQL = "with a as (select event_id, case when event_id % 3 = 0 then 0 else user_id end as capture_id, ts from events where event_type <> 'view'), b as (select event_id as frame_id, case when event_id % 3 = 0 then 0 else user_id end as capture_id, ts as frame_ts, value as sharpness from events where event_type = 'view')"


@query(ASOF_SQL + " select a.event_id, a.capture_id, b.frame_id, b.sharpness from a asof left join b on a.capture_id = b.capture_id and a.ts >= b.frame_ts")
def events_at_last_frame(spark, d):
    """Each event with the last frame of its capture up to its time; one capture holds a third of the rows."""
    rows = B.table(spark, d, "events").withColumn("capture_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    frames = rows.filter("event_type = 'view'").select(F.col("event_id").alias("frame_id"), "capture_id", F.col("ts").alias("frame_ts"), F.col("value").alias("sharpness"))
    found = timejoins.asof_join(rows.filter("event_type <> 'view'").select("event_id", "capture_id", "ts"), frames, ["capture_id"], "ts", "frame_ts", ["frame_id", "sharpness"])
    return found.select("event_id", "capture_id", "frame_id", "sharpness")


@query("""with e as (select event_id, epoch_ms(ts) as t, case when event_id % 251 = 0 then 86400000 when event_id % 5 = 0 then 600000 else (event_id % 40) * 1000 end as d, user_id % 10 as site from events),
a as (select event_id as first_id, site, t as a0, t + d as a1 from e where event_id % 2 = 0), b as (select event_id as second_id, site, t as b0, t + d // 2 as b1 from e where event_id % 2 = 1)
select first_id, second_id from a join b on a.site = b.site and a0 <= b1 and b0 <= a1""")
def overlapping_sessions(spark, d):
    """Intervals of a second to a day at ten sites."""
    k = F.col("event_id")
    length = F.when(k % 251 == 0, 86_400_000).when(k % 5 == 0, 600_000).otherwise(k % 40 * 1000)
    events = B.table(spark, d, "events")
    rows = events.select("event_id", (F.col("user_id") % 10).alias("site"), timejoins.epoch_millis(events, "ts").alias("t"), length.alias("d"))
    a = rows.filter(k % 2 == 0).select(k.alias("first_id"), "site", F.col("t").alias("a0"), (F.col("t") + F.col("d")).alias("a1"))
    b = rows.filter(k % 2 == 1).select(k.alias("second_id"), "site", F.col("t").alias("b0"), (F.col("t") + F.floor(F.col("d") / 2)).alias("b1"))
    return timejoins.interval_join(a, b, "a0", "a1", "b0", "b1", ["site"]).select("first_id", "second_id")


@query("""with m as (select user_id as capture_id, (event_id % 500)::bigint as frame, case when event_type = 'click' then 'i' when event_type = 'view' then 'p' end as kind from events)
select distinct capture_id, frame from m where kind = 'i' and exists (select 1 from m b where b.kind = 'p' and b.capture_id = m.capture_id and b.frame = m.frame)""")
def sibling_semi(spark, d):
    name = F.when(F.col("event_type") == "click", "instances.json").when(F.col("event_type") == "view", "image.png")
    members = B.table(spark, d, "events").select(F.col("user_id").alias("capture_id"), F.concat((F.col("event_id") % 500).cast("string"), F.lit("/"), name).alias("path"))
    return audit.frames_with_both(members).select("capture_id", F.col("frame").cast("long").alias("frame")).distinct()


# ------------------------------------------------------------ instances and pairs


@query(f"""with {B.INSTANCES_SQL} select capture_id, frame_index, count(*) as total, count_if(geometric)::bigint as geometric, count_if(oracle)::bigint as oracle, count_if("natural")::bigint as "natural", count_if("natural" and interior)::bigint as natural_interior from n group by 1, 2""")
def instance_audit_counts(spark, d):
    return audit.audit_counts(audit.flag_instances(B.instances(spark, d)))


@query("""with i as (select floor(vec_id / 12)::bigint as frame, vec_id, (label * 3 + vec_id) % 17 as category from embeddings)
select frame, vec_id from (select *, count(*) over (partition by frame, category) as c from i) where c = 1""")
def unique_category_per_frame(spark, d):
    rows = B.instances(spark, d).select("capture_id", "frame_index", F.col("instance_id").alias("vec_id"), P.normalized_category(F.col("category")).alias("category_key"))
    return rows.withColumn("n", audit.alike()).filter("n = 1").select(F.floor(F.col("vec_id") / 12).alias("frame"), "vec_id")


@query(f"""with {B.INSTANCES_SQL},
z as (select *, x + 5 as px, y + 5 as py, w - 5 as pw, h - 5 as ph from i),
bx as (select capture_id, frame_index, instance_index, category, captioned, geometric, 'box_2d_rend' as box_field, x as bx0, y as by0, x1 as bx1, y1 as by1, w as bw, h as bh from z
  union all select capture_id, frame_index, instance_index, category, captioned, geometric, 'box_2d_proj', px, py, x1, y1, pw, ph from z),
ob as (select *, geometric and bw >= 20 and bh >= 20 and bw * bh >= 1000 and bw * bh / (1024 * 768) <= 0.5 as oracle from bx),
un as (select *, count(*) over w as c_all, count_if(geometric) over w as c_geometric, count_if(oracle) over w as c_oracle from ob window w as (partition by capture_id, frame_index, box_field, category)),
g as (select * from (values ('all'), ('geometric'), ('oracle')) s(scope), (values (false), (true)) c(caption_required), (values ('box'), ('center')) o(mode), (values ('subset'), ('recompute')) q(pipeline),
  (values ('fraction', 0.025), ('fraction', 0.15), ('pixels', 0.0), ('pixels', 5.0), ('pixels', 40.0)) m(margin_kind, margin)),
j as (select *, oracle and category not in ('baseboard', 'ceiling', 'floor', 'object', 'wall') and (not caption_required or captioned) and case scope when 'all' then c_all when 'geometric' then c_geometric else c_oracle end = 1 as "natural",
  case when mode = 'center' then (bx0 + bx1) / 2 else bx0 end >= case when margin_kind = 'fraction' then margin * 1024 else margin end and case when mode = 'center' then (by0 + by1) / 2 else by0 end >= case when margin_kind = 'fraction' then margin * 768 else margin end
  and case when mode = 'center' then (bx0 + bx1) / 2 else bx1 end <= 1024 - case when margin_kind = 'fraction' then margin * 1024 else margin end and case when mode = 'center' then (by0 + by1) / 2 else by1 end <= 768 - case when margin_kind = 'fraction' then margin * 768 else margin end as inside from un, g),
k as (select *, count_if(inside and oracle) over (partition by capture_id, frame_index, box_field, scope, caption_required, mode, pipeline, margin_kind, margin, category) as again from j),
c as (select capture_id, frame_index, box_field, scope, caption_required, mode, pipeline, margin_kind, margin, count(*) as total, count_if(geometric) as geometric, count_if(oracle) as oracle, count_if("natural") as "natural",
  count_if(case when pipeline = 'subset' then "natural" and inside else inside and oracle and category not in ('baseboard', 'ceiling', 'floor', 'object', 'wall') and (not caption_required or captioned) and again = 1 end) as natural_interior from k group by all),
ref as (select capture_id, frame_index, count(*) as total, count_if(geometric) as geometric, count_if(oracle) as oracle, count_if("natural") as "natural", count_if("natural" and interior) as natural_interior from n group by 1, 2)
select box_field, scope, caption_required, mode, pipeline, margin_kind, margin::double as margin, count_if(c.total = ref.total)::bigint as total_matches, count_if(c.oracle = ref.oracle)::bigint as oracle_matches, count_if(c."natural" = ref."natural")::bigint as natural_matches,
  count_if(c.natural_interior = ref.natural_interior)::bigint as natural_interior_matches, count_if(c.total = ref.total and c.geometric = ref.geometric and c.oracle = ref.oracle and c."natural" = ref."natural" and c.natural_interior = ref.natural_interior)::bigint as all_matches
from c join ref using (capture_id, frame_index) group by all""")
def uniqueness_scope_grid(spark, d):
    rows = B.instances(spark, d)
    counts = sweep.rule_counts(rows, (0.025, 0.15), (0.0, 5.0, 40.0))
    found = sweep.config_matches(counts, audit.audit_counts(audit.flag_instances(rows)))
    return shown(found, "box_field", "scope", "caption_required", "mode", "pipeline", "margin_kind", "margin", "total_matches", "oracle_matches", "natural_matches", "natural_interior_matches", "all_matches")


def _objects(spark, d):
    return pairs.object_records(audit.flag_instances(B.instances(spark, d)))


def _pairs(spark, d):
    return pairs.build_pairs(_objects(spark, d))


@query(f"""with {B.INSTANCES_SQL} select capture_id, frame_index, i1 as first_instance_index, i2 as second_instance_index, round(distance_m, 6) as distance_m, both_interior, round(iou, 6) as box_iou, round(ios, 6) as intersection_over_smaller_box,
  round(min_area, 4) as minimum_box_area_px2, round(center, 6) as box_center_distance_px, round(visible, 6) as minimum_visible_fraction, round(margin, 6) as minimum_border_margin_px from p""")
def pair_geometry(spark, d):
    found = _pairs(spark, d).withColumn("minimum_box_area_px2", F.round("minimum_box_area_px2", 4))
    return shown(found, "capture_id", "frame_index", "first_instance_index", "second_instance_index", "distance_m", "both_interior", "box_iou", "intersection_over_smaller_box", "minimum_box_area_px2", "box_center_distance_px", "minimum_visible_fraction", "minimum_border_margin_px")


@query(f"with {B.INSTANCES_SQL} select capture_id, frame_index, i1 as first_instance_index, i2 as second_instance_index, round(distance_m, 6) as distance_m, round(iou, 6) as box_iou from p")
def crowded_frame_pairs(spark, d):
    """Frames of more than four objects are cut into tiles, so the way of crowded frames is taken at every size."""
    return shown(pairs.build_pairs(_objects(spark, d), crowded=4, block=3), "capture_id", "frame_index", "first_instance_index", "second_instance_index", "distance_m", "box_iou")


@query(f"""with {B.INSTANCES_SQL}, q as (select *, distance_m >= 0.25 as far from p) select capture_id, frame_index, count(*) as number_of_all_natural_pairs, count_if(far)::bigint as number_of_eligible_pairs, count_if(far and both_interior)::bigint as number_of_interior_eligible_pairs,
  count_if(far and visible >= 0.8)::bigint as visible_80, count_if(far and visible >= 1)::bigint as visible_100, count_if(far and iou <= 0.25)::bigint as iou_25, count_if(far and visible >= 1 and iou <= 0.5 and ios <= 0.8)::bigint as combined from q group by 1, 2""")
def pair_threshold_counts(spark, d):
    found = pairs.threshold_counts(_pairs(spark, d))
    by = {"visible_80": ("visibility", "0.8"), "visible_100": ("visibility", "1"), "iou_25": ("overlap", "iou<=0.25"), "combined": ("overlap", "combined")}
    return found.select("capture_id", "frame_index", "number_of_all_natural_pairs", "number_of_eligible_pairs", "number_of_interior_eligible_pairs", *(F.col(f"eligible_pairs_by_{m}")[k].alias(n) for n, (m, k) in by.items()))


@query(f"with {B.INSTANCES_SQL} select capture_id, frame_index, round(min(distance_m), 6) as min_m, round(quantile_cont(distance_m, 0.5), 6) as median_m, round(max(distance_m), 6) as max_m from p group by 1, 2")
def pair_distance_summary(spark, d):
    return shown(pairs.distance_summary(_pairs(spark, d)), "capture_id", "frame_index", "min_m", "median_m", "max_m")


@query(f"""with {B.INSTANCES_SQL}, far as (select capture_id, frame_index, count(*) as n, round(min(distance_m), 6) as min_m from p where distance_m >= 0.25 group by 1, 2), c as (select capture_id, frame_index, count(*) as objects from objects group by 1, 2)
select capture_id, frame_index, objects, coalesce(n, 0) as number_of_eligible_pairs, coalesce(n, 0) >= 12 as basic_pair_feasible, min_m from c left join far using (capture_id, frame_index)""")
def frame_feasibility(spark, d):
    objects = _objects(spark, d)
    found = pairs.feasibility(objects.select("capture_id", "frame_index").distinct(), objects).withColumns({"objects": F.size("natural_objects"), "min_m": F.col("eligible_distance_summary.min_m")})
    return shown(found, "capture_id", "frame_index", "objects", "number_of_eligible_pairs", "basic_pair_feasible", "min_m")


@query(f"with {B.INSTANCES_SQL} select capture_id, frame_index, i1 as first_instance_index, i2 as second_instance_index from p where {PASS} and both_interior")
def hard_pairs(spark, d):
    return _pairs(spark, d).filter(pairs.strict_filter(PAIRS)).select("capture_id", "frame_index", "first_instance_index", "second_instance_index")


BEST_SQL = f"""with {B.INSTANCES_SQL}, h as (select * from p where {PASS}), c as (select capture_id, frame_index, count(*) as pair_count, frame_index + 1 as candidate_rank from h group by 1, 2)"""


def _counts(spark, d):
    return _pairs(spark, d).filter(pairs.hard_filter(PAIRS)).groupBy("capture_id", "frame_index").agg(F.count("*").alias("pair_count")).withColumn("candidate_rank", F.col("frame_index") + 1)


@query(BEST_SQL + " select capture_id, frame_index, pair_count from (select *, row_number() over (partition by capture_id order by pair_count desc, candidate_rank, frame_index) as k from c) where k = 1")
def best_frame_per_capture(spark, d):
    return selection.best_frame(_counts(spark, d)).select("capture_id", "frame_index", "pair_count")


SWEEP_SQL = f"""with {B.INSTANCES_SQL}, g as (select a::double as area, s::double as side_min, b::double as border from (values (0.00125), (0.0025), (0.00375), (0.005)) x(a), (values (20.0), (30.0), (40.0), (50.0)) y(s), (values (5.0), (10.0), (15.0), (20.0)) z(b)),
f as (select distinct capture_id, frame_index, (frame_index * 3) % 5 + 1 as candidate_rank from i),
q as (select * from p where distance_m >= 0.25 and visible >= 1 and iou <= 0.5 and ios <= 0.8),
c as (select f.capture_id, f.frame_index, f.candidate_rank, g.area, side_min, border, count_if(coalesce(area_fraction >= g.area and side >= side_min and margin >= border, false)) as n from f cross join g left join q on q.capture_id = f.capture_id and q.frame_index = f.frame_index group by all),
b as (select *, row_number() over (partition by area, side_min, border, capture_id order by n desc, candidate_rank, frame_index) as k from c),
s as (select area, side_min as side, border, count_if(n >= 12)::bigint as feasible_captures, min(n)::bigint as minimum_best_pair_count, sum(n)::bigint as total_best_pairs, sum(frame_index)::bigint as best_frames from b where k = 1 group by all)"""


def _swept(spark, d):
    held = _pairs(spark, d).filter(pairs.hard_filter(PairRules(minimum_box_area_fraction=None, minimum_box_side_px=None, minimum_border_margin_px=None)))
    candidates = B.instances(spark, d).select("capture_id", "frame_index").distinct().withColumn("candidate_rank", F.col("frame_index") * 3 % 5 + 1)
    return sweep.sweep_best(sweep.sweep_counts(held, sweep.legibility_grid(spark), candidates))


@query(SWEEP_SQL + " select * from s")
def legibility_sweep(spark, d):
    best = _swept(spark, d)
    return sweep.sweep_summary(best).join(best.groupBy("area", "side", "border").agg(F.sum("frame_index").alias("best_frames")), ["area", "side", "border"])


@query(SWEEP_SQL + " select area, side, border, feasible_captures, minimum_best_pair_count from s where feasible_captures = (select max(feasible_captures) from s) order by border desc, side desc, area desc, minimum_best_pair_count desc limit 12")
def sweep_best_config(spark, d):
    return sweep.strictest_feasible(sweep.sweep_summary(_swept(spark, d))).drop("total_best_pairs")


BALANCED_SQL = f"""with {B.INSTANCES_SQL}, h as (select *, count(*) over w as n_hard, count_if(both_interior) over w as n_in from p where {PASS} window w as (partition by capture_id, frame_index)),
pool as (select *, case when n_in >= 6 then 'interior_only' else 'full_visible_fallback' end as policy from h where n_hard >= 6 and (n_in < 6 or both_interior)),
st as (select *, ntile(3) over (partition by capture_id, frame_index order by distance_m, i1, i2) as stratum from pool),
ce as (select *, ntile(2) over (partition by capture_id, frame_index, stratum order by distance_m, i1, i2) as cell from st),
be as (select *, row_number() over (partition by capture_id, frame_index, stratum, cell order by min_area desc, center desc, iou, ios, both_interior desc, i1, i2) as k from ce),
sel as (select *, row_number() over (partition by capture_id, frame_index order by stratum, distance_m, i1, i2) as pair_index, row_number() over (partition by capture_id, frame_index, stratum order by distance_m, i1, i2) as within from be where k = 1),
us as (select capture_id, frame_index, instance_index, count(*) as uses from (select capture_id, frame_index, unnest([i1, i2]) as instance_index from sel) group by 1, 2, 3),
su as (select capture_id, frame_index, count(*) as n, min(distance_m) as lo, max(distance_m) as hi, count_if(both_interior) as n_in, any_value(n_hard) as n_hard, any_value(policy) as policy from sel group by 1, 2),
sm as (select * from su join (select capture_id, frame_index, count(*) as unique_objects, max(uses) as max_uses from us group by 1, 2) using (capture_id, frame_index)),
re as (select *, unnest([case when unique_objects < 5 then 'minimum_unique_objects' end, case when max_uses > 3 then 'maximum_uses_per_object' end, case when not coalesce(lo > 0 and hi / lo >= 2.0, false) then 'minimum_distance_ratio' end, case when n_in <> 6 then 'both_objects_interior' end]) as reason from sm)"""


def _selected(spark, d):
    return selection.select_balanced(_pairs(spark, d).filter(pairs.hard_filter(PAIRS)), SCENE)


@query(BALANCED_SQL + " select printf('%s-P%02d', capture_id, pair_index) as pair_id, frame_index, case stratum when 1 then 'short' when 2 then 'medium' else 'long' end as distance_stratum, within::bigint as within_stratum_index, case when pair_index % 2 = 1 then 'A' else 'B' end as fold, i1 as first_instance_index, i2 as second_instance_index, round(distance_m, 6) as distance_m from sel")
def balanced_selection(spark, d):
    return shown(_selected(spark, d), "pair_id", "frame_index", "distance_stratum", "within_stratum_index", "fold", "first_instance_index", "second_instance_index", "distance_m")


@query(BALANCED_SQL + " select * from us")
def object_usage(spark, d):
    return selection.object_usage(_selected(spark, d))


@query(BALANCED_SQL + """, a as (select capture_id, frame_index, stratum, count(*) as candidate_pairs, min(distance_m) as lo, max(distance_m) as hi from ce group by 1, 2, 3), b as (select capture_id, frame_index, stratum, min(distance_m) as slo, max(distance_m) as shi from sel group by 1, 2, 3)
select capture_id, frame_index, stratum::bigint as distance_stratum_index, candidate_pairs, round(lo, 6) as candidate_minimum_m, round(hi, 6) as candidate_maximum_m, round(slo, 6) as selected_minimum_m, round(shi, 6) as selected_maximum_m from a join b using (capture_id, frame_index, stratum)""")
def stratum_summary(spark, d):
    cells = selection.stratify(selection.selection_pool(_pairs(spark, d).filter(pairs.hard_filter(PAIRS)), SCENE), SCENE)
    return shown(selection.stratum_summary(cells, _selected(spark, d)), "capture_id", "frame_index", "distance_stratum_index", "candidate_pairs", "candidate_minimum_m", "candidate_maximum_m", "selected_minimum_m", "selected_maximum_m")


@query(BALANCED_SQL + " select capture_id, frame_index, n as selected_pairs, round(lo, 6) as selected_minimum_m, round(hi, 6) as selected_maximum_m, n_in::bigint as selected_interior_pairs, n_hard as hard_filter_pairs, policy as interior_policy, unique_objects as unique_objects_used, max_uses as maximum_object_uses from sm")
def scene_selection_summary(spark, d):
    return shown(selection.scene_summary(_selected(spark, d)), "capture_id", "frame_index", "selected_pairs", "selected_minimum_m", "selected_maximum_m", "selected_interior_pairs", "hard_filter_pairs", "interior_policy", "unique_objects_used", "maximum_object_uses")


@query(BALANCED_SQL + " select capture_id, frame_index, reason from re where reason is not null")
def scene_acceptance_reasons(spark, d):
    return selection.scene_summary(_selected(spark, d)).select("capture_id", "frame_index", F.explode(selection.rejection_reasons(SCENE)).alias("reason"))


@query(BALANCED_SQL + """, kx as (select capture_id, frame_index, count(*) as pair_count from h group by 1, 2), bf as (select * from (select *, row_number() over (partition by capture_id order by pair_count desc, frame_index) as k from kx) where k = 1),
nf as (select capture_id, count(*) as c from kx group by 1), rs as (select capture_id, frame_index, string_agg(reason, ',') as reasons from re where reason is not null group by 1, 2)
select c.capture_id, coalesce(nf.c, 0) as candidate_frames, coalesce(bf.pair_count, 0) as best_strict_pair_count, case when nf.c is null then 'no_frame_candidates' when bf.pair_count < 6 then 'minimum_eligible_pairs' else coalesce(rs.reasons, '') end as reasons,
  coalesce(nf.c is not null and bf.pair_count >= 6 and rs.reasons is null, false) as accepted from (select distinct capture_id from i) c left join nf using (capture_id) left join bf using (capture_id) left join rs on rs.capture_id = bf.capture_id and rs.frame_index = bf.frame_index""")
def capture_decisions(spark, d):
    # The hard pairs feed the counts and the selection; they are formed once.
    held = materialize(_pairs(spark, d).filter(pairs.hard_filter(PAIRS)), "hard-pairs")
    counts, captures = held.groupBy("capture_id", "frame_index").agg(F.count("*").alias("pair_count")).withColumn("candidate_rank", F.col("frame_index") + 1), B.instances(spark, d).select("capture_id").distinct()
    best = selection.best_frame(counts).select("capture_id", "frame_index")
    chosen = held.join(best, ["capture_id", "frame_index"], "left_semi")
    summaries = selection.scene_summary(selection.select_balanced(chosen, SCENE))
    found = selection.decide(captures, counts, summaries, SCENE).withColumn("reasons", F.array_join("rejection_reasons", ","))
    return shown(found, "capture_id", "candidate_frames", "best_strict_pair_count", "reasons", "accepted")


# ------------------------------------------------------------ validation


def _manifest(spark, d):
    c = F.col
    return B.table(spark, d, "lineitem").select(
        c("l_suppkey").alias("scene"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("pair_id"), c("l_linenumber").cast("long").alias("pair_index"), F.when(c("l_returnflag") == "R", "A").when(c("l_returnflag") == "N", "B").otherwise("C").alias("fold"),
        F.when(c("l_linenumber") < 4, "short").when(c("l_linenumber") < 7, "medium").otherwise("far").alias("distance_stratum"), (c("l_quantity") / 10).alias("ground_truth_m"), (c("l_partkey") % 7).cast("string").alias("object_a"), (c("l_orderkey") % 7).cast("string").alias("object_b"),
        (1 - c("l_tax")).alias("minimum_visible_fraction"), (c("l_discount") / 10).alias("minimum_box_area_fraction"), c("l_quantity").alias("minimum_box_side_px"), F.when(c("l_quantity") > 3, c("l_quantity")).alias("minimum_border_margin_px"), (c("l_discount") * 6).alias("box_iou"), (c("l_discount") * 10).alias("intersection_over_smaller_box"), (c("l_linestatus") == "F").alias("both_interior"),
    )


MANIFEST_SQL = """m as (select l_suppkey as scene, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as pair_id, l_linenumber::bigint as pair_index, case l_returnflag when 'R' then 'A' when 'N' then 'B' else 'C' end as fold,
  case when l_linenumber < 4 then 'short' when l_linenumber < 7 then 'medium' else 'far' end as stratum, l_quantity / 10 as gt, (l_partkey % 7)::varchar as a, (l_orderkey % 7)::varchar as b, 1 - l_tax as vis, l_discount / 10 as af, l_quantity as side,
  case when l_quantity > 3 then l_quantity end as margin, l_discount * 6 as iou, l_discount * 10 as ios, l_linestatus = 'F' as interior from lineitem)"""


@query(f"""with {MANIFEST_SQL}, o as (select *, row_number() over (partition by scene order by pair_index, pair_id) as place, case when pair_index % 2 = 1 then 'A' else 'B' end as efold, lag(gt) over (partition by scene order by pair_index, pair_id) as before from m),
u as (select scene, unnest([case when pair_index <> place then 'index_gap' end, case when gt + 1e-12 < 0.25 then 'minimum_distance' end, case when fold = 'C' then 'invalid_fold' end, case when fold <> 'C' and fold <> efold then 'wrong_fold' end, case when stratum = 'far' then 'invalid_stratum' end,
  case when stratum <> 'far' and pair_index between 1 and 12 and stratum <> case least(floor((pair_index - 1) / 4), 2) when 0 then 'short' when 1 then 'medium' else 'long' end then 'wrong_stratum' end, case when a = b then 'identical_objects' end, case when before > gt then 'decreasing_distance' end, case when not interior then 'not_interior' end,
  case when vis + 1e-12 < 1 then 'minimum_visible_fraction' end, case when af + 1e-12 < 0.00375 then 'minimum_box_area_fraction' end, case when side + 1e-12 < 30 then 'minimum_box_side_px' end, case when margin is null then 'missing_minimum_border_margin_px' end, case when margin + 1e-12 < 20 then 'minimum_border_margin_px' end,
  case when iou - 1e-12 > 0.5 then 'box_iou' end, case when ios - 1e-12 > 0.8 then 'intersection_over_smaller_box' end]) as rule from o)
select scene, rule, count(*) as n from u where rule is not null group by 1, 2""")
def manifest_pair_violations(spark, d):
    return validate.pair_violations(_manifest(spark, d)).groupBy("scene", "rule").agg(F.count("*").alias("n"))


@query(f"""with {MANIFEST_SQL}, s as (select scene, count(*) as n, max(gt) / min(gt) as ratio, count_if(stratum = 'short') as short, count_if(stratum = 'medium') as medium, count_if(stratum = 'long') as long_, count_if(fold = 'A') as fa, count_if(fold = 'B') as fb,
  count_if(stratum = 'short' and fold = 'A') as sa, count_if(stratum = 'short' and fold = 'B') as sb, count_if(stratum = 'medium' and fold = 'A') as ma, count_if(stratum = 'medium' and fold = 'B') as mb from m group by 1),
us as (select scene, count(*) as objects, max(uses) as uses from (select scene, o, count(*) as uses from (select scene, unnest([a, b]) as o from m) group by 1, 2) group by 1),
v as (select scene, unnest([case when n <> 12 then 'pair_count' end, case when ratio + 1e-12 < 2.5 then 'distance_ratio' end, case when short <> 4 then 'count_short' end, case when medium <> 4 then 'count_medium' end, case when long_ <> 4 then 'count_long' end, case when fa <> 6 then 'count_A' end, case when fb <> 6 then 'count_B' end,
  case when sa <> 2 then 'count_short_A' end, case when sb <> 2 then 'count_short_B' end, case when ma <> 2 then 'count_medium_A' end, case when mb <> 2 then 'count_medium_B' end, 'count_long_A', 'count_long_B', case when objects < 6 then 'unique_objects' end, case when uses > 5 then 'object_uses' end]) as rule from s join us using (scene))
select scene, rule from v where rule is not null""")
def manifest_scene_violations(spark, d):
    return validate.scene_violations(_manifest(spark, d)).select("scene", "rule")


@query(f"""with {MANIFEST_SQL}, i as (select scene, pair_id, count(*) as n from m group by 1, 2 having count(*) > 1), p as (select scene, least(a, b) as a, greatest(a, b) as b from m group by 1, 2, 3 having count(*) > 1)
select scene, pair_id, 'duplicate_pair_id' as rule, n::varchar as observed from i union all select scene, null, 'duplicate_object_pair', count(*)::varchar from p group by 1""")
def manifest_duplicates(spark, d):
    return validate.duplicate_violations(_manifest(spark, d)).select("scene", "pair_id", "rule", "observed")


@query("""with q as (select event_id::varchar as pair_id, user_id::varchar as scene_id, case when event_id % 7 = 0 then 'C' else 'A' end as fold, case when event_id % 5 <> 0 then event_type end as stimulus, value - 5 as gt, case when event_id % 11 = 0 then '  ' else 'p' end as prompt from events)
select scene, rule, count(*) as n from (select scene_id as scene, unnest([case when fold = 'C' then 'invalid_fold' end, case when stimulus is null then 'missing_stimulus' end, case when prompt = '  ' then 'missing_prompt' end, case when gt <= 0 then 'invalid_ground_truth' end]) as rule from q) where rule is not null group by 1, 2""")
def query_manifest_violations(spark, d):
    c = F.col
    rows = B.table(spark, d, "events").select(c("event_id").cast("string").alias("pair_id"), c("user_id").cast("string").alias("scene_id"), F.when(c("event_id") % 7 == 0, "C").otherwise("A").alias("fold"), F.when(c("event_id") % 5 != 0, c("event_type")).alias("stimulus"), (c("value") - 5).alias("ground_truth_m"), F.when(c("event_id") % 11 == 0, "  ").otherwise("p").alias("prompt"))
    return validate.query_manifest_violations(rows).groupBy("scene", "rule").agg(F.count("*").alias("n"))


@query("select user_id as capture_id, event_id, (event_id % 40)::bigint as pair_index, row_number() over (partition by user_id order by event_id % 40, event_id)::bigint as place from events qualify event_id % 40 <> place")
def contiguity_check(spark, d):
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("capture_id"), "event_id", (F.col("event_id") % 40).alias("pair_index"))
    found = validate.not_contiguous(rows, "pair_index", ("capture_id",), ("event_id",)).withColumnRenamed("expected_index", "place")
    return shown(found, "capture_id", "event_id", "pair_index", "place")


@query("select o_orderkey, o_orderkey + (o_orderkey % 40 = 0)::int as pair_index, row_number() over (order by o_orderkey + (o_orderkey % 40 = 0)::int, o_orderkey)::bigint as place from orders qualify o_orderkey + (o_orderkey % 40 = 0)::int <> place")
def contiguity_of_a_whole_table(spark, d):
    rows = B.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") + (F.col("o_orderkey") % 40 == 0).cast("int")).alias("pair_index"))
    return shown(validate.not_contiguous(rows, "pair_index", ties=("o_orderkey",)).withColumnRenamed("expected_index", "place"), "o_orderkey", "pair_index", "place")


@query("""with m as (select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then l_quantity end as n, case when l_linenumber % 2 = 0 then l_tax end as t from lineitem)
select l_orderkey, l_linenumber::bigint as l_linenumber, coalesce(n, t) as value from m""")
def metric_under_several_names(spark, d):
    c = F.col
    rows = B.table(spark, d, "lineitem").select("l_orderkey", c("l_linenumber").cast("long").alias("l_linenumber"), F.struct(F.when(c("l_linenumber") % 3 == 0, c("l_quantity")).alias("side_px"), c("l_discount").alias("other")).alias("pair_quality"), F.when(c("l_linenumber") % 2 == 0, c("l_tax")).alias("minimum_side"))
    return rows.select("l_orderkey", "l_linenumber", validate.metric(rows, "minimum_side", "side_px").alias("value"))


@query("""with c as (select count(distinct l_suppkey) as scenes, count(*) as pairs from lineitem)
select 'manifest_sha256' as rule, 'abc' as observed, 'abd' as expected union all select 'selected_scenes', scenes::varchar, '-1' from c union all select 'number_of_pairs', pairs::varchar, '7' from c""")
def protocol_consistency(spark, d):
    rows = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("scene"))
    return validate.protocol_violations(rows, {"manifest_sha256": "abd", "output_sha256": "abc", "selected_scenes": -1, "number_of_pairs": 7, "selected_pairs": "many"}, "abc")


@query("select event_id as key, 'props' as field from events where event_id % 13 = 0 union all select event_id, 'absent' from events")
def required_fields(spark, d):
    rows = B.table(spark, d, "events").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 13 != 0, F.col("props")).alias("props"))
    return validate.missing_required(rows, ["props", "absent"], "key")


@query("""with t as (select event_id, case event_id % 6 when 0 then value::varchar when 1 then 'x' when 2 then '7' when 3 then '7.5' when 4 then 'NaN' else '-3' end as s from events)
select event_id, case when event_id % 6 not in (1, 4) then try_cast(s as double) end as as_double, case when try_cast(s as double) = floor(try_cast(s as double)) and event_id % 6 not in (1, 4) then try_cast(s as double)::bigint end as as_long from t""")
def numeric_casts_audit(spark, d):
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "x").when(k == 2, "7").when(k == 3, "7.5").when(k == 4, "NaN").otherwise("-3")
    return B.table(spark, d, "events").select("event_id", P.strict_double(text).alias("as_double"), P.strict_long(text).alias("as_long"))


# ------------------------------------------------------------ comparison and sets


def _runs(spark, d):
    a = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderkey").alias("run_index"), F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("raw"), F.col("o_totalprice").alias("predicted"))
    k = F.col("pair_id")
    b = a.filter(k % 101 != 0).select(F.when(k % 97 == 0, k + 1_000_000).otherwise(k).alias("pair_id"), "run_index", F.when(k % 31 == 0, F.col("source") + 1).otherwise(F.col("source")).alias("source"), F.when(k % 37 == 0, "Z").otherwise(F.col("model")).alias("model"), F.when(k % 41 == 0, "other").otherwise(F.col("raw")).alias("raw"), F.when(k % 43 == 0, F.col("predicted") + 0.5).when(k % 47 == 0, F.lit(None)).otherwise(F.col("predicted")).alias("predicted"))
    return a, b


RUNS_SQL = """x as (select o_orderkey as pair_id, o_orderkey as run_index, o_custkey as source, o_orderstatus as model, o_orderpriority as raw, o_totalprice as predicted from orders),
y as (select case when pair_id % 97 = 0 then pair_id + 1000000 else pair_id end as pair_id, run_index, case when pair_id % 31 = 0 then source + 1 else source end as source, case when pair_id % 37 = 0 then 'Z' else model end as model, case when pair_id % 41 = 0 then 'other' else raw end as raw,
  case when pair_id % 43 = 0 then predicted + 0.5 when pair_id % 47 = 0 then null else predicted end as predicted from x where pair_id % 101 <> 0)"""
FIELDS = dict(inputs=("source",), stable=("model",), texts=("raw",), numbers=("predicted",), tolerance=0.001)
_CHECKS = "case when x.source is distinct from y.source then 'input' end, case when x.model is distinct from y.model then 'stable_runtime' end, case when x.raw is distinct from y.raw then 'raw_response' end, case when (x.predicted is null) <> (y.predicted is null) or abs(x.predicted - y.predicted) > 0.001 then 'numeric_output' end"
BY_KEY_SQL = f"with {RUNS_SQL}, c as (select coalesce(x.pair_id, y.pair_id) as pair_id, x.predicted as p, y.predicted as q, unnest(case when y.pair_id is null then ['missing'] when x.pair_id is null then ['extra'] else [{_CHECKS}] end) as category from x full outer join y on x.pair_id = y.pair_id)"


@query(BY_KEY_SQL + " select pair_id, category from c where category is not null")
def run_diff_by_key(spark, d):
    return compare.diff_by_key(*_runs(spark, d), ["pair_id"], **FIELDS).select("pair_id", "category")


@query(f"with {RUNS_SQL}, c as (select x.run_index, unnest(case when x.pair_id <> y.pair_id then ['order'] else [{_CHECKS}] end) as category from x join y on x.run_index = y.run_index) select run_index, category from c where category is not null")
def run_diff_positional(spark, d):
    return compare.diff_positional(*_runs(spark, d), "pair_id", **FIELDS).select("run_index", "category")


@query(BY_KEY_SQL + " select category, count(*) as n, coalesce(round(max(case when category = 'numeric_output' then abs(p - q) end), 6), -1) as largest from c where category is not null group by 1")
def run_diff_counts(spark, d):
    return shown(compare.difference_counts(compare.diff_by_key(*_runs(spark, d), ["pair_id"], **FIELDS)), "category", "n", "largest")


@query(f"""with {RUNS_SQL}, c as (select unnest(case when x.pair_id <> y.pair_id then ['order'] else [{_CHECKS}] end) as category from x join y on x.run_index = y.run_index)
select category, count(*) as n from c where category is not null group by 1 union all select 'row_count', 1 where (select count(*) from x) <> (select count(*) from y)""")
def run_difference_counters(spark, d):
    return shown(compare.difference_counts(compare.diff_runs(*_runs(spark, d), "pair_id", **FIELDS)), "category", "n")


@query(f"""with {RUNS_SQL} select coalesce(x.run_index, y.run_index) as run_index, case when y.run_index is null then 'missing' else 'differs' end as rule, x.pair_id::varchar as expected, y.pair_id::varchar as found from x full outer join y on x.run_index = y.run_index where x.pair_id is distinct from y.pair_id""")
def reference_order_differences(spark, d):
    return compare.order_differences(*_runs(spark, d))


@query("with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey + 3 as k from orders) select k, 'missing' as side from a where k not in (select k from b) union all select k, 'extra' from b where k not in (select k from a)")
def key_set_missing_extra(spark, d):
    a, b = B.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), B.table(spark, d, "orders").select((F.col("o_custkey") + 3).alias("k"))
    return compare.key_differences(a, b, ["k"])


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    return shown(compare.duplicate_keys(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "l_orderkey", "l_linenumber", "n")


@query("select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, count(*) as n from lineitem group by 1, 2")
def unordered_pair_dedupe(spark, d):
    both = B.table(spark, d, "lineitem").groupBy(unordered_pair(F.col("l_partkey"), F.col("l_suppkey")).alias("p")).agg(F.count("*").alias("n"))
    return both.select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"), "n")


@query("with u as (select 0::bigint as input, c_custkey as k from customer where c_custkey % 2 = 0 union all select 1, c_custkey from customer where c_custkey % 3 = 0) select k, count(*) as n from u group by 1 having count(*) > 1")
def combined_duplicates(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return compare.duplicate_keys(compare.combine([c.filter("k % 2 = 0"), c.filter("k % 3 = 0")]), ["k"])


@query("with a as (select o_orderkey as i, o_custkey as v from orders), b as (select o_orderkey as i, case when o_orderkey % 50 = 0 then -1 else o_custkey end as v from orders where o_orderkey < 1000) select a.i as position from a left join b using (i) where b.i is null or a.v <> b.v")
def prefix_mismatches(spark, d):
    a = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("v"))
    b = a.filter("position < 1000").withColumn("v", F.when(F.col("position") % 50 == 0, -1).otherwise(F.col("v")))
    return compare.is_prefix(a, b, "position", ["v"])


@query(f"""with {B.FRAMES_SQL}, g as (select capture_id, event_id, oracle, "natural" as nat from f where event_id % 89 <> 0), h as (select capture_id, event_id, case when event_id % 53 = 0 then -1 else oracle end as oracle, case when event_id % 59 = 0 then null else "natural" end as nat from f where event_id % 83 <> 0),
c as (select coalesce(g.event_id, h.event_id) as event_id, unnest(case when h.event_id is null then ['unexpected'] when g.event_id is null then ['missing'] else [case when g.oracle is distinct from h.oracle then 'oracle' end, case when g.nat is distinct from h.nat then 'natural' end] end) as difference from g full outer join h on g.event_id = h.event_id)
select event_id, difference from c where difference is not null""")
def audit_mismatches(spark, d):
    rows = B.frames(spark, d).select("event_id", "oracle", "natural")
    k = F.col("event_id")
    other = rows.filter(k % 83 != 0).select("event_id", F.when(k % 53 == 0, -1).otherwise(F.col("oracle")).alias("oracle"), F.when(k % 59 != 0, F.col("natural")).alias("natural"))
    return audit.audit_mismatches(rows.filter(k % 89 != 0), other, ["oracle", "natural"], ("event_id",)).select("event_id", "difference")


@query(f"""with {B.FRAMES_SQL}, m as (select event_id from f where event_id % 53 = 0) select event_id, 'oracle' as difference, (select count(*) from m) as n_total from m order by event_id limit 10""")
def capped_mismatches(spark, d):
    rows = B.frames(spark, d).select("event_id", "oracle")
    other = rows.withColumn("oracle", F.when(F.col("event_id") % 53 == 0, -1).otherwise(F.col("oracle")))
    return audit.capped(audit.audit_mismatches(rows, other, ["oracle"], ("event_id",)), ["event_id"])


@query(f"with {B.INSTANCES_SQL}, c as (select capture_id, frame_index, count(*) as n from p group by 1, 2) select capture_id, frame_index, 'number_of_all_natural_pairs' as field, n + 1 as stored, n as recomputed from c where n % 4 = 0")
def stored_counts_that_differ(spark, d):
    now = pairs.threshold_counts(_pairs(spark, d)).select("capture_id", "frame_index", "number_of_all_natural_pairs", "number_of_eligible_pairs")
    n = F.col("number_of_all_natural_pairs")
    return pairs.count_conflicts(now.withColumn("number_of_all_natural_pairs", n + (n % 4 == 0).cast("int")), now, ["number_of_all_natural_pairs", "number_of_eligible_pairs"])


@query("""with a as (select o_orderkey as i, o_custkey as k from orders), b as (select o_orderkey as i, case when o_orderkey % 50 = 0 then -1 else o_custkey end as k from orders where o_orderkey < 1000 union all select 100000000, 1)
select b.i as run_index, case when a.i is null then 'longer' else 'order' end as rule, 'pair_id' as field from b left join a using (i) where a.i is null or a.k <> b.k union all select null, 'metadata', 'max_tokens'""")
def resume_conflicts(spark, d):
    selected = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_index"), F.col("o_custkey").alias("pair_id"))
    earlier = selected.filter("run_index < 1000").withColumn("pair_id", F.when(F.col("run_index") % 50 == 0, -1).otherwise(F.col("pair_id"))).union(spark.createDataFrame([(100_000_000, 1)], "run_index long, pair_id long"))
    metadata = "model_id string, temperature double, max_tokens int, note string"
    return compare.resume_violations(selected, earlier, spark.createDataFrame([("m", 0.0, 64, "a")], metadata), spark.createDataFrame([("m", 0.0, 32, "b")], metadata))


# ------------------------------------------------------------ order, ledger, text


@query(f"select c_custkey, sha256('{SALT}:' || c_custkey) as order_key_sha256, row_number() over (order by sha256('{SALT}:' || c_custkey), c_custkey) as order_index from customer")
def salted_hash_order(spark, d):
    return shown(ordering.salted_order(B.table(spark, d, "customer").select("c_custkey"), "c_custkey", SALT), "c_custkey", "order_key_sha256", "order_index")


@query(f"with {B.LEDGER_SQL}, x as (select *, sum((yes and qc = 'pass')::int) over (order by order_index) as run from l) select order_index, capture_id from x where order_index <= coalesce((select min(order_index) from x where run = 49), 1000000000)")
def stop_rule_prefix(spark, d):
    log = ledger.with_status(B.ledger(spark, d))
    return ordering.until_target(log, "order_index", "capture_accepted", 49).select("order_index", "capture_id")


@query(f"""with {B.LEDGER_SQL}, k as (select *, yes and qc = 'pass' as ok from l)
select count(*) as inspected, count_if(ok)::bigint as accepted, count_if(yes)::bigint as accepted_numerical, count_if(not yes)::bigint as rejected_numerical, count_if(yes and qc <> 'pass')::bigint as rejected_visual, sum(pairs) filter (ok)::bigint as selected_relations,
  round(min(order_index / 7) filter (ok), 6) as global_selected_minimum_m, round(max(order_index / 3) filter (ok), 6) as global_selected_maximum_m, round(count_if(ok) / count(*), 6) as acceptance_rate, round(count_if(ok) / count_if(yes), 6) as visual_pass_rate, 50 - count_if(ok)::bigint as target_shortfall from k""")
def ledger_rollup(spark, d):
    rows = B.ledger(spark, d).withColumns({"selected_minimum_m": F.col("order_index") / 7, "selected_maximum_m": F.col("order_index") / 3})
    return shown(ledger.rollup(rows, target=50), "inspected", "accepted", "accepted_numerical", "rejected_numerical", "rejected_visual", "selected_relations", "global_selected_minimum_m", "global_selected_maximum_m", "acceptance_rate", "visual_pass_rate", "target_shortfall")


@query(f"""with {B.LEDGER_SQL}, c as (select count(*) as inspected, count_if(yes and qc = 'pass')::bigint as accepted from l) select 'inspected' as name, inspected as observed, 102::bigint as expected from c where inspected <> 102 union all select 'accepted', accepted, 49 from c where accepted <> 49""")
def final_expectations(spark, d):
    return shown(ledger.expectation_violations(ledger.rollup(B.ledger(spark, d)), {"inspected": 102, "accepted": 49}), "name", "observed", "expected")


@query("""with r as (select o_custkey as capture_id from orders), x as (select c_custkey as capture_id from customer where c_custkey % 10 = 0)
select (select count(*) from r) as records, (select count(distinct capture_id) from r) as unique_records, (select count(*) from x) as exclusions, (select count(*) from x where capture_id not in (select capture_id from r)) as unknown_exclusions, (select count(distinct capture_id) from r where capture_id not in (select capture_id from x)) as pool""")
def order_preparation_counts(spark, d):
    records, excluded = B.table(spark, d, "orders").select(F.col("o_custkey").alias("capture_id")), B.table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("capture_id"))
    return shown(ledger.order_counts(records, excluded), "records", "unique_records", "exclusions", "unknown_exclusions", "pool")


def _batch(spark, d):
    log = B.ledger(spark, d).select("order_index", "capture_id", "visual_qc")
    n = F.col("order_index")
    official = log.filter(n <= 120).withColumn("visual_qc", F.when(n == 110, "changed").when(n == 40, "changed").otherwise(F.col("visual_qc")))
    return ledger.batch_commit(official, log.filter(n <= 100), log.filter(n.between(101, 130) & (n != 115)), ["capture_id", "visual_qc"])


@query(f"""with {B.LEDGER_SQL}, o as (select order_index, capture_id, case when order_index in (110, 40) then 'changed' else qc end as qc from l where order_index <= 120), s as (select * from l where order_index <= 100), n as (select * from l where order_index between 101 and 130 and order_index <> 115)
select order_index, rule from (select coalesce(o.order_index, s.order_index) as order_index, case when s.order_index is not null then case when (o.capture_id, o.qc) is distinct from (s.capture_id, s.qc) then 'prefix' end when n.order_index is null then 'outside' when (o.capture_id, o.qc) is distinct from (n.capture_id, n.qc) then 'differs' end as rule
  from o full outer join s using (order_index) left join n on n.order_index = coalesce(o.order_index, s.order_index)) where rule is not null""")
def batch_commit_violations(spark, d):
    return _batch(spark, d)[0]


@query(f"with {B.LEDGER_SQL} select order_index, capture_id from l where order_index between 121 and 130")
def batch_rows_to_record(spark, d):
    return _batch(spark, d)[1].select("order_index", "capture_id")


@query(f"""with {B.LEDGER_SQL}, p as (select capture_id, yes from l where order_index % 5 <> 0), v as (select capture_id, case when order_index % 11 = 0 then 'pass' else qc end as qc from l where order_index % 7 <> 0)
select capture_id, rule from (select coalesce(p.capture_id, v.capture_id) as capture_id, case when v.capture_id is null then 'missing' when p.capture_id is null then 'not_pending' when not case when yes then qc in ('pass', 'fail') else qc = 'not_applicable' end then 'verdict_does_not_fit' end as rule from p full outer join v using (capture_id)) where rule is not null""")
def visual_decisions(spark, d):
    rows, n = B.ledger(spark, d), F.col("order_index")
    decisions = rows.filter(n % 7 != 0).select("capture_id", F.when(n % 11 == 0, "pass").otherwise(F.col("visual_qc")).alias("visual_qc"))
    return ledger.visual_decisions(decisions, rows.filter(n % 5 != 0).select("capture_id", "selection_accepted"))


@query("""with f as (select doc_id, sha256(text) as h, octet_length(encode(text))::bigint as n from documents), a as (select 'doc/' || doc_id as path, case when doc_id % 9 = 0 then 'other' else h end as h, case when doc_id % 8 = 0 then n + 1 else n end as n from f), g as (select 'doc/' || doc_id as path, h, n from f where doc_id % 7 <> 0)
select path, rule from (select a.path, case when g.path is null then 'missing' when a.n <> g.n then 'size' when a.h <> g.h then 'sha256' end as rule from a left join g using (path)) where rule is not null""")
def artifact_violations(spark, d):
    k = F.col("doc_id")
    rows = document_hash_manifest(spark, d).withColumn("path", F.concat(F.lit("doc/"), k.cast("string")))
    recorded = rows.select("path", F.when(k % 9 == 0, "other").otherwise(F.col("sha256")).alias("sha256"), F.when(k % 8 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"))
    return ledger.artifact_violations(recorded, rows.filter(k % 7 != 0).select("path", "sha256", "size_bytes"))


@query(f"with {B.LEDGER_SQL} select order_index, sum(coalesce(stored, yes and qc = 'pass')::bigint) over (partition by order_index % 3 order by order_index)::bigint as accepted_so_far from l")
def accepted_so_far(spark, d):
    log = ledger.with_status(B.ledger(spark, d)).withColumn("part", F.col("order_index") % 3)
    return ordering.running_accepted(log, "part", "order_index", "capture_accepted").select("order_index", "accepted_so_far")


def seeded_order(spark, d):
    """Python's generator has no SQL form; the tests compare it with the generator itself."""
    return ordering.seeded_shuffle(B.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 20240229)


QUERIES["seeded_order"] = seeded_order


@query(f"with {B.LEDGER_SQL} select order_index, coalesce(stored, yes and qc = 'pass') as capture_accepted, case when yes and qc = 'pass' then 'accepted' when yes then 'rejected_visual' else 'rejected_numerical' end as capture_decision from l")
def ledger_status(spark, d):
    return ledger.with_status(B.ledger(spark, d)).select("order_index", "capture_accepted", "capture_decision")


@query(f"with {B.LEDGER_SQL} select case when yes and qc <> 'pass' then 'visual_qc_failure' else coalesce(reason, 'unspecified_numerical_rejection') end as reason, count(*) as n from l where not coalesce(stored, yes and qc = 'pass') group by 1")
def rejection_reason_counts(spark, d):
    rows = ledger.with_status(B.ledger(spark, d))
    return ledger.rejection_counts(rows.select(F.col("capture_accepted").alias("accepted"), "capture_decision", F.array_compact(F.array("reason")).alias("rejection_reasons")))


@query(f"""with {B.LEDGER_SQL}, v as (select capture_id, unnest([case when yes and pairs <> 12 then 'accepted_pair_count' end, case when not yes and qc <> 'not_applicable' then 'rejected_with_check' end, case when yes and order_index % 7 = 0 then 'missing_artifacts' end]) as rule from l) select capture_id, rule from v where rule is not null""")
def ledger_evidence(spark, d):
    all_four = F.array(*map(F.lit, ("validation_report", "rendered_manifest", "render_protocol", "contact_sheet")))
    rows = B.ledger(spark, d).withColumns({"artifact_names": F.when(F.col("order_index") % 7 != 0, all_four), "validation_passed": F.lit(True)})
    return ledger.evidence_violations(rows)


@query("with o as (select c_custkey as order_index, 'cap' || c_custkey as capture_id from customer), l as (select order_index, case when order_index % 60 = 0 then 'other' else capture_id end as capture_id from o where order_index < 100 and order_index <> 50) select order_index, case when l.order_index is null then 'gap' else 'wrong_capture' end as rule from o full outer join l using (order_index) where order_index < 100 and (l.order_index is null or l.capture_id <> o.capture_id)")
def ledger_order(spark, d):
    order = B.ledger(spark, d).select("order_index", "capture_id")
    log = order.filter("order_index < 100 and order_index <> 50").withColumn("capture_id", F.when(F.col("order_index") % 60 == 0, "other").otherwise(F.col("capture_id")))
    return ledger.order_violations(log, order)


@query(f"with {B.RESPONSES_SQL} select event_id, predicted as predicted_distance_m from a")
def parse_responses(spark, d):
    return B.responses(spark, d).select("event_id", R.parse_distance(F.col("raw")).alias("predicted_distance_m"))


@query(f"with {B.RESPONSES_SQL} select event_id, round(abs(predicted - truth), 6) as absolute_error_m, round(abs(predicted - truth) / truth, 6) as relative_error, round(predicted / truth, 6) as prediction_to_gt_ratio, round(ln(predicted / truth), 6) as log_error from a")
def response_errors(spark, d):
    rows = B.responses(spark, d).withColumn("p", R.parse_distance(F.col("raw")))
    p, t = F.col("p"), F.col("truth")
    return rows.select("event_id", F.round(R.absolute_error(p, t), 6).alias("absolute_error_m"), F.round(R.relative_error(p, t), 6).alias("relative_error"), F.round(R.ratio(p, t), 6).alias("prediction_to_gt_ratio"), F.round(R.log_error(p, t), 6).alias("log_error"))


@query("select doc_id, sha256(text) as sha256, octet_length(encode(text))::bigint as size_bytes from documents")
def document_hash_manifest(spark, d):
    return B.table(spark, d, "documents").select("doc_id", sha256_text(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("select p_partkey, printf('%s-P%02d', p_brand, p_partkey % 100) as pair_id, case when p_partkey % 3 > 0 then p_partkey::varchar end as capture_id from part")
def identifiers(spark, d):
    name = F.concat(F.lit("set-"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")).otherwise("x"), F.lit(".tar"))
    return B.table(spark, d, "part").select("p_partkey", pair_id(F.col("p_brand"), F.col("p_partkey") % 100).alias("pair_id"), archive_capture_id(name).alias("capture_id"))


@query("""with p as (select p_partkey, case p_partkey % 4 when 0 then '/data/project/sets/' || p_partkey || '.tar' when 1 then '/data/projects/' || p_partkey when 2 then '/other/' || p_partkey else '/data/project' end as path from part)
select p_partkey, case when path = '/data/project' then '.' when starts_with(path, '/data/project/') then substr(path, 15) else path end as shown from p""")
def displayed_paths(spark, d):
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/data/project/sets/"), k, F.lit(".tar"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("/data/projects/"), k)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("/other/"), k)).otherwise("/data/project")
    return B.table(spark, d, "part").select("p_partkey", display_path(path, "/data/project").alias("shown"))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, printf('%.6g', l_quantity / 7) as shown, printf('%.6g', l_discount) as discount from lineitem")
def six_digit_keys(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), six_digits(F.col("l_quantity") / 7).alias("shown"), six_digits(F.col("l_discount")).alias("discount"))


# ------------------------------------------------------------ files and values as written


@query("""with s as (select o_orderkey as k, 'P' || o_orderkey as pair_id, 'stimuli/' || o_orderkey || '.png' as stimulus, sha256(o_orderstatus || '|' || o_orderpriority || '|' || o_orderkey) as h from orders),
m as (select * from s where k % 13 <> 5), r as (select pair_id, case when k % 11 = 0 then '' when k % 17 = 0 then 'other' else h end as expected from s where k % 19 <> 3), f as (select stimulus, h as found from s where k % 7 <> 0)
select pair_id, rule from (select coalesce(m.pair_id, r.pair_id) as pair_id, case when m.pair_id is null then 'not_in_manifest' when r.pair_id is null then 'not_in_reference' when expected = '' then 'without_hash' when found is null then 'missing' when found <> expected then 'differs' end as rule
  from m full outer join r on m.pair_id = r.pair_id left join f on f.stimulus = m.stimulus) where rule is not null""")
def stimulus_hash_violations(spark, d):
    k = F.col("o_orderkey")
    content = F.concat_ws("|", "o_orderstatus", "o_orderpriority", k.cast("string"))
    rows = B.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("P"), k.cast("string")).alias("pair_id"), F.concat(F.lit("stimuli/"), k.cast("string"), F.lit(".png")).alias("stimulus"), sha256_text(content).alias("sha256"))
    reference = rows.filter(k % 19 != 3).select("pair_id", F.when(k % 11 == 0, "").when(k % 17 == 0, "other").otherwise(F.col("sha256")).alias("stimulus_sha256"))
    return ledger.stimulus_violations(rows.filter(k % 13 != 5), reference, rows.filter(k % 7 != 0).select(F.col("stimulus").alias("path"), "sha256"))


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _customer_lines(spark, d) -> str:
    folder = _folder(spark, "customer-lines")
    n = F.col("c_nationkey").cast("string")
    rows = B.table(spark, d, "customer").select(F.concat(F.lit("nation-"), n, F.lit(".txt")).alias("file"), "c_custkey", F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("line"))
    files.write_lines(rows, folder, "file", ["c_custkey"])
    return folder


@query("with l as (select 'nation-' || c_nationkey || '.txt' as name, c_custkey, c_custkey || '|' || c_name || '|' || c_mktsegment as line from customer) select name, sum(octet_length(encode(line)) + 1)::bigint as size_bytes, sha256(string_agg(line || chr(10), '' order by c_custkey)) as sha256 from l group by 1")
def file_digests(spark, d):
    """Files on shared storage, one for each nation, hashed chunk by chunk."""
    found = files.file_hashes(files.file_sizes(spark, _customer_lines(spark, d)))
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "size_bytes", "sha256")


@query("with l as (select 'nation-' || c_nationkey || '.txt' as name, c_nationkey, c_custkey, c_custkey || '|' || c_name || '|' || c_mktsegment as line from customer) select name, row_number() over (partition by c_nationkey order by c_custkey) as line_number, line from l")
def numbered_file_lines(spark, d):
    """Lines of the same files, numbered by ranges of 1,000 bytes."""
    found = files.numbered_lines(spark, _customer_lines(spark, d), split=1000)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "line_number", "line")


@query("""with m as (select 'set-' || c_nationkey || '.tar' as archive, c_custkey || '/instances.json' as member, '{"name": "' || c_name || '"}' as content from customer) select archive, member, octet_length(encode(content))::bigint as size_bytes, sha256(content) as sha256 from m""")
def archive_member_digests(spark, d):
    """Archives with two members a customer; the wanted ones are read by their offsets, in parts of 4,000 bytes."""
    folder, k = _folder(spark, "customer-archives"), F.col("c_custkey").cast("string")
    rows = B.table(spark, d, "customer").select(F.concat(F.lit("set-"), F.col("c_nationkey").cast("string"), F.lit(".tar")).alias("archive"), k.alias("k"), "c_name", "c_mktsegment")
    document = F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('"}'))
    members = F.array(F.struct(F.concat("k", F.lit("/instances.json")).alias("member"), document.cast("binary").alias("content")), F.struct(F.concat("k", F.lit("/other.bin")).alias("member"), F.repeat("c_mktsegment", F.lit(9)).cast("binary").alias("content")))
    files.write_archives(rows.select("archive", F.inline(members)), folder)
    found = files.archive_members(spark, folder, ("/instances.json",), split=4000)
    return found.select(F.regexp_extract("archive", "([^/]+)$", 1).alias("archive"), "member", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def _written_values(spark, d):
    """Distances written in seven ways, by event id."""
    v = F.col("value").cast("string")
    ways = {0: F.concat(F.lit('{"distance_m": '), v, F.lit("}")), 1: F.lit('{"distance_m": true}'), 2: F.lit('{"distance_m": null}'), 3: F.lit('{"other": 1}'), 4: F.concat(F.lit('{"distance_m": "'), v, F.lit('"}')), 5: F.concat(F.lit('{"distance_m": '), F.col("event_id").cast("string"), F.lit("}")), 6: F.lit('["distance_m", 1]')}
    return B.table(spark, d, "events").select("event_id", "event_type", F.coalesce(*(F.when(F.col("event_id") % 7 == k, t) for k, t in ways.items())).alias("line"))


@query("""with w as (select event_id, event_type, case event_id % 7 when 0 then '{"distance_m": ' || value || '}' when 1 then '{"distance_m": true}' when 2 then '{"distance_m": null}' when 3 then '{"other": 1}' when 4 then '{"distance_m": "' || value || '"}' when 5 then '{"distance_m": ' || event_id || '}' else '["distance_m", 1]' end as line from events),
k as (select *, json_type(line) = 'OBJECT' as is_object, json_type(line, '$.distance_m') as t, line ->> '$.distance_m' as x from w),
n as (select *, case when t is null then 'missing' when t = 'NULL' then 'null' when t = 'BOOLEAN' then 'boolean' when t = 'VARCHAR' then 'string' else 'number' end as kind from k)
select event_type, kind, is_object, count(*) as n, count_if(kind = 'number')::bigint as strict, count_if(kind in ('number', 'boolean'))::bigint as loose, count_if(kind in ('number', 'boolean', 'string'))::bigint as floats, count_if(kind = 'number' and try_cast(x as double) = floor(try_cast(x as double)))::bigint + count_if(kind = 'string' and regexp_full_match(x, '[+-]?[0-9]+'))::bigint as ints,
  round(sum(case when kind = 'boolean' then 1 when kind in ('number', 'string') then try_cast(x as double) end), 4) as total, sum(length(line))::bigint as characters from n group by 1, 2, 3""")
def written_value_kinds(spark, d):
    """What typed schemas lose: booleans against numbers, nulls against missing fields; the lines pass unchanged."""
    rows = variants.with_variant(_written_values(spark, d))
    v = F.col("value")
    told = rows.select("event_type", "line", variants.kind(v, "distance_m").alias("kind"), variants.is_object(v).alias("is_object"), variants.finite_number(v, "distance_m").alias("strict"), variants.finite_number(v, "distance_m", booleans=True).alias("loose"), variants.finite_float(v, "distance_m").alias("float"), variants.finite_int(v, "distance_m").alias("int"))
    return told.groupBy("event_type", "kind", "is_object").agg(F.count("*").alias("n"), F.count("strict").alias("strict"), F.count("loose").alias("loose"), F.count("float").alias("floats"), F.count("int").alias("ints"), F.round(F.sum("float"), 4).alias("total"), F.sum(F.length("line")).alias("characters"))


# ------------------------------------------------------------ logs


@query(f"""with {B.LEDGER_SQL}, c as (select 'part ' || order_index % 4 as ledger, order_index // 4 + 1 as k, capture_id, yes, order_index from l where order_index % 29 <> 12 or order_index < 100),
f as (select ledger, min(k) as stop from (select ledger, k, sum(yes::int) over (partition by ledger order by k) as s from c) where s >= 200 group by 1),
g as (select ledger, min(k) as gap from (select ledger, k, row_number() over (partition by ledger order by k) as r from c) where k <> r group by 1)
select c.ledger, c.k as order_index, capture_id, sum(yes::int) over (partition by c.ledger order by c.k)::bigint as accepted_so_far from c left join f using (ledger) left join g using (ledger) where k <= coalesce(stop, k) and k < coalesce(gap, k + 1)""")
def ledger_stream(spark, d):
    """Four ledgers as a stream of two files, the later rows first; what is recorded before the first gap, up to 200 acceptances."""
    folder, n = _folder(spark, "ledger-stream"), F.col("order_index")
    rows = B.ledger(spark, d).filter((n % 29 != 12) | (n < 100)).select(F.concat(F.lit("part "), (n % 4).cast("string")).alias("ledger"), (F.floor(n / 4) + 1).alias("order_index"), "capture_id", F.col("selection_accepted").alias("accepted"))
    for k in (1, 0):
        rows.filter(F.pmod(F.xxhash64("capture_id"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ledgers.PROVIDER)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    stream = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = ledgers.record_in_order(stream, target=200)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ledgers.RESULT).parquet(f"{folder}/out").filter("status = 'recorded'").select("ledger", "order_index", "capture_id", "accepted_so_far")


@query(f"with {B.LEDGER_SQL}, b as (select *, case when order_index <= 400 then 1 when order_index <= 900 then 2 else 3 end as version from l where order_index >= 1) select version::bigint as version, count(*) as n, min(order_index)::bigint as first, max(order_index)::bigint as last, count_if(yes)::bigint as accepted from b group by 1")
def commit_log_batches(spark, d):
    """The ledger committed in three batches, the second one sent twice; counts of each commit's own rows."""
    log = CommitLog(spark, _folder(spark, "commit-log"), order="order_index")
    rows, n = B.ledger(spark, d).select("order_index", "capture_id", "selection_accepted").filter("order_index >= 1"), F.col("order_index")
    for batch, part in enumerate((n <= 400, n.between(401, 900), n.between(401, 900), n > 900)):
        log.append(rows.filter(part), writer="w", batch_id=batch - (batch > 1))
    found = [log.read(v).withColumn("version", F.lit(v).cast("long")) for v in log.versions()]
    own = [found[0], *(b.join(a, "order_index", "left_anti").select(*b.columns) for a, b in zip(found, found[1:]))]
    return reduce(DataFrame.unionByName, own).groupBy("version").agg(F.count("*").alias("n"), F.min("order_index").alias("first"), F.max("order_index").alias("last"), F.count_if("selection_accepted").alias("accepted"))
