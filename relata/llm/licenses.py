"""License scan by diagonal voting, in DataFrame functions only.

Every rolling two-word hash of every text is joined to the positions at which
a template holds the same two words (a fixed, bounded table, so it is
broadcast).  A hit at text word ``i`` and template word ``j`` votes for the
diagonal ``i - j``.  The words themselves are compared in the join, so a hash
collision casts no vote.  A diagonal on which all of a phrase's two-word
offsets vote is a verbatim place of the phrase.  For the longer notices,
diagonals at most ``MERGE_GAP`` apart (a few words inserted or lost) are merged
and the span is accepted when enough of the template's offsets voted.

Defined results: a null text counts as empty; an empty text has 0 words and no
labels; repeated rows each get the same result; a null id is kept.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.common import read_table

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MERGE_GAP = 2
MIN_COVERAGE = 0.6

# Phrases whose verbatim places are counted, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Openings of widely published licence notices, lower case, without punctuation.
NOTICES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "cc-notice": "this work is licensed under a creative commons attribution license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
}
#: Two words of this list in a row cast no vote for a notice: they are too frequent to tell anything.
FILLERS = frozenset("a and any are as by for in is it of on or that the this to use with you".split())


def template_rows() -> list[tuple[str, str, bool, int, int, str, str]]:
    """(label, template, is_phrase, offsets that can vote, offset, word, next word); bounded by the two fixed lists."""
    rows = []
    for text, label, is_phrase in [(t, n, True) for t, n in PHRASES.items()] + [(t, n, False) for n, t in NOTICES.items()]:
        words = text.split()
        grams = [(j, a, b) for j, (a, b) in enumerate(zip(words, words[1:])) if is_phrase or not (a in FILLERS and b in FILLERS)]
        rows += [(label, text, is_phrase, len(grams), j, a, b) for j, a, b in grams]
    return rows


def _words(text):
    """Only A to Z are lowered: other letters keep their case, and none becomes another."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), SEPARATOR), "")


def template_hits(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per (document, text position, template position) whose two words agree."""
    spark = docs.sparkSession
    templates = spark.createDataFrame(template_rows(), "label string, template string, is_phrase boolean, n_votes int, t_pos int, w1 string, w2 string").withColumn("gram", F.xxhash64("w1", "w2"))
    # The word list is bound once as a lambda variable; were it a column of its own, the optimizer could split the text again for every word.
    grams = F.transform(F.array(_words(F.col(text_column))), lambda ws: F.struct(ws.alias("ws"), F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1))).alias("grams")))[0]
    rolled = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"), grams.alias("g")).select("id", "text_key", F.col("g.ws").alias("ws"), F.posexplode("g.grams").alias("pos", "gram"))
    same_words = (F.get("ws", F.col("pos")) == F.col("w1")) & (F.get("ws", F.col("pos") + 1) == F.col("w2"))
    return rolled.join(F.broadcast(templates), "gram").filter(same_words).select("id", "text_key", "label", "template", "is_phrase", "n_votes", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))


def license_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_coverage: float = 0.0) -> DataFrame:
    """Spans (id, text_key, label, template, is_phrase, start, coverage): verbatim places for phrases, merged diagonals for notices."""
    key = ["id", "text_key", "label", "template", "is_phrase", "n_votes"]
    votes = template_hits(docs, id_column, text_column).groupBy(*key, "diagonal").agg(F.collect_set("t_pos").alias("offsets"))
    along = Window.partitionBy("id", "text_key", "template").orderBy("diagonal")
    new_span = F.when(F.col("is_phrase") | (F.col("diagonal") - F.lag("diagonal").over(along) > MERGE_GAP), 1).otherwise(0)
    spans = votes.withColumn("new_span", new_span).withColumn("span", F.sum("new_span").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*key, "span").agg(F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("n_hit"))
    coverage = F.col("n_hit") / F.col("n_votes")
    return merged.withColumn("coverage", coverage).filter((F.col("coverage") >= F.when(F.col("is_phrase"), 1.0).otherwise(min_coverage))).select("id", "text_key", "label", "template", "is_phrase", F.col("start").cast("long").alias("start"), "coverage")


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: word count, verbatim phrase places, labels and the best coverage of any template."""
    spans = license_spans(docs, id_column, text_column)
    labelled = F.when(F.col("is_phrase") | (F.col("coverage") >= MIN_COVERAGE), F.col("label"))
    found = spans.groupBy("id", "text_key").agg(
        F.count_if("is_phrase").alias("n_base"),
        F.min(F.when(F.col("is_phrase"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("is_phrase"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(labelled)), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("key"), F.size(_words(F.col(text_column))).cast("long").alias("n_words"))
    on = counted.doc_id.eqNullSafe(found.id) & (counted.key == found.text_key)
    return counted.join(found, on, "left").select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same results in DuckDB SQL, joined on the words themselves."""
    values = ",".join(f"('{a}','{b}',{c},{d},{e},'{f}','{g}')" for a, b, c, d, e, f, g in template_rows())
    return f"""
with t(label, template, is_phrase, n_votes, t_pos, w1, w2) as (values {values}),
d as (select doc_id, row_number() over () as rid,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as ws from documents),
g as (select rid, ws, unnest(range(1, len(ws))) as p from d),
h as (select g.rid, label, template, is_phrase, n_votes, t_pos, p - 1 - t_pos as diagonal from g join t on g.ws[p] = t.w1 and g.ws[p + 1] = t.w2),
v as (select rid, label, template, is_phrase, n_votes, diagonal, list(t_pos) as offsets from h group by all),
s as (select *, case when is_phrase or diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > {MERGE_GAP} then 1 else 0 end as new_span from v),
c as (select *, sum(new_span) over (partition by rid, template order by diagonal) as span from s),
m as (select rid, label, template, is_phrase, span, min(diagonal) as start, len(list_distinct(flatten(list(offsets)))) / any_value(n_votes) as coverage from c group by all),
f as (select rid, count(*) filter (is_phrase) as n_base, min(start) filter (is_phrase) as first_word, max(start) filter (is_phrase) as last_word,
        string_agg(distinct label, ',' order by label) filter (is_phrase) as base_labels,
        string_agg(distinct label, ',' order by label) filter (is_phrase or coverage >= {MIN_COVERAGE}) as labels, max(coverage) as score
      from m where not is_phrase or coverage >= 1 group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0.0), 6) as score
from d left join f using (rid)"""
