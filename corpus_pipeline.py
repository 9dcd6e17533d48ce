"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.

1. language_id: rows whose language cannot be told (null, or no letter) go.
2. line_dedup: chunks of lines that stand earlier in the corpus are cut out;
   rows that lose their whole text go.
3. near_duplicates: of each SimHash component the row with the smallest id stays.
4. decontamination: rows that hold a benchmark item go.
5. packing: what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm import decontam, langid, linededup, packing, simhash
from relata.llm.common import discard, held_out, intermediates, materialize, read_table

#: SQL expresses none of the models, fingerprints and packings here; the stages are tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(~held_out()))
    found = langid.predict(docs, model, out=("language found", "language score", "language by letter"))
    return found.filter(langid.known_language(F.col("language by letter"))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(docs, out=("passages removed", "bytes removed"))
    kept = cleaned.filter("`passages removed` = 0 or text rlike '\\\\S'")
    changed = {"n_chars": F.when(F.col("passages removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return kept.withColumns(changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's own tables, and its predecessor's result, go when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with intermediates() as made:
            docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}")
        discard(before, *made[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
