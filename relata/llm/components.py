"""Connected components by alternating large and small stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import discard, materialize
from relata.llm.skew import join_counted

MAX_ROUNDS = 60


def _join_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Each edge (a, b) with m, the least neighbour of a; the edges of nodes with very many are not brought together."""
    return join_counted(edges, least, ["a"], total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return _join_least(both, least, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = _join_least(down, least, total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    ``rows``: about how many links there are at most, if that is known.  Rounds
    stop when a round changes nothing; ``MAX_ROUNDS`` guards against a defect
    only, and passing it is an error, never a partial result.
    """
    current = materialize(edges.select("a", "b").filter("a <> b"), "links", rows)
    before, total = None, current.count()
    for _ in range(MAX_ROUNDS):
        # A large star keeps or lessens the number of edges, so its bound holds for the small star too.
        earlier, current = current, materialize(_small_star(_large_star(current, total), 2 * total), "stars", total)
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        discard(earlier)
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct().toDF("node", "component"))
        before, total = state, state.n
    raise RuntimeError("components did not settle")
