"""Connected components of an edge table by alternating large-star and small-star rounds.

Every step is a grouped minimum (map-side combined) and a join that adaptive execution can split,
so one hub with very many edges does not land in one task. Rounds are cut by tables written to the
shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import drop_materialized, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of u is linked to u's least neighbour (or u). Returns the least neighbours' table as well.

    That table is written first: the join then shuffles both sides for itself, and adaptive execution
    can split the edges of a hub or broadcast a small table.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-least")
    return least, both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end) and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component): the least node of its component, for every node of edges(u, v) but the least ones themselves."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), label)

    def state(df: DataFrame) -> tuple[int, int, int]:
        n, total, several = df.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).agg(F.count("*"), F.sum("s"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0))).first()
        return int(n or 0), int(total or 0), int(several or 0)

    before = state(now)
    for _ in range(MAX_ROUNDS):
        least, larger = _large_star(now, label)
        after = materialize(_small_star(larger), label)
        mark = state(after)
        drop_materialized(now)
        drop_materialized(least)
        now = after
        if mark == before and mark[2] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
    raise RuntimeError("the components did not settle")
