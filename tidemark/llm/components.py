"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b), component being the smallest node that can be reached.

    In each round every node joins the neighbour (or itself) that comes first in an order hashed anew; edges then connect
    what their ends joined. About a third of the nodes or fewer remain a round, chains and stars alike. Nulls are left out.
    """
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for round_ in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c, r=round_: F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("node"))
        joins = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(ranked("b")), F.first(ranked("a")))["node"].alias("to")), "joins")
        steps.append(joins)
        moved = edges.join(joins.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(joins.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        edges = written(moved.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components() ran out of rounds")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select("node", F.col("to").alias("root"))
    for joins in steps[1:]:
        found = found.join(joins.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    found = written(found, "roots")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
