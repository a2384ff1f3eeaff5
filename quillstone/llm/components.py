"""Connected components as shuffles, for the operators that link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import stored

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, for the nodes that edges (src, dst) name.

    Large-star and small-star steps, each a shuffle by node with pre-aggregated minima, until only stars are
    left: no node has two edges up, or edges both up and down. The table that tells so holds the result.
    Every round is written to the shared folder. A star of any size has rows, never pairs.
    Edges with a null end are left out; without edges the result is empty.
    """
    e = edges.where("src != dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    e = stored(e, "edges")
    for _ in range(MOST_ROUNDS):
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionAll(e.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low"))
        large = both.where("m > n").join(least.hint("merge"), "n").select(F.col("m").alias("hi"), F.least("n", "low").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(low.hint("merge"), "hi").select(F.explode(F.array(F.struct("hi", F.col("low").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")))).alias("x")).select("x.*").where("hi != lo").distinct()
        e = stored(small, "edges")
        ends = e.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("up")), F.struct(F.col("lo").alias("node"), F.lit(None).cast(e.schema["lo"].dataType).alias("up")))).alias("x")).select("x.*")
        leaf = (F.count("up") == 1) & (F.count("*") == 1)
        nodes = stored(ends.groupBy("node").agg(F.coalesce(F.min("up"), "node").alias("component"), (leaf | (F.count("up") == 0)).alias("settled")), "nodes")
        if nodes.where("not settled").isEmpty():
            return nodes.select("node", "component")
    raise RuntimeError(f"connected components have not settled in {MOST_ROUNDS} rounds")
