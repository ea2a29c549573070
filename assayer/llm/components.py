"""Connected components of a link table by alternating star contractions.

Every round is a grouped minimum and a join, so neither links nor components
gather in one place. Rounds are cut to the shared checkpoint folder, which
bounds the plan and survives lost executors. The number of rounds grows with
the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import cut, cut_small


def _least_below(pairs: DataFrame) -> DataFrame:
    """u, v with the least neighbour of u, itself included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").withColumn("least", F.least("u", "least"))


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for every node of a link the smallest node that it reaches.

    Nulls take part in no link; repeated links and links of a node to itself
    change nothing; without links the result is empty.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    current = cut(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    before = _signature(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_below(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        marked = _least_below(large)
        small = (
            marked.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(marked.select("u", F.col("least").alias("v")))
            .distinct()
        )
        current = cut_small(small, before[0])
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
