"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard. At each level
every child draws from the row's id and the child's name, divided by the child's
weight, and the smallest draw wins; a child's weight is the sum of its shards'.
Draws of a child depend on nothing else, so a changed weight moves rows only into
or out of the subtrees that hold it. A tree grows by a region of its own, so one
more shard takes rows into itself and moves no other row: the law ``key``.

Slots number the rows of a shard from 0 without gaps, in the order of a bucket, then
id, checksum, size and piece. Equal rows are counted before anything is sorted and
dealt in pieces of ``COPIES``; a row's bucket is a part of a digest of its id,
checksum and piece, so it depends on nothing but the row. Each bucket is numbered by
itself and starts where the rows of earlier buckets end, so no shard is ever sorted
as a whole and no id, text or group of copies gathers in one task.

Defined results: a null id draws as the empty string; a null text has size 1 and
checksum 0. Weights must be positive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import cut, numbered, pick, position_of

#: Hexadecimal digits of a digest that name a bucket (4096 of them in each shard), and equal rows that stay together.
BUCKET_DIGITS, COPIES = 3, 1 << 16
DRAW_BITS = 52


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Shards with their racks and regions; names of racks are unique within a region only."""

    leaves: tuple[Leaf, ...]

    def __post_init__(self) -> None:
        if not self.leaves or any(x.weight <= 0 for x in self.leaves):
            raise ValueError("a tree needs shards, and every weight must be positive")
        if len({x.shard for x in self.leaves}) != len(self.leaves):
            raise ValueError("a shard occurs twice")

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own."""
        region, shard = max(x.region for x in self.leaves) + 1, max(x.shard for x in self.leaves) + 1
        return Tree((*self.leaves, Leaf(region, 0, shard, weight)))


def balanced(regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
    """A tree of equal weights; shards are numbered from 0 in order."""
    places = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
    return Tree(tuple(Leaf(r, k, s) for s, (r, k) in enumerate(places)))


def _draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw with the rate ``weight`` from the first 52 bits of a digest of id and name."""
    head = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, DRAW_BITS // 4), 16, 10)
    return -F.log((head.cast("double") + 0.5) / float(1 << DRAW_BITS)) / F.lit(float(weight))


def _winner(key: Column, children: dict[int, tuple[str, float]]) -> Column:
    """Number of the child with the least draw, of equal draws the least number."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    drawn = [F.struct(_draw(key, name, weight).alias("d"), F.lit(k).alias("k")) for k, (name, weight) in sorted(children.items())]
    return F.array_min(F.array(*drawn))["k"]


def _choice(of: Column, results: dict[int, Column]) -> Column:
    """The result that belongs to a number."""
    (first, found), *others = results.items()
    chosen = F.when(of == first, found)
    for number, result in others:
        chosen = chosen.when(of == number, result)
    return chosen


def assign(rows: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """The rows with one more column: the shard of the id in the column ``key``."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    racks: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in tree.leaves:
        racks.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    weight = lambda leaves: sum(x.weight for x in leaves)
    region = _winner(text, {r: (f"r{r}", sum(map(weight, held.values()))) for r, held in racks.items()})
    rack = {r: _winner(text, {k: (f"r{r}k{k}", weight(held)) for k, held in inner.items()}) for r, inner in racks.items()}
    shard = {
        r: {k: _winner(text, {x.shard: (f"s{x.shard}", x.weight) for x in held}) for k, held in inner.items()}
        for r, inner in racks.items()
    }
    walked = rows.withColumn("_region", region)
    walked = walked.withColumn("_rack", _choice(F.col("_region"), rack))
    at_rack = {r: _choice(F.col("_rack"), inner) for r, inner in shard.items()}
    return walked.withColumn(name, _choice(F.col("_region"), at_rack).cast("int")).drop("_region", "_rack")


def shards(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    counted = cut(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times")))
    placed = assign(assign(counted, "doc_id", tree, "shard"), "doc_id", tree.grown(), "grown_shard")
    placed = placed.withColumn("piece", F.explode(F.expr(f"sequence(0, (times - 1) DIV {COPIES})")))
    placed = placed.withColumn("times", F.least(F.lit(COPIES), F.col("times") - F.col("piece") * COPIES))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("piece").cast("string"))
    placed = placed.withColumn("bucket", F.substring(F.md5(name.cast("binary")), 1, BUCKET_DIGITS))
    sums = placed.groupBy("shard", "bucket").agg(F.sum("times").alias("held"))
    starts = sums.select("shard", "bucket", F.expr("sum(held) OVER (PARTITION BY shard ORDER BY bucket) - held").alias("offset"))
    # One row for each bucket of a shard: bounded by the tree, not by the table.
    starts = F.broadcast(starts) if len(tree.leaves) << 4 * BUCKET_DIGITS <= 1 << 20 else starts
    inside = "sum(times) OVER (PARTITION BY shard, bucket ORDER BY doc_id, text_crc32, size, piece ROWS UNBOUNDED PRECEDING) - times"
    slotted = placed.withColumn("inside", F.expr(inside)).join(starts, ["shard", "bucket"])
    each = F.explode(F.expr("sequence(offset + inside, offset + inside + times - 1)")).alias("slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", each, "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, folder: str, spread: int = 8) -> None:
    """All columns of the rows as Parquet under one folder a shard, each written by up to ``spread`` tasks.

    A column whose name came before, in any case, or is ``shard`` gets its number appended.
    """
    names = docs.columns
    rows = assign(numbered(docs), f"c{position_of(names, 'doc_id')}", tree, "shard")
    lowered = [n.lower() for n in names]
    kept = [n if lowered.index(n.lower()) == k and n.lower() != "shard" else f"{n}_{k}" for k, n in enumerate(names)]
    rows = rows.repartition("shard", F.pmod(F.xxhash64(*[f"c{k}" for k in range(len(names))]), F.lit(spread)))
    rows.toDF(*kept, "shard").write.partitionBy("shard").parquet(folder)
