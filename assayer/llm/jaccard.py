"""Near-duplicates by the Jaccard similarity of five-word shingles, joined exactly in metric space.

One minus the similarity is a metric, and its triangle inequality carries the join:

1. *Who can have a partner.* A document keeps as a sketch its smallest shingles by hash, as
   many as may miss in a partner and a tenth more. Two linked documents share that tenth within
   their sketches, so a document whose sketch shares less with all others is alone. All
   distinct sets are counted; no text is sampled.
2. *Regions.* The shingles of the others are ordered by how many of them hold each. A document
   is replicated to every pivot that a shingle of its boundary leads to: its rarest shingles,
   one more than may miss in a partner. The pivot of a shingle is the first document that has
   it in its boundary. Two linked documents share such a shingle, hence a region.
3. *Inside a region* documents that no pivot reaches become pivots in turn. A document within
   the radius of a pivot is linked to it; two documents may be linked only if their distances
   from every pivot differ by no more than the radius, and need no look if links already
   connect them. Only what is left is compared.
4. *Large regions* are split first, again and again: pivots drawn from their members make
   Voronoi cells, each member goes to its nearest pivot's cell and to those of pivots at most
   two radii farther, cells that lie within the radius of their pivot are done, and members of a
   cell that no outsider can reach leave it. Where all members are near each other every cell
   holds them all; a split that does not halve the rows to join is not made. What does not become
   small is compared in blocks of members dealt over tasks, all of them but for the largest part
   that links already connect, which meets only the others.

Components of the links come from star contractions. Equal sets are one node, so copies cost
no pairs. Shingles are known by 64-bit hashes, sets by 128-bit hashes.

Defined results: null and empty texts and texts without words have no shingle, are linked with
nothing and are their own component; a text of fewer than five words has one shingle; rows that
repeat a doc_id are rows of their own; a null doc_id is not the smallest unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.base import broadcast_if_small, cut, cut_small, is_small, map_texts, pick, table
from assayer.llm.components import components

WORDS, PERCENT = 5, 80
RADIUS = 1 - PERCENT / 100
#: Shingles and members of the largest region that one task joins; larger ones are split.
REGION_SHINGLES, REGION_MEMBERS = 2_000_000, 2048
#: Pivots of a split, and splits before blocks.
PIVOTS, SPLITS = 16, 4
#: Allowance for distances held as single-precision numbers; it only lets more pairs be compared.
EDGE = 1e-5

#: SQL of the least number of shingles of ``n`` that a partner shares, and of the length of the boundary.
NEEDED = f"(({PERCENT} * n + 99) div 100)"
BOUNDARY = f"(n - {NEEDED} + 1)"


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_digest
    if len(words) < WORDS:
        return np.frombuffer(digest(joined), dtype=">i8").astype(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    held = b"".join([digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[WORDS - 1 :], strict=False)])
    return np.unique(np.frombuffer(held, dtype=">i8").astype(np.int64))


def _needed(n: int) -> int:
    return -(-PERCENT * n // 100)


def _sketch(held: np.ndarray) -> np.ndarray:
    n = len(held)
    return held[: n - _needed(n) + max(1, n // 10)]


def sketches(docs: DataFrame) -> DataFrame:
    """key, doc_id, mark (hash of the text), n, two hashes of the set and its sketch, of every row; written to the shared folder."""

    def make():
        def score(texts: list) -> dict[str, list]:
            sets = [shingles(t) for t in texts]
            marks = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64) for s in sets]
            return {"n": [len(s) for s in sets], "s1": [int(m[0]) for m in marks], "s2": [int(m[1]) for m in marks], "sketch": [_sketch(s) for s in sets]}

        return score

    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("key"), "doc_id", F.xxhash64("text").alias("mark"), "text")
    return table(map_texts(rows, make, "n long, s1 long, s2 long, sketch array<bigint>", ("key", "doc_id", "mark")))


def _counted(held: DataFrame) -> DataFrame:
    """The rows whose shingle others have too, with how many do (times): counted where the rows lie, so they are shuffled once."""
    return held.withColumn("times", F.count("*").over(Window.partitionBy("shingle"))).where("times > 1")


def _partnered(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, doc_id and mark of the sets that may have a partner."""
    first = broadcast_if_small(nodes.select(F.col("node").alias("key")))
    held = rows.where("n > 0").join(first, "key", "left_semi").select(F.col("key").alias("node"), "n", F.explode("sketch").alias("shingle"))
    met = _counted(held).groupBy("node", "n").agg(F.count("*").alias("met"))
    some = cut(met.where(F.expr(f"met >= greatest(1, {NEEDED} div 10)")).select(F.col("node").alias("key")))
    return cut(rows.join(broadcast_if_small(some), "key", "left_semi").select(F.col("key").alias("node"), "doc_id", "mark"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n and the shingles of the wanted sets, from their whole texts."""
    who = broadcast_if_small(wanted.select("node", F.col("doc_id").alias("d"), F.col("mark").alias("m")))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("m"))
    texts = pick(docs, "doc_id", "text").join(who, same).select("node", "text")
    made = map_texts(texts, lambda: lambda texts: {"shingles": [shingles(t) for t in texts]}, "shingles array<bigint>", ("node",))
    sets = table(made.select("node", F.size("shingles").cast("long").alias("n"), "shingles"))
    # Rows that repeat an id and its text give their set more than once; only these are shuffled.
    twice = cut(sets.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1").select("node"))
    if twice.isEmpty():
        return sets
    twice = broadcast_if_small(twice)
    return sets.join(twice, "node", "left_anti").unionByName(table(sets.join(twice, "node", "left_semi").dropDuplicates(["node"])))


def _regions(sets: DataFrame) -> DataFrame:
    """region (its first pivot), node and n: every set in the regions of its boundary."""
    each = sets.select("node", "n", F.explode("shingles").alias("shingle"))
    known = _counted(each)
    mine = Window.partitionBy("node")
    # Shingles that nobody else has come first in the order of rarity: they fill places of the boundary that lead nowhere.
    alone = F.col("n") - F.count("*").over(mine)
    place = F.row_number().over(mine.orderBy("times", "shingle")) + alone
    placed = known.select("node", "n", "shingle", place.alias("place"), alone.alias("alone"))
    boundary = table(placed.where(F.expr(f"place <= {BOUNDARY} AND n - alone >= {NEEDED}")).select("node", "n", "shingle"))
    led = boundary.groupBy("shingle").agg(F.min("node").alias("region"), F.count("*").alias("times")).where("times > 1").select("shingle", "region")
    return boundary.join(led, "shingle").select("region", "node", "n").distinct()


class Region:
    """The sets of one region with what is needed to compare any of them with all others."""

    def __init__(self, sets: list[np.ndarray], held: list[int | None]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        known, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.marks = np.zeros(len(known), dtype=np.int32)
        #: How many shingles of each set another one of the region has: no more are shared with any.
        self.met = np.add.reduceat((np.bincount(self.ids) > 1)[self.ids].astype(np.int64), self.starts[:-1])
        self.root = np.arange(len(sets))
        self.found: list[tuple[int, int]] = []
        first: dict[int, int] = {}
        for i, pivot in enumerate(held):
            if pivot is not None:
                self.root[i] = self.root[first.setdefault(pivot, i)]

    def _of(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]

    def shared(self, i: int, others: np.ndarray | None = None) -> np.ndarray:
        """How many shingles of set ``i`` each of the others, or every set, has."""
        self.marks[self._of(i)] = 1
        if others is None:
            got = np.add.reduceat(self.marks[self.ids], self.starts[:-1])
        else:
            got = np.array([self.marks[self._of(j)].sum() for j in others.tolist()], dtype=np.int64)
        self.marks[self._of(i)] = 0
        return got

    def link(self, i: int, others: np.ndarray, got: np.ndarray) -> np.ndarray:
        """Which of the others are linked with ``i``; links that connect something new are noted."""
        linked = 100 * got >= PERCENT * (self.sizes[i] + self.sizes[others] - got)
        for j in others[linked].tolist():
            if self.root[i] != self.root[j]:
                self.found.append((i, j))
                self.root[self.root == self.root[j]] = self.root[i]
        return linked

    def possible(self, i: int, others: np.ndarray) -> np.ndarray:
        """The others that may be linked with ``i`` and that no links connect with it."""
        enough = (100 + PERCENT) * np.minimum(self.met[others], self.met[i]) >= PERCENT * (self.sizes[others] + self.sizes[i])
        return others[enough & (self.root[others] != self.root[i])]

    def join(self) -> list[tuple[int, int]]:
        """Links that connect all that the links of the region connect."""
        n = len(self.sizes)
        every, reached, left, distances = np.arange(n), np.zeros(n, dtype=bool), np.ones(n, dtype=bool), []
        # Sets that have the fewest shingles of their own reach the most others.
        for i in np.argsort(self.met - self.sizes, kind="stable")[::-1].tolist():
            if not reached[i]:
                left[i] = False
                if len(self.possible(i, every)):
                    got = self.shared(i)
                    reached |= self.link(i, every, got)
                    distances.append((1 - got / (self.sizes[i] + self.sizes - got)).astype(np.float32))
        table = np.array(distances)
        rest = every[left]
        for at, i in enumerate(rest.tolist()):
            later = self.possible(i, rest[at + 1 :])
            if len(later):
                later = later[np.abs(table[:, later] - table[:, i : i + 1]).max(axis=0) <= RADIUS + EDGE]
            if len(later):
                self.link(i, later, self.shared(i, later))
        return self.found


def _rows_of(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _join_regions(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links of each region (region, node, held), each of a size that one task joins."""
    full = members.join(sets.select("node", "shingles"), "node").select("region", "node", "held", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[list, list, list] = ([], [], [])
        current = None

        def done() -> pa.RecordBatch:
            nodes = open_[0]
            pairs = Region(open_[2], open_[1]).join() if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("region", "node", "held")]
            for region, node, held, one in zip(*columns, _rows_of(batch.column("shingles")), strict=True):
                if region != current and open_[0]:
                    yield done()
                    open_ = ([], [], [])
                current = region
                for column, value in zip(open_, (node, held, one.copy()), strict=True):
                    column.append(value)
        if open_[0]:
            yield done()

    return full.repartition("region").sortWithinPartitions("region", "node").mapInArrow(run, "a long, b long")


def _distances(members: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """region, node, n, pivot, d and linked: the distance of each member from every pivot of its region, and whether they are linked."""
    draw = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(turn)), "node"))
    chosen = members.select("region", "node", draw.alias("draw")).where(F.col("draw") <= PIVOTS).select("region", F.col("node").alias("pivot"))
    known = cut(chosen.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("theirs")), "pivot"))
    pairs = members.select("region", "node", "n").join(sets.select("node", "shingles"), "node").join(broadcast_if_small(known), "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, linked = [], []
            for one, other in zip(_rows_of(batch.column("shingles")), _rows_of(batch.column("theirs")), strict=True):
                both = len(np.intersect1d(one, other, assume_unique=True))
                far.append(1 - both / (len(one) + len(other) - both))
                linked.append(100 * both >= PERCENT * (len(one) + len(other) - both))
            kept = [batch.column(c) for c in ("region", "node", "n", "pivot")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], names=["region", "node", "n", "pivot", "d", "linked"])

    return cut(pairs.select("region", "node", "n", "pivot", "shingles", "theirs").mapInArrow(run, "region long, node long, n long, pivot long, d double, linked boolean"))


def _split(members: DataFrame, sets: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links with pivots, and the members (parent, region, node, n, held) of the Voronoi cells that are left to join; parent is the region that was split."""
    far = _distances(members, sets, turn)
    least = far.groupBy("region", "node").agg(F.min("d").alias("least"))
    cell = F.xxhash64("region", "pivot").alias("cell")
    inside = far.join(least, ["region", "node"]).where(F.col("d") <= F.col("least") + 2 * RADIUS + EDGE)
    cells = inside.select("region", cell, "node", "n", "d", F.when(F.col("d") <= RADIUS - EDGE, F.col("pivot")).alias("held"))
    outside = cells.where("held IS NULL").groupBy("cell").agg(F.min("d").alias("edge"))
    left = cells.join(outside, "cell").where(F.col("d") >= F.col("edge") - RADIUS - EDGE)
    near = far.where(F.col("linked") & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return near, left.select(F.col("region").alias("parent"), F.col("cell").alias("region"), "node", "n", "held")


def _blocks() -> Column:
    """Blocks that a group of members needs, of which one task joins two."""
    return F.ceil(F.greatest(2 * F.sum("n") / REGION_SHINGLES, 2 * F.count("*") / REGION_MEMBERS)).cast("int")


def _whole(members: DataFrame, cells: DataFrame) -> DataFrame:
    """The regions whose cells have more than half of the rows that blocks of the region itself would have."""
    rows = F.count("*") * F.when(_blocks() > 2, _blocks()).otherwise(1)
    before = members.groupBy("region").agg(rows.alias("before"))
    after = cells.groupBy(F.col("parent"), F.col("region").alias("cell")).agg(rows.alias("rows")).groupBy(F.col("parent").alias("region")).agg(F.sum("rows").alias("after"))
    return before.join(after, "region").where(2 * F.col("after") > F.col("before")).select("region")


def _sized(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of regions of two or more that one task joins, and those of larger regions with the number of blocks that they need."""
    sizes = members.groupBy("region").agg(_blocks().alias("blocks"), F.count("*").alias("size"))
    known = members.join(sizes.where("size > 1"), "region").drop("size")
    return known.where("blocks <= 2").drop("blocks"), known.where("blocks > 2")


def _in_blocks(members: DataFrame, found: DataFrame) -> DataFrame:
    """Each pair of blocks of a large region as a region of its own; every two members that no links found connect meet in one.

    The largest part of a region that links connect has blocks of its own, which meet only those of the others.
    """
    known = cut(components(found, "a", "b"))
    held = cut(members.drop("held").join(known.withColumnRenamed("root", "held"), "node", "left"))
    parts = held.where("held IS NOT NULL").groupBy("region", "held").agg(F.count("*").alias("size"))
    main = parts.groupBy("region").agg(F.max(F.struct("size", "held")).getField("held").alias("main"))
    dealt = held.join(main, "region", "left").withColumn("inside", F.coalesce(F.col("held") == F.col("main"), F.lit(False))).drop("main")
    sizes = dealt.groupBy("region", "inside").agg(_blocks().alias("blocks"))
    outer = sizes.where("NOT inside").select("region", F.col("blocks").alias("outer"))
    inner = sizes.where("inside").select("region", F.col("blocks").alias("inner"))
    # Regions without outsiders are connected. Blocks of outsiders come first, then those of the main part.
    dealt = dealt.join(outer, "region").join(inner, "region", "left").withColumn("inner", F.coalesce("inner", F.lit(0)))
    hashed = F.xxhash64("node")
    block = F.when(F.col("inside"), F.col("outer") + F.pmod(hashed, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(hashed, F.col("outer"))).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1))
    dealt = dealt.withColumn("block", block).withColumn("other", met)
    return dealt.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "node", "n", "held")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def links(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: links between sets (nodes) that connect all sets which links of similar sets connect."""
    sets = _sets(docs, _partnered(rows, nodes))
    members = cut(_regions(sets).withColumn("held", F.lit(None).cast("long")))
    small, large = _sized(members)
    found, parts, kept = [], [small], []
    for turn in range(SPLITS):
        if large.isEmpty():
            break
        large = cut(large.drop("blocks"))
        near, cells = _split(large, sets, turn)
        found.append(cut(near))
        cells = cut(cells)
        whole = cut(_whole(large, cells))
        kept.append(large.join(whole, "region", "left_semi"))
        small, large = _sized(cells.join(whole.withColumnRenamed("region", "parent"), "parent", "left_anti").drop("parent"))
        parts.append(small)
    for part in parts:
        found.append(cut(_join_regions(part, sets)))
    if kept:
        rest = cut(_all([*kept, large.drop("blocks")]))
        if not rest.isEmpty():
            found.append(cut(_join_regions(_in_blocks(rest, _all(found)), sets)))
    return _all(found)


#: A set is common if more than the thousandth part of all rows have it; there are fewer than a thousand of these.
COMMON, FEWEST_COMMON = 1000, 1000


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    rows = sketches(docs)
    total = rows.count()
    named = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = cut_small(named, total)
    found = links(docs, rows, nodes)
    who = nodes.select(F.col("node").alias("at"), F.struct(F.col("first_id").isNull().alias("absent"), F.col("first_id").alias("id"), F.col("node").alias("key")).alias("who"))
    ends = found
    for side in ("a", "b"):
        ends = ends.join(who.withColumnRenamed("who", f"{side}_who"), F.col(side) == F.col("at")).drop("at")
    linked = components(ends.select(F.col("a_who").alias("a"), F.col("b_who").alias("b")), "a", "b").select(F.col("node.key").alias("node"), F.col("root.id").alias("id"))
    # Only sets with copies or links have another smallest id than their row's own.
    classes = nodes.join(linked, "node", "left").where("copies > 1 OR id IS NOT NULL").select("s1", "s2", F.col("n").alias("size"), "copies", F.coalesce("id", "first_id").alias("id"))
    return _placed(rows, cut_small(classes, total), total)


def _placed(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Rows with the smallest id of their class; copies of common sets meet it by broadcast and never gather in one task."""
    own: Column = F.col("doc_id").alias("component_id")
    kept = ["doc_id", F.col("n").alias("n_shingles")]
    given = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("id")).alias("component_id")
    if is_small(classes):
        return rows.where("n > 0").join(F.broadcast(classes), ["s1", "s2"], "left").select(*kept, given).unionByName(rows.where("n = 0").select(*kept, own))
    least = max(FEWEST_COMMON, total // COMMON)
    common = F.broadcast(classes.where(F.col("copies") > least))
    rare = classes.where(F.col("copies") <= least)
    others = rows.where("n > 0").join(common.select("s1", "s2"), ["s1", "s2"], "left_anti").join(rare, ["s1", "s2"], "left").select(*kept, given)
    return others.unionByName(rows.where("n > 0").join(common, ["s1", "s2"]).select(*kept, given)).unionByName(rows.where("n = 0").select(*kept, own))
