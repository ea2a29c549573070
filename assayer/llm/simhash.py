"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set where more than half of the hashes of the text's
four-word shingles have it. Two fingerprints that differ in at most four bits
agree in at least three of seven blocks, so each distinct fingerprint is filed
once for every choice of three blocks; a pair that shares a file and differs in
four bits or fewer is a link, reported only from the first file that it shares.
Components of links come from star contractions.

Exact copies share a fingerprint and are one node, so a large group of copies
costs no pairs. Nothing bounds the fingerprints that share a file, as a chain of
links may be of any length, so full files are dealt over tasks: their fingerprints
get one of several numbers on the left side of the join and all of them on the
right. Which files are full is read off every ``SAMPLED``-th fingerprint by a hash;
that decides how the work is dealt, never what is compared. Nodes of links are led by their smallest id, so
that the root of a component holds the id of its class and no further join on
roots, which could gather a large component in one task, is needed.
Defined results: a null, empty or blank text has fingerprint
zero and links like any other; a group whose ids are all null has a null
component_id, otherwise null ids do not count as smallest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import broadcast_if_small, cut, cut_small, map_texts, numbered, pick, position_of
from assayer.llm.components import components

WORDS, SEED, NEAR = 4, 42, 4
BLOCKS, SHARED = 7, 3
#: One fingerprint in so many is counted by file; a file with so many of those is full; about so many fingerprints stay together.
SAMPLED, FULL, TOGETHER = 64, 32, 2048


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < WORDS:
        return int.from_bytes(digest(joined, SEED), "big", signed=True)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    held = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=False)])
    rows = np.frombuffer(held, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def block_masks() -> list[int]:
    """The seven blocks of the 64 bits as signed masks."""
    masks, low = [], 0
    for k in range(BLOCKS):
        width = 64 // BLOCKS + (k < 64 % BLOCKS)
        mask = ((1 << width) - 1) << low
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
        low += width
    return masks


def _first_shared(differing: Column) -> Column:
    """The three lowest blocks without a differing bit, as a set of bits."""
    agree = sum((F.when(differing.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, m in enumerate(block_masks())), F.lit(0))
    found, rest = F.lit(0), agree
    for _ in range(SHARED):
        lowest = rest.bitwiseAND(-rest)
        found, rest = found.bitwiseOR(lowest), rest.bitwiseAND(F.bitwise_not(lowest))
    return found


def links(prints: DataFrame, *carry: str) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column ``fp``) that differ in at most four bits, each pair once; ``carry`` comes along as a_name, b_name."""
    masks = block_masks()
    files = [(sum(1 << k for k in three), sum(masks[k] for k in three)) for three in combinations(range(BLOCKS), SHARED)]
    files = [(name, mask if mask < 1 << 63 else mask - (1 << 64)) for name, mask in files]
    entry = F.explode(F.array(*[F.struct(F.lit(name).alias("file"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")) for name, mask in files]))
    filed = prints.select("fp", *carry, entry.alias("e")).select("fp", *carry, "e.file", "e.key")
    of = lambda side: [F.col(c).alias(f"{side}_{c}") for c in carry]
    chosen = filed.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).groupBy("file", "key").agg(F.count("*").alias("n")).where(F.col("n") >= FULL)
    full = cut(chosen.select("file", "key", (F.col("n") * SAMPLED / TOGETHER + 1).cast("int").alias("deal")))
    one, every = F.lit(0).alias("turn"), F.lit(0).alias("turn")
    if not full.isEmpty():
        filed = filed.join(broadcast_if_small(full), ["file", "key"], "left")
        one = F.pmod(F.xxhash64(F.lit("deal"), "fp"), F.coalesce("deal", F.lit(1))).cast("int").alias("turn")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("deal", F.lit(1)) - 1)).alias("turn")
    left = filed.select(F.col("fp").alias("a"), *of("a"), "file", "key", one).alias("l")
    right = filed.select(F.col("fp").alias("b"), *of("b"), "file", "key", every).alias("r")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    same_file = (F.col("l.file") == F.col("r.file")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.turn") == F.col("r.turn"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(differing) <= NEAR) & (_first_shared(differing) == F.col("l.file"))
    return left.join(right, same_file & near).select("a", "b", *[f"{side}_{c}" for c in carry for side in "ab"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text) and fp of every row, written to the shared folder."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return cut(map_texts(rows, lambda: lambda texts: {"fp": [fingerprint(t) for t in texts]}, "fp long", ("doc_id", "mark")))


def _node(first_id: str, fp: str) -> Column:
    """A node of the links: its smallest id first, null ids last, then the fingerprint that tells it apart."""
    return F.struct(F.col(first_id).isNull().alias("absent"), F.col(first_id).alias("id"), F.col(fp).alias("fp"))


def _classes(rows: DataFrame, total: int) -> DataFrame:
    """fp, copies (rows that carry it), root (a fingerprint) and component_id of every distinct fingerprint."""
    prints = cut_small(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), total)
    found = links(prints, "first_id").select(_node("a_first_id", "a").alias("a"), _node("b_first_id", "b").alias("b"))
    linked = components(found, "a", "b").select(F.col("node.fp").alias("fp"), F.col("root.fp").alias("root"), F.col("root.id").alias("id"))
    rooted = prints.join(linked, "fp", "left")
    component = F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("id")).alias("component_id")
    return cut_small(rooted.select("fp", "copies", F.coalesce("root", "fp").alias("root"), component), total)


#: A fingerprint is common if it carries more than the thousandth part of all rows; there are fewer than a thousand of them in any table.
COMMON, FEWEST_COMMON = 1000, 1000


def _with_classes(rows: DataFrame) -> DataFrame:
    """The rows with root and component_id; rows of common fingerprints meet their class by broadcast, so copies never gather in one task."""
    total = rows.count()
    classes = _classes(rows, total)
    least = max(FEWEST_COMMON, total // COMMON)
    common = F.broadcast(classes.where(F.col("copies") > least).drop("copies"))
    few = rows.join(common.select("fp"), "fp", "left_anti").join(classes.where(F.col("copies") <= least).drop("copies"), "fp")
    return few.unionByName(rows.join(common, "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable) of every row."""
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _with_classes(fingerprints(docs)).select("doc_id", shown, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the smallest doc_id, then the smallest text hash.

    Rows are told apart by id and text; of identical such rows one stays.
    """
    names = docs.columns
    who, what = (f"c{position_of(names, n)}" for n in ("doc_id", "text"))
    rows = fingerprints(docs)
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")
    stays = _with_classes(rows).groupBy("root").agg(F.min(order).alias("s")).select("s.doc_id", "s.mark")
    counted = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("times"))
    stays = stays.select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"))
    one = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark"))
    gone = counted.join(stays, one, "left_anti").select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark"))
    again = counted.where("times > 1").join(stays, one, "left_semi").select(F.col("doc_id").alias("r_id"), F.col("mark").alias("r_mark"))
    n = rows.count()
    gone, again = broadcast_if_small(cut_small(gone, n)), broadcast_if_small(cut_small(again, n))
    plain = numbered(docs).withColumn("mark", F.xxhash64(what))
    kept = plain.join(gone, F.col(who).eqNullSafe(F.col("g_id")) & (F.col("mark") == F.col("g_mark")), "left_anti")
    is_again = F.col(who).eqNullSafe(F.col("r_id")) & (F.col("mark") == F.col("r_mark"))
    once = kept.join(again, is_again, "left_anti")
    one_of = kept.join(again, is_again, "left_semi").dropDuplicates([who, "mark"])
    return once.unionByName(one_of).drop("mark").toDF(*names)
