"""Benchmark decontamination as a prefix-filtered containment join.

An item's windows are its runs of 13 words, or all its words if it has fewer.
The three-word shingles of all windows are ordered by rarity: how many windows
hold the shingle, then the longer text, then the text itself. Full containment
needs every shingle of a window, so the necessary prefix is a window's rarest
shingle alone, and neighbouring windows mostly share it. Documents give a
shingle at each word; where it equals a prefix, the position of the prefix in
its window fixes where the window would start and end (it must lie inside the
document), and the words there are compared one by one.

Prefixes travel to the documents by broadcast while their measured size in bytes
stays under ``BROADCAST_BYTES``; beyond it both sides meet in a shuffle on the hashed
shingle and only documents with candidates are read again for the comparison. Words
reach that shuffle only if a table of at most ``SLOTS`` numbers says that a prefix may
equal their shingle, so what is shuffled follows the benchmark and not the corpus.
Rarity is counted over all benchmark windows, so the corpus is read once.

Everything is DataFrame functions. Defined results: null and empty texts have no
words and are never contaminated; an item without words or without an id is no
item; rows with equal item_id are one item with all their windows; an empty
benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import BROADCAST_BYTES, broadcast_if_small, cut, numbered, pick, position_of
from assayer.llm.native_text import plain_words

WINDOW, SHINGLE = 13, 3
#: Numbers that stand for hashes where a broadcast must not grow with the benchmark.
SLOTS = 1 << 20


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window (array of words) of every distinct window."""
    items = pick(benchmark, "item_id", "text").where(F.col("item_id").isNotNull())
    items = items.select("item_id", plain_words(F.col("text")).alias("words"), F.lit(WINDOW).alias("most"))
    items = items.withColumn("n", F.least(F.size("words"), "most")).where("n > 0")
    start = F.explode(F.expr("sequence(1, size(words) - n + 1)")).alias("start")
    return items.select("item_id", "words", "n", start).select("item_id", F.expr("slice(words, start, n)").alias("window")).distinct()


def _shingle(words: str, at: str, width: int) -> Column:
    """Hash of ``width`` words from the place ``at``, counted from 0; shorter at the end of the words."""
    return F.xxhash64(*[F.expr(f"get({words}, {at} + {k})") for k in range(width)])


def prefixes(held: DataFrame) -> DataFrame:
    """hash, width, place, window, window_id: each distinct window under its rarest shingle."""
    each = held.select("window").distinct().withColumn("width", F.least(F.size("window"), F.lit(SHINGLE)))
    place = F.explode(F.expr("sequence(0, size(window) - width)")).alias("place")
    shingles = each.select("window", "width", place)
    shingles = shingles.withColumn("text", F.expr("array_join(slice(window, place + 1, width), ' ')"))
    holds = shingles.groupBy("text").agg(F.countDistinct("window").alias("holds"))
    order = F.struct("holds", (-F.length("text")).alias("shorter"), "text", "place")
    first = shingles.join(holds, "text").groupBy("window", "width").agg(F.min(order).alias("f"))
    first = first.select("window", "width", F.col("f.place").alias("place"), F.xxhash64("window").alias("window_id"))
    hashed = F.when(F.col("width") == 1, _shingle("window", "place", 1)).when(F.col("width") == 2, _shingle("window", "place", 2))
    return first.withColumn("hash", hashed.otherwise(_shingle("window", "place", 3)))


def _positions(worded: DataFrame, widths: list[int], *carry: str) -> DataFrame:
    """A row for each word of a document (one without place for an empty one) and its hashed shingles."""
    rows = worded.select("doc_id", "mark", "n_words", "words", F.posexplode_outer("words").alias("at", "word"))
    shingles = [_shingle("words", "at", k) for k in widths]
    if len(shingles) == 1:
        return rows.select("doc_id", "mark", "n_words", *carry, "at", shingles[0].alias("hash"), F.coalesce(F.col("at") == 0, F.lit(True)).alias("first"))
    every = F.posexplode(F.array(*shingles)).alias("k", "hash")
    rows = rows.select("doc_id", "mark", "n_words", *carry, "at", every)
    return rows.withColumn("first", F.coalesce(F.col("at") == 0, F.lit(True)) & (F.col("k") == 0)).drop("k")


_EQUAL = "slice(words, start + 1, size(window)) = window"
_INSIDE = "start >= 0 AND start + size(window) <= n_words"


def _occurrences_by_broadcast(worded: DataFrame, table: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, mark, n_words, start, size, window_id; one row without start for each document."""
    entry = F.struct("place", "window", "window_id").alias("entry")
    grouped = table.groupBy("hash").agg(F.collect_list(entry).alias("entries"))
    met = _positions(worded, widths, "words").join(F.broadcast(grouped), "hash", "left")
    met = met.where(F.col("first") | F.col("entries").isNotNull())
    nothing = F.expr("CAST(array(NULL) AS array<struct<place:int,window:array<string>,window_id:bigint>>)")
    listed = F.when(F.col("first"), F.concat(nothing, F.coalesce("entries", F.slice(nothing, 1, 0)))).otherwise(F.col("entries"))
    rows = met.select("doc_id", "mark", "n_words", "words", "at", F.explode(listed).alias("e"))
    rows = rows.select("doc_id", "mark", "n_words", "words", (F.col("at") - F.col("e.place")).alias("start"), "e.window", "e.window_id")
    rows = rows.where(f"window_id IS NULL OR ({_INSIDE} AND {_EQUAL})")
    return rows.select("doc_id", "mark", "n_words", F.expr("IF(window_id IS NULL, NULL, start)").alias("start"), F.size("window").alias("size"), "window_id")


def _occurrences_by_shuffle(worded: DataFrame, table: DataFrame, widths: list[int]) -> DataFrame:
    """The same rows without any broadcast: narrow candidates first, then the texts of their documents."""
    places = _positions(worded, widths).where("hash IS NOT NULL AND at IS NOT NULL").select("doc_id", "mark", "n_words", "at", "hash")
    slot = F.pmod("hash", F.lit(SLOTS))
    known = table.select(slot.cast("int").alias("slot")).distinct()
    places = places.withColumn("slot", slot.cast("int")).join(F.broadcast(known), "slot", "left_semi")
    candidates = places.join(table.select("hash", "place", "window", "window_id"), "hash")
    candidates = candidates.withColumn("start", F.col("at") - F.col("place")).where(_INSIDE)
    candidates = candidates.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "start", "window", "window_id").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    there = worded.join(candidates, same).where(_EQUAL)
    found = there.select("doc_id", "mark", "n_words", "start", F.size("window").alias("size"), "window_id")
    alone = [F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("window_id")]
    return found.unionByName(worded.select("doc_id", "mark", "n_words", *alone))


def judge(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, n_hit, n_items, items (sorted text of the ids), contaminated of every row."""
    held = cut(windows(benchmark))
    table = cut(prefixes(held))
    sizes = table.agg(
        F.sum(F.octet_length(F.array_join("window", " ")) + 16 * F.size("window") + 64).alias("bytes"), F.sort_array(F.collect_set("width")).alias("widths")
    ).first()
    widths = sizes["widths"] or [SHINGLE]
    texts = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mark"), plain_words(F.col("text")).alias("words"))
    worded = texts.select("doc_id", "mark", "words", F.size("words").cast("long").alias("n_words"))
    small = (sizes["bytes"] or 0) <= broadcast_bytes
    found = (_occurrences_by_broadcast if small else _occurrences_by_shuffle)(worded, table, widths)

    once = found.groupBy("doc_id", "mark", "n_words", "start", "size", "window_id").agg(F.count("*").alias("times"))
    hit = F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("end"), "window_id"))
    copies = F.max(F.when(F.col("start").isNull(), F.col("times"))).alias("copies")
    whole = cut(once.groupBy("doc_id", "mark", "n_words").agg(copies, F.collect_list(hit).alias("hits")))

    union = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["end"], h["start"]))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    ).alias("n_hit")
    struck = whole.where(F.size("hits") > 0)
    met = struck.select("doc_id", "mark", F.explode(F.array_distinct(F.col("hits.window_id"))).alias("window_id"))
    of_window = held.select(F.xxhash64("window").alias("window_id"), F.col("item_id").cast("string").alias("item_id"))
    items = met.join(of_window, "window_id").groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    items = items.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "ids")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    each = whole.select("doc_id", "mark", "n_words", union, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    full = each.join(items, same, "left")
    return full.select(
        "doc_id", "mark", "n_words", "n_hit",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, of documents that are not contaminated."""
    names = docs.columns
    who, what = (f"c{position_of(names, n)}" for n in ("doc_id", "text"))
    bad = judge(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    bad = broadcast_if_small(cut(bad.distinct()))
    same = F.col(who).eqNullSafe(F.col("d")) & (F.xxhash64(what) == F.col("m"))
    return numbered(docs).join(bad, same, "left_anti").toDF(*names)
