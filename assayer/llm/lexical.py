"""Ranked lexical search over postings dealt by buckets of terms, exact in whole numbers.

A posting says that a document holds a term so many times. Postings carry the bucket
of their term and a slice of their document and lie together by both, so a common
term is spread over many tasks and a rare one stays in few. Only terms that some
query item holds get postings where these terms are measured to be few; otherwise all do.

The postings are a table in the shared folder, sorted by bucket and term, so a search
reads only what its terms need. Every match of an item's term is scored, scores are
summed by item and document, and ranks are a window over each item of which each task
first keeps its own best. Postings are dealt by document before the terms of the items
meet them by broadcast, so neither a common term nor a popular item gathers in one task;
items too many to be broadcast meet the postings in a shuffle on the term.

Defined results: a row is a document, so rows that repeat an id are ranked one after
the other, and a null id comes last among equal scores; null and empty texts hold no
term and count nowhere; items of equal item_id are one item with all their terms; an
item without id or without a term that any document holds has no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.base import broadcast_if_small, cut, is_small, pick, slices, table
from assayer.llm.native_text import LOWER, UPPER, WORD, plain_words

TOP, BUCKETS, SLICES = 10, 256, 16
#: Fixed values of the score.
GAIN, FLOOR, SPAN = 1_000_000_000, 10, 90


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each pair once."""
    rows = pick(items, "item_id", "text").where(F.col("item_id").isNotNull())
    return rows.select("item_id", F.explode(plain_words(F.col("text"))).alias("term")).distinct()


def postings(docs: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """bucket, slice, term, row (number of a document), doc_id, n (its terms) and tf; ``wanted`` leaves out all other terms.

    Rows without a term are sums of a task: n terms in tf documents that have any.
    """
    numbered = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = dict(numbered.dtypes)["doc_id"]
    told = numbered.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, lower, keep = re.compile(WORD).finditer, str.maketrans(UPPER, LOWER), told.value
        filled = length = 0
        names = ["row", "doc_id", "term", "n", "tf"]
        types = [pa.int64(), None, pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            types[1] = batch.schema.field("doc_id").type
            for part in slices(batch):
                out: list[list] = [[], [], [], [], []]
                ids = part.column("doc_id").to_pylist()
                for row, doc_id, text in zip(part.column("row").to_pylist(), ids, part.column("text").to_pylist(), strict=True):
                    # Texts are walked match by match, so the words of a long one are never held at once.
                    held = Counter(map(re.Match.group, find((text or "").translate(lower)))) if text else {}
                    n = sum(held.values())
                    filled, length = filled + (n > 0), length + n
                    for term in held if keep is None else held.keys() & keep:
                        for column, value in zip(out, (row, doc_id, term, n, held[term]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
        if filled:
            alone = [None, None, None, length, filled]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(alone, types, strict=True)], names=names)

    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    piece = F.coalesce(F.pmod(F.xxhash64("row"), F.lit(SLICES)), F.lit(0)).cast("int").alias("slice")
    found = numbered.mapInArrow(run, f"row long, doc_id {kind}, term string, n long, tf long")
    return found.select(bucket, piece, "*").repartition("bucket", "slice")


def _impact(documents: int, terms: int) -> Column:
    """What one unit of weight earns in a document of ``n`` terms of which ``tf`` are the term."""
    spread = f"{FLOOR}L + (({SPAN}L * n * {documents}L) div {max(terms, 1)}L)"
    return F.expr(f"({GAIN}L * tf) div (1000L * tf + 8L * ({spread}))").alias("impact")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of every item."""
    wanted = cut(item_terms(items))
    few = {r["term"] for r in wanted.select("term").distinct().collect()} if is_small(wanted) else None
    held = table(postings(docs, few).sortWithinPartitions("bucket", "term", "row"))
    sums = held.where("term IS NULL").agg(F.sum("n").alias("terms"), F.sum("tf").alias("documents")).first()
    documents, terms = sums["documents"] or 0, sums["terms"] or 0

    holders = held.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).alias("weight")
    asked = cut(wanted.join(holders, "term").select("item_id", "term", weight))
    # Dealt by document, all matches of a document meet in its task, and sums need no further shuffle.
    each = held.where("term IS NOT NULL").repartition("row").select("term", "row", "doc_id", _impact(documents, terms))
    matched = each.join(broadcast_if_small(asked), "term")
    total = matched.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return total.select("item_id", place.cast("int").alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
