"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of non-letters becomes one space, and the
grams of one to four characters are hashed into a fixed number of buckets. The
fit counts buckets by language with a distributed sum; the log-probability
matrix (buckets x languages, so of a size fixed by two parameters) is broadcast
and texts are scored in numpy by gathering and summing the rows of their grams.

Defined results: a null text or one without a letter is ``und`` with score 0;
with no labelled row at all every text is ``und``. Equal scores go to the
language that sorts first. Long texts go through numpy in pieces that continue each
other: the last code points of a piece lead the next one, so the grams are those
of the unsplit text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import held_out, map_texts, numbered, pick, position_of, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = 4
#: Characters that go through numpy at once; no result depends on it.
PIECE = 1 << 16
#: The fit reads about this many labelled documents of each language, chosen by a hash of id and text; all if there are fewer.
TRAIN_DOCS = 20_000
#: More languages than this are refused, which bounds the broadcast matrix.
MOST_LANGUAGES = 256
#: The evidence of longer texts is scaled down to so many grams before the softmax.
EVIDENCE = 200.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), dtype=bool, count=0x110000)


SPACE = np.array([32], dtype=np.uint32)


class Stream(NamedTuple):
    """Folded code points of pieces of texts, with the row, the start and the length of the lead of each piece."""

    rows: list[int]
    points: np.ndarray
    starts: np.ndarray
    leads: np.ndarray
    letters: np.ndarray


def _folded(rows: list[int], parts: list[str], leads: list[np.ndarray], fresh: bool) -> Stream:
    """Non-letters folded to one space, each piece led by the points before it; the lead of a ``fresh`` piece is part of it."""
    points, at = [], 0
    starts, led = np.zeros(len(parts), dtype=np.int64), np.array([len(x) for x in leads], dtype=np.int64)
    for k, (part, lead) in enumerate(zip(parts, leads, strict=True)):
        points += [lead, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts[k] = at
        at += len(lead) + len(points[-1])
    joined = np.concatenate(points)
    letter = _letters()[joined]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for k in range(int(led.max())):
        keep[(starts + k)[led > k]] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    points_kept = np.where(letter, joined, np.uint32(32))[keep]
    return Stream(rows, points_kept, before[starts], np.zeros_like(led) if fresh else led, np.add.reduceat(letter, starts, dtype=np.int64))


def _streams(texts: list[str | None]) -> Iterator[Stream]:
    """The texts in groups of about ``PIECE`` characters; a longer text comes in pieces that continue each other."""
    rows: list[int] = []
    parts: list[str] = []
    room = PIECE
    for row, text in enumerate(texts):
        lowered = (text or "").lower()
        if len(lowered) > PIECE:
            lead, fresh = SPACE, True
            for start in range(0, len(lowered), PIECE):
                piece = _folded([row], [lowered[start : start + PIECE]], [lead], fresh)
                yield piece
                lead, fresh = piece.points[1 - ORDERS :], False
        elif lowered:
            rows.append(row)
            parts.append(lowered)
            room -= len(lowered)
            if room <= 0:
                yield _folded(rows, parts, [SPACE] * len(parts), True)
                rows, parts, room = [], [], PIECE
    if rows:
        yield _folded(rows, parts, [SPACE] * len(parts), True)


def _buckets(stream: Stream) -> Iterator[np.ndarray]:
    """For each order the bucket of the gram at each place, BUCKETS where it would leave its piece or lies in its lead."""
    points, sizes = stream.points, np.diff(np.append(stream.starts, len(stream.points)))
    inside = np.arange(len(points)) - np.repeat(stream.starts, sizes)
    left = np.repeat(sizes, sizes) - inside
    old = np.repeat(stream.leads, sizes) - inside
    state = np.zeros(len(points), dtype=np.uint32)
    for order in range(1, ORDERS + 1):
        shifted = np.zeros(len(points), dtype=np.uint32)
        shifted[: max(0, len(points) - order + 1)] = points[order - 1 :]
        state = state * np.uint32(0x9E3779B1) + shifted + np.uint32(order)
        mixed = state ^ (state >> np.uint32(15))
        mixed = mixed * np.uint32(0x85EBCA6B)
        bucket = (mixed >> np.uint32(16)).astype(np.int64)
        yield np.where((left >= order) & (old < order), bucket, BUCKETS)


def count_grams(texts: list[str | None], labels: list[str], into: dict[str, np.ndarray]) -> None:
    """Adds the bucket counts of each text to the vector of its label."""
    for stream in _streams(texts):
        sizes = np.diff(np.append(stream.starts, len(stream.points)))
        owner = np.repeat(np.array([labels[r] for r in stream.rows], dtype=object), sizes)
        of_name = {name: owner == name for name in {labels[r] for r in stream.rows}}
        for bucket in _buckets(stream):
            for name, mine in of_name.items():
                vector = into.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                vector += np.bincount(bucket[mine], minlength=BUCKETS + 1)[:BUCKETS]


class Model:
    """Languages in order, their log priors and the log-probability matrix with a last row of zeros."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float = 0.5) -> None:
        self.languages = languages
        total = counts.sum(axis=0, keepdims=True)
        logs = np.log(counts + alpha) - np.log(total + alpha * BUCKETS)
        self.matrix = np.vstack([logs, np.zeros((1, len(languages)))]).astype(np.float32)
        self.prior = np.log(docs + 1.0) - np.log(max(1.0, (docs + 1.0).sum()))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Best language and its probability for each text."""
        width = len(self.languages)
        likely = np.zeros((len(texts), width))
        grams, letters = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for stream in _streams(texts) if width else ():
            place = np.zeros((len(stream.points), width), dtype=np.float32)
            held = np.zeros(len(stream.points), dtype=np.int64)
            for bucket in _buckets(stream):
                place += self.matrix[bucket]
                held += bucket < BUCKETS
            np.add.at(likely, stream.rows, np.add.reduceat(place, stream.starts, axis=0, dtype=np.float64))
            np.add.at(grams, stream.rows, np.add.reduceat(held, stream.starts))
            np.add.at(letters, stream.rows, stream.letters)
        if not width:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        scaled = likely * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1.0))[:, None] + self.prior
        scaled -= scaled.max(axis=1, keepdims=True)
        chance = np.exp(scaled)
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        known = letters > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.where(known, chance[np.arange(len(texts)), best], 0.0).tolist()


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Model from the rows with a label outside the held-out fold.

    About ``train_docs`` of each language are read, all if there are fewer: those
    whose hashed id and text fall under the share that one count of the labelled
    rows gives for the language, so a rare language is learnt however large the
    table is. Equal rows share a hash, so copies go in or stay out together.
    """
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(totals)
    steps = 1 << 30
    code = {n: k for k, n in enumerate(languages)}
    shares = [x for n in languages for x in (F.lit(n), F.lit(min(steps, int(steps * train_docs / totals[n]))))]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    share = F.element_at(F.create_map(*shares), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                count_grams(part.column("text").to_pylist(), part.column("lang").to_pylist(), into)
        for lang, vector in into.items():
            there = np.flatnonzero(vector)
            columns = [pa.array(there * len(code) + code[lang], pa.int32()), pa.array(vector[there])]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "n"])

    summed = sample.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    counts = np.zeros(BUCKETS * len(languages))
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return Model(languages, counts.reshape(BUCKETS, -1), np.array([totals[n] for n in languages], dtype=float))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def score(texts: list) -> dict[str, list]:
            names, chances = shared.value.score(texts)
            return {"lang_pred": names, "score": chances}

        return score

    scored = map_texts(pick(docs, "doc_id", "text"), make, "lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose language is known, if wanted with a score of at least ``least``; ``und`` goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text = f"c{position_of(names, 'text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found, chances = shared.value.score(part.column(text).to_pylist())
                yield part.filter(pa.array([f != UNKNOWN and c >= least for f, c in zip(found, chances, strict=True)], pa.bool_()))

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*names)
