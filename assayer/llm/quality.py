"""Quality classifier from positive and unlabelled texts.

Trusted positives are rows labelled 1; every other row of the learning folds is
unlabelled web text, whatever its label. A logistic model over a fixed list of
text measures and over hashed three-byte grams, which carry the wording, minimises
the non-negative unbiased risk: the positive part, plus
the unlabelled part freed of its positives and never let below zero. The share
of positives among the unlabelled is estimated from the scores of first models
that tell the two samples apart, each fitted on one half and read on the other,
by the best bin over all thresholds.

The fit reads a bounded sample of rows, chosen by a hash of their id and text, and
runs on the driver; the model is about a thousand numbers. Scores use every character of
every text. Defined results: null and empty texts get the score of a text whose
features are all zero; without a positive every score is 0; several labels of
one id count as positive if one of them is 1, and labels without an id are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import broadcast_if_small, cut, held_out, map_texts, pick

#: About so many positives and so many unlabelled rows are read for the fit.
FIT_ROWS = 12_000
THRESHOLD = 0.7
STEPS, RATE, BATCH, SEED, DECAY = 1200, 0.02, 512, 7, 1.0
SYMBOLS = "#*$%&|<>~^=_{}[]\\@+"
MEASURES = 20
#: Buckets of three-byte grams, and the weight of their shares beside standardised measures.
GRAMS, GRAM_WEIGHT = 512, 3.0


def measures(text: str | None) -> list[float]:
    """The measures of one whole text; all zero for an empty one."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * MEASURES
    letters = size - text.count(" ") - text.count("\n")
    lines = [x for x in text.split("\n") if x.strip()]
    raised = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    adjacent = sum(map(str.__eq__, words[1:], words))
    counts = {c: text.count(c) for c in SYMBOLS}
    return [
        1.0,
        math.log1p(n),
        math.log1p(size) ** 2 / 50,
        letters / n,
        math.log1p(max(map(len, words))),
        raised / n,
        plain / n,
        len(set(words)) / n,
        math.log1p(100 * adjacent / n),
        math.log1p(100 * sum(counts.values()) / n),
        math.log1p(100 * counts["|"] / n),
        math.log1p(100 * text.count("!") / n),
        math.log1p(100 * (counts["*"] + counts["#"]) / n),
        math.log1p(100 * (counts["$"] + counts["%"] + counts["&"]) / n),
        math.log1p(100 * (counts["<"] + counts[">"] + counts["{"] + counts["}"]) / n),
        math.log1p(100 * sum(map(text.count, "0123456789")) / n),
        math.log1p(100 * (text.count(".") + text.count("?")) / n),
        math.log1p(100 * text.count(",") / n),
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
    ]


def gram_shares(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed three-byte grams of the lowered text; all zero for fewer than three bytes."""
    held = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(held) < 3:
        return np.zeros(GRAMS)
    mixed = (held[:-2] * np.uint32(0x9E3779B1) + held[1:-1]) * np.uint32(0x85EBCA6B) + held[2:]
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return np.sqrt(np.bincount((mixed >> np.uint32(16)) % np.uint32(GRAMS), minlength=GRAMS) / len(mixed))


def features(texts: list[str | None]) -> np.ndarray:
    """A row of measures and gram shares for each text."""
    rows = [np.concatenate((measures(t), gram_shares(t))) for t in texts]
    return np.array(rows, dtype=np.float32).reshape(len(rows), MEASURES + GRAMS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _spread(raw: np.ndarray, middle: np.ndarray, width: np.ndarray) -> np.ndarray:
    """A constant, standardised measures, clipped, with their squares, and weighted gram shares."""
    x = np.clip((raw[:, :MEASURES] - middle) / width, -6, 6)
    return np.hstack([np.ones((len(x), 1)), x, x * x / 4, GRAM_WEIGHT * raw[:, MEASURES:]]).astype(np.float32)


def _adam(size: int, gradient, decay: float, steps: int = STEPS) -> np.ndarray:
    """Weights after ``steps`` of Adam on a noisy gradient; all but the constant decay."""
    w, m, v, rest = (np.full(size, x, dtype=np.float32) for x in (0, 0, 0, 1))
    rest[0] = 0.0
    for t in range(1, steps + 1):
        g = gradient(w) + decay * rest * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the tails of both score samples, with a margin for chance."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    tail_p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    tail_u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    margin = math.sqrt(math.log(40) / (2 * len(positive))) + math.sqrt(math.log(40) / (2 * len(unlabelled)))
    useful = tail_p >= 0.05
    bound = (tail_u[useful] + margin) / tail_p[useful]
    best = np.argmin(bound)
    return float(np.clip(tail_u[useful][best] / tail_p[useful][best], 0.01, 0.99))


class Model:
    """Non-negative positive-unlabelled logistic model."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray) -> None:
        self.weights = None
        if not len(positive):
            return
        both = np.vstack([positive, unlabelled]) if len(unlabelled) else positive
        plain = both[:, :MEASURES].astype(np.float64)
        self.middle, self.width = plain.mean(axis=0), plain.std(axis=0) + 1e-6
        p = _spread(positive, self.middle, self.width)
        u = _spread(unlabelled if len(unlabelled) else positive, self.middle, self.width)
        random = np.random.default_rng(SEED)
        some = lambda rows: rows[random.integers(0, len(rows), BATCH)]
        mean = lambda rows, scale: scale.astype(np.float32) @ rows / len(rows)

        decay = lambda rows: 1e-4 + DECAY / len(rows)

        def told_apart(p: np.ndarray, u: np.ndarray) -> np.ndarray:
            def gradient(w: np.ndarray) -> np.ndarray:
                a, b = some(p), some(u)
                return mean(a, _sigmoid(a @ w) - 1) + mean(b, _sigmoid(b @ w))

            return _adam(p.shape[1], gradient, decay(p), STEPS // 2)

        scored: list[tuple[np.ndarray, np.ndarray]] = []
        for k in (0, 1):
            mine, other = (p[k::2], u[k::2]), (p[1 - k :: 2], u[1 - k :: 2])
            if all(map(len, mine + other)):
                w = told_apart(*mine)
                scored.append((other[0] @ w, other[1] @ w))
        self.prior = prior = float(np.mean([estimate_prior(*s) for s in scored])) if scored else 0.5

        def risk(w: np.ndarray) -> np.ndarray:
            a, b = some(p), some(u)
            yes, no, other = _sigmoid(a @ w), np.logaddexp(0, a @ w).mean(), np.logaddexp(0, b @ w).mean()
            negative = mean(b, _sigmoid(b @ w)) - prior * mean(a, yes)
            if other - prior * no < 0:
                return -negative
            return prior * mean(a, yes - 1) + negative

        self.weights = _adam(p.shape[1], risk, decay(p))

    def score(self, texts: list[str | None]) -> list[float]:
        """Chance of label 1 for each text."""
        if self.weights is None:
            return [0.0] * len(texts)
        return _sigmoid(_spread(features(texts), self.middle, self.width) @ self.weights).tolist()


def _share(of: int, fit_rows: int, *columns: str) -> Column:
    """Whether a row belongs to the ``fit_rows`` of so many that a hash of its columns picks."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(*columns, F.lit("fit")), F.lit(steps)) < min(steps, int(steps * fit_rows / max(1, of)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Model from the learning folds of ``docs`` and the column quality of ``labels``.

    About ``fit_rows`` positive and as many unlabelled rows are read; ids that occur
    on many rows are thinned once more by id and text, so the bound is one of rows.
    """
    good = pick(labels, "doc_id", "quality").where((F.col("quality") == 1) & ~held_out(F.col("doc_id")))
    good = good.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = pick(docs, "doc_id", "text").where(~held_out(F.col("doc_id")))
    n_good, n_rows = good.count(), rows.select("doc_id").count()
    chosen = broadcast_if_small(cut(good.where(_share(n_good, fit_rows, "doc_id"))))
    n_trusted = rows.select("doc_id").join(chosen, "doc_id", "left_semi").count()
    marked = rows.join(chosen.withColumn("trusted", F.lit(True)), "doc_id", "left")
    trusted = F.coalesce("trusted", F.lit(False)) & _share(n_trusted, fit_rows, "doc_id", "text")
    marked = marked.select("text", trusted.alias("trusted"), _share(n_rows, fit_rows, "text", "doc_id").alias("web")).where("trusted OR web")
    read = map_texts(marked, lambda: lambda texts: {"f": [x.tobytes() for x in features(texts)]}, "f binary", ("trusted", "web")).toArrow().to_pylist()
    read.sort(key=lambda r: (r["f"], r["trusted"], r["web"]))
    side = lambda name: np.frombuffer(b"".join(r["f"] for r in read if r[name]), dtype=np.float32).reshape(-1, MEASURES + GRAMS)
    return Model(side("trusted"), side("web"))


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_texts(pick(docs, "doc_id", "text"), lambda: lambda texts: {"score": shared.value.score(texts)}, "score double")
    verdict = F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", verdict)
