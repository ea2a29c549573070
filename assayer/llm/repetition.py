"""Quality rules on repetition, with suffix arrays over words.

Words are runs of anything but the six ASCII white-space characters. Every text gets
a suffix array by prefix doubling over its word numbers; the longest common prefixes
of neighbouring suffixes delimit intervals, and an interval that can be extended
neither to the right nor to the left is a maximal repeated substring. The union of
the spans of repeats of at least ``LEAST`` words must not cover more than
``MOST_COVERED`` of the words, and no repeat may exceed ``LONGEST`` words. The words in
five-word windows found twice come from the same array: a window is found twice
if a repeat of five words or more starts where it does.

A null or empty text has no word, so it fails the base rule. Lines are cut at
line feeds only; a line equals an earlier one if all its characters do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from assayer.llm.base import map_texts, pick

WINDOW = 5
LEAST, MOST_COVERED, LONGEST = 8, 0.15, 60
FEWEST_WORDS, REPEAT_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"


def _union(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """Places covered by spans."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(inside: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the runs of marked places, cut where another text begins."""
    marked = np.where(inside, owner, -1)
    border = np.concatenate(([0], np.flatnonzero(np.diff(marked)) + 1, [len(marked)]))
    return [(s, e) for s, e in zip(border[:-1].tolist(), border[1:].tolist(), strict=True) if e > s and marked[s] >= 0]


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _double(levels: list[np.ndarray], limit: int | None = None) -> list[np.ndarray]:
    """Ranks of the prefixes of one, two, four ... words at each place, until all differ or the prefixes have ``limit`` words."""
    n = len(levels[0])
    levels = [*levels[:-1], _ranked(levels[-1])]
    while levels[-1].max() < n - 1 and (limit is None or 1 << (len(levels) - 1) < limit):
        step = 1 << (len(levels) - 1)
        follow = np.full(n, -1, dtype=np.int64)
        follow[: max(0, n - step)] = levels[-1][step:]
        levels.append(_ranked(levels[-1] * (n + 1) + follow + 1))
    return levels


def _neighbours(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and the words that each suffix has in common with the next, by descending through the lengths."""
    n = len(levels[0])
    order = np.argsort(levels[-1])
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + common, b + common
        there = (x < n) & (y < n)
        level = levels[k]
        equal = there & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])
        common += np.where(equal, 1 << k, 0)
    return order, common


def intervals(common: np.ndarray, least: int) -> np.ndarray:
    """Intervals (length, first, last) of the suffix array whose suffixes share at least ``least`` words, by a stack of open ones."""
    found: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int]] = []
    places = np.flatnonzero(common >= least)
    ends = np.append(np.diff(places) > 1, True).tolist() if len(places) else []
    for k, length, end in zip(places.tolist(), common[places].tolist(), ends, strict=True):
        first = k
        while waiting and waiting[-1][0] > length:
            held, first = waiting.pop()
            found.append((held, first, k))
        if not waiting or waiting[-1][0] < length:
            waiting.append((length, first))
        if end:
            found += [(held, first, k + 1) for held, first in reversed(waiting)]
            waiting.clear()
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def _maximal(words: np.ndarray, owner: np.ndarray, order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The intervals of repeats of at least ``LEAST`` words that cannot be extended to the left: words before them differ."""
    held = intervals(common, LEAST)
    before = np.where(np.diff(owner, prepend=-1) != 0, -1 - np.arange(len(words)), np.roll(words, 1))[order]
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    return held[changes[held[:, 2]] > changes[held[:, 1]]]


def repeats(words: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the words of the longest repeat of its text that starts there, and for each text its maximal repeats of at least ``LEAST`` words.

    Words count as equal only within one text. Texts whose repeats are short are done
    with the first few lengths; only the others go on.
    """
    found, n_maximal = np.zeros(len(words), dtype=np.int64), np.zeros(n_texts, dtype=np.int64)
    if not len(words):
        return found, n_maximal
    levels = _double([owner * (int(words.max()) + 1) + words], LEAST)
    long = np.zeros(n_texts, dtype=bool)
    long[owner[np.bincount(levels[-1])[levels[-1]] > 1]] = True
    for mine, deep in ((~long[owner], False), (long[owner], True)):
        if not mine.any():
            continue
        part = [x[mine] for x in levels]
        order, common = _neighbours(_double(part) if deep else part)
        longest = np.zeros(len(order), dtype=np.int64)
        np.maximum.at(longest, order[:-1], common)
        np.maximum.at(longest, order[1:], common)
        found[mine] = longest
        if deep:
            maximal = _maximal(words[mine], owner[mine], order, common)
            n_maximal += np.bincount(owner[mine][order[maximal[:, 1]]], minlength=n_texts)
    return found, n_maximal


def measure(texts: list[str | None]) -> dict[str, list]:
    """Base figures, repeat figures, spans and verdicts of whole texts."""
    plain = [t or "" for t in texts]
    split = [t.encode("utf-8", "surrogatepass").split() for t in plain]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    total = int(sizes.sum())
    flat = np.empty(total, dtype=object)
    flat[:] = [w for words in split for w in words]
    words = pd.factorize(flat)[0].astype(np.int64) if total else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(plain)), sizes)
    lengths, n_maximal = repeats(words, owner, len(plain))
    within = lambda least, width: _union(at := np.flatnonzero(lengths >= least), width(at), total)
    n_repeat = np.bincount(owner, weights=within(WINDOW, lambda at: np.full(len(at), WINDOW)), minlength=len(plain)).astype(np.int64)
    inside = within(LEAST, lambda at: lengths[at])
    covered = np.bincount(owner, weights=inside, minlength=len(plain)).astype(np.int64)
    longest = np.zeros(len(plain), dtype=np.int64)
    np.maximum.at(longest, owner, lengths)
    spans: list[list[list[int]]] = [[] for _ in plain]
    first = np.concatenate(([0], np.cumsum(sizes)))
    for s, e in _runs(inside, owner):
        spans[owner[s]].append([int(s - first[owner[s]]), int(e - first[owner[s]])])
    n_words = sizes.tolist()
    failed = (sizes < FEWEST_WORDS) | (100 * n_repeat > REPEAT_PERCENT * sizes)
    limited = (covered > MOST_COVERED * sizes) | (longest > LONGEST)
    lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in plain]
    return {
        "n_words": n_words,
        "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in plain],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in plain],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": n_repeat.tolist(),
        "base_failed": failed.tolist(),
        "kept": (~failed & ~limited).tolist(),
        "covered_words": covered.tolist(),
        "longest_repeat": longest.tolist(),
        "n_maximal": n_maximal.tolist(),
        "spans": spans,
    }


FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long, n_maximal long"
)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, the verdict and the three repeat figures of every whole text."""
    return map_texts(pick(docs, "doc_id", "text"), lambda: measure, FIGURES)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (first word, word after the last) covered by repeats of at least ``LEAST`` words."""
    return map_texts(pick(docs, "doc_id", "text"), lambda: measure, "spans array<array<bigint>>")
