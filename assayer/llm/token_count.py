"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string that ends a word is run through
the merges once; those that come out as a single token are proven to count as
one. While counting, a pre-token found in that table is one token at once and
only the rest is merged. Counts of merged words are remembered in a table of
bounded size in each Python worker.

The text is treated as the published file says: special strings are cut out of
the raw text and count one each; the rest is composed (NFC), letters are lowered
one by one, and the pre-token pattern is applied. A null text counts as empty: no bytes, no tokens.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

from pyspark.sql import DataFrame

from assayer.llm.base import map_texts, pick
from assayer.llm.vocabulary import Vocabulary, byte_letters, finder

#: Fixed value: the pre-token pattern of the published word vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Capital letters, with their small ones, of newer Unicode tables than Python's; the published file's library lowers them.
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_HAS_NEWER = re.compile("[" + "".join(map(chr, NEWER)) + "]").search
#: Words remembered by a worker, and the longest remembered word.
MEMORY, MEMORY_WORD = 400_000, 40
#: From so many symbols on a heap finds the next merge.
LONG_WORD = 48
NEVER = 1 << 60


class Merger:
    """Merges the symbols of one word, always the earliest rule and the leftmost place."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.rank = {pair: k for k, pair in reversed(list(enumerate(vocabulary.merges)))}
        self.letters = byte_letters()
        self.end = vocabulary.word_end

    def symbols(self, word: str) -> list[str]:
        found = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        found[-1] += self.end
        return found

    def count(self, word: str) -> int:
        """Tokens of a word that is not empty."""
        parts = self.symbols(word)
        if len(parts) > LONG_WORD:
            return self._count_long(parts)
        rank = self.rank.get
        open_pairs = [rank(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
        while open_pairs and (least := min(open_pairs)) < NEVER:
            k = open_pairs.index(least)
            parts[k] += parts.pop(k + 1)
            del open_pairs[k]
            if k < len(open_pairs):
                open_pairs[k] = rank((parts[k], parts[k + 1]), NEVER)
            if k:
                open_pairs[k - 1] = rank((parts[k - 1], parts[k]), NEVER)
        return len(parts)

    def _count_long(self, parts: list[str]) -> int:
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        rank = self.rank.get
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := rank((parts[k], parts[k + 1]), NEVER)) < NEVER]
        heapq.heapify(heap)
        left = len(parts)
        while heap:
            _, k, first, second = heapq.heappop(heap)
            n = after[k]
            if n < 0 or parts[k] != first or parts[n] != second:
                continue
            parts[k], parts[n] = first + second, ""
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            after[n] = -1
            left -= 1
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := rank((parts[a], parts[b]), NEVER)) < NEVER:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return left


def whole_tokens(vocabulary: Vocabulary) -> set[str]:
    """The texts of all vocabulary strings that are proven to encode alone as one token."""
    merger = Merger(vocabulary)
    back = {c: b for b, c in merger.letters.items()}
    proven = set()
    for written in vocabulary.ids:
        if not written.endswith(vocabulary.word_end) or not (bare := written[: len(written) - len(vocabulary.word_end)]):
            continue
        try:
            text = bytes(back[c] for c in bare).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if merger.count(text) == 1:
            proven.add(text)
    return proven


class Counter(dict):
    """Tokens by word; a word that is missing is merged and, up to the bound, remembered."""

    def __init__(self, vocabulary: Vocabulary, whole: set[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merger = whole, Merger(vocabulary)
        self.cut, self.special = vocabulary.special_pattern(), vocabulary.special
        self.find = finder(PRE_TOKEN)

    def __missing__(self, word: str) -> int:
        n = self.merger.count(word)
        if len(word) <= MEMORY_WORD:
            if len(self) >= MEMORY + len(self.whole):
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[word] = n
        return n

    def normal(self, text: str) -> str:
        """The text as the pre-token pattern sees it; white space only separates pre-tokens, so it stays as it is."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _HAS_NEWER(text):
                text = text.translate(NEWER)
        return text.lower()

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        total, rest = 0, [text]
        if self.cut and any(s in text for s in self.special):
            rest = self.cut.split(text)
            total, rest = len(rest) // 2, rest[::2]
        get = self.__getitem__
        return total + sum(sum(map(get, self.find(self.normal(part)))) for part in rest)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, limit: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, whole_tokens(vocabulary)))

    def make():
        counter = _counter(shared)

        def score(texts: list) -> dict[str, list]:
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            counts = [counter.count(t) for t in texts]
            return {"n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return score

    return map_texts(pick(docs, "doc_id", "text"), make, "n_bytes long, n_tokens long, over_limit boolean")


_held: list = [None, None]


def _counter(shared) -> Counter:
    """The counter of this worker process; tasks that follow one another share its memory."""
    if _held[0] is not shared.value:
        _held[:] = shared.value, Counter(*shared.value)
    return _held[1]
