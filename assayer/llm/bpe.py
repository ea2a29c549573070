"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the tokens finds, in one pass over a piece, the
longest token, the longest after it, and so on; where neighbours are compatible
that is the result. Else the encoder takes the longest token, falls back to shorter tokens that begin it, and steps back
where none fits; a token may follow another only if the pair is compatible, that
is, if no merge rule would have joined pieces across their border before either
side was complete. Places found to be dead ends are never tried again, so the
work is linear, and the result is exactly that of the merges.

Decoding gathers the bytes of all ids from one buffer through a table of offsets.

The text is treated as the published file says: special strings in it become
their own ids; the rest is cut by the pre-token pattern. A null text is empty.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from assayer.llm.base import map_texts, pick
from assayer.llm.vocabulary import Vocabulary, byte_letters, finder

#: Fixed value: the pre-token pattern of the published byte vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces remembered by a worker, the longest remembered piece, and remembered pairs.
MEMORY, MEMORY_PIECE, MEMORY_PAIRS = 240_000, 40, 200_000


class Codec(dict):
    """Ids by piece, computed and, up to a bound, remembered when missing; pieces met again outlive the others.

    Tokens are numbered by the time they come about: single bytes first, then
    one token for each merge in order; ``public`` turns these into published ids.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        back = {c: b for b, c in byte_letters().items()}
        spell = lambda written: bytes(back[c] for c in written)
        number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.pairs: dict[tuple[int, int], int] = {}
        for first, second in vocabulary.merges:
            pair = number[spell(first)], number[spell(second)]
            joined = spell(first + second)
            if joined not in number:
                number[joined] = len(self.parts)
                self.parts.append(pair)
            self.pairs.setdefault(pair, number[joined])
        if any(p and max(p) >= k for k, p in enumerate(self.parts)):
            raise ValueError("a merge uses a token that comes about later")
        self.size = [0] * len(self.parts)
        for token, k in number.items():
            self.size[k] = len(token)
        public = {spell(w): i for w, i in vocabulary.ids.items() if w not in vocabulary.special}
        self.public = [0] * len(self.parts)
        for token, k in number.items():
            self.public[k] = public[token]
        self.fits: dict[int, bool] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        whole = {t: k for t, k in number.items() if self.stands_alone(k)}
        self.shorter = [-1] * len(self.parts)
        for token, k in whole.items():
            self.shorter[k] = next((whole[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in whole), -1)
        self.longest = ahocorasick.Automaton()
        for token, k in whole.items():
            self.longest.add_word(token.decode("latin-1"), k)
        self.longest.make_automaton()
        self.cut, self.special = vocabulary.special_pattern(), vocabulary.special
        self.find = finder(PRE_TOKEN)
        spelled = public | {s.encode(): i for s, i in vocabulary.special.items()}
        by_id = sorted((i, t) for t, i in spelled.items())
        sizes = np.zeros(by_id[-1][0] + 1, dtype=np.int64)
        for i, token in by_id:
            sizes[i] = len(token)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.buffer = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)
        self.names = [str(i) for i in range(len(sizes))]

    def crosses(self, left: int, right: int, join: int = -1) -> bool:
        """Whether merging would join the sides before both are complete; ``join`` is a token allowed to do so.

        The last part of the left side and the first part of the right side that
        exist at the same time form a pair. They stand until they merge with
        their own neighbour; on a tie the left place goes first.
        """
        left_end = right_end = len(self.parts)
        while True:
            made = self.pairs.get((left, right))
            if made is not None and made != join and made < left_end and made <= right_end:
                return True
            if left >= right and self.parts[left]:
                left_end, left = left, self.parts[left][1]
            elif self.parts[right]:
                right_end, right = right, self.parts[right][0]
            else:
                return False

    def stands_alone(self, token: int) -> bool:
        """Whether the bytes of a token encode as that token."""
        parts = self.parts[token]
        return parts is None or not self.crosses(*parts, join=token)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens may stand side by side."""
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= MEMORY_PAIRS:
                self.fits.clear()
            known = self.fits[pair] = not self.crosses(left, right)
        return known

    def pieces(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token that is not empty."""
        size, fits = self.size, self.fits
        letters = piece.decode("latin-1")
        # The longest tokens one after the other, as one pass finds them; where all may stand side by side, they are the result.
        found = [token for _, token in self.longest.iter_long(letters)]
        for k in range(1, len(found)):
            known = fits.get(found[k - 1] << 32 | found[k])
            if not (self.compatible(found[k - 1], found[k]) if known is None else known):
                break
        else:
            return found
        n = len(piece)
        dead = bytearray(n + 1)
        shorter, compatible, longest = self.shorter, self.compatible, self.longest.iter_long
        found, token = found[:k], found[k]
        place = sum([size[t] for t in found])
        while True:
            end = place + size[token]
            if not dead[end] and (not found or compatible(found[-1], token)):
                found.append(token)
                if end == n:
                    return found
                place, token = end, next(longest(letters, end))[1]
                continue
            token = shorter[token]
            while token < 0:
                dead[place] = 1
                token = found.pop()
                place -= size[token]
                token = shorter[token]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            public = self.public
            ids = tuple([public[k] for k in self.pieces(piece.encode("utf-8", "surrogatepass"))])
        if len(piece) <= MEMORY_PIECE:
            if 2 * len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Published ids of a whole text."""
        if not text:
            return []
        get = self.__getitem__
        if not (self.cut and any(s in text for s in self.special)):
            return list(chain.from_iterable(map(get, self.find(text))))
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(text)):
            ids.extend([self.special[part]] if k % 2 else chain.from_iterable(map(get, self.find(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of published ids; bytes that are no UTF-8 become replacement characters."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, dtype=np.int64)
        if ids.min() < 0 or ids.max() >= len(self.names):
            raise ValueError("an id is outside the vocabulary")
        start, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(start - (ends - sizes), sizes)
        return self.buffer[places].tobytes().decode("utf-8", "replace")


_held: list = [None, None]


def _codec(shared) -> Codec:
    """The codec of this worker process; tasks that follow one another share its memory."""
    if _held[0] is not shared.value:
        _held[:] = shared.value, Codec(shared.value)
    return _held[1]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        codec = _codec(shared)
        return lambda texts: {"ids": [codec.encode(t) for t in texts]}

    return map_texts(pick(docs, "doc_id", "text"), make, "ids array<bigint>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and decoded text of every row of doc_id and ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        codec = _codec(shared)
        return lambda lists: {"decoded": [codec.decode(ids or []) for ids in lists]}

    rows = pick(encoded, "doc_id", "ids").withColumnRenamed("ids", "text")
    return map_texts(rows, make, "decoded string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, both digested."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        codec = _codec(shared)

        def score(texts: list) -> dict[str, list]:
            found: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts:
                ids = codec.encode(text)
                found["n_tokens"].append(len(ids))
                found["ids_sha256"].append(hashlib.sha256(",".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
                found["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            return found

        return score

    return map_texts(pick(docs, "doc_id", "text"), make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
