"""Published tokenizer files read on the driver; executors get them as one broadcast of a fixed size."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import regex


def byte_letters() -> dict[int, str]:
    """The public byte alphabet: visible Latin-1 characters stand for themselves, other bytes for 256 and up in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Code points (first, last) that this box's pattern library counts as letters or numbers and the published files'
#: library, which holds the tables of Unicode 16, does not.
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))


def _set(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


#: Letters, numbers and white space below U+0250, and the blocks of punctuation that stand beside them.
EARLY = {r"\p{L}": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"\p{N}": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\p{White_Space}": "\t-\r \u0085\u00a0"}
LATE = "[^\0-\u024f\u2010-\u2027\u2030-\u205e]"


def _early(pattern: str) -> Callable[[str], list[str]]:
    """The pattern for texts without ``LATE`` characters, for the library that knows no properties and is faster."""
    written = pattern.replace(r"\P{White_Space}", "[^" + EARLY[r"\p{White_Space}"] + "]")
    # Inside a class a property is its ranges; outside it is a class of its own.
    parts = re.split(r"(\[[^\]]*\])", written)
    for name, ranges in EARLY.items():
        parts = [p.replace(name, ranges if k % 2 else f"[{ranges}]") for k, p in enumerate(parts)]
    return re.compile("".join(parts)).findall


def finder(pattern: str) -> Callable[[str], list[str]]:
    """Finds all matches of a pattern in which letters and numbers are those of Unicode 16; texts without newer ones take the plain pattern."""
    exact = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{_set(NEWER_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_set(NEWER_NUMBERS)}]]")
    plain, careful = regex.compile(pattern).findall, regex.compile("(?V1)" + exact).findall
    newer = re.compile(f"[{_set(NEWER_LETTERS + NEWER_NUMBERS)}]").search
    early, late = _early(pattern), re.compile(LATE).search
    return lambda text: early(text) if text.isascii() or not late(text) else plain(text) if not newer(text) else careful(text)


@dataclass(frozen=True)
class Vocabulary:
    """Ids by written token, merges in order, special tokens by text, and the mark that ends a word."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    word_end: str

    def special_pattern(self) -> regex.Pattern | None:
        """Finds special tokens in a raw text, the longest first."""
        if not self.special:
            return None
        return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-pair vocabulary from its JSON file."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model = held["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-pair vocabulary")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in held.get("added_tokens") or []}
    return Vocabulary(dict(model["vocab"]), merges, special, model.get("end_of_word_suffix") or "")
