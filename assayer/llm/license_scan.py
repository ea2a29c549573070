"""Licence scan: an Aho-Corasick automaton over notice phrases and a parser of licence expressions.

A text is lowered (A-Z) and cut into words of letters, digits and non-ASCII
characters. One automaton finds every place of the notice phrases, aligned to
words; the three base phrases are counted and placed. Identifier tags are found
in the raw text by the same kind of automaton; the expression behind a tag is
parsed by a shunting-yard parser with the precedence ``with`` > ``and`` > ``or``.

``labels`` holds the labels of base phrases, other notice phrases and tagged
expressions. ``score`` is the share of the found licence claims that an open
policy allows: an ``and`` needs both sides, an ``or`` one of them, ``with`` keeps
the verdict of its left side; 0 without any claim. Tags count in any case of their
letters. Null and empty texts have no word and no claim. What follows a complete
expression on its line is no part of it; a tag without one, or with an operator that
nothing follows, adds nothing.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from assayer.llm.base import map_texts, pick

#: The base phrases with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice phrases of other widely used licences, in their own words, with labels.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license v3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license v2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "gnu free documentation license": "gfdl",
    "mozilla public license version 1": "mpl-1",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license v 2": "mpl-2",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "redistribution and use in source and binary forms": "bsd",
    "under the bsd license": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "the mit license mit": "mit",
    "under the apache license": "apache-2",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "under the isc license": "isc",
    "boost software license": "bsl-1",
    "the origin of this software must not be misrepresented": "zlib",
    "python software foundation license": "psf",
    "artistic license 2": "artistic-2",
    "sil open font license": "ofl",
    "microsoft public license": "ms-pl",
    "do what the fuck you want to public license": "wtfpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "cc0 1 0 universal": "cc0",
    "cc by 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution 4": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "open database license": "odbl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "all rights reserved": "all-rights-reserved",
}
#: Families of tag identifiers: an identifier belongs to the longest one that it is or that it begins with before "-" or ".".
FAMILIES = {
    "mit": "mit", "mit-0": "mit", "x11": "mit", "apache-1": "apache-1", "apache-2": "apache-2", "gpl-1": "gpl-1", "gpl-2": "gpl-2", "gpl-3": "gpl-3",
    "lgpl": "lgpl", "agpl-1": "agpl-1", "agpl-3": "agpl-3", "gfdl": "gfdl", "mpl-1": "mpl-1", "mpl-2": "mpl-2", "epl": "epl", "eupl": "eupl", "cddl": "cddl",
    "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "bsl-1": "bsl-1", "psf": "psf", "python": "psf", "artistic-1": "artistic-1", "artistic-2": "artistic-2",
    "ofl": "ofl", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "wtfpl": "wtfpl", "unlicense": "unlicense", "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa",
    "cc-by-nd": "cc-by-nd", "cc-by-nc": "cc-by-nc", "odbl": "odbl", "sspl": "sspl", "busl": "busl", "elastic": "elastic", "ncsa": "ncsa", "postgresql": "postgresql",
}
ALLOWED = frozenset(
    "mit apache-1 apache-2 bsd isc zlib bsl-1 psf artistic-2 ncsa postgresql cc-by cc0 unlicense public-domain wtfpl ofl mpl-2 ms-pl".split()
)
TAGS = ("spdx-license-identifier:", "license-expression:")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_SEPARATE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SYMBOL = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: White space within the line, then a symbol.
_NEXT = re.compile(r"[^\S\n]*(" + _SYMBOL.pattern + ")")


def parse_expression(text: str) -> list[str] | None:
    """The expression in postfix order, or None if it is not well formed."""
    output: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for symbol in _SYMBOL.findall(text):
        word = symbol.lower()
        if word in PRECEDENCE:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[word]:
                output.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        elif word == "(":
            if not operand_next:
                return None
            waiting.append(word)
        elif word == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                return None
            output.append(word)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return output + waiting[::-1]


def expression_at(text: str, at: int) -> list[str] | None:
    """Postfix order of the longest well-formed expression from a place on, None if there is none or what can be read ends behind an operator.

    Reading stops at the end of the line, at the first character that is neither white
    space nor part of a symbol (a comma, a quote, the end of a comment), and at the first
    symbol that cannot continue the expression (prose, a bracket, the end of a sentence).
    """
    held: list[str] = []
    whole = depth = 0
    operand_next = True
    while match := _NEXT.match(text, at):
        at = match.end()
        symbol = match[1].rstrip(".-")
        word = symbol.lower()
        if operand_next:
            fits = word == "(" or (word not in PRECEDENCE and any(map(str.isalnum, word)))
        else:
            fits = word in PRECEDENCE or (word == ")" and depth > 0)
        if not fits:
            break
        held.append(symbol)
        depth += (word == "(") - (word == ")")
        operand_next = word == "(" or word in PRECEDENCE
        if not operand_next and not depth:
            whole = len(held)
        if symbol != match[1]:
            break
    if not whole or held[-1].lower() in PRECEDENCE:
        return None
    return parse_expression(" ".join(held[:whole]))


def label_of(identifier: str) -> str:
    """Label of a lowered identifier: that of its family, itself if it has none; a "+" behind it changes nothing."""
    part = identifier = identifier.rstrip("+")
    while part not in FAMILIES:
        part = part[: max(part.rfind("-"), part.rfind("."))] if "-" in part or "." in part else ""
        if not part:
            return identifier
    return FAMILIES[part]


def evaluate(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> tuple[bool, set[str]]:
    """Verdict of the policy and the labels of the licences named; exceptions behind ``with`` carry no label."""
    stack: list[tuple[bool, set[str]]] = []
    for word in postfix:
        if word in PRECEDENCE:
            (right, right_labels), (left, left_labels) = stack.pop(), stack.pop()
            if word == "with":
                stack.append((left, left_labels))
            else:
                stack.append((left and right if word == "and" else left or right, left_labels | right_labels))
        else:
            label = label_of(word)
            stack.append((label in allowed, {label}))
    return stack[0]


class Scanner:
    """Both automata, built once in each Python worker."""

    def __init__(self) -> None:
        self.phrases = ahocorasick.Automaton()
        for phrase, label in (NOTICES | BASE).items():
            self.phrases.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> dict[str, object]:
        """The result columns of one text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(_SEPARATE).split()
        padded = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        verdicts: list[bool] = []
        at = before = 0
        for end, (phrase, label, is_base) in self.phrases.iter(padded):
            labels.add(label)
            verdicts.append(label in ALLOWED)
            if is_base:
                base.add(label)
                place = end - len(phrase)
                # Phrases of several lengths may start in another order than they end, but never far apart.
                before += padded.count(" ", at, place) if place >= at else -padded.count(" ", place, at)
                at = place
                starts.append(before - 1)
        lowered = raw.lower().decode("latin-1")
        for end, _ in self.tags.iter(lowered):
            postfix = expression_at(lowered, end + 1)
            if postfix:
                verdict, named = evaluate(postfix)
                labels |= named
                verdicts.append(verdict)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels | base)),
            "score": sum(verdicts) / len(verdicts) if verdicts else 0.0,
        }


ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and the scan of every whole text."""

    def make():
        scanner = Scanner()
        columns = [part.split()[0] for part in ADDED.split(", ")]

        def score(texts: list) -> dict[str, list]:
            found = [scanner.scan(t) for t in texts]
            return {c: [f[c] for f in found] for c in columns}

        return score

    return map_texts(pick(docs, "doc_id", "text"), make, ADDED)
