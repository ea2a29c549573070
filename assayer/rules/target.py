"""The bounded path language of constraint targets.

    target  = path ('|' path)*
    path    = '.' | ['.//' | '//' | './'] step (('/' | '//') step)*
    step    = ('.' | name | '(' name ('|' name)* ')') predicate*
    predicate = '[' test (' and ' test)* ']'
    test    = '@'flag '=' strings | 'starts-with(@'flag',' string ')'
            | 'has-oscal-namespace(' strings ')' | name

Anything else is None: a target that is read in part would select too little.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9._-]*")
TOKEN = re.compile(r"\s*(//|/|\||\(|\)|\[|\]|,|=|@|\.(?![A-Za-z0-9_-])|'[^']*'|\"[^\"]*\"|[A-Za-z_][A-Za-z0-9._-]*)")


@dataclass(frozen=True)
class Test:
    """A predicate: equals, starts, namespace or child."""

    __test__ = False
    kind: str
    name: str = ""
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Step:
    """Names to descend to (none: stay), whether at any depth, and the tests of the node reached."""

    names: tuple[str, ...]
    deep: bool = False
    tests: tuple[Test, ...] = ()


Path = tuple[Step, ...]


class _Unread(Exception):
    pass


class _Reader:
    """Recursive descent over tokens."""

    def __init__(self, text: str) -> None:
        self.tokens: list[str] = []
        at, text = 0, text.strip()
        while at < len(text):
            found = TOKEN.match(text, at)
            if not found:
                raise _Unread
            self.tokens.append(found[1])
            at = found.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or (wanted and token not in wanted):
            raise _Unread
        self.at += 1
        return token

    def name(self) -> str:
        token = self.take()
        if not NAME.fullmatch(token):
            raise _Unread
        return token

    def string(self) -> str:
        token = self.take()
        if token[0] not in "'\"":
            raise _Unread
        return token[1:-1]

    def strings(self) -> tuple[str, ...]:
        if self.peek() != "(":
            return (self.string(),)
        self.take("(")
        found = [self.string()]
        while self.peek() == ",":
            self.take(",")
            found.append(self.string())
        self.take(")")
        return tuple(found)

    def test(self) -> Test:
        if self.peek() == "@":
            self.take("@")
            flag = self.name()
            self.take("=")
            return Test("equals", flag, self.strings())
        name = self.name()
        if self.peek() != "(":
            return Test("child", name)
        self.take("(")
        if name == "starts-with":
            self.take("@")
            flag = self.name()
            self.take(",")
            made = Test("starts", flag, (self.string(),))
        elif name == "has-oscal-namespace":
            first = self.strings()
            while self.peek() == ",":
                self.take(",")
                first += (self.string(),)
            made = Test("namespace", "ns", first)
        else:
            raise _Unread
        self.take(")")
        return made

    def tests(self) -> tuple[Test, ...]:
        found: list[Test] = []
        while self.peek() == "[":
            self.take("[")
            found.append(self.test())
            while self.peek() == "and":
                self.take("and")
                found.append(self.test())
            self.take("]")
        return tuple(found)

    def step(self, deep: bool, first: bool) -> Step:
        if self.peek() == ".":
            self.take(".")
            names: tuple[str, ...] = ()
        elif self.peek() == "(":
            self.take("(")
            if self.peek() == ".":
                self.take(".")
                names = ()
            else:
                listed = [self.name()]
                while self.peek() == "|":
                    self.take("|")
                    listed.append(self.name())
                names = tuple(listed)
            self.take(")")
        else:
            names = (self.name(),)
        if not names and (deep or not first):
            raise _Unread
        return Step(names, deep, self.tests())

    def path(self) -> Path:
        deep = False
        if self.peek() == "." and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] in ("/", "//"):
            self.take(".")
            deep = self.take("/", "//") == "//"
        elif self.peek() == "//":
            self.take("//")
            deep = True
        steps = [self.step(deep, True)]
        while self.peek() in ("/", "//"):
            steps.append(self.step(self.take("/", "//") == "//", False))
        return () if steps == [Step(())] else tuple(steps)


def parse_target(text: str) -> tuple[Path, ...] | None:
    """The paths of a target, or None if any of it is outside the language."""
    try:
        reader = _Reader(text)
        paths = [reader.path()]
        while reader.peek() == "|":
            reader.take("|")
            paths.append(reader.path())
        return tuple(paths) if reader.at == len(reader.tokens) else None
    except _Unread:
        return None


def split_top(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == mark and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def parse_value_target(text: str) -> tuple[tuple[Path, ...], str] | None:
    """Paths and the flag that a value target ends with ('' for the node's own value), or None."""
    text = text.strip()
    parts = split_top(text, "|")
    if len(parts) > 1 and any("@" in split_top(p, "/")[-1][:1] for p in parts):
        read = [parse_value_target(p) for p in parts]
        if any(r is None for r in read) or len({r[1] for r in read if r}) != 1:
            return None
        return tuple(path for r in read if r for path in r[0]), read[0][1]
    head, _, last = text.rpartition("/") if "/" in text else ("", "", text)
    if last.startswith("@"):
        if not NAME.fullmatch(last[1:]):
            return None
        if not head:
            return ((),), last[1:]
        paths = parse_target(head)
        return None if paths is None else (paths, last[1:])
    paths = parse_target(text)
    return None if paths is None else (paths, "")
