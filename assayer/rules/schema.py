"""A published JSON Schema compiled into the few shapes that documents are walked by.

Only the keywords that such schemas use to describe documents are read; what a
node does not settle is ``open`` and is reported, never guessed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from assayer.errors import RuleError

HOPS = 16
LOCAL = "#/definitions/"
SCALAR_DEFINITION = re.compile(r"[A-Za-z0-9]+Datatype")
OBJECT_WORDS = {"properties", "required", "additionalProperties"}


@dataclass(frozen=True)
class Datatype:
    """A named scalar type."""

    name: str
    json_type: str | None = None
    pattern: str | None = None
    minimum: float | None = None
    description: str = ""

    @property
    def checkable(self) -> bool:
        """Whether the pattern can be applied; one that cannot is reported as not checked."""
        if self.pattern is None:
            return True
        try:
            re.compile(self.pattern)
        except re.error:
            return False
        return True


@dataclass(frozen=True)
class Shape:
    """What the schema says at one position.

    ``kind`` is scalar, object, array, choice (of object alternatives), either
    (one value or an array of them), free (nothing is said) or open (not read).
    """

    kind: str
    node: int = 0
    title: str = ""
    declared: str | None = None
    datatype: Datatype | None = None
    enums: tuple[str, ...] = ()
    reason: str = ""
    parts: tuple[int, ...] = ()


@dataclass
class Schema:
    """Shapes by schema node; nodes are numbered as they are met, so cycles cost nothing."""

    raw: dict[str, Any]
    models: dict[str, int] = field(default_factory=dict)
    datatypes: dict[str, Datatype] = field(default_factory=dict)
    _nodes: list[dict[str, Any]] = field(default_factory=list)
    _number: dict[int, int] = field(default_factory=dict)
    _shape: dict[int, Shape] = field(default_factory=dict)

    def __post_init__(self) -> None:
        definitions = self.raw.get("definitions")
        if not isinstance(definitions, dict):
            raise RuleError("the schema has no definitions")
        for name, node in definitions.items():
            if SCALAR_DEFINITION.fullmatch(name):
                self.datatypes[name] = self._datatype(name, node, definitions, 0)
        for branch in self.raw.get("oneOf", []):
            for name, node in branch.get("properties", {}).items():
                if name != "$schema":
                    self.models[name] = self.number(node)
        if not self.models:
            raise RuleError("the schema names no document root")

    def number(self, node: dict[str, Any]) -> int:
        """The number of a schema node."""
        key = id(node)
        if key not in self._number:
            self._number[key] = len(self._nodes)
            self._nodes.append(node)
        return self._number[key]

    def _datatype(self, name: str, node: dict[str, Any], definitions: dict[str, Any], hops: int) -> Datatype:
        """A scalar definition; of several that apply the narrower type and the branch's own pattern hold."""
        kind, pattern, low = node.get("type"), node.get("pattern"), node.get("minimum")
        for part in node.get("allOf", []):
            if hops < HOPS and (target := str(part.get("$ref", ""))).startswith(LOCAL):
                base = self._datatype(name, definitions.get(target[len(LOCAL) :], {}), definitions, hops + 1)
                kind = base.json_type if kind is None or (kind == "number" and base.json_type == "integer") else kind
                pattern, low = pattern or base.pattern, base.minimum if low is None else low
            else:
                own = part.get("type")
                kind = own if kind is None or (kind == "number" and own == "integer") else kind
                pattern, low = part.get("pattern", pattern), part.get("minimum", low)
        return Datatype(name, kind, pattern, low, str(node.get("description", "")))

    def shape(self, number: int) -> Shape:
        """The shape at a numbered node."""
        if number not in self._shape:
            self._shape[number] = self._read(self._nodes[number])
        return self._shape[number]

    def _read(self, node: dict[str, Any]) -> Shape:
        title, enums = str(node.get("title", "")), []
        for _ in range(HOPS):
            target = node.get("$ref")
            if isinstance(target, str):
                name = target.rsplit("/", 1)[-1]
                if name in self.datatypes:
                    found = self.datatypes[name]
                    return Shape("scalar", title=title, declared=found.json_type, datatype=found, enums=tuple(enums))
                node = self._follow(target)
                title = title or str(node.get("title", ""))
                continue
            union = node.get("allOf") or node.get("anyOf")
            if not union:
                return self._plain(node, title, tuple(enums))
            if all("properties" in b for b in union):
                return Shape("choice", title=title, parts=tuple(map(self.number, union)))
            if pair := self._either(union):
                return Shape("either", title=title, parts=pair)
            enums += [json.dumps(v) if not isinstance(v, str) else v for b in union for v in b.get("enum", [])]
            rest = [b for b in union if "enum" not in b]
            if len(rest) != 1:
                return Shape("open", title=title, reason="the schema combines alternatives in a form that is not read")
            node = rest[0]
        raise RuleError("a chain of references does not end")

    def _follow(self, target: str) -> dict[str, Any]:
        found = self.raw["definitions"].get(target[len(LOCAL) :]) if target.startswith(LOCAL) else None
        if not isinstance(found, dict):
            raise RuleError(f"the schema has no {target}")
        return found

    def _either(self, union: list[dict[str, Any]]) -> tuple[int, int] | None:
        """One value or an array of the same values: the plain and the array branch."""
        arrays = [b for b in union if b.get("type") == "array"]
        singles = [b for b in union if b.get("type") != "array"]
        if len(arrays) == len(singles) == 1 and arrays[0].get("items") == singles[0]:
            return self.number(singles[0]), self.number(arrays[0])
        return None

    def _plain(self, node: dict[str, Any], title: str, enums: tuple[str, ...]) -> Shape:
        declared = node.get("type")
        if declared is None and OBJECT_WORDS & set(node):
            declared = "object"
        kind = declared if declared in ("object", "array") else "free" if declared is None else "scalar"
        return Shape(kind, self.number(node), title, declared, None, enums)

    def part(self, number: int, title: str) -> Shape:
        """One alternative of a choice, under the title of the choice."""
        return self._plain(self._nodes[number], title, ())

    def properties(self, shape: Shape) -> dict[str, Any]:
        """Declared properties of an object shape."""
        found = self._nodes[shape.node].get("properties")
        return found if isinstance(found, dict) else {}

    def required(self, shape: Shape) -> list[str]:
        return [str(r) for r in self._nodes[shape.node].get("required", [])]

    def closed(self, shape: Shape) -> bool:
        return self._nodes[shape.node].get("additionalProperties") is False

    def item(self, shape: Shape) -> int | None:
        """Number of the item node of an array shape."""
        found = self._nodes[shape.node].get("items")
        return self.number(found) if isinstance(found, dict) else None

    def least_items(self, shape: Shape) -> int | None:
        found = self._nodes[shape.node].get("minItems")
        return found if isinstance(found, int) and not isinstance(found, bool) else None

    def alternatives(self, shape: Shape) -> str:
        """The alternatives in words."""
        said = []
        for k, number in enumerate(shape.parts, 1):
            part = self.part(number, shape.title)
            needs = ", ".join(sorted(self.required(part))) or "nothing"
            only = f", permits only {', '.join(sorted(self.properties(part)))}" if self.closed(part) else ""
            said.append(f"({k}) needs {needs}{only}")
        return "; ".join(said)
