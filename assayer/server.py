"""Line-delimited JSON-RPC over standard input: validate, rule, coverage and limits, all read-only.

A request that cannot be answered gets an error and never ends the loop. Names
that ask for a verdict on implementation or security are refused as such.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from pyspark.sql import SparkSession

from assayer import __version__
from assayer.errors import Refusal
from assayer.operators.findings import SEVERITIES, exit_codes
from assayer.operators.provenance import CODES, constraints_by_id, coverage_table
from assayer.plans.validate import validate
from assayer.rules.pack import RulePack
from assayer.sinks.reports import json_report
from assayer.sources.documents import expand, inside, read_documents

#: Words of names that ask for a verdict.
JUDGING = frozenset(
    "acceptable accreditation accredited adequate ato authorisation authorised authorization authorized certification certified compliant effective "
    "implemented inadequate ineffective insecure insufficient noncompliant secure sufficient unacceptable unauthorised unauthorized unimplemented unsafe "
    "unsecure".split()
)
BOUNDARY = "this server reports structure and makes no judgment about implementation, security or authorization"
MEANINGS = {
    "ERROR": "the document breaks a rule that it is bound by", "WARNING": "a rule advises against it", "INFO": "for the record",
    "UNVERIFIABLE": "not decided either way with what was supplied; never a pass",
}
TEXT = {"type": "string"}
TOOLS = {
    "validate": ("Findings of one document, with further ones to resolve against", {"path": TEXT, "resolve": {"type": "array", "items": TEXT}, "suggest": {"type": "boolean"}}, ["path"]),
    "rule": ("What a finding code reports, or how a constraint is declared", {"identifier": TEXT}, ["identifier"]),
    "coverage": ("Which constraints are evaluated, and why the rest are not", {"kind": TEXT, "evaluated": {"type": "boolean"}}, []),
    "limits": ("What a run does not say", {}, []),
}


def asks_for_judgment(name: str) -> bool:
    """Whether any whole word of a name is one of verdicts."""
    return bool(JUDGING & set(re.split("[^a-z0-9]+", name.lower())))


class Server:
    """Answers for one rule pack, below one folder."""

    def __init__(self, spark: SparkSession, pack: RulePack, root: str, limits: dict[str, Any] | None = None) -> None:
        self.spark, self.pack, self.root, self.limits_said = spark, pack, root, limits or {}

    def validate(self, path: str, resolve: Iterable[str] = (), suggest: bool = False) -> dict[str, Any]:
        files = [inside(f, self.root) for f in expand([path])]
        if len(files) != 1:
            raise Refusal("one document is validated at a time")
        more = [inside(f, self.root) for f in expand(resolve)]
        documents = read_documents(self.spark, sorted({*files, *more}), pattern="*")
        mine = documents.where(documents.doc_id == files[0]).select("doc_id")
        found = validate(documents, self.pack, mine, suggest)
        return {"exit_code": exit_codes(found, mine).first()["exit_code"], "report": json.loads(json_report(found.collect(), files[0]))}

    def rule(self, identifier: str) -> dict[str, Any]:
        for code, emitted, what in CODES:
            if code == identifier:
                cited = {k: v for k, v in self.pack.citations.get(code, {}).items() if v}
                return {"code": code, "emitted_by": emitted, "reports": what} | cited
        rows = [r.asDict() for r in constraints_by_id(self.spark, self.pack, identifier).collect()]
        if not rows:
            raise Refusal(f"{identifier!r} is neither a finding code nor a constraint")
        return {"declarations": rows}

    def coverage(self, kind: str = "", evaluated: bool | None = None) -> dict[str, Any]:
        rows = [r.asDict() for r in coverage_table(self.spark, self.pack, kind, evaluated).orderBy("kind").collect()]
        stranded = [{"identifier": c.identifier, "index": c.index, "reason": why} for c, why in self.pack.stranded()]
        return {"published": len(self.pack.constraints), "evaluated": len(self.pack.evaluated()), "kinds": rows, "stranded": stranded}

    def limits(self) -> dict[str, Any]:
        return self.limits_said | {"severities": {s: MEANINGS[s] for s in SEVERITIES}}

    def answer(self, request: Any) -> dict[str, Any] | None:
        """The response to one decoded request; None for a notification."""
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return _error(None, -32600, "not a request")
        number, method, params = request.get("id"), request["method"], request.get("params") or {}
        if number is None:
            return None
        if method == "initialize":
            return _result(number, {"serverInfo": {"name": "assayer", "version": __version__}, "capabilities": {"tools": {}}})
        if method == "tools/list":
            listed = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]
            return _result(number, {"tools": listed})
        if method != "tools/call":
            return _error(number, -32601, f"no method {method}")
        name = str(params.get("name", ""))
        if name not in TOOLS:
            return _error(number, -32602, BOUNDARY if asks_for_judgment(name) else f"no tool {name}")
        tool: Callable[..., dict[str, Any]] = getattr(self, name)
        try:
            said = tool(**(params.get("arguments") or {}))
        except Refusal as refusal:
            return _result(number, {"isError": True, "exit_code": 2, "content": [{"type": "text", "text": str(refusal)}]})
        except TypeError as error:
            return _error(number, -32602, str(error))
        return _result(number, {"content": [{"type": "text", "text": json.dumps(said, sort_keys=True)}]})

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        """Answers line by line until the input ends."""
        for line in lines:
            if not line.strip():
                continue
            try:
                response = self.answer(json.loads(line))
            except ValueError:
                response = _error(None, -32700, "not JSON")
            if response is not None:
                out.write(json.dumps(response) + "\n")
                out.flush()


def _result(number: Any, result: dict[str, Any]) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": number, "result": result}


def _error(number: Any, code: int, message: str) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}
