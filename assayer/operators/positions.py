"""Where in the text of a document the value of each pointer begins."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.operators.shred import escaped

BLANK = re.compile(r"[ \t\n\r]*")
LITERAL = re.compile(r"[^\s,\]}]+")
PLACES = "doc_id string, pointer string, offset long, line long, column long, error string"
ARROW = pa.schema([
    ("doc_id", pa.string()), ("pointer", pa.string()), ("offset", pa.int64()), ("line", pa.int64()), ("column", pa.int64()), ("error", pa.string()),
])


class Misplaced(ValueError):
    """The text is not JSON; the message says where reading stopped."""


def offsets(text: str) -> dict[str, int]:
    """Offset of the value at each pointer; of a repeated key the last value counts.

    One pass with a stack of open containers, so depth is no concern. A frame is
    (pointer, index of the next item, or None for an object).
    """
    found: dict[str, int] = {}
    stack: list[list] = []
    at = BLANK.match(text, 0).end()
    pointer = ""
    while True:
        if at >= len(text):
            raise Misplaced(f"the text ends at {at} where a value should be")
        found[pointer] = at
        opened = text[at]
        if opened in "{[":
            at = BLANK.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if opened == "{" else "]"):
                at += 1
            else:
                stack.append([pointer, None if opened == "{" else 0])
                pointer, at = _next(text, at, stack[-1])
                continue
        elif opened == '"':
            at = scanstring(text, at + 1)[1]
        else:
            literal = LITERAL.match(text, at)
            if not literal:
                raise Misplaced(f"no value at {at}")
            at = literal.end()
        while True:
            at = BLANK.match(text, at).end()
            if not stack:
                if at < len(text):
                    raise Misplaced(f"text goes on at {at}")
                return found
            mark = text[at : at + 1]
            if mark == ",":
                pointer, at = _next(text, BLANK.match(text, at + 1).end(), stack[-1])
                break
            if mark != ("}" if stack[-1][1] is None else "]"):
                raise Misplaced(f"neither an end nor a comma at {at}")
            stack.pop()
            at += 1


def _next(text: str, at: int, frame: list) -> tuple[str, int]:
    """Pointer and offset of the next member of an open container."""
    if frame[1] is not None:
        frame[1] += 1
        return f"{frame[0]}/{frame[1] - 1}", at
    if text[at : at + 1] != '"':
        raise Misplaced(f"no member name at {at}")
    key, at = scanstring(text, at + 1)
    at = BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise Misplaced(f"no colon at {at}")
    return f"{frame[0]}/{escaped(key)}", BLANK.match(text, at + 1).end()


def source_index(documents: DataFrame) -> DataFrame:
    """doc_id, pointer, offset, line, column (both from 1) of every value; a text that is not JSON gives its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, rows = batch.slice(start, 256), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = text or ""
                    starts = [0, *(m.end() for m in re.finditer("\n", text))]
                    try:
                        for pointer, at in offsets(text).items():
                            line = bisect_right(starts, at)
                            rows.append({"doc_id": doc_id, "pointer": pointer, "offset": at, "line": line, "column": at - starts[line - 1] + 1})
                    except ValueError as error:
                        rows.append({"doc_id": doc_id, "error": str(error)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return documents.selectExpr("CAST(doc_id AS string) AS doc_id", "text").mapInArrow(run, PLACES)
