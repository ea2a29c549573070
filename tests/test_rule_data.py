"""New rule data: refused as a whole, written as a whole, shown as a difference."""

import hashlib
import json

import pytest
from assayer.errors import Refusal
from assayer.operators import rule_data


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def folders(tmp_path):
    held, new = tmp_path / "held", tmp_path / "new"
    for folder, texts in ((held, {"a.xml": "<a/>", "b.xml": "<b/>"}), (new, {"a.xml": "<a>1</a>", "b.xml": "<b/>", "other.xml": "<!DOCTYPE x>"})):
        folder.mkdir()
        for name, text in texts.items():
            (folder / name).write_text(text)
    (held / "manifest.json").write_text(json.dumps([{"name": n, "sha256": sha(t)} for n, t in (("a.xml", "<a/>"), ("b.xml", "<b/>"))]))
    return held, new


def test_candidates_are_refused_as_a_whole(spark, folders):
    _, new = folders
    files = rule_data.candidate(spark, str(new), ["a.xml", "b.xml"])
    assert {r["name"]: r["sha256"] for r in rule_data.records(files).collect()} == {"a.xml": sha("<a>1</a>"), "b.xml": sha("<b/>")}
    with pytest.raises(Refusal, match="c.xml is absent; other.xml carries <!DOCTYPE"):
        rule_data.candidate(spark, str(new), ["a.xml", "c.xml", "other.xml"])


def test_a_write_moves_all_or_nothing(spark, folders):
    held, new = folders
    files = rule_data.candidate(spark, str(new), ["a.xml", "b.xml"])
    before = {p.name: p.read_bytes() for p in held.iterdir()}
    (held / "manifest.json").write_text(json.dumps([{"name": "a.xml", "sha256": sha("<a/>")}]))
    with pytest.raises(Refusal, match="0 row"):
        rule_data.write(files, str(held))
    assert {p.name: p.read_bytes() for p in held.iterdir()} | {"manifest.json": b""} == before | {"manifest.json": b""}
    (held / "manifest.json").write_bytes(before["manifest.json"])
    assert rule_data.write(files, str(held)) == ["a.xml", "b.xml"]
    assert (held / "a.xml").read_text() == "<a>1</a>" and {r["name"]: r["sha256"] for r in rule_data.manifest_of(str(held))} == {"a.xml": sha("<a>1</a>"), "b.xml": sha("<b/>")}
    assert sorted(p.name for p in held.iterdir()) == ["a.xml", "b.xml", "manifest.json"]


def test_differences_as_text(spark):
    files = spark.createDataFrame([("a.xml", "1" * 64, "2" * 64), ("b.xml", None, "3" * 64)], "name string, before string, after string")
    none = spark.createDataFrame([], "rule_kind string, identifier string, change string")
    text = rule_data.difference_text(none, files, ("1", "2"))
    assert "release: 1 -> 2\nfiles whose bytes differ: 2\n  a.xml: 111111111111 -> 222222222222\n  b.xml: (absent) -> 333333333333\nadded: 0" in text and "no constraint shows" in text
    some = spark.createDataFrame([("is-unique", "x", "added"), ("matches", "y", "now skipped")], "rule_kind string, identifier string, change string")
    text = rule_data.difference_text(some, files.limit(0), ("1", "1"))
    assert "added: 1\n  x (is-unique)" in text and "now skipped: 1\n  y (matches)" in text and "no constraint shows" not in text
