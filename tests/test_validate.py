"""Every finding code has a witness, and a clean document has none of them."""

import copy
import json

import pytest
from assayer.errors import Refusal
from assayer.operators import baseline, checks, compare, findings, imports, package, patch, positions, scoring, suggest, texts
from assayer.operators.evaluate import evaluate
from assayer.operators.provenance import CODES, codes, constraints_by_id, coverage_table, declaration
from assayer.operators.shred import DEEPEST, shred
from assayer.plans.validate import validate
from assayer.rules.pack import pack_of
from assayer.sources.documents import from_texts
from pyspark.sql import functions as F

D = "#/definitions/"
TEXT = {"$ref": D + "StringDatatype"}


def make_pack():
    control = {
        "title": "Control", "type": "object", "required": ["id"], "additionalProperties": False,
        "properties": {
            "id": {"title": "Control Identifier", "$ref": D + "WordDatatype"}, "uuid": {"$ref": D + "UUIDDatatype"}, "n": {"$ref": D + "PositiveDatatype"},
            "letters": {"$ref": D + "LetterDatatype"}, "controls": {"type": "array", "minItems": 1, "items": {"$ref": D + "control"}},
            "who": {"anyOf": [
                {"type": "object", "required": ["person"], "additionalProperties": False, "properties": {"person": TEXT}},
                {"type": "object", "required": ["firm"], "additionalProperties": False, "properties": {"firm": TEXT}},
            ]},
            "odd": {"anyOf": [{"type": "string"}, {"type": "integer"}]}, "loose": {"type": "array"},
        },
    }
    meta = {
        "title": "Metadata", "type": "object", "required": ["title"],
        "properties": {"title": TEXT, "oscal-version": TEXT, "links": {"type": "array", "items": {"type": "object", "properties": {"href": TEXT, "rel": TEXT}}}},
    }
    use = {"type": "object", "properties": {"href": TEXT, "with": {"title": "Match Controls by Identifier", **TEXT}}}
    schema = {
        "definitions": {
            "StringDatatype": {"type": "string"}, "WordDatatype": {"type": "string", "pattern": "^[a-z0-9.-]+$"}, "LetterDatatype": {"type": "string", "pattern": "^\\p{L}+$"},
            "UUIDDatatype": {"type": "string", "pattern": "^[0-9a-f]{4}$"}, "IntegerDatatype": {"type": "integer"},
            "PositiveDatatype": {"allOf": [{"$ref": D + "IntegerDatatype"}, {"minimum": 1}]}, "control": control, "metadata": meta,
        },
        "oneOf": [
            {"properties": {"catalog": {"title": "Catalog", "type": "object", "required": ["metadata"], "additionalProperties": False, "properties": {"metadata": {"$ref": D + "metadata"}, "controls": {"type": "array", "items": {"$ref": D + "control"}}}}}},
            {"properties": {"profile": {"title": "Profile", "type": "object", "properties": {"metadata": {"$ref": D + "metadata"}, "imports": {"type": "array", "items": use}}}}},
        ],
    }
    rules = [
        {"kind": "is-unique", "context": "catalog", "target": "//control", "keys": ["@id"], "identifier": "one-id", "level": "WARNING"},
        {"kind": "index", "context": "catalog", "target": "//control", "keys": ["@id"], "identifier": "ids", "index": "controls"},
        {"kind": "index-has-key", "context": "profile", "target": "import", "keys": ["@with"], "identifier": "known", "index": "controls"},
        {"kind": "has-cardinality", "context": "catalog", "target": "control", "low": 1, "high": 3, "identifier": "some"},
        {"kind": "matches", "context": "control", "target": "@id", "regex": "^a[a-z0-9.-]*$", "identifier": "a-first"},
        {"kind": "expect", "context": "control"},
    ]
    return pack_of(schema, rules, names={"control": ["controls", "control"], "import": ["imports"], "catalog": ["catalog"], "profile": ["profile"]}, release="2")


CATALOG = {"catalog": {"metadata": {"title": "t", "oscal-version": "2"}, "controls": [{"id": "a-1", "uuid": "00aa", "n": 1, "who": {"person": "p"}}, {"id": "a-2", "uuid": "00bb", "controls": [{"id": "a-2.1"}]}]}}
PROFILE = {"profile": {"metadata": {"title": "t", "oscal-version": "2", "links": [{"href": "#00aa"}]}, "imports": [{"href": "cat.json", "with": "a-1"}]}}


@pytest.fixture(scope="module")
def pack():
    return make_pack()


def run(spark, pack, **documents):
    """Findings of documents given as d=value, by (document, code, location)."""
    made = from_texts(spark, {f"d/{n}.json": json.dumps(v) for n, v in documents.items()})
    return validate(made, pack).collect()


def codes_of(rows, doc=None):
    return {(r["code"], r["location"]) for r in rows if doc is None or r["doc_id"] == f"d/{doc}.json"}


def spoilt(document, *changes):
    """A copy with changes: (way, value); the value None removes."""
    made = copy.deepcopy(document)
    for way, value in changes:
        *path, last = way
        at = made
        for step in path:
            at = at[step]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return made


def test_clean_documents_have_notices_only(spark, pack):
    rows = run(spark, pack, cat=CATALOG, prof=PROFILE)
    assert {r["severity"] for r in rows} == {"INFO", "UNVERIFIABLE"}
    assert {r["code"] for r in rows} == {"IMPORT_RESOLVED", "CONSTRAINT_NOT_EVALUATED"}
    assert [tuple(r) for r in rows] == sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[3], r[4], r[1], r[5], r[2], r[6]))


C = ("catalog", "controls", 0)
DEFECTS = [
    (((("catalog", "metadata", "title"), None),), "REQUIRED_PROPERTY_MISSING", "/catalog/metadata"),
    ((((*C, "new"), 1),), "PROPERTY_UNDECLARED", "/catalog/controls/0"),
    ((((*C, "id"), "A 1"),), "DATATYPE_MISMATCH", "/catalog/controls/0/id"),
    ((((*C, "n"), "x"),), "TYPE_MISMATCH", "/catalog/controls/0/n"),
    ((((*C, "n"), True),), "TYPE_MISMATCH", "/catalog/controls/0/n"),
    (((C, "scalar"),), "TYPE_MISMATCH", "/catalog/controls/0"),
    ((((*C, "n"), 0),), "DATATYPE_BELOW_MINIMUM", "/catalog/controls/0/n"),
    ((((*C, "uuid"), "00bb"),), "UUID_NOT_UNIQUE", "/catalog/controls/1/uuid"),
    ((((*C, "id"), "a-2.1"),), "CONSTRAINT_NOT_UNIQUE", "/catalog/controls/1/controls/0"),
    ((((*C, "id"), "b-1"),), "CONSTRAINT_VALUE_MISMATCH", "/catalog/controls/0/id"),
    (((("catalog", "controls", 1, "controls"), []),), "ARRAY_TOO_SHORT", "/catalog/controls/1/controls"),
    (((("catalog", "controls"), []),), "CONSTRAINT_CARDINALITY", "/catalog"),
    ((((*C, "who"), {"person": "p", "firm": "f"}),), "NO_SCHEMA_ALTERNATIVE", "/catalog/controls/0/who"),
    ((((*C, "who"), "p"),), "SUBTREE_NOT_READ", "/catalog/controls/0/who"),
    ((((*C, "odd"), 1),), "SUBTREE_NOT_READ", "/catalog/controls/0/odd"),
    ((((*C, "loose"), [1]),), "SUBTREE_NOT_READ", "/catalog/controls/0/loose"),
    ((((*C, "letters"), "x"),), "PATTERN_NOT_CHECKED", "/catalog"),
    (((("catalog", "metadata", "oscal-version"), "1"),), "OSCAL_VERSION_DIFFERS", "/catalog/metadata/oscal-version"),
    (((("catalog", "metadata", "links"), [{"href": "#gone"}]),), "REFERENCE_UNRESOLVED", "/catalog/metadata/links/0/href"),
    (((("catalog", "metadata", "oscal-version"), "1"), ((*C, "n"), 0)), "VERSION_SKEW_SUSPECTED", "/catalog/metadata/oscal-version"),
]


@pytest.fixture(scope="module")
def corrupted(spark, pack):
    """All defects in one run, each in its own document."""
    return run(spark, pack, ok=CATALOG, **{f"x{k}": spoilt(CATALOG, *changes) for k, (changes, _, _) in enumerate(DEFECTS)})


@pytest.mark.parametrize("k", range(len(DEFECTS)))
def test_defects_are_found_where_they_are(corrupted, k):
    _, code, location = DEFECTS[k]
    assert (code, location) in codes_of(corrupted, f"x{k}")
    assert code not in {c for c, _ in codes_of(corrupted, "ok")}


def test_references_without_their_documents_are_not_judged(spark, pack):
    lone = spoilt(PROFILE, (("profile", "imports", 0, "href"), "gone.json"), (("profile", "imports", 0, "with"), "z"))
    rows = run(spark, pack, prof=lone)
    assert ("IMPORT_NOT_SUPPLIED", "/profile/imports/0/href") in codes_of(rows)
    open_ones = [r for r in rows if r["code"] == "REFERENCE_UNVERIFIABLE"]
    assert {r["location"] for r in open_ones} == {"/profile/imports/0", "/profile/imports/0/with", "/profile/metadata/links/0/href"}
    assert all(r["severity"] == "UNVERIFIABLE" and "gone.json" in r["message"] for r in open_ones)
    assert not any(r["severity"] == "ERROR" for r in rows)


def test_ambiguous_imports(spark, pack):
    documents = {"a/cat.json": CATALOG, "b/cat.json": CATALOG, "c/prof.json": PROFILE}
    rows = validate(from_texts(spark, {n: json.dumps(v) for n, v in documents.items()}), pack).collect()
    found = [r for r in rows if r["code"] == "IMPORT_AMBIGUOUS"]
    assert len(found) == 1 and "a/cat.json, b/cat.json" in found[0]["message"]


def test_settled_references_are_one_report_each_with_suggestions(spark, pack):
    wrong = spoilt(PROFILE, (("profile", "imports", 0, "with"), "A-01"), (("profile", "metadata", "links", 0, "href"), "#00ab"))
    docs = from_texts(spark, {"cat.json": json.dumps(CATALOG), "prof.json": json.dumps(wrong)})
    rows = validate(docs, pack, spark.createDataFrame([("prof.json",)], "doc_id string"), with_suggestions=True).collect()
    assert {r["doc_id"] for r in rows} == {"prof.json"}
    found = {r["location"]: r for r in rows if r["code"] == "REFERENCE_UNRESOLVED"}
    assert [s["value"] for s in found["/profile/imports/0/with"]["suggestions"]] == ["a-1"]
    assert [s["value"] for s in found["/profile/metadata/links/0/href"]["suggestions"]][0] == "#00aa"


def test_unsettled_wins_over_settled(spark):
    base = [("d", "REFERENCE_UNRESOLVED", "ERROR", "/x/href", "href", "#k", "m"), ("d", "REFERENCE_UNVERIFIABLE", "UNVERIFIABLE", "/x", "@href", "k", "m"), ("d", "OTHER", "INFO", "/x", "p", "v", "m")]
    rows = [spark.createDataFrame([r], "doc_id string, code string, severity string, location string, prop string, value string, message string") for r in base]
    kept = findings.merge_references(findings.union(rows)).collect()
    assert {r["code"] for r in kept} == {"REFERENCE_UNVERIFIABLE", "OTHER"}


def test_unreadable_documents_refuse_the_run(spark, pack):
    for text in ("{", "[1]", "{}", '{"catalog": {}, "profile": {}}', '{"catalog": {}, "more": 1}', '{"catalog":' + "[" * (DEEPEST + 5) + "]" * (DEEPEST + 5) + "}"):
        with pytest.raises(Refusal):
            validate(from_texts(spark, {"x.json": text, "y.json": json.dumps(CATALOG)}), pack)


def test_results_do_not_depend_on_partitions(spark, pack):
    docs = from_texts(spark, {f"d{k}.json": json.dumps(spoilt(CATALOG, ((*C, "n"), 0))) for k in range(6)})
    one, many = validate(docs.coalesce(1), pack).collect(), validate(docs.repartition(5), pack).collect()
    assert one == many


def test_every_code_is_described():
    known = {code for _, code, _ in DEFECTS} | {c for _, held in findings.TIERS for c in held}
    assert known <= {c for c, _, _ in CODES} and len(CODES) == 22


def test_targets_reach_below_what_the_schema_does_not_declare(spark, pack):
    document = {"catalog": {"metadata": {"title": "t"}, "strange": {"controls": [{"id": "a-1"}, {"id": "a-1"}]}}}
    facts = evaluate(from_texts(spark, {"d": json.dumps(document)}), pack, ("selected",)).where("rule = 0").orderBy("place").collect()
    assert [f["pointer"] for f in facts] == ["/catalog/strange/controls/0", "/catalog/strange/controls/1"]


def test_first_is_first_in_the_order_of_a_search_by_name(spark, pack):
    nested = {"catalog": {"metadata": {"title": "t"}, "controls": [{"id": "a-1", "controls": [{"id": "a-9"}]}, {"id": "a-9"}]}}
    rows = run(spark, pack, cat=nested)
    found = {r["location"] for r in rows if r["code"] == "CONSTRAINT_NOT_UNIQUE"}
    assert found == {"/catalog/controls/0/controls/0"}


def test_shredded_nodes(spark):
    rows = {r["pointer"]: r for r in shred(from_texts(spark, {"d": '{"a/b": [1.0, true, null, {"c~": "x"}], "k": 1, "k": 2}', "bad": "{"})).collect() if r["doc_id"] == "d"}
    assert rows["/a~1b/0"]["sval"] == "1.0" and rows["/a~1b/0"]["jtype"] == "number" and rows["/a~1b/1"]["sval"] == "True"
    assert rows["/a~1b/3/c~0"]["raw_pointer"] == "/a/b/3/c~" and rows["/a~1b/3/c~0"]["parent"] == "/a/b/3"
    assert rows["/k"]["sval"] == "2" and rows["/a~1b/2"]["jtype"] == "null"
    bad = shred(from_texts(spark, {"bad": "{"})).collect()
    assert len(bad) == 1 and bad[0]["error"] and bad[0]["depth"] is None


def test_positions(spark):
    text = '{\n "a": [1,\n  {"b/c": "x"}],\n "a": null }'
    assert positions.offsets(text)["/a"] == text.rindex("null")
    rows = {r["pointer"]: (r["line"], r["column"]) for r in positions.source_index(from_texts(spark, {"d": text})).collect()}
    assert rows[""] == (1, 1) and rows["/a/1/b~1c"] == (3, 11) and rows["/a"] == (4, 7)
    deep = "[" * 5000 + "]" * 5000
    assert len(positions.offsets(deep)) == 5000
    for bad in ("", "{", '{"a"}', "[1 2]", "[1] x", "{1:2}", "[,]"):
        with pytest.raises(ValueError):
            positions.offsets(bad)


def differences(spark, pairs):
    return [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(suggest.difference("a", "b")).collect()]


def test_normal_differences_and_edits(spark):
    pairs = [("AC-02", "ac-2"), ("#ac-2", "ac.2"), ("ac-2", "ac-3"), ("a", "a"), ("##a", "#A"), (None, "a"), ("a_1", "a-1")]
    said = ["case and zero-padding", "a leading '#' and the separator", None, None, None, None, "the separator"]
    assert differences(spark, pairs) == said
    for a, b, n in [("ab", "ba", 1), ("ca", "abc", None), ("abc", "abc", 0), ("kitten", "sittin", 2), ("abcd", "a", None), ("", "ab", 2), ("abc", "acb1", 2)]:
        assert suggest.edits(a, b) == n


def test_close_pairs_miss_nothing(spark):
    words = ["control-1", "control-01", "contorl-1", "control.1", "cntrl-1", "other", "othre", "o", "", "control-12", "CONTROL-1"]
    df = spark.createDataFrame([("p", w) for w in words], "pool string, value string")
    got = {(r["written"], r["value"]): (r["rank"], r["edits"], r["difference"]) for r in suggest.close_pairs(df.withColumnRenamed("value", "written"), df, "pool").collect()}
    pairs = [(a, b) for a in words for b in words if a != b]
    want = {}
    for (a, b), said in zip(pairs, differences(spark, pairs), strict=True):
        n = suggest.edits(a, b)
        if said or n is not None:
            want[a, b] = (0, 0, said) if said else (1, n, f"{n} character edit{'s' * (n != 1)}")
    assert got == want and ("control-1", "CONTROL-1") in got and ("other", "othre") in got


def finding(code="C", location="/a", prop="p", value="v", severity="ERROR", message="m", citation="c"):
    return ("", code, severity, location, prop, value, message, (citation, "", ""), None, None, None)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), findings.FINDING)


def test_comparison(spark):
    before = table(spark, finding(), finding(location="/gone", prop="g"), finding(location="/old", value="w"), finding(prop="x", value="1"), finding(location="/1", prop="t"), finding(location="/2", prop="t"))
    after = table(spark, finding(), finding(location="/new", value="w"), finding(prop="x", value="2"), finding(location="/3", prop="t"), finding(prop="n"))
    rows = compare.compare(before, after).collect()
    count = lambda s: sum(r["status"] == s for r in rows)
    assert [count(s) for s in ("unchanged", "moved", "changed", "removed", "added")] == [1, 1, 1, 3, 2]
    assert {(r["before"] or r["after"])["location"] for r in rows if r["undecided"]} == {"/1", "/2", "/3"}
    assert compare.new_errors(compare.compare(before, after)).count() == 2
    fields = compare.changes(compare.compare(before, after)).collect()
    assert [(f["field"], f["before"], f["after"]) for f in fields] == [("value", "1", "2")]
    flat = compare.compare(before, after, pair_moves=False)
    assert compare.summary(flat).first().asDict() == {"removed": 4, "added": 3, "changed": 1, "moved": 0, "unchanged": 1}


def test_rule_changes(spark):
    old, new = make_pack(), make_pack()
    new.constraints[0] = new._compiled(type(new.constraints[0])(**(vars(new.constraints[0]) | {"level": "ERROR", "target": "control"})))
    new.add(kind="expect", context="x", identifier="e")
    rows = {(r["identifier"], r["change"]) for r in compare.compare_rules(checks.rules_table(spark, old), checks.rules_table(spark, new)).collect()}
    assert rows == {("one-id", "releveled"), ("one-id", "retargeted"), ("e", "added")}


def test_baselines(spark):
    found = table(spark, finding(), finding(value="other"), finding(severity="UNVERIFIABLE", code="U"))
    entry = lambda *v: spark.createDataFrame([v], baseline.ENTRY)
    marked = baseline.apply(found, entry("C", "/a", "p", "v", "why", "2024-01-01")).collect()
    assert sum(r["acknowledged"] is not None for r in marked) == 1 and len(marked) == 3
    assert [r["code"] for r in baseline.apply(found, entry("C", "/z", "p", "v", "why", "2024-01-01")).collect()].count("BASELINE_STALE") == 1
    with pytest.raises(Refusal):
        baseline.apply(found, entry("U", "/a", "p", "v", "why", "2024-01-01"))
    for bad in (("C", "/a", "p", "v", " ", "2024-01-01"), ("C", "/a", "p", "v", "w", "2024-02-30"), ("C", "/a", "p", "v", "w", "24-1-1")):
        with pytest.raises(Refusal):
            baseline.check_entries(entry(*bad))
    with pytest.raises(Refusal):
        baseline.check_entries(entry("C", "/a", "p", "v", "w", "2024-01-01").unionByName(entry("C", "/a", "p", "v", "x", "2024-01-01")))
    assert baseline.draft(found).count() == 2
    gated = findings.gates(found)
    assert found.where(gated).count() == 2 and found.where(findings.gates(found, "info")).count() == 2


def test_packages(spark, pack):
    docs = from_texts(spark, {"a/cat.json": json.dumps(CATALOG), "a/prof.json": json.dumps(PROFILE), "b/copy.json": json.dumps(CATALOG)})
    facts = evaluate(docs, pack)
    met, reached = imports.closure(docs, facts.where("kind = 'scalar'"), docs)
    assert {r["doc_id"] for r in package.unreferenced(docs, met).collect()} == {"a/prof.json", "b/copy.json"}
    shared = {r["value"]: r["members"] for r in package.collisions(facts.where("kind = 'scalar' AND name = 'uuid'")).collect()}
    assert shared == {"00aa": ["a/cat.json", "b/copy.json"], "00bb": ["a/cat.json", "b/copy.json"]}
    assert package.not_in_package(met).count() == 0
    totals = package.totals(validate(docs, pack), docs)
    assert package.verdict(totals) == 0 and totals.count() == 3


def test_import_cycles_end(spark):
    scalars = spark.createDataFrame([("a.json", 0, "/x/imports/0/href", "href", "string", "b.json"), ("b.json", 0, "/x/imports/0/href", "href", "string", "./a.json"), ("a.json", 1, "/x/source", "source", "string", "a.json")], "doc_id string, ord int, pointer string, name string, jtype string, value string")
    docs = spark.createDataFrame([("a.json",), ("b.json",)], "doc_id string")
    met, reached = imports.closure(docs, scalars, docs)
    assert {(r["primary"], r["doc_id"]) for r in reached.collect()} == {(p, d) for p in ("a.json", "b.json") for d in ("a.json", "b.json")}
    assert met.where("primary = 'a.json' AND href = 'a.json' AND resolved_to IS NULL").count() == 1


def test_wanted_columns_and_facts_alone_are_carried_down(spark, pack):
    docs = from_texts(spark, {"d": '{"a/b": [1.0, true, null, {"c~": "x"}], "k": [[[[[[[[[[[[7]]]]]]]]]]]]}', "bad": "{"})
    every = shred(docs)
    for wanted in (("doc_id", "depth", "error"), ("pointer", "sval"), ("parent", "is_item", "n_children"), ("place", "order", "name")):
        assert sorted(map(repr, shred(docs, *wanted).collect())) == sorted(map(repr, every.select(*wanted).collect()))
    assert every.where("depth > 8").count() == 5 and every.count() == 21
    facts = from_texts(spark, {"a/cat.json": json.dumps(CATALOG), "a/prof.json": json.dumps(PROFILE)})
    whole = evaluate(facts, pack).collect()
    for kind in ("scalar", "undeclared", "selected", "missing"):
        assert sorted(map(repr, evaluate(facts, pack, (kind,)).collect())) == sorted(repr(r) for r in whole if r["kind"] == kind)


def test_names_that_many_documents_share_are_counted_once(spark):
    docs = spark.createDataFrame([(f"p/{k}/x.json",) for k in range(5)] + [("q/y.json",), ("r/y.xml",), ("r/y.xml",), ("z.json",)], "doc_id string")
    asking = [("p/0/x.json", "x.json"), ("a.json", "x.json"), ("a.json", "x.xml"), ("q/y.json", "y.json"), ("a.json", "y.xml"), ("a.json", "y.txt"), ("z.json", "z.xml"), ("a.json", None), ("a.json", "none")]
    edges = spark.createDataFrame([(p, p, "/h", n, n) for p, n in asking], "primary string, doc_id string, pointer string, href string, target_name string")
    members = imports.answering(edges, docs)
    counted = {(r["primary"], r["target_name"]): (r["n_candidates"], r["resolved_to"]) for r in imports.answered(edges, members).collect()}
    assert counted == {
        ("p/0/x.json", "x.json"): (4, None), ("a.json", "x.json"): (5, None), ("a.json", "x.xml"): (5, None), ("q/y.json", "y.json"): (1, "r/y.xml"), ("a.json", "y.xml"): (1, "r/y.xml"),
        ("a.json", "y.txt"): (2, None), ("z.json", "z.xml"): (0, None), ("a.json", None): (0, None), ("a.json", "none"): (0, None),
    }
    listed = {(r["primary"], r["target_name"]): r["candidates"] for r in imports.matched(edges, docs).collect()}
    assert {k: len(v) for k, v in listed.items()} == {k: n for k, (n, _) in counted.items()} and listed["p/0/x.json", "x.json"] == [f"p/{k}/x.json" for k in range(1, 5)]


def test_back_matter_links(spark):
    rows = [("p.json", 0, "/m/back-matter/resources/0/uuid", "uuid", "string", "u1"), ("p.json", 1, "/m/back-matter/resources/0/rlinks/0/href", "href", "string", "#x"), ("p.json", 2, "/m/back-matter/resources/0/rlinks/1/href", "href", "string", "https://h/x/cat.xml?q#f"), ("p.json", 3, "/m/imports/0/href", "href", "string", "#u1")]
    scalars = spark.createDataFrame(rows, "doc_id string, ord int, pointer string, name string, jtype string, value string")
    assert [r["target_name"] for r in imports.named_edges(scalars).collect()] == ["cat.xml"]


def test_patches(spark):
    document = {"m": {"a": [1, 2], "b": {"c": 1}}}
    steps = [{"op": "add", "path": "/m/a/-", "value": 3}, {"op": "remove", "path": "/m/a/0"}, {"op": "replace", "path": "/m/b/c", "value": {"d": 1}}]
    assert patch.apply_patch(document, steps) == {"m": {"a": [2, 3], "b": {"c": {"d": 1}}}} and document["m"]["a"] == [1, 2]
    for bad in ([{"op": "move", "path": "/m"}], [{"op": "add", "path": "/m/x"}], [{"op": "remove", "path": "/m/z"}], [{"op": "replace", "path": "/m/a/9", "value": 1}], [{"op": "add", "path": "m", "value": 1}], {}):
        with pytest.raises(Refusal):
            patch.apply_patch(document, bad)
    docs = from_texts(spark, {"d": json.dumps({"m": {"uuid": "u", "metadata": {"title": "t", "last-modified": "2024-01-01T00:00:00Z"}, "x": [{"uuid": "v", "href": "#u"}]}}), "e": '{"m": {}}'})
    rows = {(r["doc_id"], r["defect"]): r["text"] for r in patch.with_defects(docs).collect()}
    assert all(rows["d", n] for n in patch.DEFECTS) and [n for n in patch.DEFECTS if rows["e", n]] == ["add_undeclared"]
    ops = spark.createDataFrame([([("add", "/a", "TODO later"), ("add", "/b", "fine"), ("remove", "/c", None)],)], "o " + patch.OPERATION)
    assert ops.select(patch.placeholders(F.col("o"))).first()[0] == ["/a"]


def test_texts(spark):
    held = texts.sections(spark.createDataFrame([("s", "before\n# A\nbody a\n## B\nbody b\n# C\n\n")], "source string, text string"))
    assert [(r["path"], r["body"]) for r in held.orderBy("number").collect()] == [([], "before"), (["A"], "body a"), (["A", "B"], "body b")]
    near = texts.section_for(spark.createDataFrame([("s", "/A/3/B/0/x")], "source string, location string"), held).collect()
    assert near[0]["path"] == ["A", "B"]
    sources = spark.createDataFrame([("s", "It says:  “quite a long  sentence here, word for word”."), ("t", "nothing")], "source string, text string")
    quotes = spark.createDataFrame([(1, "s", 'says: "quite a long sentence'), (2, "s", "too short"), (3, "s", "this sentence is not there at all"), (4, "z", "quite a long sentence here"), (5, "t", "quite a long sentence here"), (6, "s", "longsentencewithoutspaces here")], "quote_id int, source string, quote string")
    verdicts = {r["quote_id"]: r["verdict"] for r in texts.verified_quotes(quotes, sources).collect()}
    assert [verdicts[k][:9] for k in (1, 2, 3, 4, 5, 6)] == ["ok", "too short", "not found", "names a s", "not found", "not found"]
    one = lambda c: spark.range(1).select(c).first()[0]
    guard = texts.Guard(judging=(r"\b(?:is|are) (?:\w+ )?(?:compliant|ready|secure|low)\b",), boundary=(r"\bwhether\b",))
    assert one(texts.screen(F.lit("Fine. The system is fully compliant. Whether it is secure is unknown.\nIt is ready."), guard)) == f"Fine. {texts.WITHHELD} Whether it is secure is unknown.\n{texts.WITHHELD}"
    assert one(texts.withheld_sentences(F.lit("The risk is low. Ok."), guard)) == ["The risk is low."]
    assert one(texts.screen(F.lit("It is secure. Yes."), texts.Guard())) == "It is secure. Yes."
    assert one(texts.strike_markers(F.lit("See [Q1], [Q12]."), F.array(F.lit("Q1")))) == "See [Q1], [quote Q12 withheld]."
    long = "This is a quotation of more than forty letters"
    assert one(texts.strike_inline(F.lit(f'He said "{long}" and "{long} too".'), F.array(F.lit(long)))) == f'He said "{long}" and {texts.INLINE_WITHHELD}.'
    assert one(texts.reply_json(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}' and one(texts.reply_json(F.lit("none"))) is None
    assert one(texts.constraint_ids(F.lit("constraint one-id (is-unique, level ERROR)"))) == ["one-id"]


def test_budget_stops_at_the_first_overflow(spark):
    rows = [(1, "s", "a", "x" * 5), (2, "s", "a", "x" * 5), (3, "s", "b", "x" * 9), (4, "s", "c", "x")]
    kept = texts.within_budget(spark.createDataFrame([("q", *r) for r in rows], "q string, n int, source string, label string, passage string"), ["q"], ["n"], each=8, total=12).collect()
    assert [r["n"] for r in kept] == [1]


def test_quotations_match_a_plain_search(spark):
    import random

    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma-delta", "of", "a", "internationalisation", "counterrevolutionaries", "electroencephalography", "é", "“on”"]
    held = [(f"s{k}", " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for k in range(40)] + [("empty", ""), ("none", None), ("s0", "other alpha beta of a alpha of")]
    wanted = []
    for k in range(120):
        text = held[rnd.randrange(40)][1]
        start = rnd.randrange(len(text) + 1)
        wanted.append((k, text[start : start + rnd.randrange(15, 60)] + ("x" if k % 9 == 0 else "")))
    wanted += [(200, "ternationalisation cou"), (201, "ounterrevolutionarie"), (202, "unterrevolutionarie"), (203, None), (204, "lectroencephalography")]
    plain = lambda t: " ".join((t or "").translate(str.maketrans("“”", '""')).split())
    want = {(k, s) for k, q in wanted for s, t in held if len(plain(q)) >= 20 and plain(q) in plain(t)}
    got = texts.quoted_in(spark.createDataFrame(wanted, "quote_id int, quote string"), spark.createDataFrame(held, "source string, text string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60 and {k for k, _ in want} >= {200, 201, 204}
    assert texts.quoted_in(spark.createDataFrame([(1, "short")], "quote_id int, quote string"), spark.createDataFrame(held, "source string, text string")).count() == 0


def test_quotations_are_read_against_their_own_source_only(spark):
    held = spark.createDataFrame([("s", "a sentence that  both texts hold"), ("t", "a sentence that both texts hold"), ("s", "nothing")], "source string, text string")
    asked = spark.createDataFrame([(1, "s", "sentence that both texts"), (2, "t", "sentence that neither holds"), (3, "z", "sentence that both texts"), (4, "s", "too short")], "quote_id int, source string, quote string")
    assert [tuple(r) for r in texts.quoted_there(asked, held).collect()] == [(1, "s")]
    assert {r["quote_id"]: r["verdict"] for r in texts.verified_quotes(asked, held).collect()} == {1: "ok", 2: "not found verbatim in that source", 3: "names a source that does not exist", 4: "too short to verify"}


@pytest.mark.parametrize("small", [True, False])
def test_keywords_are_counted_alike_with_and_without_broadcast(spark, monkeypatch, small):
    monkeypatch.setattr(texts, "is_small", lambda df: small)
    asked = spark.createDataFrame([(1, "red fox hunting"), (2, "fox"), (3, None)], "query_id int, query string")
    held = spark.createDataFrame([("a", "x", "a red fox"), ("a", "y", "fox fox"), ("b", "x", "hunting the red fox"), ("c", "", None)], "source string, label string, passage string")
    rows = texts.keyword_top(asked, held, 2).collect()
    assert {(r["query_id"], r["source"], r["label"], r["overlap"], r["place"]) for r in rows} == {(1, "b", "x", 3, 1), (1, "a", "x", 2, 2), (2, "a", "x", 1, 1), (2, "a", "y", 1, 2)}


def test_budgets_of_large_groups(spark):
    rows = [(f"g{k % 3}", k, f"s{k % 50}", str(k), "x" * (k % 7)) for k in range(900)] + [("g2", 5, "s5", "5", "again"), (None, 1, None, None, "xx"), ("h", None, "s", "l", None)]
    held = spark.createDataFrame(rows, "shelf string, n int, source string, label string, passage string").repartition(6)
    got = {(r["shelf"], r["n"], r["label"]): r["spent"] for r in texts.within_budget(held, ["shelf"], ["n"], each=5, total=40).collect()}
    for shelf in ("g0", "g1", "g2"):
        spent = 0
        for g, n, _, label, passage in sorted((r for r in rows[:900] if r[0] == shelf), key=lambda r: r[1]):
            spent += len(passage[:5])
            assert (got.get((g, n, label)) == spent) == (spent <= 40), (g, n)
    assert got[(None, 1, None)] == 2


def test_scoring(spark):
    unit = lambda *u: spark.createDataFrame([(x,) for x in u], "unit string")
    assert [r[0] for r in scoring.coverage(unit("a", "b"), unit("a")).collect()] == ["b"]
    with pytest.raises(Refusal):
        scoring.coverage(unit("a"), unit("z"))
    prov = lambda *r: spark.createDataFrame(list(r), "shard int, model string, commit string")
    cases = spark.createDataFrame([(0, "a"), (1, "b")], "shard int, unit string")
    assert scoring.merge_shards(cases, prov((0, "m", "x"), (1, "m", "y")), ["unit"]).count() == 2
    with pytest.raises(Refusal):
        scoring.merge_shards(cases, prov((0, "m", "x"), (1, "n", "y")), ["unit"])
    with pytest.raises(Refusal):
        scoring.merge_shards(cases.unionByName(spark.createDataFrame([(1, "a")], "shard int, unit string")), prov((0, "m", "x"), (1, "m", "x")), ["unit"])
    before, after = table(spark, finding(), finding(prop="q")), table(spark, finding(prop="new"))
    got = scoring.repair_outcomes(before, after, spark.createDataFrame([("", "/a", "C")], "doc_id string, location string, code string")).first()
    assert (got["resolved"], got["introduced"], got["clean"]) == (True, 1, False)
    assert scoring.new_errors(after, before).count() == 1
    files = spark.createDataFrame([("a", "1"), ("b", "x")], "id string, sha256 string")
    states = {r["id"]: r["state"] for r in scoring.pinned(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, sha256 string"), files).collect()}
    assert states == {"a": "present", "b": "refused", "c": "absent"}
    held = spark.createDataFrame([("x", "1", False, False), ("x", "2", True, False)], "category string, id string, lexical boolean, judged boolean")
    assert scoring.boundary_summary(held).first().asDict() == {"category": "x", "cases": 2, "held": 1, "crossed": ["2"]}


def test_provenance(spark, pack):
    assert codes(spark).count() == 22
    assert constraints_by_id(spark, pack, "one-id").first()["target"] == "//control"
    counted = {r["kind"]: (r["published"], r["evaluated"]) for r in coverage_table(spark, pack).collect()}
    assert counted["expect"] == (1, 0) and counted["index"] == (1, 1)
    assert coverage_table(spark, pack, evaluated=False).count() == 1
    module = '<x><is-unique id="a" target="t"><key/></is-unique><is-unique id="b"/></x>'
    take = lambda i: spark.range(1).select(declaration(F.lit(module), "is-unique", i)).first()[0]
    assert take("a") == '<is-unique id="a" target="t"><key/></is-unique>' and take("b") == '<is-unique id="b"/>' and take("c") is None


def test_scalars_of_no_use_become_no_rows(spark):
    from assayer.operators import evaluate as ev
    from assayer.operators.shred import read
    from assayer.plans import tables as t

    text = '{"order":{"number":1,"status":"F","lines":[{"flag":"R","linenumber":3},{"flag":"N","linenumber":"x"}]}}'
    docs = spark.createDataFrame([("a", text)], "doc_id string, text string")
    rules = t.order_pack([{"kind": "has-cardinality", "context": "order", "target": "line[@flag='R']", "identifier": "r"}])
    rows = ev._models(read(docs), sorted(rules.schema.models))
    numbers = rules.evaluated()
    nodes = ev.typed_nodes(rows, rules, False, ev._tests(rules, numbers), numbers, ev._used({"selected"}, numbers), ())
    assert nodes.count() == 5  # the document, the order, its lines and each of the two
    assert [r["pointer"] for r in ev.evaluate(docs, rules, ("selected",)).collect()] == ["/order/lines/0"]
    named = ev.evaluate(docs, rules, ("scalar",), ("flag",)).collect()
    assert sorted(r["pointer"] for r in named) == ["/order/lines/0/flag", "/order/lines/1/flag"]
    both = ev.evaluate(docs, rules, ("scalar", "mistyped"), ("flag",)).collect()
    assert sorted(r["pointer"] for r in both) == ["/order/lines/0/flag", "/order/lines/1/flag", "/order/lines/1/linenumber"]


def test_levels_are_counted_alike_by_both_ways(spark, monkeypatch):
    from assayer.operators import shred

    texts = ["", "1", "[]", '{"a":[{"b":[1,{"c":{}}]}]}', r'{"a\"[[[":"]]{{\\","b":[[]]}', "[[[[[[1]]]]]]", "[[[[[[[[[[{}]]]]]]]]]]", '{"a":"[', "[}", "]["]
    docs = spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)] + [("n", None)], "doc_id string, text string")
    said = lambda: [tuple(r) for r in shred.read(docs).select("doc_id", "levels", "error").orderBy("doc_id").collect()]
    quick = said()
    monkeypatch.setattr(shred, "SHALLOW", 0)
    assert said() == quick


def test_objects_of_unread_scalars_are_not_opened(spark):
    from assayer.operators import shred

    docs = from_texts(spark, {"d": '{"o":{"s":"x","t":true,"n":null,"e":{},"l":[{"k":1,"_":"y"},{"k":[1]},2,"z",[]]}}'})
    every = shred.shred(docs)
    for wanted in (("depth",), ("pointer", "leaf"), ("name", "place", "depth")):
        assert sorted(map(repr, shred.shred(docs, *wanted).collect())) == sorted(map(repr, every.select(*wanted).collect()))
    rows = shred.read(docs)
    top = shred.roots(rows).select("doc_id", "fresh", "m", "a", "name", "depth", "v")
    held = lambda name, v: F.coalesce(shred.is_object(v) | shred.is_array(v), F.lit(False))
    lean = shred.descend(top, shred.levels_of(rows), of_use=held, read_of=[])
    assert sorted((r["name"], r["depth"]) for r in lean.collect()) == [("", 0), ("e", 2), ("k", 4), ("l", 2), ("l", 3), ("l", 3), ("l", 3), ("o", 1)]


def test_keys_are_taken_by_path_as_by_members(spark):
    from assayer.operators import evaluate as ev
    from assayer.rules.pack import KeyField

    texts = ['{"a":null}', '{"a":1.50}', '{"a":{"b":1}}', '{"a":[1]}', '{"a":true,"b\'\\"c":"q"}', "{}", "[1]", '{"a":"x\\"y"}', '{"a":123456789012345678901234567890}']
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string").select("k", F.try_parse_json("text").alias("v"))
    plain = lambda name: F.try_element_at(ev.members(F.col("v")), F.lit(name))
    by_members = lambda name: F.when(plain(name).isNotNull() & ev.members(plain(name)).isNull() & ev.items(plain(name)).isNull(), ev.scalar_text(plain(name), ev.json_kind(plain(name))))
    for name in ("a", "b'\"c", "b"):
        found = rows.select(ev._key_text(KeyField(f"@{name}", None)).alias("x"), by_members(name).alias("y"), ev._member(name).isNotNull().alias("has"), plain(name).isNotNull().alias("had")).collect()
        assert [(r["x"], r["has"]) for r in found] == [(r["y"], r["had"]) for r in found]


def test_constraints_are_told_without_workers_outside_the_jvm(spark):
    from assayer.operators import checks
    from assayer.plans import tables as t

    plan = checks.rules_table(spark, t.trade_pack())._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ExternalRDD" not in plan


def test_moves_are_paired_without_another_join_of_the_runs(spark):
    make = lambda *places: findings.as_findings(spark.createDataFrame(
        [("d", "C", "ERROR", place, prop, "v", "m") for place, prop in places], "doc_id string, code string, severity string, location string, prop string, value string, message string"
    ).withColumn("rule", findings.rule("r")))
    found = compare.compare(make(("/a", "p"), ("/b", "q"), ("/c", "s"), ("/e", "u")), make(("/x", "p"), ("/b", "q"), ("/y", "s"), ("/z", "s"), ("/f", "w")))
    rows = [(r["status"], r["before"] and r["before"]["location"], r["after"] and r["after"]["location"], r["undecided"]) for r in found.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, [
        ("moved", "/a", "/x", False), ("unchanged", "/b", "/b", False), ("removed", "/c", None, True), ("added", None, "/y", True), ("added", None, "/z", True),
        ("removed", "/e", None, False), ("added", None, "/f", False),
    ]))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 2


def test_objects_that_no_step_can_stand_on_become_no_rows(spark):
    from assayer.operators import evaluate as ev
    from assayer.operators.shred import read
    from assayer.plans import tables as t

    texts = {
        "a": '{"order":{"number":1,"priority":"p","lines":[{"flag":"R"},{"flag":"N"}]}}', "b": '{"order":{"number":2,"priority":"p","lines":[{"orders":[{"number":3,"priority":"p"}]},{"x":[[1]]}]}}',
        "c": '{"order":{"number":4,"priority":"q","x":[1,[2]]}}',
    }
    docs = from_texts(spark, texts)
    rules = t.order_pack([{"kind": "is-unique", "context": "order", "target": ".[@priority='p']", "keys": ["@number"], "identifier": "r"}])
    numbers = rules.evaluated()
    found = ev.evaluate(docs, rules, ("selected",)).collect()
    assert sorted((r["doc_id"], r["pointer"], r["key"]) for r in found) == [("a", "/order", '["1"]'), ("b", "/order", '["2"]'), ("b", "/order/lines/0/orders/0", '["3"]')]
    rows = ev._models(read(docs.where("doc_id = 'a'")), sorted(rules.schema.models))
    nodes = ev.typed_nodes(rows, rules, False, ev._tests(rules, numbers), numbers, ev._used({"selected"}, numbers), ())
    assert nodes.count() == 3  # the document, the order and its list of lines, none of which becomes a row


def test_only_nodes_of_use_stay_in_the_descent(spark):
    from assayer.operators import shred

    docs = from_texts(spark, {"d": '{"o":{"s":"x","l":[{"k":1},[2]]},"e":{}}'})
    rows = shred.read(docs)
    top = shred.roots(rows).select("doc_id", "fresh", "m", "a", "name", "raw", "depth", "item", "leaf")
    whole = {r["raw"] for r in shred.descend(top, shred.levels_of(rows)).where("leaf").collect()}
    kept = [r["raw"] for r in shred.descend(top, shred.levels_of(rows), stays=F.col("leaf")).collect()]
    assert sorted(kept) == sorted(whole) == ["/o/l/0/k", "/o/l/1/0", "/o/s"]


def test_words_of_constraints_meet_only_what_repeats_a_key(spark):
    from assayer.operators import checks, evaluate as ev
    from assayer.plans import tables as t

    facts = spark.createDataFrame([("d", "selected", f"/order/lines/{k}", 0, "/order", 0, [str(k)], '["1"]') for k in (0, 1)], "doc_id string, kind string, pointer string, rule int, context string, alternative int, place array<string>, key string")
    facts = facts.select(*[F.col(n) if n in facts.columns else F.lit(None).cast(k).alias(n) for n, k in {"doc_id": "string", **ev.TYPES}.items()])
    rules = t.order_pack([{"kind": "is-unique", "context": "order", "target": "line", "keys": ["@linenumber"], "identifier": "one-line"}])
    found = checks.uniqueness(facts, rules)
    assert [(r["location"], r["value"]) for r in found.collect()] == [("/order/lines/1", "1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("Window")


def test_orders_are_dealt_before_documents_are_made_of_them(spark, sf_dir):
    from assayer.plans import tables as t

    assert "RepartitionByExpression" in t.trade_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_long_cuts_leave_the_setting_as_it_was(spark):
    from assayer import durable

    was = spark.conf.get(durable.INFERRING)
    assert durable.cut_long(spark.range(3).where("id > 1")).count() == 1 and spark.conf.get(durable.INFERRING) == was
    with pytest.raises(Exception):
        durable.cut_long(spark.range(1).select(F.raise_error(F.lit("x"))))
    assert spark.conf.get(durable.INFERRING) == was
