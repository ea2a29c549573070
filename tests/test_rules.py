"""Targets, schemas and packs."""

import pytest
from assayer.errors import RuleError
from assayer.rules.pack import KeyField, pack_of, read_modules
from assayer.rules.schema import Schema
from assayer.rules.target import Step, Test, parse_target, parse_value_target


@pytest.mark.parametrize(
    ("text", "paths"),
    [
        (".", ((),)),
        ("a", ((Step(("a",)),),)),
        ("a/b", ((Step(("a",)), Step(("b",))),)),
        ("a|b", ((Step(("a",)),), (Step(("b",)),))),
        ("//a", ((Step(("a",), True),),)),
        (".//a", ((Step(("a",), True),),)),
        ("./a", ((Step(("a",)),),)),
        ("//(a|b)", ((Step(("a", "b"), True),),)),
        ("a//b", ((Step(("a",)), Step(("b",), True)),)),
        ("a[@x='1'][c]", ((Step(("a",), False, (Test("equals", "x", ("1",)), Test("child", "c"))),),)),
        ("a[@x=('1', \"2\") and starts-with(@y,'z')]", ((Step(("a",), False, (Test("equals", "x", ("1", "2")), Test("starts", "y", ("z",)))),),)),
        (".[has-oscal-namespace('n')]/b", ((Step((), False, (Test("namespace", "ns", ("n",)),)), Step(("b",))),)),
    ],
)
def test_targets(text, paths):
    assert parse_target(text) == paths


@pytest.mark.parametrize("text", ["", "*", "a/*", "a/", "//", "a//", "doc(x)", "a[not(b)]", "a[", "a[@x]", "a[@x=y]", "(.|a)/b", "a/.", "../a", "a|", "a b"])
def test_refused_targets(text):
    assert parse_target(text) is None


def test_value_targets():
    assert parse_value_target("@f") == (((),), "f")
    assert parse_value_target("a/@f") == (((Step(("a",)),),), "f")
    assert parse_value_target("a/@f|b/@f") == (((Step(("a",)),), (Step(("b",)),)), "f")
    assert parse_value_target("a") == (((Step(("a",)),),), "")
    for bad in ("a/@f|b/@g", "(.|a)/p/@name", "a[@f", "@", "a/@f/b"):
        assert parse_value_target(bad) is None


def schema(**definitions):
    return {"definitions": definitions, "oneOf": [{"properties": {"root": {"type": "object", "properties": {"x": {"$ref": "#/definitions/x"}}}}}]}


def shape_of(**definitions):
    made = Schema(schema(**definitions))
    return made, made.shape(made.number(made.properties(made.shape(made.models["root"]))["x"]))


def test_shapes_of_schema_nodes():
    made, found = shape_of(x={"title": "X", "$ref": "#/definitions/y"}, y={"anyOf": [{"$ref": "#/definitions/IdDatatype"}, {"enum": ["a"]}]}, IdDatatype={"type": "string", "pattern": "^x$"})
    assert (found.kind, found.title, found.declared, found.enums, found.datatype.pattern) == ("scalar", "X", "string", ("a",), "^x$")
    assert shape_of(x={"anyOf": [{"properties": {"a": {}}}, {"properties": {"b": {}}}]})[1].kind == "choice"
    one = {"$ref": "#/definitions/y"}
    assert shape_of(x={"anyOf": [one, {"type": "array", "items": one}]}, y={"type": "object"})[1].kind == "either"
    assert shape_of(x={"anyOf": [{"type": "string"}, {"type": "integer"}]})[1].kind == "open"
    assert shape_of(x={"required": ["a"]})[1].declared == "object"
    assert shape_of(x={})[1].kind == "free"


def test_datatypes_take_the_narrower_type_and_their_own_pattern():
    made, _ = shape_of(
        x={}, NumberDatatype={"type": "number"}, WholeDatatype={"allOf": [{"$ref": "#/definitions/NumberDatatype"}, {"type": "integer", "minimum": 1}]},
        BaseDatatype={"type": "string", "pattern": "^.+$"}, NameDatatype={"allOf": [{"$ref": "#/definitions/BaseDatatype"}, {"pattern": "^[a-z]+$"}]},
    )
    assert (made.datatypes["WholeDatatype"].json_type, made.datatypes["WholeDatatype"].minimum) == ("integer", 1)
    assert made.datatypes["NameDatatype"].pattern == "^[a-z]+$"


def test_schemas_that_cannot_be_read():
    for bad in ({}, {"definitions": {}}, {"definitions": {}, "oneOf": []}):
        with pytest.raises(RuleError):
            Schema(bad)
    with pytest.raises(RuleError):
        shape_of(x={"$ref": "#/definitions/gone"})
    with pytest.raises(RuleError):
        shape_of(x={"$ref": "#/definitions/y"}, y={"$ref": "#/definitions/x"})


def test_skip_reasons():
    pack = pack_of(schema(x={}, TokDatatype={"type": "string", "pattern": "^\\p{L}$"}, LowDatatype={"type": "string", "pattern": "^[a-z]$"}))
    said = {
        "allowed-values": {}, "expect": {}, "strange": {}, "is-unique": {"target": "doc(x)", "keys": ["."]}, "index": {"target": "a", "keys": []},
        "index-has-key": {"target": "a", "keys": ["@a/b"]}, "has-cardinality": {"target": "a/*"},
    }
    for kind, more in said.items():
        pack.add(kind=kind, context="root", **more)
    for more in ({}, {"regex": "a$"}, {"regex": "^(a$"}, {"datatype": "tok"}, {"datatype": "none"}):
        pack.add(kind="matches", context="root", target="@f", **more)
    assert all(c.skipped for c in pack.constraints)
    for more in ({"regex": "^a$"}, {"datatype": "low"}):
        pack.add(kind="matches", context="root", target="@f", **more)
    pack.add(kind="index-has-key", context="root", target="a", keys=[KeyField("@a", "x(.)")], index="nowhere")
    assert [c.skipped for c in pack.constraints[-3:]] == ["", "", ""]
    assert [why for _, why in pack.stranded()] == ["no declaration"]
    assert pack.skipped_counts()["matches"] == 5


MODULE = """<METASCHEMA xmlns="http://csrc.nist.gov/ns/oscal/metaschema/1.0">
<define-assembly name="thing"><use-name>item</use-name>
 <model><assembly ref="part"><group-as name="parts"/></assembly></model>
 <constraint><is-unique id="u" target="part" level="WARNING"><key-field target="@id" pattern="x(.*)"/></is-unique>
 <has-cardinality target="part" min-occurs="1" max-occurs="unbounded"/></constraint></define-assembly>
<define-assembly name="part"><define-flag name="id"><constraint><allowed-values id="v"/></constraint></define-flag></define-assembly></METASCHEMA>"""


def test_modules():
    pack = read_modules(schema(x={}), {"m.xml": MODULE})
    unique, count, values = pack.constraints
    assert (unique.identifier, unique.severity, unique.context, unique.keys) == ("u", "WARNING", "item", (KeyField("@id", "x(.*)"),))
    assert (count.low, count.high) == (1, None) and values.skipped
    assert pack.properties("part") == {"part", "parts"} and "item" in pack.properties("thing")
    with pytest.raises(RuleError):
        read_modules(schema(x={}), {"m.xml": "<!DOCTYPE x>" + MODULE})
