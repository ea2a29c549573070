"""Facts of documents: what their nodes are by the schema, and which of them constraints select.

Documents are shredded level by level (``operators.shred``), and every new level meets
two things there:

* the *transition table* of the schema, a row for each state and step (a property or an
  item), broadcast; which of several object alternatives holds is a vote of the required
  and undeclared names of each alternative over the names that the object has;
* the *tests* of all constraints, evaluated on the node itself; what a node passes travels
  down with its way, so a predicate on a node above is known below without a join.

Targets are matched against a *dictionary of ways*: the distinct ways of names from the root
to a node, with names that no constraint speaks of made one. It is small however many
documents there are, so each way is matched once, with the places of the nodes that tests are
asked of, and the matches are broadcast to the nodes. No step needs a shuffle of nodes, and
all set questions (uniqueness, look-ups, counts, imports) are asked of the facts with joins,
windows and aggregates.

Facts by ``kind``: model, error, scalar, missing, undeclared, mistyped, unread, no_branch,
short, context (of counted constraints), selected (node and key of a constraint) and value
(of a pattern constraint).
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from assayer.durable import cut_long
from assayer.errors import Refusal
from assayer.operators.shred import descend, is_array, is_object, is_read, items, json_kind, levels_of, members, names_of, no_texts, read, roots, scalar_text, shells
from assayer.rules.pack import NAMESPACE, Constraint, KeyField, RulePack
from assayer.rules.schema import Schema, Shape
from assayer.rules.target import Path, Test

FACTS = (
    "doc_id string, kind string, pointer string, name string, value string, jtype string, datatype string, title string, detail string, "
    "enums array<string>, low int, found int, rule int, context string, alternative int, place array<string>, key string, model string, ord array<string>"
)
FACT = FACTS.replace("doc_id string, ", "", 1)
TYPES = dict(part.split(" ") for part in FACT.split(", "))
#: Ways that a dictionary may hold; rules speak of few names, so real ones hold hundreds.
MOST_WAYS = 100_000
ITEM = "*"
#: The state of the document itself, above its root, and that of nodes of which the schema says nothing.
TOP, HIDDEN = -1, -2

ALTERNATIVE = "id:int,title:string,required:array<string>,declared:array<string>,closed:boolean,needs:string,says:map<string,string>"
STATE = (
    f"id:int,kind:string,title:string,declared:string,datatype:string,enums:array<string>,reason:string,required:array<string>,named:array<string>,"
    f"closed:boolean,low:int,has_item:boolean,said:string,alternatives:array<struct<{ALTERNATIVE}>>"
)
TRANSITIONS = f"_state int, _step string, _listed boolean, s struct<{STATE}>"


def _told_as(value: Any, kind: DataType) -> Any:
    """A value as JSON has it: tuples under the names of their fields."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: _told_as(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    return [_told_as(v, kind.elementType) for v in value] if isinstance(kind, ArrayType) else value


def fixed_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver knows, as a literal of the plan: no worker outside the JVM hands them over."""
    kind = StructType.fromDDL(schema)
    text = json.dumps([_told_as(r, kind) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), ArrayType(kind))))


class States:
    """The states of a schema that documents can reach, as rows of the transition table."""

    def __init__(self, schema: Schema) -> None:
        self.schema, self.ids, self.open = schema, {}, []
        self.rows: list[tuple] = []
        for name, number in schema.models.items():
            self._to(TOP, name, number)
        while self.open:
            self._below(*self.open.pop())

    def _id(self, shape: Shape) -> int:
        """The number of a shape; alternatives carry the title of their choice."""
        key = (shape.kind, shape.node, shape.title, shape.datatype, shape.enums, shape.parts, shape.reason)
        if key not in self.ids:
            self.ids[key] = len(self.ids)
            self.open.append((self.ids[key], shape))
        return self.ids[key]

    def _to(self, state: int, step: str, number: int) -> None:
        shape = self.schema.shape(number)
        either = [self.schema.shape(p) for p in shape.parts] if shape.kind == "either" else [shape, shape]
        self.rows += [(state, step, listed, self._told(either[listed])) for listed in (False, True)]

    def _object(self, shape: Shape) -> bool:
        return shape.kind == "object" or (shape.kind == "free" and shape.datatype is None)

    def _below(self, state: int, shape: Shape) -> None:
        if self._object(shape):
            for name, node in self.schema.properties(shape).items():
                if isinstance(node, dict):
                    self._to(state, name, self.schema.number(node))
        if shape.kind in ("array", "free") and shape.datatype is None and (item := self.schema.item(shape)) is not None:
            self._to(state, ITEM, item)

    def _named(self, shape: Shape) -> list[str]:
        return [n for n, node in self.schema.properties(shape).items() if isinstance(node, dict)]

    def _alternatives(self, shape: Shape) -> list[tuple]:
        found = []
        for number in shape.parts:
            part = self.schema.part(number, shape.title)
            says = {k: json.dumps(v, sort_keys=True) for k, v in self.schema.properties(part).items()}
            needs = json.dumps(sorted(self.schema.required(part)))
            found.append((self._id(part), part.title, self.schema.required(part), list(self.schema.properties(part)), self.schema.closed(part), needs, says))
        return found

    def _told(self, shape: Shape) -> tuple:
        held, array = self._object(shape), shape.kind in ("array", "free") and shape.datatype is None
        return (
            self._id(shape), shape.kind, shape.title, shape.declared, shape.datatype.name if shape.datatype else None, list(shape.enums) or None, shape.reason,
            self.schema.required(shape) if held else [], self._named(shape) if held else [], held and self.schema.closed(shape),
            self.schema.least_items(shape) if array else None, array and self.schema.item(shape) is not None,
            self.schema.alternatives(shape) if shape.kind == "choice" else "", self._alternatives(shape) if shape.kind == "choice" else [],
        )


def transitions(spark: SparkSession, schema: Schema) -> DataFrame:
    """The transition table of a schema."""
    return fixed_rows(spark, States(schema).rows, TRANSITIONS)


def _names() -> Column:
    return F.coalesce(F.map_keys("m"), no_texts())


def _listed(names: Column) -> Column:
    return F.array_join(F.array_sort(names), ", ")


def _fitting() -> Column:
    """The alternatives that have all they require and, where they are closed, declare all that is there."""
    fits = lambda a: (F.size(F.array_except(a["required"], _names())) == 0) & (~a["closed"] | (F.size(F.array_except(_names(), a["declared"])) == 0))
    return F.filter(F.col("s.alternatives"), fits)


def _agree(fitting: Column) -> Column:
    """Whether all of them require the same and say the same of what is there."""
    said = F.transform(fitting, lambda a: F.struct(a["needs"].alias("needs"), F.transform(F.array_sort(_names()), lambda n: F.try_element_at(a["says"], n)).alias("says")))
    return F.size(F.array_distinct(said)) == 1


NOTE = "array<struct<kind:string,name:string,detail:string,low:int,found:int>>"


def _note(kind: str, name: Column, detail: Column, low: Column | None = None, found: Column | None = None) -> Column:
    whole = lambda c: (F.lit(None) if c is None else c).cast("int")
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"), whole(low).alias("low"), whole(found).alias("found"))


def _typed(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with what the columns need that come with them: state, outcome and notes of new rows, by the state that they met."""
    kind, shape = F.col("jtype"), F.col("s.kind")
    said = F.when(kind == "object", "an object").when(kind == "array", "an array").otherwise(F.concat(F.lit("a JSON "), kind))
    rows = rows.withColumn("fit", F.when(F.col("fresh") & (shape == "choice") & (kind == "object"), _fitting()))
    fit = F.col("fit")
    known = F.col("s.id").isNotNull()
    held = (kind == "object") & ((shape == "object") | ((shape == "free") & F.col("s.datatype").isNull()))
    listed = (kind == "array") & shape.isin("array", "free") & F.col("s.datatype").isNull()
    declared = F.col("s.declared")
    wrong = declared.isNotNull() & ~((kind == declared) | ((declared == "number") & (kind == "integer")))
    outcome = (
        F.when(~known, "hidden").when(shape == "open", "hidden").when((shape == "choice") & (kind != "object"), "hidden")
        .when(shape == "choice", F.when(F.size(fit) == 0, "hidden").when(_agree(fit), "object").otherwise("hidden"))
        .when(held, "object").when(listed, F.when(F.col("s.has_item"), "array").otherwise("hidden")).when(wrong, "hidden")
        .when(kind.isin("object", "array"), "hidden").otherwise("scalar")
    )
    rows = rows.withColumn("found", F.when(F.col("fresh"), outcome))
    first = F.get("fit", F.lit(0))
    chosen = shape == "choice"
    required, named = F.when(chosen, first["required"]).otherwise(F.col("s.required")), F.when(chosen, F.map_keys(first["says"])).otherwise(F.col("s.named"))
    title = F.when(chosen, first["title"]).otherwise(F.col("s.title"))
    assembly = F.when(title == "", "this object").otherwise(title)
    closed = F.when(chosen, first["closed"]).otherwise(F.col("s.closed"))
    is_object = F.col("found") == "object"
    none = F.array().cast(NOTE)
    missing = F.transform(F.array_except(required, _names()), lambda n: _note("missing", n, assembly))
    undeclared = F.transform(F.array_except(_names(), named), lambda n: _note("undeclared", n, assembly))
    name = F.col("name")
    one = lambda kind, detail: F.array(_note(kind, name, detail))
    nothing = F.concat(
        F.lit("no alternative accepts an object with the properties "), F.coalesce(F.nullif(_listed(_names()), F.lit("")), F.lit("(none)")), F.lit(": "), F.col("s.said")
    )
    other = (
        F.when(~known, none).when(shape == "open", one("unread", F.col("s.reason")))
        .when(chosen & (kind != "object"), one("unread", F.lit("the schema offers object alternatives and the value is no object")))
        .when(chosen & (F.size(fit) == 0), one("no_branch", nothing))
        .when(chosen, one("unread", F.lit("several alternatives accept the object and disagree about its properties")))
        .when(listed, one("unread", F.lit("the schema declares no shape for the items of this array")))
        .when(wrong, one("mistyped", F.concat(F.lit("the schema declares type '"), declared, F.lit("' here, and the value is "), said)))
        .when(kind.isin("object", "array"), one("mistyped", F.concat(F.lit("the schema declares type 'scalar' here, and the value is "), said))).otherwise(none)
    )
    short = (F.col("found") == "array") & (F.size("a") < F.col("s.low"))
    notes = (
        F.when(is_object, F.concat(missing, F.when(closed, undeclared).otherwise(none)))
        .when(F.col("found") == "hidden", other)
        .when(short, F.array(_note("short", name, F.lit(None).cast("string"), F.col("s.low"), F.size("a")))).otherwise(none)
    )
    state = F.when(is_object & chosen, first["id"]).when(F.col("found").isin("object", "array"), F.col("s.id")).otherwise(HIDDEN)
    new = F.col("fresh")
    return rows, {
        **({"notes": F.when(new, notes.cast(NOTE)).otherwise(F.col("notes"))} if "notes" in rows.columns else {}), "state": F.when(new, state).otherwise(F.col("state")),
        "outcome": F.when(new, F.col("found")).otherwise(F.col("outcome")),
        **{c: F.when(new, F.col(f"s.{c}")).otherwise(F.col(c)) for c in ("title", "datatype", "enums") if c in rows.columns},
    }


def _member(name: str) -> Column:
    """A member of the object ``v``, taken by its path, so that the others are not made."""
    quotes = [q for q in "'\"" if q not in name]
    if not name or not quotes or "]" in name:
        return F.try_element_at(members(F.col("v")), F.lit(name))
    return F.try_variant_get("v", f"$[{quotes[0]}{name}{quotes[0]}]", "variant")


def _bare(v: Column) -> Column:
    """Whether a value is there and no container."""
    return v.isNotNull() & ~is_object(v) & ~is_array(v)


def _text_of(v: Column) -> Column:
    # The usual kinds first; the others are told apart by more questions.
    usual = F.schema_of_variant(v).isin("STRING", "BIGINT")
    return F.when(usual, F.try_variant_get(v, "$", "string")).otherwise(scalar_text(v, json_kind(v)))


def _scalar_of(v: Column) -> Column:
    """The text of a value that is there and no container, else null."""
    usual = F.schema_of_variant(v).isin("STRING", "BIGINT")
    return F.when(usual, F.try_variant_get(v, "$", "string")).when(_bare(v), scalar_text(v, json_kind(v)))


def _passes(pack: RulePack, test: Test) -> Column:
    """Whether a node passes a test; false for a node that is no object, but for its namespace."""
    if test.kind == "namespace":
        space = _member(test.name)
        own = F.when(space.isNull(), F.lit(NAMESPACE)).when(json_kind(space) == "string", F.try_variant_get(space, "$", "string"))
        return F.coalesce(F.when(~is_object(F.col("v")), F.lit(NAMESPACE)).otherwise(own).isin(*test.values), F.lit(False))
    if test.kind == "equals":
        said = _scalar_of(_member(test.name)).isin(*test.values)
    elif test.kind == "starts":
        flag = _member(test.name)
        said = _bare(flag) & (json_kind(flag) == "string") & F.startswith(F.try_variant_get(flag, "$", "string"), F.lit(test.values[0]))
    else:
        filled = [(v := _member(n)).isNotNull() & ~F.is_variant_null(v) & (F.coalesce(F.size(items(v)), F.lit(1)) != 0) for n in sorted(pack.properties(test.name))]
        said = reduce(lambda a, b: a | b, filled)
    return F.coalesce(said, F.lit(False))


def _tests(pack: RulePack, rules: list[int]) -> list[Test]:
    """The tests of these constraints, each once."""
    return list(dict.fromkeys(t for k in rules for path in pack.constraints[k].paths or () for step in path for t in step.tests))


def _spoken(pack: RulePack, rules: list[int]) -> list[str]:
    """Property names that contexts and steps of these constraints speak of."""
    names = {n for k in rules for n in pack.properties(pack.constraints[k].context)}
    return sorted(names | {p for k in rules for path in pack.constraints[k].paths or () for step in path for n in step.names for p in pack.properties(n)})


def _ways(spoken: list[str], marks: list[Column]) -> dict[str, Column]:
    """The columns of the way to a new node: names, raw pointers and passed tests of the nodes that steps can stand on."""
    array, own = F.col("a").isNotNull(), F.col("item").isNotNull()
    # The items of a property stand for it; items of items are on no way by name.
    stands = F.when(own, ~F.col("nested")).otherwise(~array)
    known = F.when(~stands, F.lit("")).when(F.col("name").isin(*spoken) if spoken else F.lit(False), F.col("name")).otherwise("")
    adds = stands | own
    untested = F.array().cast("array<int>")
    # Tests are asked at the nodes of steps and contexts only, which all have a name that is spoken of.
    passed = F.when(known != "", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(marks)]))).otherwise(untested) if marks else untested

    new = F.col("fresh")
    longer = lambda column, value: F.when(new & adds, F.concat(column, F.array(value))).otherwise(F.col(column))
    return {
        "stands": F.when(new, stands).otherwise(F.col("stands")), "way": longer("way", known), "ways": longer("ways", F.col("raw")),
        "passed": longer("passed", passed), "nested": F.when(new, own & array).otherwise(F.col("nested")),
    }


def matches(way: tuple[str, ...], path: Path, properties, context: int) -> list[tuple[tuple[int, Test], ...]]:
    """How a path from the node at place ``context`` of a way ends at its last node: for each, the tests and the places they are asked at."""
    last = len(way) - 1
    going: list[tuple[int, tuple[tuple[int, Test], ...]]] = [(context, ())]
    for step in path:
        after = []
        for at, tests in going:
            if not step.names:
                after.append((at, (*tests, *((at, t) for t in step.tests))))
                continue
            names = set().union(*(properties(n) for n in step.names))
            for to in range(at + 1, last + 1 if step.deep else min(at + 1, last) + 1):
                if way[to] in names:
                    after.append((to, (*tests, *((to, t) for t in step.tests))))
        going = after
    return list(dict.fromkeys(tests for at, tests in going if at == last))


MATCH = "rule int, context int, alternative int, tests array<struct<at:int,test:int>>"


def _dictionary(spark: SparkSession, pack: RulePack, rules: list[int], ways: list[tuple[str, ...]], tests: list[Test]) -> DataFrame:
    """way, the matches that end there, in the order in which the first that holds is taken, and whether they ask for tests; those without are settled here."""
    number = {t: k for k, t in enumerate(tests)}
    rows = []
    for way in ways:
        held = []
        for k in rules:
            rule = pack.constraints[k]
            for context in range(1, len(way)):
                if way[context] in pack.properties(rule.context):
                    for alternative, path in enumerate(rule.paths or ()):
                        held += [(k, context, alternative, [(at, number[t]) for at, t in found]) for found in matches(way, path, pack.properties, context)]
        asks = any(m[3] for m in held)
        if not asks:
            held = list({(m[0], m[1]): m for m in reversed(held)}.values())[::-1]
        if held:
            rows.append((list(way), held, asks))
    kind = MATCH.replace(", ", ",").replace(" ", ":")
    return fixed_rows(spark, rows, f"way array<string>, matches array<struct<{kind}>>, asks boolean")


def _holding(matches: Column) -> Column:
    """Of the matches whose tests hold the first for each constraint and context."""
    holds = lambda m: F.forall(m["tests"], lambda t: F.array_contains(F.get("passed", t["at"]), t["test"]))
    kept = F.filter(matches, holds)
    same = lambda a, b: (a["rule"] == b["rule"]) & (a["context"] == b["context"])
    return F.filter(kept, lambda m, i: ~F.exists(F.slice(kept, 1, i), lambda other: same(other, m)))


def _start(key: KeyField) -> tuple[Column, Column]:
    """The pattern of a key field and the group that it gives."""
    return F.lit(f"^(?:{key.pattern})"), F.lit(1 if re.compile(key.pattern).groups else 0)


def _single(key: KeyField) -> bool:
    return key.target == "." or key.target.startswith("@")


def _key_text(key: KeyField) -> Column:
    """The text of a key field that selects one value at most."""
    text = F.when(_bare(F.col("v")), _text_of(F.col("v"))) if key.target == "." else _scalar_of(_member(key.target[1:]))
    if key.pattern is None:
        return text
    start, group = _start(key)
    return F.when(F.regexp_like(text, start), F.get(F.regexp_extract_all(text, start, group), F.lit(0)))


def _key_texts(pack: RulePack, key: KeyField) -> Column:
    """Texts of one key field at a node; a field that selects nothing is one null."""
    if _single(key):
        return F.array(_key_text(key))
    listed = [F.coalesce(items(v), F.array(F.when(~F.is_variant_null(v), v))) for v in (_member(n) for n in sorted(pack.properties(key.target)))]
    values = F.flatten(F.array(*listed))
    texts = F.transform(F.filter(values, _bare), _text_of)
    if key.pattern is not None:
        start, group = _start(key)
        texts = F.transform(F.filter(texts, lambda x: F.regexp_like(x, start)), lambda x: F.get(F.regexp_extract_all(x, start, group), F.lit(0)))
    return F.when(F.size(texts) == 0, F.array(F.lit(None).cast("string"))).otherwise(texts)


def _combined(some: Column, texts: Column) -> Column:
    """Each of some lists with each of the texts at its end."""
    return F.flatten(F.transform(some, lambda a: F.transform(texts, lambda b: F.concat(a, F.array(b)))))


def _keys(pack: RulePack, rule: Constraint) -> Column:
    """Every combination of the key fields of a constraint that is not all null."""
    if all(map(_single, rule.keys)):
        texts = [_key_text(key) for key in rule.keys]
        return F.when(F.coalesce(*texts).isNotNull(), F.array(F.to_json(F.array(*texts)))).otherwise(no_texts())
    found = F.transform(_key_texts(pack, rule.keys[0]), lambda x: F.array(x))
    for texts in (_key_texts(pack, key) for key in rule.keys[1:]):
        found = _combined(found, texts)
    return F.transform(F.filter(found, lambda k: F.exists(k, lambda x: x.isNotNull())), lambda k: F.to_json(k))


def _fact(**columns: Column) -> Column:
    return F.struct(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in TYPES.items()])


def _of_rule(pack: RulePack, rules: list[int], make, otherwise: Column) -> Column:
    """A column by the number of the constraint that matched."""
    out = otherwise
    for k in rules:
        out = F.when(F.col("hit.rule") == k, make(pack.constraints[k])).otherwise(out)
    return out


def _picked(nodes: DataFrame, pack: RulePack, rules: list[int], tests: list[Test]) -> DataFrame:
    """Facts context, selected and value of the nodes."""
    spark = nodes.sparkSession
    spoken = _spoken(pack, rules)
    found = nodes.where("stands").select("way").where(F.array_contains(F.lit(spoken), F.element_at("way", -1)) if spoken else F.lit(False)).distinct().limit(MOST_WAYS + 1).collect()
    if len(found) > MOST_WAYS:
        raise Refusal(f"the documents have more than {MOST_WAYS} ways to the names that constraints speak of")
    dictionary = _dictionary(spark, pack, rules, sorted(tuple(r["way"]) for r in found), tests)
    met = nodes.where("stands").join(F.broadcast(dictionary), "way").withColumn("hit", F.explode(F.when(F.col("asks"), _holding(F.col("matches"))).otherwise(F.col("matches")))).drop("matches", "asks")
    governed = F.lit(False)
    for model in pack.schema.models:
        numbers = [k for k in rules if pack.governs(pack.constraints[k], model)]
        governed = governed | ((F.col("model") == model) & F.col("hit.rule").isin(*numbers))
    met = met.where(governed)
    base = {"rule": F.col("hit.rule"), "context": F.get("ways", F.col("hit.context")), "alternative": F.col("hit.alternative"), "place": F.col("place"), "ord": F.col("order"), "model": F.col("model")}
    keyed = [k for k in rules if pack.constraints[k].kind not in ("matches", "has-cardinality")]
    valued = [k for k in rules if pack.constraints[k].kind == "matches"]
    no_key = F.array(F.lit(None).cast("string"))
    keys = F.when(F.col("hit.rule").isin(*keyed), _of_rule(pack, keyed, lambda c: _keys(pack, c), no_texts())).otherwise(no_key) if keyed else no_key
    if not valued:
        base |= {"kind": F.lit("selected"), "pointer": F.col("raw"), "key": F.explode(keys)}
        picked = met.select("doc_id", *[c.cast(TYPES[n]).alias(n) if n != "key" else c.alias(n) for n, c in base.items()])
        picked = picked.select("doc_id", *[F.col(n) if n in base else F.lit(None).cast(kind).alias(n) for n, kind in TYPES.items()])
    else:
        facts = F.array().cast(f"array<struct<{FACT.replace(', ', ',').replace(' ', ':')}>>")
        met = met.withColumn("keys", keys)
        selected = F.transform("keys", lambda k: _fact(kind=F.lit("selected"), pointer=F.col("raw"), key=k, **base))

        def value_of(c: Constraint) -> Column:
            name = c.flag or pack.value_keys.get(c.context, "")
            own = F.when(_bare(F.col("v")), F.array(_fact(kind=F.lit("value"), pointer=F.col("raw"), value=_text_of(F.col("v")), **base))) if not c.flag else F.when(F.lit(False), facts)
            if name:
                there = F.concat(F.col("raw"), F.lit(f"/{name}"))
                own = own.when(_bare(_member(name)), F.array(_fact(kind=F.lit("value"), pointer=there, value=_text_of(_member(name)), **base)))
            return own.otherwise(facts)

        selected = F.when(F.col("hit.rule").isin(*valued), _of_rule(pack, valued, value_of, facts)).otherwise(selected)
        picked = met.select("doc_id", F.explode(selected).alias("fact")).select("doc_id", "fact.*")
    counted = [k for k in rules if pack.constraints[k].kind == "has-cardinality"]
    if not counted:
        return picked
    governs = lambda k: F.col("model").isin(*[m for m in pack.schema.models if pack.governs(pack.constraints[k], m)])
    of = [F.when(F.element_at("way", -1).isin(*sorted(pack.properties(pack.constraints[k].context))) & governs(k), F.lit(k)) for k in counted]
    contexts = nodes.where("stands AND depth > 0").select("doc_id", "raw", "model", "order", F.explode(F.array(*of)).alias("rule")).where("rule IS NOT NULL")
    told = {"kind": F.lit("context"), "rule": F.col("rule"), "pointer": F.col("raw"), "model": F.col("model"), "ord": F.col("order")}
    return picked.unionByName(contexts.select("doc_id", *[told.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in TYPES.items()]))


def _typed_facts(nodes: DataFrame, used: set[str]) -> DataFrame:
    """Facts of the schema: notes, and the scalars that it declares, as far as their columns are there."""
    base = {"pointer": F.col("pointer"), "model": F.col("model"), "ord": F.col("order")}
    notes = F.transform("notes", lambda n: _fact(kind=n["kind"], name=n["name"], detail=n["detail"], low=n["low"], found=n["found"], **base)) if "notes" in used else None
    if "title" in used:
        scalar = F.array(_fact(
            kind=F.lit("scalar"), name=F.col("name"), value=scalar_text(F.col("v"), F.col("jtype")), jtype=F.col("jtype"), title=F.col("title"), datatype=F.col("datatype"), enums=F.col("enums"), **base
        ))
        if notes is None:
            nodes, notes = nodes.where("outcome = 'scalar'"), scalar
        else:
            notes = F.when(F.col("outcome") == "scalar", F.concat(notes, scalar)).otherwise(notes)
    return nodes.where("depth > 0").select("doc_id", F.explode(notes).alias("fact")).select("doc_id", "fact.*")


def _models(rows: DataFrame, known: list[str]) -> DataFrame:
    """The rows with ``model``, the one root of a document, or the ``error`` that refuses it."""
    expected, names = ", ".join(sorted(known)), F.coalesce(names_of(F.col("v")), no_texts())
    rows = rows.withColumns({"names": names, "plain": is_object(F.col("v"))})
    found = F.filter("names", lambda n: n.isin(*known))
    others = F.filter("names", lambda n: ~n.isin(*known, "$schema"))
    shown = F.coalesce(F.nullif(_listed(F.col("names")), F.lit("")), F.lit("(nothing)"))
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("plain"), f"not an object with one of the roots {expected}")
        .when(F.size(found) == 0, F.concat(F.lit(f"no document root; expected one of {expected}, found "), shown))
        .when(F.size(found) > 1, F.concat(F.lit("more than one document root: "), _listed(found)))
        .when(F.size(others) > 0, F.concat(F.lit("properties beside the root "), F.get(found, F.lit(0)), F.lit(": "), _listed(others)))
    )
    return rows.withColumns({"model": F.get(found, F.lit(0)), "refusal": error}).drop("names", "plain", "error").withColumnRenamed("refusal", "error")


NOTES = ("missing", "undeclared", "mistyped", "unread", "no_branch", "short")
STRUCTURE = (*NOTES, "scalar")
#: Facts that a scalar can give; the other notes are of objects and arrays.
OF_SCALARS = ("mistyped", "unread", "scalar")
PICKED = ("context", "selected", "value")


def _used(wanted: set[str], rules: list[int]) -> set[str]:
    """The columns of the descent that facts of these kinds are made from."""
    used = {"doc_id", "fresh", "m", "a", "depth", "name", "item", "order", "model"}
    if wanted & set(STRUCTURE):
        used |= {"jtype", "pointer", "state", "outcome"} | ({"notes"} if wanted & set(NOTES) else set())
    if "scalar" in wanted:
        used |= {"v", "title", "datatype", "enums"}
    return used | ({"v", "raw", "place", "deep", "stands", "nested", "way", "ways", "passed"} if rules else set())


def typed_nodes(rows: DataFrame, pack: RulePack, typed: bool, tests: list[Test], rules: list[int], used: set[str], scalars: tuple[str, ...] | None = None, stays: Column | None = None) -> DataFrame:
    """All nodes of the readable documents, or those for which ``stays`` holds, with what the schema and the tests of constraints say of them, in the columns of use.

    If names of ``scalars`` are given, other scalars are left out, but for those that a step of a constraint can stand on.
    """
    top = roots(rows.where("error IS NULL"))
    none = F.lit(None).cast("string")
    top = top.withColumns({
        "model": F.get(F.filter(F.map_keys("m"), lambda n: n.isin(*pack.schema.models)), F.lit(0)), "state": F.lit(TOP), "outcome": F.lit("top"), "notes": F.array().cast(NOTE), "title": none,
        "datatype": none, "enums": no_texts(), "stands": F.lit(True), "nested": F.lit(False), "way": F.array(F.lit("")), "ways": F.array(F.lit("")), "passed": F.array(F.array().cast("array<int>")),
    })
    table = F.broadcast(transitions(rows.sparkSession, pack.schema)) if typed else None
    on_way = _ways(_spoken(pack, rules), [_passes(pack, t) for t in tests]) if rules else {}

    def enter(nodes: DataFrame) -> DataFrame:
        names, made = nodes.columns, dict(on_way)
        if table is not None:
            step = F.when(F.col("item").isNotNull(), F.lit(ITEM)).otherwise(F.col("name"))
            here = F.col("fresh") & (F.col("state") == F.col("_state")) & (step == F.col("_step")) & ((F.col("jtype") == "array") == F.col("_listed"))
            nodes, columns = _typed(nodes.join(table, here, "left"))
            made |= columns
        return nodes.select(*[made[c].alias(c) if c in made else F.col(c) for c in names])

    spoken = _spoken(pack, rules) if rules else []
    among = lambda name, some: F.coalesce(name.isin(*some), F.lit(False)) if some else F.lit(False)
    speaks = lambda name: among(name, spoken)
    # A scalar that no step can stand on is of use for its own facts only.
    read_of = [*spoken, *(scalars or ())]
    lean = scalars is not None and not typed

    def held(name: Column, v: Column, left: int) -> Column:
        if left < 1:
            return among(name, read_of)
        if not lean:
            return among(name, read_of) | F.coalesce(is_array(v) | is_object(v), F.lit(False))
        # Where the schema is not asked, an object is of use that has a name or holds what a step can stand on. Scalars in an array are called like it.
        further = F.exists(F.array(shells(v)), lambda s: is_read(s, v, read_of, left > 1))
        return among(name, read_of) | F.coalesce((is_array(v) | further) if left > 1 else further, F.lit(False))

    nodes = descend(top.select(*[c for c in top.columns if c in used]), levels_of(rows), enter, speaks, None, read_of if lean else None, stays, None if scalars is None else held)
    # A document's only root but for the name of its schema, which is no node to be judged.
    return nodes.where((F.col("depth") == 0) | (F.get("order", F.lit(0)) == F.col("model")))


def _of_use(wanted: set[str], spoken: list[str], used: set[str]) -> tuple[Column, Column]:
    """Whether facts of the wanted kinds can come from a node (the schema has something to say of it, or a step can stand on its name), and whether from its value."""
    scalar = F.col("outcome") == "scalar" if "scalar" in wanted else F.lit(False)
    told = F.exists("notes", lambda n: n["kind"].isin(*sorted(wanted))) if "notes" in used else F.lit(False)
    stood = F.col("stands") & F.element_at("way", -1).isin(*spoken) if spoken else F.lit(False)
    return scalar | stood | told, scalar | stood


def evaluate(documents: DataFrame, pack: RulePack, kinds: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of every document (doc_id, text), or those of some kinds only, and of scalars those of some ``names`` only, which saves the work for the others."""
    wanted = set(kinds or (*STRUCTURE, *PICKED, "model", "error"))
    # Parsed once and written to the shared folder: the levels, the ways and the facts are then read from there.
    rows = cut_long(_models(read(documents), sorted(pack.schema.models)))
    whole = lambda df: df.select(*[c.split(" ")[0] for c in FACTS.split(", ")])
    parts = []
    if wanted & {"model", "error"}:
        said = F.when(F.col("error").isNotNull(), _fact(kind=F.lit("error"), detail=F.col("error"))).otherwise(
            _fact(kind=F.lit("model"), name=F.col("model"), pointer=F.concat(F.lit("/"), F.replace(F.replace("model", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), model=F.col("model"), ord=no_texts())
        )
        parts.append(rows.select("doc_id", said.alias("fact")).select("doc_id", "fact.*"))
    rules = pack.evaluated() if wanted & set(PICKED) else []
    typed = bool(wanted & set(STRUCTURE))
    if typed or rules:
        tests = _tests(pack, rules)
        # Descended once, for the ways and both kinds of facts to read, however often a run reads those.
        used = _used(wanted, rules)
        left = () if not wanted & set(OF_SCALARS) else names if wanted & set(OF_SCALARS) == {"scalar"} else None
        stays, valued = _of_use(wanted, _spoken(pack, rules) if rules else [], used)
        nodes = typed_nodes(rows, pack, typed, tests, rules, used, left, stays)
        kept = [c for c in nodes.columns if c in used - {"item", "deep", "nested", "state", "v"}]
        nodes = cut_long(nodes.select(*kept, *([F.when(valued, F.col("v")).alias("v")] if "v" in used else [])))
        if typed:
            parts.append(_typed_facts(nodes, used))
        if rules:
            parts.append(_picked(nodes, pack, rules, tests))
    if not parts:
        return documents.sparkSession.createDataFrame([], FACTS)
    found = reduce(DataFrame.unionByName, map(whole, parts)).where(F.col("kind").isin(*sorted(wanted)))
    return found if names is None else found.where((F.col("kind") != "scalar") | F.col("name").isin(*names))
