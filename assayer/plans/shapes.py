"""Queries on what schemas, names and models make of documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.durable import cut
from assayer.functions import scalars
from assayer.operators import assist, checks, findings, imports, package, patch, provenance, texts
from assayer.operators.evaluate import evaluate
from assayer.operators.shred import shred
from assayer.plans import tables as t
from assayer.plans.registry import query

LETTERS = "^[E-P][A-Z]*$"


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, '/event' AS location, 'coupon' AS prop, 'Event' AS assembly FROM events WHERE event_type = 'purchase'")
def implicit_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object shape that names no type is one all the same."""
    shape = {k: v for k, v in t.obj("Event", type=t.TEXT, user=t.WHOLE, k=t.TEXT).items() if k != "type"}
    facts = evaluate(t.event_documents(spark, sf_dir), t.pack({"event": shape}), ("undeclared",))
    return facts.select("doc_id", F.col("pointer").alias("location"), F.col("name").alias("prop"), F.col("detail").alias("assembly"))


def _branches(second: dict) -> dict:
    """Two alternatives that accept the same persons, and one for firms."""
    first = t.obj("Person", ("first-name",), number=t.WHOLE, first_name=t.TEXT)
    firm = t.obj("Organisation", ("firm-name",), number=t.WHOLE, firm_name=t.TEXT)
    return {"party": t.obj("Party", who={"title": "Who", "anyOf": [first, second, firm]}, balance=t.ref("DecimalDatatype"))}


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS value, 'StringDatatype' AS datatype FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')")
def branch_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives that say the same of a document's properties are read as one."""
    same = t.obj("Nicked", ("first-name",), number=t.WHOLE, first_name=t.TEXT, nick=t.TEXT)
    facts = evaluate(t.party_documents(spark, sf_dir), t.pack(_branches(same)), ("scalar",))
    return facts.where("name = 'first-name'").select("doc_id", "value", "datatype")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, '/party/who' AS location, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'SUBTREE_NOT_READ' ELSE 'NO_SCHEMA_ALTERNATIVE' END AS code
FROM customer WHERE c_mktsegment <> 'FURNITURE'""")
def branch_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives that disagree leave the part unread, and an object that none accepts is a finding."""
    other = t.obj("Nicked", ("first-name",), number=t.TEXT, first_name=t.TEXT, nick=t.TEXT)
    found = checks.structure(evaluate(t.party_documents(spark, sf_dir), t.pack(_branches(other))))
    return found.select("doc_id", "location", "code")


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, '/event/k' AS location, 'UNVERIFIABLE' AS severity FROM events")
def unread_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of scalar types is not read and is reported."""
    mixed = {"anyOf": [{"type": "string"}, {"type": "integer"}]}
    rules = t.pack({"event": t.obj("Event", closed=False, type=t.TEXT, user=t.WHOLE, k=mixed)})
    found = checks.structure(evaluate(t.event_documents(spark, sf_dir), rules)).where("code = 'SUBTREE_NOT_READ'")
    return found.select("doc_id", "location", "severity")


def _kinds(spark: SparkSession, sf_dir: str, kind: dict, **more: dict) -> DataFrame:
    part = t.obj("Part", number=t.WHOLE, name=t.TEXT, type=kind, ns=t.TEXT)
    schema = {"definitions": t.SCALARS | more, "oneOf": [{"properties": {"brand": t.obj("Brand", name=t.TEXT, parts=t.arr(part))}}]}
    rules = t.pack_of(schema, [], release="1")
    found = checks.datatypes(evaluate(t.brand_documents(spark, sf_dir), rules), rules)
    return found.groupBy("value", "code").agg(F.count("*").alias("n"))


@query(f"SELECT p_type AS value, 'DATATYPE_MISMATCH' AS code, count(*) AS n FROM part WHERE NOT regexp_matches(p_type, '{LETTERS}') GROUP BY 1")
def narrowed_datatype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A datatype made of a general one and a pattern of its own holds the values to that pattern."""
    narrow = {"allOf": [t.ref("StringDatatype"), {"type": "string", "pattern": LETTERS}]}
    return _kinds(spark, sf_dir, t.ref("NarrowDatatype"), NarrowDatatype=narrow)


@query(f"SELECT p_type AS value, 'DATATYPE_MISMATCH' AS code, count(*) AS n FROM part WHERE NOT regexp_matches(p_type, '{LETTERS}') AND p_type <> 'STANDARD' GROUP BY 1")
def reference_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to references and a union of a datatype with listed values come down to the datatype and the list."""
    union = {"anyOf": [t.ref("EarlyDatatype"), {"enum": ["STANDARD"]}]}
    return _kinds(spark, sf_dir, t.ref("outer"), outer=t.ref("inner"), inner=union, EarlyDatatype={"type": "string", "pattern": LETTERS})


@query("""SELECT event_type AS model, count(*) AS n FROM events WHERE event_type IN ('view', 'click') AND user_id % 2 = 1 GROUP BY 1""")
def model_scoping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module's constraints govern the models that are listed for it and no other."""
    roots = {k: t.obj(k, user=t.WHOLE) for k in ("view", "click", "error", "purchase", "signup")}
    even = {"kind": "matches", "context": "user", "target": ".", "regex": "^[0-9]*[02468]$", "module": "m", "identifier": "even"}
    rules = t.pack(roots, [even], models_of={"m": frozenset({"view", "click"})})
    facts = evaluate(t.kind_documents(spark, sf_dir), rules)
    failed = checks.matches(facts, rules).select("doc_id")
    return facts.where("kind = 'model'").join(failed, "doc_id").groupBy(F.col("name").alias("model")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT r_name || '-' || (c_custkey // {t.TOGETHER["customer"]}) AS doc, n_nationkey, count(*) AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n_nationkey) - 1 AS i FROM p)
SELECT doc AS doc_id, '/region/nations/' || i AS location, k || ' present' AS value, 'There must be at least 4 and at most 6 of customer here.' AS message FROM n WHERE k NOT BETWEEN 4 AND 6""")
def context_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are reported where their context stands, not at the root."""
    rules = t.region_pack([{"kind": "has-cardinality", "context": "nation", "target": "customer", "identifier": "few", "low": 4, "high": 6}])
    found = checks.cardinality(evaluate(t.region_documents(spark, sf_dir), rules, ("selected", "context")), rules)
    return found.select("doc_id", "location", "value", "message")


@query("""SELECT CAST(event_id AS VARCHAR) AS doc_id, k AS prop, n || ' constraint(s)' AS value, 'UNVERIFIABLE' AS severity FROM events, (VALUES ('allowed-values', 2), ('expect', 1), ('is-unique', 1)) v(k, n)""")
def coverage_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is told how many constraints of each kind nobody evaluated."""
    listed = [{"kind": k, "context": "event", "target": ".", "identifier": f"{k}-{n}"} for k, n in (("allowed-values", 1), ("allowed-values", 2), ("expect", 1))]
    keyless = {"kind": "is-unique", "context": "event", "target": ".", "identifier": "keyless"}
    rules = t.event_pack([*listed, keyless])
    return checks.coverage(evaluate(t.event_documents(spark, sf_dir), rules, ("model",)), rules).select("doc_id", "prop", "value", "severity")


@query("""SELECT p_partkey, v.skipped FROM part JOIN (VALUES (0, 'the target is outside the path language'), (1, 'it declares neither a pattern nor a datatype'), (2, 'the pattern is not anchored at both ends, so dialects may differ'),
  (3, 'the pattern cannot be compiled'), (4, 'it declares no key'), (5, 'the kind is not known'), (6, ''), (7, 'a key field is outside the path language')) v(n, skipped) ON p_size % 8 = v.n""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the constraint that each part declares is not evaluated."""
    said = [
        ("has-cardinality", "../x", {}), ("matches", "@url", {}), ("matches", "@url", {"regex": "^h"}), ("matches", "@url", {"regex": "^($"}), ("is-unique", "link", {}),
        ("unheard-of", ".", {}), ("is-unique", "link", {"keys": ["@href"]}), ("is-unique", "link", {"keys": ["a/b"]}),
    ]
    rules = t.page_pack([{"kind": k, "context": "page", "target": target, "identifier": str(i)} | more for i, (k, target, more) in enumerate(said)])
    parts = t.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8).cast("string").alias("identifier"))
    return parts.join(F.broadcast(checks.rules_table(spark, rules).select("identifier", "skipped")), "identifier").select("p_partkey", "skipped")


@query(f"""SELECT 'order-' || o_orderkey || '.json' AS doc_id, 'Nothing in the index builders carries this key. Every document that it could reach was supplied, so it resolves to nothing.' AS message,
  'constraint known-builder (index-has-key, level WARNING), declared on order in : target ''.'', key @customer' AS citation, 'known-builder' AS ids
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' UNION ALL
SELECT 'nation-' || c_nationkey || '-' || (c_custkey // {t.TOGETHER["customer"]}) || '.json', 'Nothing in the index nowhere carries this key. No evaluated constraint builds this index, so the key could not be looked up.',
  'an index that is not built settles nothing', '' FROM customer""")
def settled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and citations say whether a look-up was settled; identifiers of constraints are read back from citations."""
    rules, docs = t.trade_pack(), t.trade_documents(spark, sf_dir)
    facts = cut(evaluate(docs, rules, ("scalar", "selected"), imports.ASKED))
    met, reached = imports.closure(docs, facts.where("kind = 'scalar'"), docs)
    found = checks.cross_references(facts, rules, reached, imports.completeness(docs, met))
    citation = F.col("rule.citation")
    return found.select("doc_id", "message", citation.alias("citation"), F.array_join(texts.constraint_ids(citation), ",").alias("ids"))


@query(r"""SELECT CAST(event_id AS VARCHAR) AS doc_id, '{' || chr(10) || ' "type": "' || event_type || '",' || chr(10) || ' "user": ' || user_id || ',' || chr(10) || ' "k": ' ||
  CASE WHEN event_id % 2 = 1 THEN '"' || json_extract_string(props, '$.k') || '"' ELSE json_extract_string(props, '$.k') END
  || CASE WHEN event_type = 'purchase' THEN ',' || chr(10) || ' "coupon": "none"' ELSE '' END || chr(10) || '}' AS excerpt FROM events""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a document around a location, also where the location itself is not there."""
    docs = t.event_documents(spark, sf_dir)
    places = docs.select("doc_id", F.when(F.col("text").contains("coupon"), "/event/coupon/x").otherwise("/event/k").alias("location"))
    at = F.regexp_replace("location", "/x$", "")
    return assist.excerpts(places.withColumn("location", at), docs).select("doc_id", "excerpt")


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS shown FROM documents")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long values are cut, and the cut is visible."""
    return t.table(spark, sf_dir, "documents").select("doc_id", scalars.shorten(F.col("text")).alias("shown"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN '/b' ELSE '' END || CASE WHEN regexp_matches(text, '(?i)\\b(todo|tbd|fixme|placeholder|xxx|changeme)\\b') AND turn % 2 = 0 THEN '/a' ELSE '' END AS paths FROM conversations""")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a patch that a person still has to write."""
    step = lambda op, path, value: F.struct(F.lit(op).alias("op"), F.lit(path).alias("path"), value.alias("value"))
    unfinished = F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit(" TODO"))).otherwise("text")
    steps = F.array(step("add", "/b", unfinished), step("remove", "/c", F.lit(None).cast("string")))
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(patch.placeholders(steps), ",").alias("paths"))


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, user_id % 2 = 1 AS refused, CASE WHEN user_id % 2 = 1 THEN 0 ELSE 101 END AS nodes FROM events")
def depth_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nested too deeply are refused whole, others are read whole."""
    n = F.when(F.col("user_id") % 2 == 1, 400).otherwise(100)
    docs = t.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("doc_id"), F.concat(F.repeat(F.lit("["), n), F.lit("1"), F.repeat(F.lit("]"), n)).alias("text")
    )
    return shred(docs, "doc_id", "depth", "error").groupBy("doc_id").agg(F.max(F.col("error").isNotNull()).alias("refused"), F.count("depth").cast("int").alias("nodes"))


@query(r"""SELECT CAST(page_id AS VARCHAR) AS doc_id, 'u' || page_id AS uuid, coalesce(nullif(regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '([^/?#]*)(?:[?#].*)?$', 1), '') || ',', '') || 'second.json' AS names FROM pages""")
def resource_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names behind the resources of a document, in its order."""
    links = F.array(F.struct(F.col("url").alias("href")), F.struct(F.lit("x/second.json?q=1#f").alias("href")))
    held = F.struct(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("uuid"), links.alias("rlinks"))
    body = F.struct(F.struct(F.struct(F.array(held).alias("resources")).alias("back-matter")).alias("page"))
    docs = t.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.to_json(body).alias("text"))
    resource = t.obj("Resource", uuid=t.TEXT, rlinks=t.arr(t.obj("Link", href=t.TEXT)))
    rules = t.pack({"page": t.obj("Page", back_matter=t.obj("Back", resources=t.arr(resource)))})
    found = imports.resource_links(evaluate(docs, rules, ("scalar",)))
    return found.select("doc_id", "uuid", F.array_join("names", ",").alias("names"))


@query("""SELECT 'use/profile-' || g || '.json' AS doc_id, CASE WHEN g % 3 = 2 THEN 'missing.json' ELSE '../lib/catalog-' || (g // 10) || '.xml#x' END AS href,
  CASE WHEN g % 3 <> 2 THEN 'lib/catalog-' || (g // 10) || '.json' END AS resolved_to, g % 3 = 2 AS absent FROM (SELECT DISTINCT doc_id // 100 AS g FROM labels)""")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that members state themselves, and those that nothing answers."""
    docs = t.label_documents(spark, sf_dir)
    met, _ = imports.closure(docs, evaluate(docs, t.label_pack(), ("scalar",)), docs)
    gone = package.not_in_package(met).select("doc_id", "href", F.lit(True).alias("absent"))
    graph = package.import_graph(met).select("doc_id", "href", "resolved_to").join(gone, ["doc_id", "href"], "left")
    return graph.withColumn("absent", F.coalesce("absent", F.lit(False)))


@query("""WITH e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)
SELECT a AS doc_id, '/x/imports/0/href' AS location, 'IMPORT_RESOLVED' AS code, b AS value FROM e WHERE a LIKE 's%'
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey || '#/x/imports/0/href', 'IMPORT_RESOLVED', 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def qualified_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is met in another document is reported with that document's name."""
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    nation, supplier = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "supplier")
    pairs = supplier.select(key("s", "s_suppkey").alias("a"), key("n", "s_nationkey").alias("b")).unionByName(nation.select(key("n", "n_nationkey").alias("a"), key("r", "n_regionkey").alias("b")))
    rows = pairs.select(F.col("a").alias("doc_id"), F.lit(0).alias("ord"), F.lit("/x/imports/0/href").alias("pointer"), F.lit("href").alias("name"), F.lit("string").alias("jtype"), F.col("b").alias("value"))
    documents = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    met, _ = imports.closure(supplier.select(key("s", "s_suppkey").alias("doc_id")), rows, documents)
    return imports.import_findings(met).select("doc_id", "location", "code", "value")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_brand = 'Brand#11' THEN '<matches id="Brand#11" target="' || p_type || '"><remarks>' || p_size || '</remarks></matches>' END AS words FROM part""")
def declaration_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a declaration, taken from its module."""
    module = F.concat(F.lit('<module><index id="x"/><matches id="'), "p_brand", F.lit('" target="'), "p_type", F.lit('"><remarks>'), F.col("p_size").cast("string"), F.lit("</remarks></matches></module>"))
    rows = t.table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").cast("string").alias("doc_id"), provenance.declaration(module, "matches", "Brand#11").alias("words"))


@query("""SELECT event_id, '{"a":{"y":[1,' || json_extract_string(props, '$.k') || '],"z":"' || event_type || '"},"b":' || user_id || '}' AS json FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts in one spelling, whatever the order of their members."""
    k = F.get_json_object("props", "$.k")
    written = F.concat(F.lit('{ "b" : '), F.col("user_id").cast("string"), F.lit(', "a": {"z": "'), "event_type", F.lit('", "y": [1, '), k, F.lit("]}}"))
    return t.table(spark, sf_dir, "events").select("event_id", scalars.canonical(written).alias("json"))


DEFECT_SQL = """WITH p AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, page_id % 2 = 0 AS zoned, page_id FROM pages), d AS (SELECT unnest(['remove_required', 'add_undeclared', 'break_uuid', 'drop_timezone', 'wrong_type', 'duplicate_uuid', 'dangle_fragment']) AS defect)
SELECT doc_id, defect, CASE WHEN defect = 'drop_timezone' AND NOT zoned THEN NULL WHEN defect = 'remove_required' THEN NULL WHEN defect = 'drop_timezone' THEN '2024-01-01T00:00:00' WHEN zoned THEN '2024-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00' END AS stamp,
  CASE WHEN defect = 'drop_timezone' AND NOT zoned THEN NULL WHEN defect = 'wrong_type' THEN '{"not":"a string"}' ELSE 't' END AS title,
  CASE WHEN defect = 'drop_timezone' AND NOT zoned THEN NULL WHEN defect = 'break_uuid' THEN 'not-a-uuid' ELSE 'u' || doc_id END AS uuid,
  CASE WHEN defect = 'add_undeclared' THEN 'hello' END AS extra, CASE WHEN defect = 'drop_timezone' AND NOT zoned THEN NULL WHEN defect = 'duplicate_uuid' THEN 'u' || doc_id ELSE 'v' || doc_id END AS other,
  CASE WHEN defect = 'drop_timezone' AND NOT zoned THEN NULL WHEN defect = 'dangle_fragment' THEN '#00000000-0000-4000-8000-000000000000' ELSE '#u' || doc_id END AS href FROM p, d"""


@query(DEFECT_SQL)
def seeded_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the seven defects put into every document that has a place for it."""
    pid = F.col("page_id").cast("string")
    stamp = F.when(F.col("page_id") % 2 == 0, "2024-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00")
    link = F.struct(F.concat(F.lit("v"), pid).alias("uuid"), F.concat(F.lit("#u"), pid).alias("href"))
    body = F.struct(F.concat(F.lit("u"), pid).alias("uuid"), F.struct(F.lit("t").alias("title"), stamp.alias("last-modified")).alias("metadata"), F.array(link).alias("links"))
    made = patch.with_defects(t.table(spark, sf_dir, "pages").select(pid.alias("doc_id"), F.to_json(F.struct(body.alias("page"))).alias("text")))
    got = lambda path, name: F.get_json_object("text", f"$.page.{path}").alias(name)
    return made.select(
        "doc_id", "defect", got("metadata.last-modified", "stamp"), got("metadata.title", "title"), got("uuid", "uuid"), got("metadata.invented-property", "extra"),
        got("links[0].uuid", "other"), got("links[0].href", "href"),
    )


@query("""SELECT CAST(event_id AS VARCHAR) AS doc_id, 'The schema (Event) names ' || CASE WHEN event_type = 'purchase' THEN 'coupon' END || ' nowhere.' AS citation, 'http://rules.example/schema' AS url, '2024-02-29' AS retrieved
FROM events WHERE event_type = 'purchase'""")
def cited_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings cite the rules that a pack supplies for their code, filled from the finding."""
    said = {"PROPERTY_UNDECLARED": {"citation": "The schema (Event) names {property} nowhere.", "url": "http://rules.example/schema", "retrieved": "2024-02-29"}}
    found = findings.as_findings(checks.structure(evaluate(t.event_documents(spark, sf_dir), t.event_pack())).where("code = 'PROPERTY_UNDECLARED'"))
    return findings.cited(found, said).select("doc_id", "rule.citation", "rule.url", "rule.retrieved")
