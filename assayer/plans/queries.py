"""The engine's operators bound to relational tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.durable import cut
from assayer.functions import scalars
from assayer.operators import baseline as bl
from assayer.operators import checks, compare, findings, imports, package, patch, positions, provenance, scoring, suggest, texts
from assayer.operators.evaluate import evaluate
from assayer.operators.shred import shred
from assayer.plans import tables as t
from assayer.plans.registry import ORACLES as ORACLES
from assayer.plans.registry import QUERIES as QUERIES
from assayer.plans.registry import query
from assayer.plans.validate import validate
from assayer.rules.pack import KeyField
from assayer.sinks import reports
from assayer.sources.reports import BLOCKS, SKIPPED, cache_name, page_texts

STRUCTURE = ("missing", "undeclared", "mistyped", "unread", "no_branch", "short")
PICKED = ("selected", "context", "value")


def _selected(docs: DataFrame, rules) -> DataFrame:
    return evaluate(docs, rules, ("selected",))


NATION = f"'nation-' || c_nationkey || '-' || (c_custkey // {t.TOGETHER['customer']}) || '.json'"
BRAND = f"p_brand || '-' || (p_partkey // {t.TOGETHER['part']})"
LINES = """WITH l AS (SELECT o_orderkey AS o, l_linenumber, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY o_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
"""


# -- shredding, pointers, models ------------------------------------------------


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, '/k' AS pointer, json_extract_string(props, '$.k') AS sval, 'integer' AS jtype FROM events")
def shred_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    return shred(docs).where("depth = 1").select("doc_id", "pointer", "sval", "jtype")


@query("""SELECT name, jtype, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT unnest(['number', 'customer']) AS name, 'integer' AS jtype, (SELECT count(*) FROM orders) AS n
  UNION ALL SELECT unnest(['status', 'priority']), 'string', (SELECT count(*) FROM orders)
  UNION ALL SELECT unnest(['linenumber', 'part', 'supplier']), 'integer', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  UNION ALL SELECT unnest(['flag', 'status']), 'string', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  UNION ALL SELECT 'mark', 'string', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'
  UNION ALL SELECT 'state', 'string', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> 'O') GROUP BY 1, 2""")
def shred_order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = shred(t.order_documents(spark, sf_dir), "name", "jtype", "pointer").where("jtype NOT IN ('object', 'array')")
    return leaves.groupBy("name", "jtype").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT count(*) AS o FROM orders), h AS (SELECT count(DISTINCT l_orderkey) AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  l AS (SELECT count(*) AS l, count(*) FILTER (l_returnflag <> 'N') AS m, count(*) FILTER (l_linestatus <> 'O') AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 0 AS depth, o AS n FROM s UNION ALL SELECT 1, o FROM s UNION ALL SELECT 2, o * 4 + h FROM s, h
UNION ALL SELECT 3, l FROM l UNION ALL SELECT 4, l * 5 + m + s FROM l""")
def depth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(t.order_documents(spark, sf_dir), "depth").groupBy("depth").agg(F.count("*").alias("n"))


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, '/' || replace(replace(url, '~', '~0'), '/', '~1') AS pointer, '/' || url AS raw_pointer FROM pages")
def pointer_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.to_json(F.create_map("url", F.lit(1))).alias("text"))
    return shred(docs).where("depth = 1").select("doc_id", "pointer", "raw_pointer")


@query("""WITH l AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT place, CAST(n AS BIGINT) AS n FROM (SELECT '/order/lines/' || unnest(['linenumber', 'part', 'supplier', 'flag', 'status']) AS place, (SELECT count(*) FROM l) AS n
  UNION ALL SELECT '/order/' || unnest(['number', 'status', 'priority', 'customer']), (SELECT count(*) FROM orders)
  UNION ALL SELECT '/order/lines/mark', count(*) FROM l WHERE l_returnflag <> 'N' UNION ALL SELECT '/order/lines/state', count(*) FROM l WHERE l_linestatus <> 'O')""")
def path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = shred(t.order_documents(spark, sf_dir), "leaf", "pointer").where("leaf")
    return leaves.groupBy(scalars.template(F.col("pointer")).alias("place")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS model, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1 UNION ALL SELECT 'refused', count(*) FROM events WHERE event_type = 'signup'")
def model_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = {k: t.obj(k, user=t.WHOLE) for k in ("view", "click", "error", "purchase")}
    facts = evaluate(t.kind_documents(spark, sf_dir), t.pack(roots)).where("kind IN ('model', 'error')")
    return facts.groupBy(F.coalesce("model", F.lit("refused")).alias("model")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, v.pointer, CAST(v.line AS BIGINT) AS line, CAST(v.col AS BIGINT) AS "column" FROM pages,
  (VALUES ('', 1, 1), ('/page', 1, 9), ('/page/url', 1, 16), ('/page/links', 2, 11), ('/page/links/0', 2, 12), ('/page/links/0/href', 3, 8)) v(pointer, line, col)""")
def source_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.replace(F.replace("text", F.lit(',"links"'), F.lit(',\n  "links"')), F.lit('{"href":'), F.lit('{\n"href":'))
    docs = t.page_documents(spark, sf_dir).withColumn("text", lines)
    index = positions.source_index(docs)
    placed = findings.attach_positions(findings.as_findings(index.select("doc_id", F.col("pointer").alias("location"))), index)
    place = F.col("position")
    return placed.select("doc_id", F.col("location").alias("pointer"), place.line.cast("long").alias("line"), place.column.cast("long").alias("column"))


# -- the schema walk ---------------------------------------------------------------


def _structure(docs: DataFrame, rules) -> DataFrame:
    return checks.structure(evaluate(docs, rules, STRUCTURE))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'REQUIRED_PROPERTY_MISSING' AS code, '/order' AS location, 'lines' AS prop FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(t.order_documents(spark, sf_dir), t.order_pack(required=("lines",))).select("doc_id", "code", "location", "prop")


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, '/event' AS location, 'coupon' AS prop FROM events WHERE event_type = 'purchase'")
def undeclared_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(t.event_documents(spark, sf_dir), t.event_pack()).where("code = 'PROPERTY_UNDECLARED'").select("doc_id", "location", "prop")


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, '/event/k' AS location, 'ERROR' AS severity FROM events WHERE event_id % 2 = 1")
def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(t.event_documents(spark, sf_dir), t.event_pack()).where("code = 'TYPE_MISMATCH'").select("doc_id", "location", "severity")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, '1 item(s)' AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey HAVING count(*) = 1""")
def array_too_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.structure(evaluate(t.order_documents(spark, sf_dir), t.order_pack(least=2), ("short",))).where("code = 'ARRAY_TOO_SHORT'").select("doc_id", "value")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'NO_SCHEMA_ALTERNATIVE' AS code FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE')""")
def branch_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(t.party_documents(spark, sf_dir), t.party_pack()).select("doc_id", "code")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, count(*) AS n, count(*) = 1 AS alone FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def one_or_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t.line_shape()
    rules = t.pack({"order": t.obj("Order", lines={"anyOf": [line, t.arr(line)]})})
    leaves = evaluate(t.one_or_many_documents(spark, sf_dir), rules, ("scalar",), ("linenumber",))
    return leaves.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("pointer") == "/order/lines/linenumber").alias("alone"))


@query(f"SELECT {BRAND} AS doc_id, p_brand AS value FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$') GROUP BY 1, 2")
def datatype_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.brand_pack(name=t.ref("BrandDatatype"))
    return checks.datatypes(evaluate(t.brand_documents(spark, sf_dir), rules), rules).select("doc_id", "value")


@query(f"SELECT {BRAND} AS doc_id, p_type AS value, count(*) AS n FROM part WHERE NOT regexp_matches(p_type, '^[E-P][A-Z]*$') AND p_type NOT IN ('SMALL') GROUP BY 1, 2")
def enum_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _early_pack()
    found = checks.datatypes(evaluate(t.brand_documents(spark, sf_dir), rules), rules)
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def _early_pack():
    scalars = t.SCALARS | {"EarlyDatatype": {"type": "string", "pattern": "^[E-P][A-Z]*$"}}
    part = t.obj("Part", number=t.WHOLE, name=t.TEXT, type={"anyOf": [t.ref("EarlyDatatype"), {"enum": ["SMALL"]}]}, ns=t.TEXT)
    schema = {"definitions": scalars, "oneOf": [{"properties": {"brand": t.obj("Brand", name=t.TEXT, parts=t.arr(part))}}]}
    return t.pack_of(schema, [], release="1")


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'DATATYPE_BELOW_MINIMUM' AS code, '/party/balance' AS location FROM customer WHERE c_acctbal < 0")
def below_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.party_pack()
    return checks.datatypes(evaluate(t.party_documents(spark, sf_dir), rules), rules).select("doc_id", "code", "location")


@query(f"SELECT {BRAND} AS doc_id, count(*) || ' value(s)' AS value, 'UNVERIFIABLE' AS severity FROM part GROUP BY 1")
def pattern_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.brand_pack(kind=t.ref("LetterDatatype"))
    found = checks.datatypes(evaluate(t.brand_documents(spark, sf_dir), rules), rules)
    return found.where("code = 'PATTERN_NOT_CHECKED'").select("doc_id", "value", "severity")


# -- targets ---------------------------------------------------------------------


def _counted(context: str, target: str, **more) -> dict:
    return {"kind": "has-cardinality", "context": context, "target": target, "identifier": target, **more}


REGIONS = f"""WITH p AS (SELECT r_name || '-' || (c_custkey // {t.TOGETHER["customer"]}) AS doc, n_nationkey, c_custkey, c_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
  n AS (SELECT doc, n_nationkey, row_number() OVER (PARTITION BY doc ORDER BY n_nationkey) - 1 AS i FROM (SELECT DISTINCT doc, n_nationkey FROM p)),
  c AS (SELECT doc, i, row_number() OVER (PARTITION BY doc, n_nationkey ORDER BY c_custkey) - 1 AS j FROM n JOIN p USING (doc, n_nationkey))
"""


@query(REGIONS + "SELECT doc AS doc_id, '/region/nations/' || i AS pointer FROM n")
def target_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(t.region_documents(spark, sf_dir), t.region_pack([_counted("region", "nation")])).select("doc_id", "pointer")


@query(REGIONS + "SELECT doc AS doc_id, '/region/nations/' || i || '/customers/' || j AS pointer FROM c")
def target_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(t.region_documents(spark, sf_dir), t.region_pack([_counted("region", "//customer")])).select("doc_id", "pointer")


@query(REGIONS + "SELECT doc AS doc_id, '/region/nations/' || i AS pointer FROM n UNION SELECT doc, '/region/nations/' || i || '/customers/' || j FROM c")
def target_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.region_pack([_counted("region", "nation|.//customer|nation/customer")])
    return _selected(t.region_documents(spark, sf_dir), rules).select("doc_id", "pointer")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, '0 present' AS value FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('R', 'A'))""")
def pred_flag_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.order_pack([_counted("order", "line[@flag=('R','A')]", low=1)])
    return checks.cardinality(evaluate(t.order_documents(spark, sf_dir), rules, PICKED), rules).select("doc_id", "value")


@query(f"SELECT {BRAND} AS doc_id, count(*) AS n FROM part WHERE starts_with(p_name, 'small') GROUP BY 1")
def pred_starts_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.brand_pack([_counted("brand", "part[starts-with(@name,'small')]")])
    return _selected(t.brand_documents(spark, sf_dir), rules).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT {BRAND} AS doc_id, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def pred_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.brand_pack([_counted("brand", "part[has-oscal-namespace('http://csrc.nist.gov/ns/oscal')]")])
    return _selected(t.brand_documents(spark, sf_dir), rules).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS doc_id, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
AND o_orderstatus = 'F' GROUP BY 1""")
def pred_child_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.customer_pack([_counted("customer", "order[line and @status='F']")])
    return _selected(t.customer_documents(spark, sf_dir), rules).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT {BRAND} AS doc, p_type, row_number() OVER (PARTITION BY {BRAND} ORDER BY p_partkey) - 1 AS i FROM part)
SELECT doc AS doc_id, '/brand/parts/' || i || '/type' AS pointer, p_type AS value FROM p""")
def value_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.brand_pack([{"kind": "matches", "context": "brand", "target": "part/@type", "regex": "^X$"}])
    return evaluate(t.brand_documents(spark, sf_dir), rules, ("value",)).select("doc_id", "pointer", "value")


@query(REGIONS + r"""SELECT doc AS doc_id, '["' || regexp_extract(c_name, '^Customer#0*([0-9]+)', 1) || '"]' AS key FROM p""")
def key_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = KeyField("@name", r"Customer#0*([0-9]+)")
    rules = t.region_pack([{"kind": "is-unique", "context": "region", "target": "//customer", "keys": [key]}])
    return _selected(t.region_documents(spark, sf_dir), rules).select("doc_id", "key")


# -- constraints -----------------------------------------------------------------


def _unique(*keys: str) -> list[dict]:
    return [{"kind": "is-unique", "context": "order", "target": "line", "keys": list(keys), "identifier": "one-line", "level": "ERROR"}]


@query(LINES + """, r AS (SELECT *, row_number() OVER (PARTITION BY o, l_linenumber ORDER BY i) AS n FROM l)
SELECT CAST(o AS VARCHAR) AS doc_id, '/order/lines/' || i AS location, CAST(l_linenumber AS VARCHAR) AS value, 'ERROR' AS severity FROM r WHERE n > 1""")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.order_pack(_unique("@linenumber"))
    return checks.uniqueness(evaluate(t.order_documents(spark, sf_dir), rules, PICKED), rules).select("doc_id", "location", "value", "severity")


@query(LINES + """, k AS (SELECT *, nullif(l_returnflag, 'N') AS m, nullif(l_linestatus, 'O') AS s FROM l),
  r AS (SELECT *, row_number() OVER (PARTITION BY o, m, s ORDER BY i) AS n FROM k WHERE m IS NOT NULL OR s IS NOT NULL)
SELECT CAST(o AS VARCHAR) AS doc_id, '/order/lines/' || i AS location, coalesce(m, '(absent)') || ' | ' || coalesce(s, '(absent)') AS value FROM r WHERE n > 1""")
def unique_composite_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.order_pack(_unique("@mark", "@state"))
    return checks.uniqueness(evaluate(t.order_documents(spark, sf_dir), rules, PICKED), rules).select("doc_id", "location", "value")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, count(l_orderkey) || ' present' AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey HAVING count(l_orderkey) NOT BETWEEN 1 AND 6""")
def cardinality_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.order_pack([_counted("order", "line", low=1, high=6)])
    return checks.cardinality(evaluate(t.order_documents(spark, sf_dir), rules, PICKED), rules).select("doc_id", "value")


@query(f"SELECT {NATION} AS doc_id, '[\"' || c_custkey || '\"]' AS key, 'builders' AS index_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.trade_pack()
    return checks.indexes(evaluate(t.trade_documents(spark, sf_dir), rules, PICKED), rules).select("doc_id", "key", "index_name")


@query(f"""WITH p AS (SELECT c_custkey, c_mktsegment, {NATION} AS doc, row_number() OVER (PARTITION BY {NATION} ORDER BY c_custkey) - 1 AS j FROM customer)
SELECT 'order-' || o_orderkey || '.json' AS doc_id, '["' || c_custkey || '"]' AS key, doc || '/nation/customers/' || j AS location FROM orders JOIN p ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def index_first_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, docs = t.trade_pack(), t.trade_documents(spark, sf_dir)
    facts = cut(evaluate(docs, rules, ("scalar", "selected"), imports.ASKED))
    _, reached = imports.closure(docs, facts.where("kind = 'scalar'"), docs)
    asked = checks.selections(facts, rules, "index-has-key").where("index_name = 'builders'")
    return checks.first_met(asked, reached, checks.indexes(facts, rules)).select("doc_id", "key", "location")


@query("""SELECT 'order-' || o_orderkey || '.json' AS doc_id, 'REFERENCE_UNRESOLVED' AS code, 'WARNING' AS severity, CAST(o_custkey AS VARCHAR) AS value
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'""")
def index_has_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, docs = t.trade_pack(), t.trade_documents(spark, sf_dir)
    facts = cut(evaluate(docs, rules, ("scalar", "selected"), imports.ASKED))
    met, reached = imports.closure(docs, facts.where("kind = 'scalar'"), docs)
    found = checks.cross_references(facts, rules, reached, imports.completeness(docs, met))
    return found.where("code = 'REFERENCE_UNRESOLVED'").select("doc_id", "code", "severity", "value")


@query(f"SELECT {NATION} AS doc_id, 'UNVERIFIABLE' AS severity, count(*) AS n FROM customer GROUP BY 1")
def index_unbuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.trade_pack()
    docs = t.trade_documents(spark, sf_dir)
    itself = docs.select(F.col("doc_id").alias("primary"), "doc_id", F.lit(0).alias("hops"))
    complete = docs.select("doc_id", F.lit(True).alias("complete"), F.lit("").alias("why"), F.lit("").alias("remedy"))
    found = checks.cross_references(evaluate(docs, rules, ("selected",)), rules, itself, complete)
    return found.where("message LIKE '%nowhere%'").groupBy("doc_id", "severity").agg(F.count("*").alias("n"))


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, url AS value FROM pages WHERE NOT regexp_matches(url, '^https://')")
def matches_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = t.page_pack([{"kind": "matches", "context": "page", "target": "@url", "regex": "^https://.*$", "identifier": "secure"}])
    return checks.matches(evaluate(t.page_documents(spark, sf_dir), rules, PICKED), rules).select("doc_id", "value")


@query("""SELECT o_orderpriority AS level, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ERROR' WHEN o_orderpriority = '3-MEDIUM' THEN 'WARNING'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'INFO' ELSE 'ERROR' END AS severity, count(*) AS n FROM orders GROUP BY 1, 2""")
def level_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"1-URGENT": "CRITICAL", "2-HIGH": "ERROR", "3-MEDIUM": "WARNING", "4-NOT SPECIFIED": "INFORMATIONAL", "5-LOW": "UNKNOWN"}
    rules = t.order_pack([
        {"kind": "is-unique", "context": "order", "target": f".[@priority='{p}']", "keys": ["@number"], "identifier": p, "level": level} for p, level in levels.items()
    ])
    rows = checks.selections(evaluate(t.order_documents(spark, sf_dir), rules, PICKED), rules, "is-unique")
    return rows.groupBy(F.col("identifier").alias("level"), "severity").agg(F.count("*").alias("n"))


@query("""SELECT p_type AS kind, count(*) AS published, count(*) FILTER (p_size % 3 = 0) AS evaluated,
  array_to_string(list_sort(list(DISTINCT p_brand) FILTER (p_size % 3 <> 0)), ',') AS reasons FROM part GROUP BY 1""")
def coverage_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = t.table(spark, sf_dir, "part").select(F.col("p_type").alias("rule_kind"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("skipped"))
    return provenance.coverage_of(declared).withColumn("reasons", F.array_join("reasons", ","))


# -- identifiers, references, versions ----------------------------------------------


SHELF = f"source || '-' || (doc_id // {t.TOGETHER['text']}) || '.json'"


@query(f"""WITH x AS (SELECT {SHELF} AS shelf, md5(text) AS u, row_number() OVER (PARTITION BY {SHELF} ORDER BY doc_id) - 1 AS i FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY shelf, u ORDER BY i) AS n FROM x)
SELECT shelf AS doc_id, '/shelf/texts/' || i || '/uuid' AS location, u AS value FROM r WHERE n > 1""")
def uuid_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.identifiers(evaluate(t.text_documents(spark, sf_dir), t.text_pack())).select("doc_id", "location", "value")


@query("""SELECT 'use/profile-' || (doc_id // 100) || '.json' AS doc_id, CASE WHEN (doc_id // 100) % 3 = 2 THEN 'REFERENCE_UNVERIFIABLE' ELSE 'REFERENCE_UNRESOLVED' END AS code,
  CASE WHEN (doc_id // 100) % 3 = 2 THEN 'UNVERIFIABLE' ELSE 'ERROR' END AS severity, 't-' || doc_id AS value FROM labels
WHERE (doc_id // 100) % 3 = 2 OR doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def ref_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.label_documents(spark, sf_dir)
    facts = cut(evaluate(docs, t.label_pack(), ("scalar",)))
    met, reached = imports.closure(docs, facts, docs)
    return checks.references(facts, reached, imports.completeness(docs, met)).select("doc_id", "code", "severity", "value")


@query("""SELECT code, severity, count(*) AS n FROM (
  SELECT CASE WHEN (doc_id // 100) % 3 = 2 THEN 'REFERENCE_UNVERIFIABLE' ELSE 'REFERENCE_UNRESOLVED' END AS code, CASE WHEN (doc_id // 100) % 3 = 2 THEN 'UNVERIFIABLE' ELSE 'ERROR' END AS severity FROM labels
    WHERE (doc_id // 100) % 3 = 2 OR doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
  UNION ALL SELECT CASE WHEN g % 3 = 2 THEN 'IMPORT_NOT_SUPPLIED' ELSE 'IMPORT_RESOLVED' END, 'INFO' FROM (SELECT DISTINCT doc_id // 100 AS g FROM labels)) GROUP BY 1, 2""")
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate(t.label_documents(spark, sf_dir), t.label_pack())
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, regexp_replace(url, '^[^/]*//[^/]*/', '#') AS value FROM pages WHERE regexp_matches(url, '^[^/]*//[^/]*/')""")
def ref_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.page_documents(spark, sf_dir)
    itself = docs.select(F.col("doc_id").alias("primary"), "doc_id", F.lit(0).alias("hops"))
    return checks.open_references(evaluate(docs, t.page_pack()), itself).select("doc_id", "value")


@query("""SELECT 'use/profile-' || g || '.json' AS doc_id, g % 3 <> 2 AS complete, CASE WHEN g % 3 = 2 THEN '1 imported document(s) were not supplied (missing.json)' ELSE '' END AS why
FROM (SELECT DISTINCT doc_id // 100 AS g FROM labels) UNION ALL SELECT DISTINCT 'lib/catalog-' || (doc_id // 1000) || '.json', true, '' FROM documents""")
def ref_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.label_documents(spark, sf_dir)
    met, _ = imports.closure(docs, evaluate(docs, t.label_pack()).where("kind = 'scalar'"), docs)
    return imports.completeness(docs, met).select("doc_id", "complete", "why")


@query("""WITH n AS (SELECT DISTINCT p_name AS v FROM part)
SELECT a.v AS written, b.v AS value FROM n a JOIN n b ON a.v <> b.v AND damerau_levenshtein(a.v, b.v) <= 2""")
def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t.table(spark, sf_dir, "part").select(F.lit("n").alias("pool"), F.col("p_name").alias("value")).distinct()
    return suggest.close_pairs(names.withColumnRenamed("value", "written"), names, "pool").select("written", "value")


@query(r"""SELECT c_name AS name, regexp_replace(replace(lower(regexp_replace(c_name, '^#', '')), '_', '-'), '0*([0-9])', '\1', 'g') AS normal FROM customer""")
def normalized_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), scalars.normal_form(F.col("c_name")).alias("normal"))


@query("""SELECT code, count(*) AS n FROM (SELECT 'OSCAL_VERSION_DIFFERS' AS code FROM events WHERE event_type <> 'view'
UNION ALL SELECT 'VERSION_SKEW_SUSPECTED' FROM events WHERE event_type <> 'view' AND event_id % 2 = 1) GROUP BY 1""")
def version_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    written = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    body = F.concat(F.lit('{"event":{"metadata":{"oscal-version":"'), "event_type", F.lit('"},"k":'), written, F.lit("}}"))
    docs = t.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc_id"), body.alias("text"))
    rules = t.pack({"event": t.obj("Event", metadata=t.obj("Metadata", oscal_version=t.TEXT), k=t.WHOLE)}, release="view")
    facts = evaluate(docs, rules)
    skew = checks.version_skew(facts, rules, findings.as_findings(checks.structure(facts)))
    return checks.versions(facts, rules).select("code").unionByName(skew.select("code")).groupBy("code").agg(F.count("*").alias("n"))


# -- imports and packages ------------------------------------------------------------


@query(f"""SELECT 'order-' || o_orderkey || '.json' AS doc_id, '/order/imports/0/href' AS pointer, {NATION} AS target_name
FROM orders JOIN customer ON o_custkey = c_custkey""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = evaluate(t.trade_documents(spark, sf_dir), t.trade_pack(), ("scalar",), imports.ASKED)
    return imports.named_edges(facts).select("doc_id", "pointer", "target_name")


@query("""SELECT 'use/profile-' || g || '.json' AS doc_id, CASE WHEN g % 3 = 2 THEN 'IMPORT_NOT_SUPPLIED' ELSE 'IMPORT_RESOLVED' END AS code,
  CASE WHEN g % 3 = 2 THEN 'missing.json' ELSE '../lib/catalog-' || (g // 10) || '.xml#x' END AS value FROM (SELECT DISTINCT doc_id // 100 AS g FROM labels)""")
def import_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.label_documents(spark, sf_dir)
    met, _ = imports.closure(docs, evaluate(docs, t.label_pack()).where("kind = 'scalar'"), docs)
    return imports.import_findings(met).select("doc_id", "code", "value")


@query("""WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT CAST(p_partkey AS VARCHAR) AS doc_id, n.n AS candidates,
  CASE WHEN n.n = 1 THEN 'IMPORT_RESOLVED' ELSE 'IMPORT_AMBIGUOUS' END AS code FROM part JOIN n USING (p_name)""")
def import_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.table(spark, sf_dir, "part")
    supplied = parts.select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit("/"), "p_name", F.lit(".json")).alias("doc_id"))
    key = F.col("p_partkey").cast("string")
    asking = parts.select(key.alias("primary"), key.alias("doc_id"), F.lit("/x/imports/0/href").alias("pointer"), F.col("p_name").alias("href"), F.concat("p_name", F.lit(".xml")).alias("target_name"))
    found = imports.status(imports.answered(asking, imports.answering(asking, supplied)))
    return found.select("doc_id", F.col("n_candidates").cast("long").alias("candidates"), "code")


CHAIN = """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'n' || n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey),
  w AS (SELECT 's' || s_suppkey AS p, 'n' || s_nationkey AS d FROM supplier UNION SELECT p, b FROM w JOIN e ON d = a)
"""


@query(CHAIN + "SELECT p AS \"primary\", d AS doc_id FROM w UNION SELECT 's' || s_suppkey, 's' || s_suppkey FROM supplier")
def reachable_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    nation, supplier = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "supplier")
    pairs = supplier.select(key("s", "s_suppkey").alias("a"), key("n", "s_nationkey").alias("b"))
    pairs = pairs.unionByName(nation.select(key("n", "n_nationkey").alias("a"), key("r", "n_regionkey").alias("b")))
    pairs = pairs.unionByName(nation.select(key("r", "n_regionkey").alias("a"), key("n", "n_nationkey").alias("b")))
    scalars = pairs.select(
        F.col("a").alias("doc_id"), F.monotonically_increasing_id().cast("int").alias("ord"), F.lit("/x/imports/0/href").alias("pointer"), F.lit("href").alias("name"),
        F.lit("string").alias("jtype"), F.col("b").alias("value"),
    )
    documents = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    _, reached = imports.closure(supplier.select(key("s", "s_suppkey").alias("doc_id")), scalars, documents)
    return reached.select("primary", "doc_id")


@query(f"""SELECT 'order-' || o_orderkey || '.json' AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL (SELECT {NATION} FROM customer EXCEPT SELECT {NATION} FROM orders JOIN customer ON o_custkey = c_custkey)""")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.trade_documents(spark, sf_dir)
    met, _ = imports.closure(docs, evaluate(docs, t.trade_pack(), ("scalar",), imports.ASKED), docs)
    return package.unreferenced(docs, met)


@query(f"""SELECT md5(text) AS value, array_to_string(list_sort(list(DISTINCT {SHELF})), ',') AS members FROM documents GROUP BY text HAVING count(DISTINCT {SHELF}) > 1""")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = evaluate(t.text_documents(spark, sf_dir), t.text_pack())
    found = package.collisions(facts.where("kind = 'scalar' AND name = 'uuid'"))
    return found.select("value", F.array_join("members", ",").alias("members"))


@query("""SELECT CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 1 ELSE 0 END AS exit_code,
  count(*) FILTER (event_type = 'error') AS "ERROR", count(*) FILTER (event_type = 'purchase') AS "WARNING", count(*) FILTER (event_type = 'view') AS "INFO",
  count(*) FILTER (event_type IN ('click', 'signup')) AS "UNVERIFIABLE" FROM events GROUP BY 1""")
def package_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.event_findings(spark, sf_dir)
    return package.totals(found, found.select("doc_id"))


# -- the algebra of findings -----------------------------------------------------------


@query("""WITH f AS (SELECT DISTINCT user_id, event_type, event_id, props FROM events)
SELECT CAST(user_id AS VARCHAR) AS doc_id, 'F' || row_number() OVER (PARTITION BY user_id ORDER BY '/log/' || event_id) AS label, '/log/' || event_id AS location FROM f""")
def finding_union_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.event_findings(spark, sf_dir)
    twice = findings.union([found, found.where("severity = 'ERROR'"), found])
    return findings.labelled(findings.as_findings(twice).distinct()).select("doc_id", "label", "location")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_partkey AS VARCHAR) AS value,
  CASE WHEN bool_or(l_returnflag = 'N') THEN 'REFERENCE_UNVERIFIABLE' ELSE 'REFERENCE_UNRESOLVED' END AS code FROM lineitem GROUP BY 1, 2""")
def reference_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("string")
    base = {"doc_id": F.col("l_orderkey").cast("string"), "message": F.col("l_linenumber").cast("string")}
    prose = lines.select(*[c.alias(n) for n, c in base.items()], F.concat(F.lit("/p/"), part, F.lit("/href")).alias("location"), F.lit("href").alias("prop"), F.concat(F.lit("#"), part).alias("value"), F.lit("REFERENCE_UNRESOLVED").alias("code"), F.lit("ERROR").alias("severity"))
    layer = lines.where("l_returnflag = 'N'").select(*[c.alias(n) for n, c in base.items()], F.concat(F.lit("/p/"), part).alias("location"), F.lit("@href").alias("prop"), part.alias("value"), F.lit("REFERENCE_UNVERIFIABLE").alias("code"), F.lit("UNVERIFIABLE").alias("severity"))
    merged = findings.merge_references(findings.union([layer, prose]))
    return merged.select("doc_id", F.regexp_replace("value", "^#", "").alias("value"), "code")


@query("""SELECT count(*) FILTER (event_type = 'error') AS "ERROR", count(*) FILTER (event_type = 'purchase') AS "WARNING", count(*) FILTER (event_type = 'view') AS "INFO",
  count(*) FILTER (event_type IN ('click', 'signup')) AS "UNVERIFIABLE", count(*) FILTER (event_type = 'error') AS gating, CAST(0 AS BIGINT) AS acknowledged, CAST(0 AS BIGINT) AS stale FROM events""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.tally(t.event_findings(spark, sf_dir))


@query("""SELECT code, tier_order, tier, severity, count(*) AS findings FROM events JOIN (VALUES ('error', 'TYPE_MISMATCH', 1, 'Shape the validator could not read', 'ERROR'),
  ('purchase', 'DATATYPE_MISMATCH', 3, 'Values against their datatypes', 'WARNING'), ('view', 'IMPORT_RESOLVED', 9, 'For the record', 'INFO'),
  ('click', 'REFERENCE_UNVERIFIABLE', 8, 'Not settled: UNVERIFIABLE', 'UNVERIFIABLE'), ('signup', 'UNHEARD_OF', 11, 'Other', 'UNVERIFIABLE'))
  v(e, code, tier_order, tier, severity) ON event_type = e GROUP BY ALL""")
def fix_order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.fix_order(t.event_findings(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS turn FROM orders)
SELECT o_orderkey, o_orderstatus, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, o_orderstatus LIMIT 50""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return findings.round_robin(orders, 50, "o_orderstatus", ("o_orderkey",))


@query("""SELECT '/log/' || event_id AS location, sha256(concat_ws(chr(31), CASE event_type WHEN 'error' THEN 'TYPE_MISMATCH' WHEN 'purchase' THEN 'DATATYPE_MISMATCH'
  WHEN 'view' THEN 'IMPORT_RESOLVED' WHEN 'click' THEN 'REFERENCE_UNVERIFIABLE' ELSE 'UNHEARD_OF' END, '/log/' || event_id, 'k', 'http://rules.example/', event_type)) AS fingerprint FROM events""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.event_findings(spark, sf_dir).select("location", findings.fingerprint().alias("fingerprint"))


@query("""SELECT '/log/' || event_id AS location, '::' || CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'notice' END || ' file=' || user_id || ',title='
  || CASE event_type WHEN 'error' THEN 'ERROR TYPE_MISMATCH' WHEN 'purchase' THEN 'WARNING DATATYPE_MISMATCH' WHEN 'view' THEN 'INFO IMPORT_RESOLVED'
  WHEN 'click' THEN 'UNVERIFIABLE REFERENCE_UNVERIFIABLE' ELSE 'UNVERIFIABLE UNHEARD_OF' END || '::/log/' || event_id || ' It happened.' AS line FROM events""")
def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = reports.annotations(t.event_findings(spark, sf_dir)).select("line")
    return lines.select(F.regexp_extract("line", "::(/log/[0-9]+) ", 1).alias("location"), "line")


@query("""SELECT count(*) AS targets, count(*) FILTER (lang IS NOT NULL) AS validated, count(*) FILTER (lang IS NULL) AS not_read,
  count(*) FILTER (lang IS NOT NULL AND n_chars % 3 > 0) AS with_errors, count(*) FILTER (lang IS NOT NULL AND n_chars % 2 = 0) AS complete,
  CAST(sum(n_chars) AS BIGINT) AS import_edges, CAST(sum(n_chars // 2) AS BIGINT) AS import_edges_resolved FROM documents""")
def survey_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = t.table(spark, sf_dir, "documents").select(
        F.when(F.col("lang").isNull(), "not read").otherwise("fetched").alias("outcome"), (F.col("n_chars") % 3).alias("errors"), (F.col("n_chars") % 2 == 0).alias("complete"),
        F.col("n_chars").alias("imports"), F.expr("n_chars DIV 2").alias("imports_resolved"),
    )
    return scoring.survey_summary(records)


@query("""SELECT CASE event_type WHEN 'error' THEN 'TYPE_MISMATCH' WHEN 'purchase' THEN 'DATATYPE_MISMATCH' WHEN 'view' THEN 'IMPORT_RESOLVED' WHEN 'click' THEN 'REFERENCE_UNVERIFIABLE'
  ELSE 'UNHEARD_OF' END AS code, min(CAST(user_id AS VARCHAR) || ' /log/' || event_id) AS first_place, count(*) AS n FROM events GROUP BY 1""")
def example_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.example_locations(t.event_findings(spark, sf_dir))
    return rows.select("code", F.concat_ws(" ", "doc_id", "location").alias("first_place"), "n")


@query("SELECT url, substr(sha256(url), 1, 12) AS folder FROM pages")
def cache_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("url", cache_name(F.col("url")).alias("folder"))


# -- comparison and baseline -------------------------------------------------------------

RUNS = """WITH x AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, l_returnflag AS c, day(l_shipdate) % 2 = 0 AS even, year(l_shipdate) AS y FROM lineitem),
  a AS (SELECT DISTINCT k, c, '/line/' || k AS loc, CASE WHEN even THEN 'discount' ELSE 'same' END AS v FROM x WHERE y <= 1999),
  b AS (SELECT DISTINCT k, c, CASE WHEN c = 'R' THEN '/moved/' ELSE '/line/' END || k AS loc, CASE WHEN even THEN 'tax' ELSE 'same' END AS v FROM x WHERE y >= 1995),
  a1 AS (SELECT k, c, loc, max(v) AS v FROM a GROUP BY ALL), b1 AS (SELECT k, c, loc, max(v) AS v FROM b GROUP BY ALL),
  gone AS (SELECT * FROM a1 WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.loc = a1.loc AND b1.c = a1.c)),
  come AS (SELECT * FROM b1 WHERE NOT EXISTS (SELECT 1 FROM a1 WHERE b1.loc = a1.loc AND b1.c = a1.c)),
  moved AS (SELECT gone.k, gone.c, gone.v FROM gone JOIN come USING (k, c, v))
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare(t.line_findings(spark, sf_dir, False), t.line_findings(spark, sf_dir, True))


def _status(name: str, side: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _compared(spark, sf_dir).where(F.col("status") == name)
        return rows.select(F.col(f"{side}.location").alias("location"), F.col(f"{side}.value").alias("value"))

    run.__name__ = f"diff_{name}"
    query(RUNS + sql)(run)


_status("removed", "before", "SELECT loc AS location, v AS value FROM gone WHERE NOT EXISTS (SELECT 1 FROM moved WHERE moved.k = gone.k AND moved.c = gone.c AND moved.v = gone.v)")
_status("added", "after", "SELECT loc AS location, v AS value FROM come WHERE NOT EXISTS (SELECT 1 FROM moved WHERE moved.k = come.k AND moved.c = come.c AND moved.v = come.v)")
_status("changed", "after", "SELECT b1.loc AS location, b1.v AS value FROM a1 JOIN b1 USING (loc, c) WHERE a1.v <> b1.v")
_status("moved", "after", "SELECT '/moved/' || k AS location, v AS value FROM moved")


@query(RUNS + "SELECT b1.loc AS location, 'value' AS field, a1.v AS before, b1.v AS after FROM a1 JOIN b1 USING (loc, c) WHERE a1.v <> b1.v")
def diff_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.changes(_compared(spark, sf_dir)).select("location", "field", "before", "after")


ENTRIES = "SELECT event_id FROM events WHERE event_id % 7 = 0 AND event_type IN ('error', 'purchase', 'view')"


def baseline_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.event_findings(spark, sf_dir).where("severity != 'UNVERIFIABLE'").withColumn("n", F.regexp_extract("location", "([0-9]+)$", 1).cast("long"))
    some = found.where("n % 7 = 0").select("code", "location", F.col("prop").alias("property"), F.when(F.col("n") % 2 == 0, F.col("value")).otherwise("gone").alias("value"))
    return bl.check_entries(some.withColumns({"reason": F.lit("known"), "acknowledged_on": F.lit("2024-02-29")}))


@query("""SELECT CASE WHEN event_id % 14 = 0 AND event_type IN ('error', 'purchase', 'view') THEN 'known' END AS reason, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'stale', count(*) FROM events WHERE event_id % 14 = 7 AND event_type IN ('error', 'purchase', 'view')""")
def baseline_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = bl.apply(t.event_findings(spark, sf_dir), baseline_entries(spark, sf_dir))
    reason = F.when(F.col("code") == "BASELINE_STALE", "stale").otherwise(F.col("acknowledged.reason")).alias("reason")
    return marked.groupBy(reason).agg(F.count("*").alias("n"))


@query("""SELECT '/log/' || event_id AS location, 'gone' AS value, 'WARNING' AS severity FROM events WHERE event_id % 14 = 7 AND event_type IN ('error', 'purchase', 'view')""")
def baseline_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.stale(t.event_findings(spark, sf_dir), baseline_entries(spark, sf_dir)).select("location", "value", "severity")


@query("""SELECT '/log/' || event_id AS location, json_extract_string(props, '$.k') AS value, '' AS reason FROM events WHERE event_type IN ('error', 'purchase', 'view')""")
def baseline_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.draft(t.event_findings(spark, sf_dir)).select("location", "value", "reason")


# -- texts, patches, harness ------------------------------------------------------------


def _swapped(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


_BLOCKS = "(?:" + "|".join(sorted(BLOCKS | {"pre"})) + ")"
_SKIPPED = "|".join(f"<{tag}[^>]*>.*?</{tag}>" for tag in sorted(SKIPPED))
_PLAIN = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_BODY = _swapped(_swapped("html", f"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<title>.*?</title>|{_SKIPPED}", ""), r"\s+", " ")
_BODY = _swapped(_swapped(_swapped(_BODY, "<h1[^>]*>", r"\n\n# "), "</h1>", r"\n"), f"</?{_BLOCKS}( [^>]*)?/?>", r"\n")
_BODY = _PLAIN.format(_swapped(_swapped(_BODY, "<t[dh][^>]*>", " | "), "<[^>]*>", ""))
_BODY = _swapped(_swapped(_swapped(_BODY.replace(r"'\n", "E'\\n"), " *\\n *", "~~~").replace("'~~~'", "chr(10)"), "\\n{3,}", "~~~").replace("'~~~'", "chr(10) || chr(10)"), r"^\s+|\s+$", "")
#: The pages of the tables hold these elements and entities only; the SQL takes them away step by step.
PAGE_SQL = f"""SELECT page_id, {_BODY} || chr(10) AS text,
  {_PLAIN.format(_swapped("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))", r"\s+", " "))} AS title FROM pages"""


@query(PAGE_SQL)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(t.table(spark, sf_dir, "pages"))


SECTIONS = f"""WITH p AS ({PAGE_SQL}), l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM p),
  h AS (SELECT *, regexp_matches(line, '^#{{1,6}} .+$') AS head, count(*) FILTER (regexp_matches(line, '^#{{1,6}} .+$')) OVER (PARTITION BY page_id ORDER BY k) AS part FROM l),
  s AS (SELECT page_id, part, coalesce(trim(max(regexp_extract(line, '^#{{1,6}} (.+)$', 1)) FILTER (head)), '') AS heading,
    regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT head), ''), '^\\s+|\\s+$', '', 'g') AS body FROM h GROUP BY page_id, part)
"""


@query(SECTIONS + """SELECT CAST(page_id AS VARCHAR) AS source, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part) - 1 AS INTEGER) AS number,
  CASE WHEN part = 0 THEN '' ELSE heading END AS path, CASE WHEN part = 0 THEN '(preamble)' ELSE heading END AS heading, body FROM s WHERE body <> ''""")
def sections_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sections(spark, sf_dir).withColumn("path", F.array_join("path", " > "))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_texts(t.table(spark, sf_dir, "pages"))
    return texts.sections(pages.select(F.col("page_id").cast("string").alias("source"), "text"))


NORMAL = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"""SELECT item_id AS quote_id, CAST(doc_id AS VARCHAR) AS source FROM benchmark JOIN documents ON contains({NORMAL.format("documents.text")}, {NORMAL.format("benchmark.text")})""")
def quote_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return texts.quoted_in(quotes, t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))


STOPS = ", ".join(f"'{w}'" for w in scalars.STOP)


@query(f"""WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')) AS w FROM benchmark),
  d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')) AS w FROM documents),
  s AS (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN d USING (w) WHERE w NOT IN ({STOPS}) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, CAST(doc_id AS VARCHAR)) AS place FROM s)
SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS source, overlap, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    held = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("").alias("label"), F.col("text").alias("passage"))
    return texts.keyword_top(asked, held, 5).select("query_id", "source", "overlap", "place")


@query("""WITH p AS (SELECT source, doc_id, sum(least(length(text), 6000)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents)
SELECT source AS shelf, doc_id, CAST(spent AS BIGINT) AS spent FROM p WHERE spent <= 24000""")
def passage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = t.table(spark, sf_dir, "documents").select(F.col("source").alias("shelf"), "source", F.col("doc_id").cast("string").alias("label"), F.col("text").alias("passage"), "doc_id")
    return texts.within_budget(held, ["shelf"], ["doc_id"]).select("shelf", "doc_id", "spent")


GUARD = texts.Guard(judging=(r"\b(?:is|are) (?:fully |partly )?(?:implemented|secure|compliant)\b",), boundary=(r"\b(?:cannot|whether)\b",))
#: Sentences that follow the texts of the tables, so that both verdicts occur among real ones.
JUDGED, UNJUDGED = "The control is fully implemented.", "This tool cannot say whether it is secure."


@query(rf"""SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '([.!?])\s+([\p{{Lu}}\p{{N}}\p{{Ps}}\p{{Pi}}"''*-])', '\1 \2', 'g')), chr(10))
  || chr(10) || CASE WHEN toxic = 1 THEN '{texts.WITHHELD}' ELSE '{UNJUDGED}' END || ' Done.' AS shown FROM documents JOIN labels USING (doc_id)""")
def guard_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.when(F.col("toxic") == 1, JUDGED).otherwise(UNJUDGED), F.lit(" Done."))
    return rows.select("doc_id", texts.screen(said, GUARD).alias("shown"))


@query("""SELECT 'invented' AS what, CAST(conv_id AS VARCHAR) AS unit, 'T' || (turn + 1) AS label FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)
UNION ALL SELECT 'uncovered', CAST(conv_id AS VARCHAR), 'T' || turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn + 1 = c.turn)""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t.table(spark, sf_dir, "conversations")
    unit = F.col("conv_id").cast("string").alias("unit")
    said = turns.select(unit, F.concat(F.lit("T"), (F.col("turn") + 1).cast("string")).alias("label"))
    there = turns.select(unit, F.concat(F.lit("T"), F.col("turn").cast("string")).alias("label"))
    invented, uncovered = texts.label_coverage(said, there)
    return invented.withColumn("what", F.lit("invented")).unionByName(uncovered.withColumn("what", F.lit("uncovered"))).select("what", "unit", "label")


@query("""SELECT doc_id, coalesce(text, '') || CASE WHEN quality = 1 THEN ' Seen in [Q1] and [quote Q2 withheld].' ELSE ' Seen in [quote Q1 withheld] and [quote Q2 withheld].' END AS prose
FROM documents JOIN labels USING (doc_id)""")
def struck_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id")
    known = F.when(F.col("quality") == 1, F.array(F.lit("Q1"))).otherwise(F.array(F.lit("Q9")))
    return rows.select("doc_id", texts.strike_markers(F.concat(F.coalesce("text", F.lit("")), F.lit(" Seen in [Q1] and [Q2].")), known).alias("prose"))


@query("""SELECT CAST(event_id AS VARCHAR) AS doc_id, CASE WHEN event_type = 'purchase' THEN '' WHEN event_type = 'view' THEN 'move' ELSE 'there is nothing at /event/coupon' END AS refused,
  CASE WHEN event_type = 'purchase' THEN '{"event": {"type": "purchase", "user": ' || user_id || ', "k": [' || event_id || ']}}' END AS text FROM events""")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.concat(
        F.lit('[{"op": "replace", "path": "/event/k", "value": ['), "doc_id", F.lit(']}, {"op": "'),
        F.when(F.col("text").contains('"type":"view"'), "move").otherwise("remove"), F.lit('", "path": "/event/coupon"}]'),
    )
    done = t.event_documents(spark, sf_dir).withColumn("p", patch.patched(F.col("text"), steps))
    refused = F.when(F.col("p.error").contains("'op': 'move'"), "move").otherwise(F.coalesce("p.error", F.lit("")))
    return done.select("doc_id", refused.alias("refused"), F.col("p.text").alias("text"))


@query("SELECT '/log/' || event_id AS location, '/log' AS parent FROM events")
def parent_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.event_findings(spark, sf_dir).select("location", scalars.parent_pointer(F.col("location")).alias("parent"))


@query("SELECT doc_id AS unit FROM documents EXCEPT SELECT doc_id FROM labels")
def eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("doc_id").alias("unit")
    return scoring.coverage(t.table(spark, sf_dir, "documents").select(unit), t.table(spark, sf_dir, "labels").select(unit))


@query("""SELECT doc_id AS unit FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels""")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, unit = t.table(spark, sf_dir, "documents"), F.col("doc_id").alias("unit")
    shards = [docs.where("lang = 'en'").select(unit), docs.where("n_chars > 1000").select(unit), t.table(spark, sf_dir, "labels").select(unit)]
    whole = shards[0].withColumn("shard", F.lit(0))
    for k, shard in enumerate(shards[1:], 1):
        whole = whole.unionByName(shard.withColumn("shard", F.lit(k)))
    return scoring.missing_everywhere(whole, len(shards))


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS injector, count(*) AS cases, count(*) FILTER (quality = 1) AS resolved,
  count(*) FILTER (quality = 1 AND toxic = 0) AS clean, count(*) FILTER (toxic > 0) AS introduced FROM labels GROUP BY 1""")
def injector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = t.table(spark, sf_dir, "labels").select(
        F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("injector"), (F.col("quality") == 1).alias("resolved"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"), F.col("toxic").alias("introduced"),
    )
    return scoring.outcome_summary(records)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS occurrence FROM lineitem)
SELECT occurrence, count(*) AS n FROM r GROUP BY 1""")
def positional_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.positional(t.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return rows.groupBy(F.col("occurrence").cast("long").alias("occurrence")).agg(F.count("*").alias("n"))

