"""Queries on findings, reports, replies and scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import scalars
from assayer.operators import assist, baseline, compare, findings, provenance, rule_data, scoring, suggest, texts
from assayer.plans import queries as q
from assayer.plans import tables as t
from assayer.plans.registry import query
from assayer.sinks import reports
from assayer.sources.reports import manifest

CODE = "CASE event_type WHEN 'error' THEN 'TYPE_MISMATCH' WHEN 'purchase' THEN 'DATATYPE_MISMATCH' WHEN 'view' THEN 'IMPORT_RESOLVED' WHEN 'click' THEN 'REFERENCE_UNVERIFIABLE' ELSE 'UNHEARD_OF' END"
SEVERITY = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'view' THEN 'INFO' ELSE 'UNVERIFIABLE' END"
EVENTS = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id, event_type, {CODE} AS code, {SEVERITY} AS severity, '/log/' || event_id AS location, json_extract_string(props, '$.k') AS value FROM events)
"""


# -- the algebra of findings ---------------------------------------------------------


@query(EVENTS + "SELECT doc_id, max(CASE WHEN severity IN ('ERROR', 'WARNING') THEN 1 ELSE 0 END) AS exit_code FROM e GROUP BY 1")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stricter gate fails documents with warnings too."""
    found = t.event_findings(spark, sf_dir)
    return findings.exit_codes(found, found.select("doc_id"), fail_on="warning")


@query(EVENTS + """SELECT doc_id, count(*) FILTER (severity = 'ERROR') AS "ERROR", count(*) FILTER (severity = 'WARNING') AS "WARNING", count(*) FILTER (severity = 'INFO') AS "INFO",
  count(*) FILTER (severity = 'UNVERIFIABLE') AS "UNVERIFIABLE" FROM e GROUP BY 1""")
def severity_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all severities of every document, zeros included."""
    return findings.severity_counts(t.event_findings(spark, sf_dir), "doc_id")


@query(EVENTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY location) AS n FROM e)
SELECT doc_id, 'F' || n AS label, location FROM r WHERE code = 'DATATYPE_MISMATCH' ORDER BY doc_id, location LIMIT 40""")
def selected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first findings of a code, under the labels that they carry in their report."""
    return findings.chosen(t.event_findings(spark, sf_dir), code="DATATYPE_MISMATCH", first=40).select("doc_id", "label", "location")


def _half(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    """Findings without those whose number leaves a rest by three."""
    return t.event_findings(spark, sf_dir).where(F.regexp_extract("location", "([0-9]+)$", 1).cast("long") % 3 != rest)


SPLIT = EVENTS + """, k AS (SELECT doc_id, code, value, event_type, count(*) FILTER (event_id % 3 = 1) AS gone, count(*) FILTER (event_id % 3 = 0) AS came FROM e GROUP BY ALL)
"""


@query(SPLIT + "SELECT doc_id, location, CASE WHEN event_id % 3 = 1 THEN 'removed' ELSE 'added' END AS status FROM e JOIN k USING (doc_id, code, value, event_type) WHERE event_id % 3 <> 2 AND gone > 0 AND came > 0 AND gone + came > 2")
def undecided_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed and added findings that could be paired in several ways are not paired."""
    rows = compare.compare(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1)).where("undecided")
    side = F.coalesce("before", "after")
    return rows.select(side["doc_id"].alias("doc_id"), side["location"].alias("location"), "status")


@query(SPLIT + "SELECT doc_id, location FROM e JOIN k USING (doc_id, code, value, event_type) WHERE event_id % 3 = 0 AND severity = 'ERROR' AND NOT (gone = 1 AND came = 1)")
def fresh_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that a change brought in; one that only moved is not among them."""
    return compare.new_errors(compare.compare(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1))).select("after.doc_id", "after.location")


@query("""SELECT p_type AS rule_kind, CAST(p_partkey AS VARCHAR) AS identifier, unnest(list_filter([CASE WHEN p_partkey % 10 = 0 THEN 'removed' END, CASE WHEN p_partkey % 10 = 1 THEN 'added' END,
  CASE WHEN p_partkey % 10 > 1 AND p_size % 5 = 0 THEN 'releveled' END, CASE WHEN p_partkey % 10 > 1 AND p_size % 7 = 0 THEN 'retargeted' END,
  CASE WHEN p_partkey % 10 > 1 AND p_size % 4 = 0 THEN 'now skipped' WHEN p_partkey % 10 > 1 AND p_size % 4 = 1 THEN 'now evaluated' END], lambda x: x IS NOT NULL)) AS change FROM part""")
def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of declared constraints between two releases."""
    n, size = F.col("p_partkey"), F.col("p_size")
    base = {"rule": n.cast("int"), "rule_kind": F.col("p_type"), "identifier": n.cast("string"), "declared_on": F.lit("part")}
    parts = t.table(spark, sf_dir, "part")
    old = parts.where("p_partkey % 10 != 1").select(*[c.alias(k) for k, c in base.items()], F.lit("ERROR").alias("severity"), F.lit(".").alias("target"), F.when(size % 4 == 1, "why").otherwise("").alias("skipped"))
    new = parts.where("p_partkey % 10 != 0").select(
        *[c.alias(k) for k, c in base.items()], F.when(size % 5 == 0, "INFO").otherwise("ERROR").alias("severity"), F.when(size % 7 == 0, "x").otherwise(".").alias("target"),
        F.when(size % 4 == 0, "why").otherwise("").alias("skipped"),
    )
    return compare.compare_rules(old, new).select("rule_kind", "identifier", "change")


@query("SELECT count(*) FILTER (event_id % 14 = 0 AND event_type IN ('error', 'purchase', 'view')) AS acknowledged, count(*) FILTER (event_id % 14 = 7 AND event_type IN ('error', 'purchase', 'view')) AS stale FROM events")
def baseline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings are acknowledged, and how many entries acknowledge nothing."""
    return baseline.counts(baseline.apply(t.event_findings(spark, sf_dir), q.baseline_entries(spark, sf_dir)))


# -- reports ----------------------------------------------------------------------------


@query(EVENTS + """SELECT doc_id, code AS rule_id, CASE severity WHEN 'INFO' THEN 'informational' WHEN 'UNVERIFIABLE' THEN 'open' ELSE 'fail' END AS kind,
  CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END AS level, doc_id AS uri, location AS pointer, 'k = ' || value || '. It happened.' AS message FROM e""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result of the log for each finding, made by Spark for tables of any size."""
    return reports.sarif_results(t.event_findings(spark, sf_dir), "log").select("doc_id", "rule_id", "kind", "level", "uri", "pointer", "message")


@query(EVENTS + "SELECT code AS id, 'http://rules.example/' AS help, count(*) AS results FROM e GROUP BY 1")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the log for each code that is met."""
    return reports.sarif_rules(t.event_findings(spark, sf_dir)).select("id", "help", "results")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lib/x.json' END AS file, CASE WHEN doc_id % 3 = 1 THEN '/catalog' ELSE '/a/' || doc_id END AS pointer FROM documents""")
def split_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and pointer of locations in the document itself and in others."""
    n = F.col("doc_id").cast("string")
    location = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("lib/x.json#/a/"), n)).when(F.col("doc_id") % 3 == 1, F.lit("/catalog")).otherwise(F.concat(F.lit("/a/"), n))
    found = t.table(spark, sf_dir, "documents").select("doc_id", reports.split_location(location, F.lit("catalog")).alias("p"))
    return found.select("doc_id", "p.file", "p.pointer")


@query(EVENTS + """SELECT location, rpad(severity, 12, ' ') || ' ' || code || '  at=' || location || chr(10) || '    k = ' || value || chr(10) || '    It happened.' || chr(10) || '    rule: ' || event_type || chr(10)
  || '    source: http://rules.example/ (retrieved )' AS block FROM e""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report's lines of every finding."""
    return t.event_findings(spark, sf_dir).select("location", F.regexp_replace(reports.text_lines(), "\\s+$", "").alias("block"))


@query(EVENTS + """SELECT doc_id, '{"code":"' || code || '","severity":"' || severity || '","location":"' || location || '","property":"k","value":"' || value || '","message":"It happened.","rule":{"citation":"' || event_type
  || '","url":"http://rules.example/","retrieved":""}}' AS json FROM e""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON record of every finding; what is absent has no key."""
    return reports.records(t.event_findings(spark, sf_dir))


@query(f"WITH x AS ({q.PAGE_SQL}) SELECT page_id, sha256(html) AS raw_sha256, octet_length(encode(html)) AS raw_bytes, sha256(x.text) AS text_sha256, octet_length(encode(x.text)) AS text_bytes FROM pages JOIN x USING (page_id)")
def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and sizes of pages and of their texts."""
    held = manifest(t.table(spark, sf_dir, "pages"))
    return held.withColumns({c: F.col(c).cast("long") for c in ("raw_bytes", "text_bytes")})


@query("""WITH p AS (SELECT event_id, 'assayer ' || (user_id % 3) AS a, 'assayer ' || (event_id % 3) AS b, CASE event_type WHEN 'view' THEN '' ELSE event_type END AS r, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN event_type ELSE 'click' END AS s FROM events)
SELECT event_id, 'before' AS side, 'written by ' || a || ', the other by ' || b AS note FROM p WHERE a <> b UNION ALL SELECT event_id, 'before', 'its rules are not recorded' FROM p WHERE r = ''
UNION ALL SELECT event_id, 'after', 'its rules are not recorded' FROM p WHERE s = '' UNION ALL SELECT event_id, 'after', 'judged by ' || s || ', the other by ' || r FROM p WHERE r <> '' AND s <> '' AND r <> s""")
def provenance_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be said before two reports are compared, for a pair of runs of each event."""
    kind, n = F.col("event_type"), F.col("event_id")
    before = F.struct(F.concat(F.lit("assayer "), (F.col("user_id") % 3).cast("string")).alias("tool"), F.when(kind == "view", "").otherwise(kind).alias("rules"))
    after = F.struct(F.concat(F.lit("assayer "), (n % 3).cast("string")).alias("tool"), F.when(n % 4 == 0, "").when(n % 4 == 1, kind).otherwise("click").alias("rules"))
    pairs = t.table(spark, sf_dir, "events").select("event_id", before.alias("before"), after.alias("after"))
    return compare.notes_of_pairs(pairs, "event_id")


@query("""SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text || marked) AS sha256, CAST(octet_length(encode(text || marked)) AS BIGINT) AS size,
  CASE WHEN contains(text || marked, '<!DOCTYPE') THEN 'carries <!DOCTYPE' WHEN contains(text || marked, '<!ENTITY') THEN 'carries <!ENTITY' END AS refusal
FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN '<!DOCTYPE x>' WHEN 1 THEN '<!ENTITY y>' ELSE '' END AS marked FROM documents WHERE text IS NOT NULL)""")
def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, size and refusal of every file of a candidate."""
    n = F.col("doc_id") % 5
    content = F.concat("text", F.when(n == 0, "<!DOCTYPE x>").when(n == 1, "<!ENTITY y>").otherwise("")).cast("binary")
    return rule_data.records(t.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("name"), content.alias("content")))


@query("""SELECT part, count(*) AS n, array_to_string(list_sort(list(line)), ';') AS lines FROM (
  SELECT 'files' AS part, p_brand || ': ' || coalesce(left(b, 12), '(absent)') || ' -> ' || coalesce(left(a, 12), '(absent)') AS line FROM (
    SELECT p_brand, max(CASE WHEN p_brand NOT LIKE '%3' THEN sha256(p_brand) END) AS b, max(CASE WHEN p_brand NOT LIKE '%4' THEN sha256(CASE WHEN p_brand LIKE '%2' THEN 'new' ELSE '' END || p_brand) END) AS a FROM part GROUP BY p_brand) WHERE a IS DISTINCT FROM b
  UNION ALL SELECT change, identifier || ' (' || rule_kind || ')' FROM (SELECT p_type AS rule_kind, CAST(p_partkey AS VARCHAR) AS identifier, unnest(list_filter([CASE WHEN p_partkey % 10 = 0 THEN 'removed' END,
    CASE WHEN p_partkey % 10 = 1 THEN 'added' END, CASE WHEN p_partkey % 10 > 1 AND p_size % 5 = 0 THEN 'releveled' END], lambda x: x IS NOT NULL)) AS change FROM part)) GROUP BY part""")
def difference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a difference between two releases of rules: files whose bytes differ and constraints that changed."""
    parts = t.table(spark, sf_dir, "part")
    brands = parts.select(F.col("p_brand").alias("name")).distinct()
    old = brands.where("name NOT LIKE '%3'").withColumn("sha256", F.sha2("name", 256))
    new = brands.where("name NOT LIKE '%4'").withColumn("sha256", F.sha2(F.concat(F.when(F.col("name").like("%2"), "new").otherwise(""), "name"), 256))
    n = F.col("p_partkey")
    declared = [n.cast("int").alias("rule"), F.col("p_type").alias("rule_kind"), n.cast("string").alias("identifier"), F.lit("part").alias("declared_on"), F.lit(".").alias("target"), F.lit("").alias("skipped")]
    before = parts.where("p_partkey % 10 != 1").select(*declared, F.lit("ERROR").alias("severity"))
    after = parts.where("p_partkey % 10 != 0").select(*declared, F.when(F.col("p_size") % 5 == 0, "INFO").otherwise("ERROR").alias("severity"))
    lines = rule_data.difference_lines(compare.compare_rules(before, after), rule_data.changed_files(old, new))
    return lines.withColumn("lines", F.array_join("lines", ";"))


# -- texts and replies --------------------------------------------------------------------


@query(q.SECTIONS + "SELECT CAST(page_id AS VARCHAR) AS source, heading AS path, body FROM s WHERE part = 1 AND body <> ''")
def section_of_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section whose headings a pointer names, or the nearest one above."""
    held = q.page_sections(spark, sf_dir)
    places = held.where("size(path) = 1").select("source", F.concat(F.lit("/"), scalars.escape_pointer(F.element_at("path", 1)), F.lit("/3/deeper/0")).alias("location"))
    return texts.section_for(places, held).select("source", F.array_join("path", " > ").alias("path"), "body")


@query(f"""WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')) AS w FROM benchmark),
  d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')) AS w FROM documents),
  s AS (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN d USING (w) WHERE w NOT IN ({q.STOPS}) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, CAST(doc_id AS VARCHAR)) AS place FROM s),
  p AS (SELECT item_id, doc_id, place, sum(least(length(text), 900)) OVER (PARTITION BY item_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS spent FROM r JOIN documents USING (doc_id) WHERE place <= 3)
SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS source, CAST(place AS INTEGER) AS place, CAST(spent AS BIGINT) AS spent FROM p WHERE spent <= 2000""")
def evidence_for_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages shown for each question, within the budget."""
    asked = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    held = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("").alias("label"), F.col("text").alias("passage"))
    return texts.evidence(asked, held, k=3, each=900, total=2000).select("query_id", "source", "place", "spent")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE text END AS answer FROM conversations")
def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object of replies, in a code fence, among prose, or absent."""
    made = F.to_json(F.struct(F.col("text").alias("answer")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here: "), made, F.lit(" done."))).otherwise(F.lit("no object"))
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get_json_object(texts.reply_json(reply), "$.answer").alias("answer"))


@query(f"""WITH c AS (SELECT CAST(item_id AS VARCHAR) AS quote_id, text AS quote, CASE WHEN item_id % 5 = 0 THEN 'nowhere' ELSE CAST(doc_id AS VARCHAR) END AS source, doc_id FROM benchmark
  JOIN (SELECT doc_id, text AS body FROM documents) ON doc_id % (SELECT count(*) FROM benchmark) = item_id % (SELECT count(*) FROM benchmark))
SELECT c.quote_id || '-' || c.doc_id AS quote_id, CASE WHEN c.source = 'nowhere' THEN 'names a source that does not exist' WHEN length({q.NORMAL.format("c.quote")}) < 20 THEN 'too short to verify'
  WHEN NOT contains({q.NORMAL.format("documents.text")}, {q.NORMAL.format("c.quote")}) THEN 'not found verbatim in that source' ELSE 'ok' END AS verdict FROM c JOIN documents USING (doc_id)
UNION ALL SELECT 'own-' || doc_id, CASE WHEN length({q.NORMAL.format("left(text, 60)")}) < 20 THEN 'too short to verify' ELSE 'ok' END FROM documents""")
def quote_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of quotations of every document and of passages said to stand in one."""
    docs = t.table(spark, sf_dir, "documents")
    items = t.table(spark, sf_dir, "benchmark")
    n = items.count()
    strange = docs.select("doc_id").join(items, F.col("doc_id") % n == F.col("item_id") % n).select(
        F.concat_ws("-", F.col("item_id").cast("string"), F.col("doc_id").cast("string")).alias("quote_id"),
        F.when(F.col("item_id") % 5 == 0, "nowhere").otherwise(F.col("doc_id").cast("string")).alias("source"), F.col("text").alias("quote"),
    )
    own = docs.select(F.concat(F.lit("own-"), F.col("doc_id").cast("string")).alias("quote_id"), F.col("doc_id").cast("string").alias("source"), F.expr("left(text, 60)").alias("quote"))
    return texts.verified_quotes(strange.unionByName(own), docs.select(F.col("doc_id").cast("string").alias("source"), "text"))


@query("""WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS unit, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT 'invented' AS what, unit, 'F' || (last + 1) AS name FROM l WHERE turn = last AND last > 0 UNION ALL SELECT DISTINCT 'left out', unit, 'G0' FROM l WHERE last = 0""")
def walkthrough_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a walkthrough made up, and groups that it leaves out."""
    turns = t.table(spark, sf_dir, "conversations")
    unit, label = F.col("conv_id").cast("string").alias("unit"), F.concat(F.lit("F"), F.col("turn").cast("string")).alias("label")
    many = turns.join(turns.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")
    said = F.when(F.col("last") > 0, F.concat(F.lit("Then F"), (F.col("turn") + 1).cast("string"), F.lit(". "))).otherwise("")
    steps = many.select(unit, F.col("turn").alias("number"), F.concat(said, "text").alias("text"))
    _, invented, left_out = assist.walkthrough(steps, turns.select(unit, label, F.lit("G0").alias("group")), q.GUARD)
    rows = invented.select(F.lit("invented").alias("what"), "unit", F.col("label").alias("name"))
    return rows.unionByName(left_out.select(F.lit("left out").alias("what"), "unit", F.col("group").alias("name")))


@query("SELECT conv_id || '/' || turn AS prompt_id, md5(text) AS reply FROM conversations")
def recorded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded replies, found by the digest of the prompt."""
    prompts = t.table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), F.col("text").alias("prompt"))
    digest = F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256")
    return assist.replay(prompts, prompts.select(digest, F.md5(F.col("prompt").cast("binary")).alias("reply")).distinct())


@query(EVENTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY location) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM e)
SELECT doc_id, string_agg('F' || n || '  ' || severity || ' ' || code || ' at=' || location || ' k=' || value, chr(10) ORDER BY n) || CASE WHEN any_value(total) > 5 THEN chr(10) || '... and ' || (any_value(total) - 5) || ' more' ELSE '' END AS context
FROM r WHERE n <= 5 GROUP BY 1""")
def findings_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is shown of each document's findings."""
    return assist.context(t.event_findings(spark, sf_dir), 5)


@query(EVENTS + "SELECT location, CASE WHEN severity = 'UNVERIFIABLE' THEN 1 ELSE 0 END AS notes FROM e")
def finding_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many things have to be said beside each finding."""
    return assist.notes(t.event_findings(spark, sf_dir)).select("location", F.size("notes").alias("notes"))


@query("""WITH n AS (SELECT DISTINCT p_name AS v FROM part), p AS (SELECT a.v AS written, b.v AS value, damerau_levenshtein(a.v, b.v) AS edits FROM n a JOIN n b ON a.v <> b.v WHERE damerau_levenshtein(a.v, b.v) <= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY written ORDER BY edits, value) AS turn FROM p)
SELECT written, value, edits || CASE WHEN edits = 1 THEN ' character edit' ELSE ' character edits' END AS difference, CAST(turn AS INTEGER) AS turn FROM r WHERE turn <= 3""")
def suggested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three declared names that a written one may mean, the closest first."""
    names = t.table(spark, sf_dir, "part").select(F.lit("n").alias("pool"), F.col("p_name").alias("value")).distinct()
    return suggest.best(suggest.close_pairs(names.withColumnRenamed("value", "written"), names, "pool"), "pool").select("written", "value", "difference", "turn")


# -- scores ---------------------------------------------------------------------------------


@query(EVENTS + "SELECT doc_id, location, code FROM e WHERE event_id % 3 = 0 AND severity = 'ERROR'")
def new_error_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors whose identity an earlier run did not have."""
    return scoring.new_errors(_half(spark, sf_dir, 1), _half(spark, sf_dir, 0)).select("doc_id", "location", "code")


@query(EVENTS + """, x AS (SELECT *, code = 'TYPE_MISMATCH' AS target, event_id % 3 = 1 AS gone, event_id % 3 = 0 AS came FROM e),
  s AS (SELECT doc_id, bool_or(target) AS asked, bool_or(target AND gone) AS resolved, count(*) FILTER (came) AS introduced, count(*) FILTER (gone AND NOT target) AS also_resolved FROM x GROUP BY 1)
SELECT doc_id, resolved, introduced, also_resolved, resolved AND introduced = 0 AS clean FROM s WHERE asked""")
def repair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change did to its targets, and what else it did."""
    targets = t.event_findings(spark, sf_dir).where("code = 'TYPE_MISMATCH'").select("doc_id", "location", "code")
    return scoring.repair_outcomes(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1), targets)


@query("""SELECT CAST(quality AS VARCHAR) AS category, count(*) AS cases, count(*) FILTER (toxic = 0 AND doc_id % 5 <> 0) AS held,
  coalesce(array_to_string(list_sort(list(lpad(CAST(doc_id AS VARCHAR), 9, '0')) FILTER (toxic = 1 OR doc_id % 5 = 0)), ','), '') AS crossed FROM labels GROUP BY 1""")
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where replies stayed within the boundary, by category."""
    rows = t.table(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("category"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), (F.col("toxic") == 1).alias("lexical"), (F.col("doc_id") % 5 == 0).alias("judged"),
    )
    return scoring.boundary_summary(rows).withColumn("crossed", F.array_join("crossed", ","))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'absent' WHEN doc_id % 5 = 0 THEN 'refused' ELSE 'present' END AS state FROM documents")
def pinned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a manifest whose bytes are there, are others, or are missing."""
    docs = t.table(spark, sf_dir, "documents")
    key, digest = F.col("doc_id").cast("string").alias("id"), F.sha2(F.col("text").cast("binary"), 256)
    files = docs.where("doc_id % 3 != 0").select(key, F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(digest).alias("sha256"))
    return scoring.pinned(docs.select(key, digest.alias("sha256")), files).select("id", "state")


@query("""SELECT CAST(conv_id AS VARCHAR) AS unit, count(*) AS claims, count(*) FILTER (turn % 2 = 0) AS verified, count(*) FILTER (turn % 2 = 1) AS withheld, count(*) FILTER (turn % 2 = 1) = 0 AS faithful FROM conversations GROUP BY 1""")
def grounding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a reply's claims stand in their sources."""
    turns = t.table(spark, sf_dir, "conversations")
    verdict = F.when(F.col("turn") % 2 == 0, "ok").otherwise("not found verbatim in that source").alias("verdict")
    return scoring.grounding(turns.select(F.col("conv_id").cast("string").alias("unit"), verdict))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'no text of this source is held' WHEN doc_id % 5 = 0 THEN 'the words do not stand in the source' ELSE 'quoted' END AS state,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sha256(text) END AS source_sha256 FROM documents WHERE length(trim(regexp_replace(left(text, 60), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) >= 20""")
def assembled_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations with the digest of their source, or a statement that the source's text is not held."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "text")
    quote = F.when(F.col("doc_id") % 5 == 0, F.lit("words that no document of this table can hold")).otherwise(F.expr("left(text, 60)"))
    asked = docs.where(F.char_length(scalars.normalize(F.expr("left(text, 60)"))) >= 20).select("id", F.col("id").alias("source"), quote.alias("quote"))
    held = docs.where("doc_id % 3 != 0").select(F.col("id").alias("source"), "text")
    return provenance.quotations(asked, held).select("id", "state", "source_sha256")
