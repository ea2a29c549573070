"""The checks: relations of facts in, findings out.

Each check is a plan of joins, windows and aggregates over the facts of all
documents at once. Rules travel as literal columns or as small tables with a row
for each declared constraint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions.scalars import shorten, shown_key, template, text
from assayer.operators.evaluate import fixed_rows
from assayer.operators.findings import rule
from assayer.rules.pack import RulePack

#: Java's patterns under these flags agree with the dialect that packs are written in.
DIALECT = "(?dU)"
#: Titles that declare an identifier, and titles that refer to one with what they may name.
DECLARING = ("Control Identifier", "Group Identifier", "Parameter Identifier", "Part Identifier", "Role Identifier")
REFERRING = {
    "Control Identifier Reference": ("Control Identifier", "a control"),
    "Match Controls by Identifier": ("Control Identifier", "a control in an imported control set"),
    "Parameter ID": ("Parameter Identifier", "a parameter"),
    "Control Statement Reference": ("Part Identifier", "a control statement, which is a part"),
}
VERSION = "oscal-version"
UUID_TYPE = "UUIDDatatype"


def of_kind(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("kind").isin(*kinds))


def structure(facts: DataFrame) -> DataFrame:
    """What the schema walk met: properties missing or undeclared, wrong types, short arrays, unread parts."""
    rows = of_kind(facts, "missing", "undeclared", "mistyped", "unread", "no_branch", "short")
    kind = F.col("kind")
    code = (
        F.when(kind == "missing", "REQUIRED_PROPERTY_MISSING").when(kind == "undeclared", "PROPERTY_UNDECLARED").when(kind == "mistyped", "TYPE_MISMATCH")
        .when(kind == "no_branch", "NO_SCHEMA_ALTERNATIVE").when(kind == "short", "ARRAY_TOO_SHORT").otherwise("SUBTREE_NOT_READ")
    )
    message = (
        F.when(kind == "missing", text(F.col("detail"), " requires this property."))
        .when(kind == "undeclared", text(F.col("detail"), " declares no such property and permits no others."))
        .when(kind == "short", text("At least ", F.col("low").cast("string"), " item(s) are required where the property is present."))
        .otherwise(text(F.upper(F.substring("detail", 1, 1)), F.expr("substr(detail, 2)"), "."))
    )
    value = F.when(kind == "missing", "(absent)").when(kind == "short", text(F.col("found").cast("string"), " item(s)")).otherwise("(present)")
    severity = F.when(kind == "unread", "UNVERIFIABLE").otherwise("ERROR")
    return rows.select(
        "doc_id", code.alias("code"), severity.alias("severity"), F.col("pointer").alias("location"), F.col("name").alias("prop"), value.alias("value"),
        message.alias("message"), rule(text("the schema's declaration at ", template(F.col("pointer")))).alias("rule"),
    )


def datatypes(facts: DataFrame, pack: RulePack) -> DataFrame:
    """Values against the patterns and bounds of their datatypes, and the patterns that were not applied."""
    rows = of_kind(facts, "scalar").where(F.col("datatype").isNotNull())
    fails, bounds, unchecked = F.lit(False), F.lit(None).cast("double"), []
    for name, kind in sorted(pack.schema.datatypes.items()):
        mine = F.col("datatype") == name
        if kind.pattern is not None and not kind.checkable:
            unchecked.append(name)
        elif kind.pattern is not None:
            fails = F.when(mine, ~F.col("value").rlike(DIALECT + kind.pattern)).otherwise(fails)
        if kind.minimum is not None:
            bounds = F.when(mine, F.lit(float(kind.minimum))).otherwise(bounds)
    listed = F.coalesce(F.array_contains("enums", F.col("value")), F.lit(False))
    cited = rule(text("the schema's datatype ", F.col("datatype"))).alias("rule")
    base = ("doc_id", F.col("pointer").alias("location"), F.col("name").alias("prop"))
    wrong = rows.where((F.col("jtype") == "string") & fails & ~listed).select(
        *base, F.lit("DATATYPE_MISMATCH").alias("code"), F.lit("ERROR").alias("severity"), shorten(F.col("value")).alias("value"),
        text("The value does not match the pattern of ", F.col("datatype"), ".").alias("message"), cited,
    )
    numeric = F.col("jtype").isin("integer", "number")
    low = rows.withColumn("bound", bounds).where(numeric & (F.col("value").try_cast("double") < F.col("bound"))).select(
        *base, F.lit("DATATYPE_BELOW_MINIMUM").alias("code"), F.lit("ERROR").alias("severity"), "value",
        text("The value is below the minimum ", F.regexp_replace(F.col("bound").cast("string"), r"\.0$", ""), " of ", F.col("datatype"), ".").alias("message"), cited,
    )
    open_values = rows.where(F.col("datatype").isin(*unchecked) if unchecked else F.lit(False)).where("jtype = 'string'")
    open_values = open_values.groupBy("doc_id", "model", "datatype").agg(F.count("*").alias("n")).select(
        "doc_id", text("/", F.col("model")).alias("location"), F.col("datatype").alias("prop"), F.lit("PATTERN_NOT_CHECKED").alias("code"),
        F.lit("UNVERIFIABLE").alias("severity"), text(F.col("n").cast("string"), " value(s)").alias("value"),
        F.lit("The pattern of this datatype cannot be applied here, so these values neither passed nor failed.").alias("message"), cited,
    )
    return wrong.unionByName(low).unionByName(open_values)


def rules_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """One row a declared constraint."""
    rows = [
        (k, c.kind, c.identifier, c.severity, c.context, c.target, c.index, ", ".join(x.target for x in c.keys), c.low, c.high, c.citation(), c.index in pack.built(), c.skipped)
        for k, c in enumerate(pack.constraints)
    ]
    return fixed_rows(
        spark, rows,
        "rule int, rule_kind string, identifier string, severity string, declared_on string, target string, index_name string, fields string, "
        "at_least int, at_most int, citation string, built boolean, skipped string",
    )


def selections(facts: DataFrame, pack: RulePack, *kinds: str) -> DataFrame:
    """Selected nodes of constraints of these kinds, with what the constraint says."""
    table = rules_table(facts.sparkSession, pack).where(F.col("rule_kind").isin(*kinds))
    return of_kind(facts, "selected", "value").drop("kind").join(F.broadcast(table), "rule")


def numbers(pack: RulePack, *kinds: str) -> list[int]:
    """Numbers of the constraints of these kinds."""
    return [k for k, c in enumerate(pack.constraints) if c.kind in kinds]


def uniqueness(facts: DataFrame, pack: RulePack) -> DataFrame:
    """Within one context, every node that repeats a key of an earlier node."""
    rows = of_kind(facts, "selected", "value").where(F.col("rule").isin(*numbers(pack, "is-unique", "index")))
    order = Window.partitionBy("doc_id", "rule", "context", "key").orderBy("alternative", "place", "ord")
    first = F.first("pointer").over(order)
    # What the constraint says meets the few that repeat a key, so the window moves none of it.
    repeated = selections(rows.withColumn("used", first).where(F.col("pointer") != F.col("used")), pack, "is-unique", "index")
    return repeated.select(
        "doc_id", F.lit("CONSTRAINT_NOT_UNIQUE").alias("code"), "severity", F.col("pointer").alias("location"), F.col("fields").alias("prop"),
        shown_key(F.col("key")).alias("value"),
        text("This key is already used at ", F.col("used"), "; it must be unique among the ", F.col("target"), " of each ", F.col("declared_on"), ".").alias("message"),
        rule(F.col("citation")).alias("rule"),
    )


def indexes(facts: DataFrame, pack: RulePack) -> DataFrame:
    """doc_id, index_name, key, rule, place, location: the index of each document, a key where it was met first.

    Documents that import it look up in it (``first_met``); it is never copied for each of them.
    """
    rows = selections(facts, pack, "index").select("doc_id", "index_name", "key", "rule", "place", F.concat("doc_id", "pointer").alias("location"))
    return rows.groupBy("doc_id", "index_name", "key").agg(F.min(F.struct("rule", "place", "location")).alias("f")).select("doc_id", "index_name", "key", "f.*")


def first_met(asked: DataFrame, reached: DataFrame, held: DataFrame) -> DataFrame:
    """doc_id, index_name, key, location of what is asked for (doc_id, index_name, key): the entry of the nearest document that the asking one reaches."""
    at = reached.select(F.col("primary").alias("doc_id"), F.col("doc_id").alias("holder"), "hops")
    entries = held.select(F.col("doc_id").alias("holder"), "index_name", "key", "rule", "place", "location")
    met = asked.select("doc_id", "index_name", "key").distinct().join(at, "doc_id").join(entries, ["holder", "index_name", "key"])
    first = F.min(F.struct("hops", "holder", "rule", "place", "location")).alias("f")
    return met.groupBy("doc_id", "index_name", "key").agg(first).select("doc_id", "index_name", "key", "f.location")


def met_in(asked: DataFrame, reached: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """doc_id and ``keys`` of what is asked for and some document that the asking one reaches holds (columns holder and ``keys``).

    What is asked is joined with the few documents it reaches and then looked up
    there, so a large document is not repeated for each one that imports it.
    """
    at = reached.select(F.col("primary").alias("doc_id"), F.col("doc_id").alias("holder"))
    return asked.select("doc_id", *keys).distinct().join(at, "doc_id").join(held, ["holder", *keys], "left_semi").select("doc_id", *keys).distinct()


def cross_references(facts: DataFrame, pack: RulePack, reached: DataFrame, complete: DataFrame) -> DataFrame:
    """Keys that no entry of their index carries; settled only if the index is built and every import was supplied."""
    rows = selections(facts, pack, "index-has-key")
    entries = selections(facts, pack, "index").select(F.col("doc_id").alias("holder"), "index_name", "key").distinct()
    carried = met_in(rows.select("doc_id", "index_name", "key"), reached, entries, "index_name", "key")
    absent = rows.join(carried, ["doc_id", "index_name", "key"], "left_anti").join(complete, "doc_id", "left")
    settled = F.coalesce("complete", F.lit(True)) & F.col("built")
    why = (
        F.when(settled, "Every document that it could reach was supplied, so it resolves to nothing.")
        .when(~F.col("built"), "No evaluated constraint builds this index, so the key could not be looked up.")
        .otherwise(text(F.col("why"), ", so whether it resolves cannot be settled here."))
    )
    return absent.select(
        "doc_id", F.when(settled, "REFERENCE_UNRESOLVED").otherwise("REFERENCE_UNVERIFIABLE").alias("code"),
        F.when(settled, F.col("severity")).otherwise("UNVERIFIABLE").alias("severity"), F.col("pointer").alias("location"), F.col("fields").alias("prop"),
        shown_key(F.col("key")).alias("value"), text("Nothing in the index ", F.col("index_name"), " carries this key. ", why).alias("message"),
        rule(F.when(settled, F.col("citation")).when(F.col("built"), "references reach as far as the supplied documents").otherwise("an index that is not built settles nothing")).alias("rule"),
    )


def cardinality(facts: DataFrame, pack: RulePack) -> DataFrame:
    """Contexts with fewer or more selected nodes than declared, contexts without any included.

    A context and each of its nodes is one fact, so one count over both kinds of facts gives all numbers, zero too.
    """
    table = rules_table(facts.sparkSession, pack).where("rule_kind = 'has-cardinality'")
    rows = of_kind(facts, "context", "selected").where(F.col("rule").isin(*numbers(pack, "has-cardinality")))
    is_node = F.col("kind") == "selected"
    rows = rows.withColumn("context", F.when(is_node, F.col("context")).otherwise(F.col("pointer")))
    rows = rows.groupBy("doc_id", "rule", "context").agg(F.count(F.when(is_node, 1)).alias("n")).join(F.broadcast(table), "rule")
    outside = F.coalesce(F.col("n") < F.col("at_least"), F.lit(False)) | F.coalesce(F.col("n") > F.col("at_most"), F.lit(False))
    bounds = F.concat_ws(" and ", text("at least ", F.col("at_least").cast("string")), text("at most ", F.col("at_most").cast("string")))
    return rows.where(outside).select(
        "doc_id", F.lit("CONSTRAINT_CARDINALITY").alias("code"), "severity", F.col("context").alias("location"), F.col("target").alias("prop"),
        text(F.col("n").cast("string"), " present").alias("value"), text("There must be ", bounds, " of ", F.col("target"), " here.").alias("message"),
        rule(F.col("citation")).alias("rule"),
    )


def matches(facts: DataFrame, pack: RulePack) -> DataFrame:
    """Values that fail a declared pattern or the pattern of a declared datatype; each failed pattern is a finding."""
    rows = selections(facts, pack, "matches")
    failed = F.array().cast("array<string>")
    for k, c in enumerate(pack.constraints):
        if c.kind != "matches" or c.skipped:
            continue
        patterns = [(f"the pattern {c.regex}", c.regex)] if c.regex else []
        if c.datatype:
            found = pack.datatype(c.datatype)
            patterns.insert(0, (f"the datatype {c.datatype} ({found.description})", found.pattern))
        tests = [F.when(~F.col("value").rlike(DIALECT + p), F.lit(said)) for said, p in patterns]
        failed = F.when(F.col("rule") == k, F.filter(F.array(*tests), lambda t: t.isNotNull())).otherwise(failed)
    each = rows.withColumn("pattern", F.explode(failed))
    return each.select(
        "doc_id", F.lit("CONSTRAINT_VALUE_MISMATCH").alias("code"), "severity", F.col("pointer").alias("location"), F.col("target").alias("prop"),
        shorten(F.col("value")).alias("value"), text("The value must match ", F.col("pattern"), ", and does not.").alias("message"), rule(F.col("citation")).alias("rule"),
    )


def coverage(facts: DataFrame, pack: RulePack) -> DataFrame:
    """For each document and kind, how many declared constraints were not evaluated, whatever model they govern."""
    counted = list(pack.skipped_counts().items())
    kinds = facts.sparkSession.createDataFrame(counted, "prop string, n int")
    rows = of_kind(facts, "model").select("doc_id", F.col("name").alias("model")).crossJoin(F.broadcast(kinds))
    return rows.select(
        "doc_id", F.lit("CONSTRAINT_NOT_EVALUATED").alias("code"), F.lit("UNVERIFIABLE").alias("severity"), text("/", F.col("model")).alias("location"), "prop",
        text(F.col("n").cast("string"), " constraint(s)").alias("value"),
        text(F.col("n").cast("string"), " constraint(s) of this kind were not evaluated. They neither passed nor failed.").alias("message"),
        rule("what is not evaluated is not passed").alias("rule"),
    )


def constraints(facts: DataFrame, pack: RulePack, reached: DataFrame, complete: DataFrame) -> DataFrame:
    """All findings of the constraint layer."""
    parts = [uniqueness(facts, pack), cross_references(facts, pack, reached, complete), cardinality(facts, pack), matches(facts, pack), coverage(facts, pack)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def identifiers(facts: DataFrame) -> DataFrame:
    """UUIDs declared twice in one document."""
    rows = of_kind(facts, "scalar").where((F.col("datatype") == UUID_TYPE) & (F.col("name") == "uuid") & (F.col("jtype") == "string"))
    first = F.first("pointer").over(Window.partitionBy("doc_id", "value").orderBy("ord"))
    repeated = rows.withColumn("used", first).where(F.col("pointer") != F.col("used"))
    return repeated.select(
        "doc_id", F.lit("UUID_NOT_UNIQUE").alias("code"), F.lit("ERROR").alias("severity"), F.col("pointer").alias("location"), F.lit("uuid").alias("prop"), "value",
        text("This UUID is already used at ", F.col("used"), ".").alias("message"), rule("a UUID identifies one object").alias("rule"),
    )


def named_identifiers(facts: DataFrame) -> DataFrame:
    """doc_id, what, value: identifiers that documents declare."""
    rows = of_kind(facts, "scalar").where("jtype = 'string'")
    what = F.when(F.col("title").isin(*DECLARING), F.col("title")).when(F.col("name") == "uuid", F.lit("uuid"))
    return rows.select("doc_id", what.alias("what"), "value").where("what IS NOT NULL").distinct()


def declared(facts: DataFrame, reached: DataFrame) -> DataFrame:
    """primary, what, value: identifiers declared anywhere in the documents that a primary reaches."""
    return reached.select("primary", "doc_id").join(named_identifiers(facts), "doc_id").select("primary", "what", "value").distinct()


def open_references(facts: DataFrame, reached: DataFrame) -> DataFrame:
    """References and fragments that name no declared identifier: doc_id, pointer, name, value, wanted, said."""
    rows = of_kind(facts, "scalar").where("jtype = 'string'")
    wanted, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for title, (target, words) in REFERRING.items():
        wanted = F.when(F.col("title") == title, target).otherwise(wanted)
        said = F.when(F.col("title") == title, words).otherwise(said)
    rows = rows.select("doc_id", "pointer", "name", "value", wanted.alias("wanted"), said.alias("said"))
    held = named_identifiers(facts).withColumnRenamed("doc_id", "holder")
    typed = rows.where("wanted IS NOT NULL")
    typed = typed.join(met_in(typed, reached, held.withColumnRenamed("what", "wanted"), "wanted", "value"), ["doc_id", "wanted", "value"], "left_anti")
    loose = rows.where((F.col("name") == "href") & F.col("value").startswith("#") & F.col("wanted").isNull())
    loose = loose.withColumn("bare", F.expr("substr(value, 2)"))
    anything = held.select("holder", F.col("value").alias("bare")).distinct()
    loose = loose.join(met_in(loose, reached, anything, "bare"), ["doc_id", "bare"], "left_anti").drop("bare")
    loose = loose.withColumn("said", F.lit("an object by its identifier"))
    return typed.select(*rows.columns).unionByName(loose.select(*rows.columns))


def references(facts: DataFrame, reached: DataFrame, complete: DataFrame) -> DataFrame:
    """References that resolve to nothing where everything was supplied, and those that cannot be settled otherwise."""
    rows = open_references(facts, reached).join(complete, "doc_id", "left")
    settled = F.coalesce("complete", F.lit(True))
    why = F.when(settled, "Every imported document was supplied, so it resolves to nothing.").otherwise(text(F.col("why"), ". ", F.col("remedy")))
    return rows.select(
        "doc_id", F.when(settled, "REFERENCE_UNRESOLVED").otherwise("REFERENCE_UNVERIFIABLE").alias("code"),
        F.when(settled, "ERROR").otherwise("UNVERIFIABLE").alias("severity"), F.col("pointer").alias("location"), F.col("name").alias("prop"), "value",
        text("This names ", F.col("said"), ", and the supplied documents declare no such identifier. ", why).alias("message"),
        rule(F.when(settled, "the effective data model of a document holds the documents it imports").otherwise("references reach as far as the supplied documents")).alias("rule"),
    )


def versions(facts: DataFrame, pack: RulePack) -> DataFrame:
    """A release declared in the metadata that is not the release of the rules."""
    rows = declared_versions(facts).where(F.col("value") != pack.release)
    return rows.select(
        "doc_id", F.lit("OSCAL_VERSION_DIFFERS").alias("code"), F.lit("WARNING").alias("severity"), F.col("pointer").alias("location"), F.lit(VERSION).alias("prop"), "value",
        text(f"All findings rest on the rules of release {pack.release}; the document declares ", F.col("value"), ".").alias("message"),
        rule("a document declares the release it is written for").alias("rule"),
    )


def declared_versions(facts: DataFrame) -> DataFrame:
    three = F.char_length("pointer") - F.char_length(F.replace(F.col("pointer"), F.lit("/"), F.lit(""))) == 3
    return of_kind(facts, "scalar").where((F.col("name") == VERSION) & three)


def version_skew(facts: DataFrame, pack: RulePack, found: DataFrame) -> DataFrame:
    """For documents of another release that have errors: the errors by code, which may not be errors there."""
    errors = found.where("severity = 'ERROR'").groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda s: F.concat(s["code"], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", ")
    errors = errors.groupBy("doc_id").agg(F.sum("n").alias("errors"), named.alias("codes"))
    rows = declared_versions(facts).where(F.col("value") != pack.release).join(errors, "doc_id")
    return rows.select(
        "doc_id", F.lit("VERSION_SKEW_SUSPECTED").alias("code"), F.lit("INFO").alias("severity"), F.col("pointer").alias("location"), F.lit(VERSION).alias("prop"), "value",
        text(F.col("errors").cast("string"), f" ERROR finding(s) rest on release {pack.release}: ", F.col("codes"), ". Whether they are errors under ", F.col("value"), " was not determined.").alias("message"),
        rule("a document declares the release it is written for").alias("rule"),
    )
