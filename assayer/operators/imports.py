"""The import graph: edges, the documents they name, what is reachable, and what stays open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.durable import broadcast_if_small, cut
from assayer.functions.scalars import file_name, fragment_of, path_of, stem

#: Pointer segments below which an href imports a document, and the scalar that does so by itself.
SEGMENTS = ("imports", "import-profile", "import-ssp", "import-ap", "import-component-definitions")
NAMES = ("source",)
#: All names of scalars that edges and the links of resources are read from.
ASKED = ("href", "uuid", *NAMES)
RESOURCE = r"/back-matter/resources/([^/]+)/"


def edges(scalars: DataFrame) -> DataFrame:
    """doc_id, pointer, href of everything that names another document."""
    below = F.exists(F.split("pointer", "/"), lambda s: s.isin(*SEGMENTS))
    is_import = ((F.col("name") == "href") & below) | F.col("name").isin(*NAMES)
    return scalars.where((F.col("jtype") == "string") & is_import).select("doc_id", "pointer", F.col("value").alias("href"))


def resource_links(scalars: DataFrame) -> DataFrame:
    """doc_id, uuid, names: file names behind a back-matter resource, in document order."""
    held = scalars.where(F.col("jtype") == "string").select(
        "doc_id", "ord", "pointer", "name", "value", F.regexp_extract("pointer", RESOURCE, 1).alias("k")
    ).where("k != ''")
    uuids = held.where(F.col("pointer").rlike(r"/back-matter/resources/[^/]+/uuid$")).select("doc_id", "k", F.col("value").alias("uuid"))
    links = held.where((F.col("name") == "href") & file_name(F.col("value")).isNotNull())
    names = links.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("ord", file_name(F.col("value")).alias("file")))).alias("l"))
    return uuids.join(names, ["doc_id", "k"], "left").select("doc_id", "uuid", F.coalesce(F.col("l.file"), F.array().cast("array<string>")).alias("names"))


def named_edges(scalars: DataFrame) -> DataFrame:
    """Edges with the file name they ask for; a bare fragment asks for the first usable link of that resource."""
    asked = edges(scalars).withColumn("own", file_name(F.col("href")))
    asked = asked.withColumn("fragment", F.when((path_of(F.col("href")) == "") & (fragment_of(F.col("href")) != ""), fragment_of(F.col("href"))))
    links = resource_links(scalars).select(F.col("doc_id").alias("d"), F.col("uuid").alias("u"), F.get("names", F.lit(0)).alias("linked"))
    links = links.groupBy("d", "u").agg(F.max("linked").alias("linked"))
    joined = asked.join(links, (F.col("doc_id") == F.col("d")) & (F.col("fragment") == F.col("u")), "left")
    return joined.select("doc_id", "pointer", "href", F.coalesce("own", "linked").alias("target_name"))


def answering(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """how (0 by full name, 1 by stem), answer, member: the supplied documents that answer to names which ``wanted`` (target_name) asks for."""
    both = lambda full, loose: F.inline(F.array(F.struct(F.lit(0).alias("how"), full.alias("answer")), F.struct(F.lit(1).alias("how"), loose.alias("answer"))))
    names = wanted.select("target_name").where("target_name IS NOT NULL").distinct()
    asked = broadcast_if_small(cut(names.select(both(F.col("target_name"), stem(F.col("target_name")))).distinct()))
    file = F.substring_index("doc_id", "/", -1)
    each = documents.select(F.col("doc_id").alias("member"), both(file, stem(file)))
    return cut(each.join(asked, ["how", "answer"], "left_semi").distinct())


def answered(asking: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of (primary, doc_id) with ``n_candidates``, how many ``members`` answer by full name, failing that by stem, and ``resolved_to``, the only one; a primary never answers itself.

    Each name is counted once, with its first and last member, so an edge meets one
    row however many documents share its name.
    """
    by_name = broadcast_if_small(cut(members.groupBy("how", "answer").agg(F.count("*").alias("n"), F.min("member").alias("first"), F.max("member").alias("last"))))
    themselves = broadcast_if_small(members)
    found = asking.select("primary", "doc_id", "pointer", "href", "target_name").distinct()
    for how, name in ((0, F.col("target_name")), (1, stem(F.col("target_name")))):
        found = found.withColumn("answer", name)
        held = by_name.where(F.col("how") == how).select("answer", F.col("n").alias(f"n_{how}"), "first", "last")
        itself = themselves.where(F.col("how") == how).select("answer", F.col("member").alias("primary"), F.lit(True).alias("itself"))
        found = found.join(held, "answer", "left").join(itself, ["answer", "primary"], "left")
        found = found.withColumns({
            f"n_{how}": F.coalesce(F.col(f"n_{how}"), F.lit(0)) - F.when(F.col("itself"), 1).otherwise(0),
            f"only_{how}": F.when(F.col("itself") & (F.col("first") == F.col("primary")), F.col("last")).otherwise(F.col("first")),
        }).drop("first", "last", "itself", "answer")
    full = F.col("n_0") > 0
    found = found.withColumns({"by_name": full, "n_candidates": F.when(full, F.col("n_0")).otherwise(F.col("n_1")), "only": F.when(full, F.col("only_0")).otherwise(F.col("only_1"))})
    only = F.when(F.col("n_candidates") == 1, F.col("only")).alias("resolved_to")
    return found.select("primary", "doc_id", "pointer", "href", "target_name", "n_candidates", "by_name", only)


def with_candidates(found: DataFrame, members: DataFrame) -> DataFrame:
    """``answered`` edges, cut, with the list of their ``candidates``; only edges with several look it up."""
    several = found.where("n_candidates > 1").withColumns({"how": F.when(F.col("by_name"), 0).otherwise(1), "answer": F.when(F.col("by_name"), F.col("target_name")).otherwise(stem(F.col("target_name")))})
    lone = F.when(F.col("resolved_to").isNull(), F.array().cast("array<string>")).otherwise(F.array("resolved_to"))
    if several.isEmpty():
        return found.withColumn("candidates", lone).drop("by_name")
    lists = members.groupBy("how", "answer").agg(F.array_sort(F.collect_list("member")).alias("members"))
    listed = several.join(lists, ["how", "answer"]).withColumn("candidates", F.filter("members", lambda m: m != F.col("primary"))).drop("members", "how", "answer")
    return listed.unionByName(found.where("n_candidates <= 1").withColumn("candidates", lone)).drop("by_name")


def matched(asking: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges of (primary, doc_id) with their candidates: by full name, failing that by stem; a primary never answers itself."""
    members = answering(asking, documents)
    return with_candidates(cut(answered(asking, members)), members)


def closure(primaries: DataFrame, scalars: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All edges met from each primary, and (primary, doc_id, hops) of what it reaches.

    The frontier is joined with the edges once a round and the pairs already met
    are taken out, so cycles end; the rounds are as many as the longest chain.
    """
    named = cut(named_edges(scalars))
    frontier = primaries.select(F.col("doc_id").alias("primary"), "doc_id").distinct()
    reached = cut(frontier.withColumn("hops", F.lit(0)))
    members = answering(named, documents)
    met, hops, frontier = None, 0, reached
    while True:
        step = cut(answered(frontier.select("primary", "doc_id").join(named, "doc_id"), members))
        met = step if met is None else met.unionByName(step)
        hops += 1
        new = step.where(F.col("resolved_to").isNotNull()).select("primary", F.col("resolved_to").alias("doc_id")).distinct()
        frontier = cut(new.join(reached.select("primary", "doc_id"), ["primary", "doc_id"], "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            return with_candidates(met, members), reached
        reached = reached.unionByName(frontier)


def status(found: DataFrame) -> DataFrame:
    """Edges with their code: resolved, ambiguous or not supplied."""
    code = (
        F.when(F.col("resolved_to").isNotNull(), "IMPORT_RESOLVED")
        .when(F.col("n_candidates") > 1, "IMPORT_AMBIGUOUS")
        .otherwise("IMPORT_NOT_SUPPLIED")
    )
    return found.withColumn("code", code)


def _listed(values: Column) -> Column:
    """Up to four of some texts in order, and how many more there are."""
    some = F.array_join(F.slice(values, 1, 4), ", ")
    return F.when(F.size(values) > 4, F.concat(some, F.lit(", and "), (F.size(values) - 4).cast("string"), F.lit(" more"))).otherwise(some)


def completeness(primaries: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, complete, why (what is open, in words) and remedy of every primary."""
    coded = status(found)
    parts = {}
    for name, code in (("absent", "IMPORT_NOT_SUPPLIED"), ("ambiguous", "IMPORT_AMBIGUOUS")):
        parts[f"n_{name}"] = F.count(F.when(F.col("code") == code, 1))
        parts[f"{name}"] = F.array_sort(F.collect_set(F.when(F.col("code") == code, F.col("href"))))
    open_edges = coded.groupBy("primary").agg(*[c.alias(n) for n, c in parts.items()])
    joined = primaries.select("doc_id").distinct().join(open_edges.withColumnRenamed("primary", "doc_id"), "doc_id", "left")
    absent = F.when(F.col("n_absent") > 0, F.concat(F.col("n_absent").cast("string"), F.lit(" imported document(s) were not supplied ("), _listed(F.col("absent")), F.lit(")")))
    ambiguous = F.when(
        F.col("n_ambiguous") > 0,
        F.concat(F.col("n_ambiguous").cast("string"), F.lit(" imported document(s) each matched more than one supplied file ("), _listed(F.col("ambiguous")), F.lit(")")),
    )
    why = F.concat_ws(", and ", absent, ambiguous)
    remedy = (
        F.when(absent.isNotNull() & ambiguous.isNotNull(), "Supply the missing document, and narrow what is supplied to the one file each import means.")
        .when(ambiguous.isNotNull(), "Narrow what is supplied to the one file this import means.")
        .when(absent.isNotNull(), "Supply the imported document.")
        .otherwise("")
    )
    return joined.select("doc_id", F.coalesce(F.col("n_absent") + F.col("n_ambiguous") == 0, F.lit(True)).alias("complete"), why.alias("why"), remedy.alias("remedy"))


def import_findings(found: DataFrame) -> DataFrame:
    """A finding for every edge met from a primary."""
    coded = status(found)
    message = (
        F.when(F.col("code") == "IMPORT_RESOLVED", F.concat(F.lit("This import matched the supplied document "), F.col("resolved_to"), F.lit(".")))
        .when(
            F.col("code") == "IMPORT_AMBIGUOUS",
            F.concat(F.size("candidates").cast("string"), F.lit(" supplied documents answer to this file name ("), F.array_join("candidates", ", "), F.lit("), so which is meant cannot be told.")),
        )
        .otherwise(F.lit("No supplied document answers to this file name, so identifiers it declares are unknown here."))
    )
    location = F.when(F.col("doc_id") == F.col("primary"), F.col("pointer")).otherwise(F.concat("doc_id", F.lit("#"), "pointer"))
    cited = F.struct(F.lit("the effective data model of a document holds the documents it imports").alias("citation"), F.lit("").alias("url"), F.lit("").alias("retrieved"))
    return coded.select(
        F.col("primary").alias("doc_id"), "code", F.lit("INFO").alias("severity"), location.alias("location"), F.lit("href").alias("prop"),
        F.col("href").alias("value"), message.alias("message"), cited.alias("rule"),
    )
