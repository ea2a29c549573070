"""Documents and findings made from relational tables, and the rule packs that judge them.

The tables are turned into JSON with ``to_json``, one document a group, and run
through the engine itself; nothing here answers a question by its own SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.findings import as_findings, rule
from assayer.rules.pack import RulePack, pack_of

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(name: str) -> dict:
    return {"$ref": f"#/definitions/{name}"}


def obj(title: str, required: tuple[str, ...] = (), closed: bool = True, **properties: dict) -> dict:
    """An object shape; underscores in property names stand for dashes."""
    node: dict = {"title": title, "type": "object", "properties": {k.replace("_", "-"): v for k, v in properties.items()}}
    return node | ({"required": list(required)} if required else {}) | ({"additionalProperties": False} if closed else {})


def arr(items: dict, least: int | None = None) -> dict:
    return {"type": "array", "items": items} | ({} if least is None else {"minItems": least})


SCALARS = {
    "StringDatatype": {"type": "string", "description": "any text"},
    "IntegerDatatype": {"type": "integer"},
    "DecimalDatatype": {"type": "number"},
    "BalanceDatatype": {"type": "number", "minimum": 0},
    "BrandDatatype": {"type": "string", "pattern": "^Brand#[0-9]$"},
    "KindDatatype": {"type": "string", "pattern": "^[A-S][A-Z]*$"},
    "LetterDatatype": {"type": "string", "pattern": "^\\p{L}+$"},
    "UUIDDatatype": {"type": "string", "pattern": "^[0-9a-f]{32}$"},
    "URIDatatype": {"type": "string", "pattern": "^https://"},
}
TEXT, WHOLE = ref("StringDatatype"), ref("IntegerDatatype")


def pack(roots: dict[str, dict], constraints: list[dict] | None = None, **more) -> RulePack:
    """A pack with the common scalar types and one root for each document kind."""
    schema = {"definitions": dict(SCALARS), "oneOf": [{"properties": {name: node}} for name, node in roots.items()]}
    return pack_of(schema, constraints or [], release=more.pop("release", "1"), **more)


NAMES = {n: [n, f"{n}s"] for n in ("line", "order", "nation", "customer", "part", "import")}


def line_shape(**more: dict) -> dict:
    return obj("Line", linenumber=WHOLE, part=WHOLE, supplier=WHOLE, flag=TEXT, status=TEXT, mark=TEXT, state=TEXT, **more)


def order_pack(constraints: list[dict] | None = None, required: tuple[str, ...] = (), least: int | None = None) -> RulePack:
    node = obj("Order", required, number=WHOLE, status=TEXT, priority=TEXT, customer=WHOLE, lines=arr(line_shape(), least))
    return pack({"order": node}, constraints, names=NAMES)


def lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and its lines in a fixed order; mark and state are absent for the flags N and O."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    held = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER))).alias("lines"))
    shown = F.transform("lines", lambda x: F.struct(
        x["l_linenumber"].alias("linenumber"), x["l_partkey"].alias("part"), x["l_suppkey"].alias("supplier"), x["l_returnflag"].alias("flag"),
        x["l_linestatus"].alias("status"), F.when(x["l_returnflag"] != "N", x["l_returnflag"]).alias("mark"), F.when(x["l_linestatus"] != "O", x["l_linestatus"]).alias("state"),
    ))
    return held.select("l_orderkey", shown.alias("lines"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines_of_orders(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order; orders without lines have no member ``lines``."""
    body = F.struct(F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"), "lines")
    return order_rows(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("doc_id"), F.to_json(F.struct(body.alias("order"))).alias("text"))


def one_or_many_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose only line is written without an array around it."""
    rows = order_rows(spark, sf_dir).where("lines IS NOT NULL")
    lines = F.when(F.size("lines") == 1, F.to_json(F.get("lines", F.lit(0)))).otherwise(F.to_json("lines"))
    return rows.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit('{"order":{"lines":'), lines, F.lit("}}")).alias("text"))


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer with its orders and their lines."""
    rows = order_rows(spark, sf_dir).groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("status"), "lines"))).alias("orders")
    )
    body = F.struct(F.col("o_custkey").alias("number"), "orders")
    return rows.select(F.col("o_custkey").cast("string").alias("doc_id"), F.to_json(F.struct(body.alias("customer"))).alias("text"))


def customer_pack(constraints: list[dict]) -> RulePack:
    order = obj("Order", number=WHOLE, status=TEXT, lines=arr(line_shape()))
    return pack({"customer": obj("Customer", number=WHOLE, orders=arr(order))}, constraints, names=NAMES)


#: Rows with neighbouring numbers that share a document, so no document grows with its table.
TOGETHER = {"customer": 500, "part": 200, "text": 100, "catalog": 1000}


def batch(column: str, of: str) -> Column:
    """The number of the document that a row goes to."""
    return F.expr(f"{column} DIV {TOGETHER[of]}")


def region_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each region: nations and their customers, those with neighbouring numbers together."""
    people = table(spark, sf_dir, "customer").groupBy("c_nationkey", batch("c_custkey", "customer").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))).alias("customers")
    )
    nations = table(spark, sf_dir, "nation").join(people, F.col("n_nationkey") == F.col("c_nationkey"))
    held = nations.groupBy("n_regionkey", "b").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("number"), F.col("n_name").alias("name"), "customers"))).alias("nations"))
    rows = table(spark, sf_dir, "region").join(held, F.col("r_regionkey") == F.col("n_regionkey"))
    body = F.struct(F.col("r_name").alias("name"), "nations")
    return rows.select(F.concat_ws("-", "r_name", F.col("b").cast("string")).alias("doc_id"), F.to_json(F.struct(body.alias("region"))).alias("text"))


def region_pack(constraints: list[dict]) -> RulePack:
    customer = obj("Customer", number=WHOLE, name=TEXT, segment=TEXT)
    nation = obj("Nation", number=WHOLE, name=TEXT, customers=arr(customer))
    return pack({"region": obj("Region", name=TEXT, nations=arr(nation))}, constraints, names=NAMES)


def brand_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each brand with its parts, those with neighbouring numbers together; parts of even size carry no namespace."""
    part = F.struct(
        F.col("p_partkey").alias("number"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.when(F.col("p_size") % 2 == 1, F.lit("http://other.example")).alias("ns")
    )
    rows = table(spark, sf_dir, "part").groupBy("p_brand", batch("p_partkey", "part").alias("b")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    body = F.struct(F.col("p_brand").alias("name"), "parts")
    return rows.select(F.concat_ws("-", "p_brand", F.col("b").cast("string")).alias("doc_id"), F.to_json(F.struct(body.alias("brand"))).alias("text"))


def brand_pack(constraints: list[dict] | None = None, kind: dict | None = None, name: dict | None = None) -> RulePack:
    part = obj("Part", number=WHOLE, name=TEXT, type=kind or TEXT, ns=TEXT)
    return pack({"brand": obj("Brand", name=name or TEXT, parts=arr(part))}, constraints, names=NAMES)


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each event: purchases carry a coupon, and k is text for odd numbers of event."""
    k = F.get_json_object("props", "$.k")
    written = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    extra = F.when(F.col("event_type") == "purchase", F.lit(',"coupon":"none"')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"event":{"type":"'), "event_type", F.lit('","user":'), F.col("user_id").cast("string"), F.lit(',"k":'), written, extra, F.lit("}}"))
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc_id"), body.alias("text"))


def event_pack(constraints: list[dict] | None = None) -> RulePack:
    return pack({"event": obj("Event", type=TEXT, user=WHOLE, k=WHOLE)}, constraints)


def kind_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose document root is their type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("doc_id"), F.concat(F.lit('{"'), "event_type", F.lit('":{"user":'), F.col("user_id").cast("string"), F.lit("}}")).alias("text")
    )


def party_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons, organisations, both or neither, by their segment."""
    person = F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD", "MACHINERY"), F.col("c_name")).alias("first-name")
    firm = F.when(F.col("c_mktsegment").isin("FURNITURE", "MACHINERY"), F.col("c_name")).alias("firm-name")
    body = F.struct(F.struct(F.col("c_custkey").alias("number"), person, firm).alias("who"), F.col("c_acctbal").alias("balance"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.to_json(F.struct(body.alias("party"))).alias("text"))


def party_pack() -> RulePack:
    person = obj("Person", ("first-name",), number=WHOLE, first_name=TEXT)
    firm = obj("Organisation", ("firm-name",), number=WHOLE, firm_name=TEXT)
    return pack({"party": obj("Party", who={"title": "Who", "anyOf": [person, firm]}, balance=ref("BalanceDatatype"))})


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.struct(F.struct(F.col("url").alias("url"), F.array(F.struct(F.regexp_replace("url", "^[^/]*//[^/]*/", "#").alias("href"))).alias("links")).alias("page"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.to_json(body).alias("text"))


def page_pack(constraints: list[dict] | None = None) -> RulePack:
    link = obj("Link", href=TEXT)
    return pack({"page": obj("Page", url=TEXT, links=arr(link))}, constraints)


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source documents that list the digests of its texts as identifiers, texts with neighbouring numbers together."""
    rows = table(spark, sf_dir, "documents").groupBy("source", batch("doc_id", "text").alias("b")).agg(F.sort_array(F.collect_list(F.struct("doc_id", F.md5(F.col("text").cast("binary")).alias("uuid")))).alias("t"))
    body = F.struct(F.struct(F.transform("t", lambda x: F.struct(x["uuid"].alias("uuid"))).alias("texts")).alias("shelf"))
    return rows.select(F.concat("source", F.lit("-"), F.col("b").cast("string"), F.lit(".json")).alias("doc_id"), F.to_json(body).alias("text"))


def text_pack() -> RulePack:
    return pack({"shelf": obj("Shelf", texts=arr(obj("Text", uuid=ref("UUIDDatatype"))))})


def label_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that declare English texts with neighbouring numbers as controls, and one for each hundred labels that refers to texts."""
    texts = table(spark, sf_dir, "documents").withColumn("b", batch("doc_id", "catalog"))
    control = F.when(F.col("lang") == "en", F.struct(F.concat(F.lit("t-"), F.col("doc_id").cast("string")).alias("id")))
    held = texts.groupBy("b").agg(F.sort_array(F.collect_list(control)).alias("controls"))
    name = F.concat(F.lit("lib/catalog-"), F.col("b").cast("string"), F.lit(".json"))
    catalog = held.select(name.alias("doc_id"), F.to_json(F.struct(F.struct("controls").alias("catalog"))).alias("text"))
    wanted = F.struct(F.concat(F.lit("t-"), F.col("doc_id").cast("string")).alias("control-id"))
    groups = table(spark, sf_dir, "labels").groupBy(F.expr("doc_id DIV 100").alias("g")).agg(F.sort_array(F.collect_list(wanted)).alias("uses"))
    imports = F.array(F.struct(F.when(F.col("g") % 3 == 2, F.lit("missing.json")).otherwise(F.concat(F.lit("../lib/catalog-"), F.expr("g DIV 10").cast("string"), F.lit(".xml#x"))).alias("href")))
    body = F.struct(F.struct(imports.alias("imports"), "uses").alias("profile"))
    profiles = groups.select(F.concat(F.lit("use/profile-"), F.col("g").cast("string"), F.lit(".json")).alias("doc_id"), F.to_json(body).alias("text"))
    return catalog.unionByName(profiles)


def label_pack() -> RulePack:
    control = obj("Control", id={"title": "Control Identifier", **TEXT})
    use = obj("Use", control_id={"title": "Control Identifier Reference", **TEXT})
    return pack({
        "catalog": obj("Catalog", controls=arr(control)), "profile": obj("Profile", imports=arr(obj("Import", href=TEXT)), uses=arr(use)),
    })


def trade_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each nation that list customers with neighbouring numbers, and one for each order that imports the document of its customer."""
    people = table(spark, sf_dir, "customer").withColumn("b", batch("c_custkey", "customer"))
    listed = people.groupBy("c_nationkey", "b").agg(F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("number"), F.col("c_mktsegment").alias("segment")))).alias("customers"))
    href = F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit(".json"))
    nations = listed.select(href.alias("doc_id"), F.to_json(F.struct(F.struct("customers").alias("nation"))).alias("text"))
    # Dealt anew, since the few columns read of a large file are few splits and what is made of each row is much more work than reading it.
    dealt = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey")
    orders = dealt.join(people, F.col("o_custkey") == F.col("c_custkey"))
    body = F.struct(F.struct(F.array(F.struct(href.alias("href"))).alias("imports"), F.col("o_custkey").alias("customer")).alias("order"))
    return nations.unionByName(orders.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("doc_id"), F.to_json(body).alias("text")))


def trade_pack() -> RulePack:
    customer = obj("Customer", number=WHOLE, segment=TEXT)
    return pack(
        {"nation": obj("Nation", customers=arr(customer)), "order": obj("Order", imports=arr(obj("Import", href=TEXT)), customer=WHOLE)},
        [
            {"kind": "index", "context": "nation", "target": "customer[@segment='BUILDING']", "keys": ["@number"], "index": "builders", "identifier": "builders"},
            {"kind": "index-has-key", "context": "order", "target": ".", "keys": ["@customer"], "index": "builders", "identifier": "known-builder", "level": "WARNING"},
            {"kind": "index-has-key", "context": "nation", "target": "customer", "keys": ["@number"], "index": "nowhere", "identifier": "stranded"},
        ],
        names=NAMES,
    )


SEVERITY_OF = {"error": "ERROR", "purchase": "WARNING", "view": "INFO"}
CODE_OF = {"error": "TYPE_MISMATCH", "purchase": "DATATYPE_MISMATCH", "view": "IMPORT_RESOLVED", "click": "REFERENCE_UNVERIFIABLE", "signup": "UNHEARD_OF"}


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each event: what happened is its code, the user is its document."""
    lookup = lambda pairs: F.create_map(*[F.lit(x) for p in pairs.items() for x in p])[F.col("event_type")]
    return as_findings(table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("doc_id"), lookup(CODE_OF).alias("code"), F.coalesce(lookup(SEVERITY_OF), F.lit("UNVERIFIABLE")).alias("severity"),
        F.concat(F.lit("/log/"), F.col("event_id").cast("string")).alias("location"), F.lit("k").alias("prop"), F.get_json_object("props", "$.k").alias("value"),
        F.lit("It happened.").alias("message"), rule(F.col("event_type"), "http://rules.example/").alias("rule"),
    ))


def line_findings(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Two runs over the lines, one without the last three years of shipping and one without the first three.

    Distinct lines become findings; a line shipped on an even day carries its
    discount as a value in the first run and its tax in the second, and returned
    lines stand elsewhere in the second run.
    """
    rows = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    rows = rows.where(year >= 1995) if late else rows.where(year <= 1999)
    line = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    even = F.dayofmonth("l_shipdate") % 2 == 0
    value = F.when(even, F.lit("tax" if late else "discount")).otherwise("same")
    location = F.when(F.lit(late) & (F.col("l_returnflag") == "R"), F.concat(F.lit("/moved/"), line)).otherwise(F.concat(F.lit("/line/"), line))
    return as_findings(rows.select(
        F.lit("").alias("doc_id"), F.lit("CONSTRAINT_NOT_UNIQUE").alias("code"), F.lit("ERROR").alias("severity"), location.alias("location"), line.alias("prop"),
        value.alias("value"), F.lit("m").alias("message"), rule(F.col("l_returnflag")).alias("rule"),
    ).distinct())
