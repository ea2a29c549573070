"""JSON documents shredded into one row a node, level by level, inside Spark.

A text is parsed once into a VARIANT. Each level turns the containers of the level
above into rows of their members; rows that are already open pass on, so the whole
descent is one chain without a shuffle and without a worker outside the JVM. How many
levels there are is read off the brackets of the texts first; a document nested deeper
than ``DEEPEST`` is refused by that measure, before anything of it becomes a row. Long
chains are cut every ``TOGETHER`` levels.

Members of an object come in the order of their names, items of an array in their own.
``order`` sorts nodes of a document so that a container comes before what it holds;
``place`` sorts them as a search by name meets them, all items of an array before what
lies below the first. Pointers come escaped and raw, since both spellings are reported.
Numbers are shown as decimals without trailing zeros, whole ones of fraction type with
one; of a repeated key the last value holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.durable import cut_long

DEEPEST, TOGETHER = 200, 8
#: Levels that are counted without a walk over the brackets.
SHALLOW = 6
#: Digits from which a whole number is kept as a decimal.
LONG_DIGITS = 19
#: Bytecode of the largest method that the JVM compiles; levels joined into a larger one would be interpreted.
COMPILED = "8000"


def escaped(token: str) -> str:
    """A pointer token by RFC 6901."""
    return token.replace("~", "~0").replace("/", "~1")


def _escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def json_kind(v: Column) -> Column:
    """The JSON type of a VARIANT that is no container; true is never an integer."""
    return _kind_of(F.schema_of_variant(v))


def _kind_of(said: Column) -> Column:
    whole = (said == "BIGINT") | (F.regexp_extract(said, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int") >= LONG_DIGITS)
    return F.when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said == "VOID", "null").when(whole, "integer").otherwise("number")


def scalar_text(v: Column, kind: Column) -> Column:
    """A scalar as reports show it."""
    shown = F.try_variant_get(v, "$", "string")
    plain = F.when(shown.rlike(r"^-?\d+$"), F.concat(shown, F.lit(".0"))).otherwise(shown)
    return F.when(kind == "null", "None").when(kind == "boolean", F.initcap(shown)).when(kind == "number", plain).otherwise(shown)


def members(v: Column) -> Column:
    """The members of an object as a map; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """The items of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _nested(levels: int) -> str:
    """A pattern of texts whose brackets are paired and nested in at most so many levels; possessive, so nothing is tried twice."""
    plain = r'[^\[\]{}"]++|"(?:[^"\\]++|\\.)*+"'
    held = f"(?:{plain})*+"
    for _ in range(levels):
        held = rf"(?:{plain}|[\[{{]{held}[\]}}])*+"
    return rf"(?s)^{held}\z"


def read(documents: DataFrame) -> DataFrame:
    """doc_id, v (null where the document is refused), levels below the root, and error."""
    settings = documents.sparkSession.conf
    settings.set("spark.sql.variant.allowDuplicateKeys", "true")
    settings.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*+"', "")
    # Runs of brackets: how deep it is after each is the number that stands before it and its own length up or down.
    runs = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[{]++|[\]}]++"), F.lit(0)), lambda r: F.when(F.left(r, F.lit(1)).isin("[", "{"), F.char_length(r)).otherwise(-F.char_length(r)))
    step = lambda a, n: F.struct((a["now"] + n).alias("now"), F.greatest(a["most"], a["now"] + n).alias("most"))
    most = F.aggregate(runs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])
    # Few levels are told by one match each, which stops at the first bracket that is too deep.
    fits = lambda k: F.regexp_like("text", F.lit(_nested(k)))
    pairs = [F.when(fits(k), F.when(fits(k - 1), k - 1).otherwise(k)) for k in range(2, SHALLOW + 1, 2)]
    most = F.when(text == "", 0).otherwise(F.coalesce(F.when(fits(0), 0), *pairs, most))
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", most.alias("levels"))
    deep = F.col("levels") > DEEPEST
    rows = rows.select("doc_id", "levels", F.when(~deep, F.try_parse_json("text")).alias("v"))
    error = F.when(deep, f"nested deeper than {DEEPEST} levels").when(F.col("v").isNull(), "not valid JSON")
    return rows.select("doc_id", "v", F.when(F.col("v").isNull(), 0).otherwise(F.col("levels")).alias("levels"), error.alias("error"))



#: A type that an object becomes without its members and that no scalar becomes; one that scalars can become would convert each.
SHELL = "struct<_:boolean>"


def is_object(v: Column) -> Column:
    """Whether a value is an object, told without making its members."""
    return F.try_variant_get(v, "$", SHELL).isNotNull()


def is_array(v: Column) -> Column:
    """Whether a value is an array, told without making its items."""
    return F.try_variant_get(v, "$", f"array<{SHELL}>").isNotNull()


def shells(v: Column) -> Column:
    """The members of an object as a map that tells which are objects; null for anything else."""
    return F.try_variant_get(v, "$", f"map<string,{SHELL}>")


def names_of(v: Column) -> Column:
    """The names of an object's members; null for anything else."""
    return F.map_keys(shells(v))


def is_read(shells_of: Column, v: Column, names: list[str], deeper: bool = True) -> Column:
    """Whether an object has members of these names, or any (``deeper``) that hold more; given its ``shells``."""
    asked = F.arrays_overlap(F.map_keys(shells_of), F.array(*map(F.lit, names))) if names else F.lit(False)
    some = lambda x: F.array_size(F.array_compact(F.map_values(x))) > 0
    return (asked | some(shells_of) | some(F.try_variant_get(v, "$", f"map<string,array<{SHELL}>>"))) if deeper else asked


def no_texts() -> Column:
    return F.array().cast("array<string>")


def _opened(v: Column) -> tuple[Column, Column, Column]:
    """Members, items and kind of a value."""
    m, a = members(v), items(v)
    return m, a, F.when(m.isNotNull(), "object").when(a.isNotNull(), "array").otherwise(json_kind(v))


def roots(read_rows: DataFrame) -> DataFrame:
    """The root node of every document that could be read."""
    none = no_texts()
    m, a, kind = _opened(F.col("v"))
    return read_rows.where("v IS NOT NULL").select(
        "doc_id", "v", m.alias("m"), a.alias("a"), kind.alias("jtype"), F.lit(True).alias("fresh"), F.lit(0).alias("depth"), F.lit("").alias("pointer"), F.lit("").alias("raw"), F.lit(None).cast("string").alias("above"),
        F.lit("").alias("name"), F.lit(None).cast("int").alias("item"), none.alias("order"), none.alias("place"), none.alias("deep"), F.coalesce(F.size(m), F.size(a), F.lit(0)).alias("size"),
        (m.isNull() & a.isNull()).alias("leaf"),
    )


def descend(
    rows: DataFrame, levels: int, enter: Callable[[DataFrame], DataFrame] | None = None, whole: Callable[[Column], Column] | None = None,
    of_use: Callable[[Column, Column], Column] | None = None, read_of: list[str] | None = None, stays: Column | None = None,
    useful: Callable[[Column, Column, int], Column] | None = None,
) -> DataFrame:
    """All nodes at and below the given fresh ones; ``enter`` gives each level's new rows (``fresh``) what they take from the node above.

    ``enter`` finds the columns of the node above as they were; what it gives rows that are not fresh is not used.
    Of the columns of ``roots`` only those that the rows have are made. ``v`` is kept of scalars, and of containers
    whose name ``whole`` accepts. Members and items that ``of_use`` refuses by name and value become no rows; ``useful`` is told as well how many
    levels of containers a value has at most, itself included. If names are
    given as ``read_of``, nobody reads the values and kinds of other scalars, nor ``m``: objects that hold scalars only and
    none of these names are then not opened, and their members come by name alone, or not at all if there is ``of_use``. Nodes for which ``stays`` does not hold are
    left out once what lies below them is there. All columns of a node that is done travel as one struct, so a level
    copies them at once. Rows that are done leave the chain wherever it is cut.
    """
    entry = "array<struct<name:string,item:int,v:variant>>"
    done: list[DataFrame] = []
    if of_use and not useful:
        useful = lambda name, v, _: of_use(name, v)
    by_name = read_of is not None and not useful
    if by_name:
        rows = rows.withColumn("keys", no_texts())
    # ``label`` is the name of a fresh node, for the items below it.
    rows = rows.withColumn("label", F.col("name"))
    opening = ["m", "a", "label", *(["keys"] if by_name else [])]
    names = [c for c in rows.columns if c not in ("fresh", *opening)]
    kept_back = F.lit(True) if stays is None else F.coalesce(stays, F.lit(False))
    rows = rows.select("fresh", F.struct(*names).alias("node"), kept_back.alias("stay"), *opening)
    for level in range(levels):
        if level and level % TOGETHER == 0:
            rows = cut_long(rows)
            done.append(rows.where("NOT fresh").select("node.*"))
            rows = rows.where("fresh")
        named = F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("name"), F.lit(None).cast("int").alias("item"), e["value"].alias("v")))
        numbered = F.transform("a", lambda x, i: F.struct(F.lit(None).cast("string").alias("name"), i.alias("item"), x.alias("v")))
        if useful:
            left = levels - level - 1
            named, numbered = F.filter(named, lambda e: useful(e["name"], e["v"], left)), F.filter(numbered, lambda e: useful(F.col("label"), e["v"], left))
        if by_name:
            named = F.coalesce(named, F.when(F.size("keys") > 0, F.transform("keys", lambda k: F.struct(k.alias("name"), F.lit(None).cast("int").alias("item"), F.lit(None).cast("variant").alias("v")))))
        below = F.coalesce(named, numbered)
        itself = F.array(F.lit(None).cast("struct<name:string,item:int,v:variant>"))
        both = F.flatten(F.array(itself, F.coalesce(below, F.array().cast(entry))))
        below = both if stays is None else F.when(F.col("stay"), both).otherwise(below)
        # Nothing below is one row without a member, the node itself; as an outer one it is not looked through for a filter, which would make the array twice.
        rows = rows.select("node", "stay", F.explode_outer(F.when(F.col("fresh"), below)).alias("c"))
        if stays is not None:
            rows = rows.where("c IS NOT NULL OR stay")
        new, own = F.col("c").isNotNull(), F.col("c.item").isNotNull()
        rows = rows.select("node", "stay", "c", *[F.col("node").getField(n).alias(n) for n in names])
        token = F.when(own, F.col("c.item").cast("string")).otherwise(F.col("c.name"))
        sorted_ = F.when(own, F.lpad(F.col("c.item").cast("string"), 10, "0")).otherwise(F.lit(""))
        name = F.when(own, F.col("name")).otherwise(F.col("c.name"))
        # Items of an array stand beside each other under its name, so the array itself adds nothing to places.
        spot = lambda last: F.concat("deep", F.array(name, F.lit(last), sorted_))
        # Columns of their own, so that a value is opened once however many columns ask for it.
        value = F.col("c.v")
        if level + 1 == levels:
            # No document is nested deeper, so what is here is no container.
            never = lambda kind: F.lit(None).cast(kind)
            rows = rows.withColumns({"c_m": never("map<string,variant>"), "c_a": never("array<variant>"), "c_o": never(f"map<string,{SHELL}>")})
            held = F.lit(False)
        elif read_of is None:
            rows = rows.withColumns({"c_m": members(value), "c_a": items(value)})
            held = F.col("c_m").isNotNull()
        else:
            # A scalar is no object, and its members are asked for no further.
            rows = rows.withColumns({"c_o": shells(value), "c_a": items(value)})
            held = F.col("c_o").isNotNull()
            # A container of the deepest level holds scalars only.
            opened = is_read(F.col("c_o"), value, read_of, level + 2 < levels)
            rows = rows.withColumn("c_m", F.when(held & opened, members(value)))
        m, a = F.col("c_m"), F.col("c_a")
        bare = ~held & a.isNull()
        rows = rows.withColumn("c_said", F.when(bare, F.schema_of_variant(F.col("c.v"))))
        kind = F.when(held, "object").when(a.isNotNull(), "array").otherwise(_kind_of(F.col("c_said")))
        array = ~own & a.isNotNull()
        kept = bare | whole(name) if whole else bare
        made = {
            "depth": lambda: F.col("depth") + 1, "above": lambda: F.col("raw"), "pointer": lambda: F.concat("pointer", F.lit("/"), _escaped(token)), "raw": lambda: F.concat("raw", F.lit("/"), token),
            "name": lambda: name, "item": lambda: F.col("c.item"), "order": lambda: F.concat("order", F.array(F.when(own, sorted_).otherwise(token))), "place": lambda: spot("0"),
            "v": lambda: F.when(kept, F.col("c.v")), "jtype": lambda: kind, "leaf": lambda: bare, "size": lambda: F.coalesce(F.size(m), F.size(a), F.lit(0)),
        }
        made |= {"deep": lambda: F.when(array, F.col("deep")).otherwise(spot("1"))}
        opens = {"m": F.when(new, m), "a": F.when(new, a), "label": F.when(new, name), "keys": F.when(new & m.isNull(), F.map_keys("c_o")) if by_name else None}
        rows = rows.select(
            new.alias("fresh"), "node", "stay", *[opens[c].alias(c) for c in opening], *[F.when(new, made[c]()).alias(c) if c in made else F.col(c) for c in names]
        )
        rows = enter(rows) if enter else rows
        fresh = F.col("fresh")
        rows = rows.select("fresh", F.when(fresh, F.struct(*names)).otherwise(F.col("node")).alias("node"), F.when(fresh, kept_back).otherwise(True).alias("stay"), *opening)
    rows = (rows if stays is None else rows.where("stay")).select("node.*")
    for part in done:
        rows = rows.unionByName(part)
    return rows


def levels_of(read_rows: DataFrame) -> int:
    """Levels of the deepest document that is read."""
    return read_rows.agg(F.max("levels")).first()[0] or 0


#: The columns of nodes that ``shred`` gives, and those of the descent that each is made from.
MADE_FROM = {
    "doc_id": (), "depth": ("depth",), "pointer": ("pointer",), "raw_pointer": ("raw",), "parent": ("raw", "above"), "name": ("name",), "is_item": ("item",), "item_index": ("item",), "jtype": ("jtype",), "leaf": ("leaf",),
    "sval": ("v", "jtype"), "n_children": ("size",), "order": ("order",), "place": ("name", "place", "deep"), "error": (),
}


def shred(documents: DataFrame, *wanted: str) -> DataFrame:
    """Nodes of every document (doc_id, text); an unreadable one gives a single row with its error and no node.

    Columns: doc_id, depth, pointer, raw_pointer, parent (raw pointer of the node above), name,
    is_item, item_index, jtype, leaf (no container), sval, n_children, order, place, error; or only those ``wanted``,
    which saves carrying the others down. Texts are parsed once.
    """
    columns = wanted or tuple(MADE_FROM)
    rows = cut_long(read(documents))
    used = {"doc_id", "fresh", "m", "a", "name", *(x for c in columns for x in MADE_FROM[c])}
    top = roots(rows)
    found = descend(top.select(*[c for c in top.columns if c in used]), levels_of(rows), read_of=None if used & {"v", "jtype", "size"} else [])
    made = {
        "raw_pointer": F.col("raw") if "raw" in used else None, "parent": F.col("above") if "above" in used else None, "is_item": F.col("item").isNotNull() if "item" in used else None,
        "item_index": F.col("item") if "item" in used else None, "sval": F.when(~F.col("jtype").isin("object", "array"), scalar_text(F.col("v"), F.col("jtype"))) if "v" in used else None,
        "n_children": F.col("size") if "size" in used else None, "error": F.lit(None).cast("string"),
    }
    nodes = found.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])
    kinds = dict(nodes.dtypes)
    bad = rows.where("error IS NOT NULL")
    return nodes.unionByName(bad.select(*[F.col(c) if c in ("doc_id", "error") else F.lit(None).cast(kinds[c]).alias(c) for c in nodes.columns]))
