"""Information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) are found by fixed patterns. Their texts are
the protected entities. The words of every document that mentions an entity are its
terms, and the whole corpus says how strongly a term reveals it: with N documents,
n(e) that mention the entity, n(t) that hold the term and n(t,e) that do both, the
pointwise mutual information log(n(t,e) N / (n(t) n(e))) is set against the
information of the entity itself, log(N / n(e)). A term that gives away at least
``DISCLOSED`` of it, seen in at least ``SUPPORT`` contexts, is a span of the kind
``term`` wherever it stands, in any document. Contexts are documents that differ in
their set of words, or, where that gives more, mentions with the term close by that
differ in the set of words around them: both sets hold the term, so it makes no
difference. Sanitising replaces base
spans by the name of their kind (generalised) and removes terms; base spans that
overlap are replaced as one, by the name of the longest.

Everything is DataFrame functions. Places are code points, end exclusive. Defined
results: null and empty texts have no span; in an empty corpus nothing is
disclosed; an entity that every document mentions carries no information and is
disclosed by no term; terms never overlap base spans; rows that repeat an id with its
text are one document wherever documents are counted, so repeating a corpus changes no
span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import broadcast_if_small, cut, is_small, numbered, pick, position_of

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, with guards that keep long runs linear and matches the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Texts that fail these hold no valid match.
MAY_HOLD = {"ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
TERM = r"\p{L}[\p{L}\p{M}'’-]*+"
#: Characters read on either side of a mention, and the disclosure thresholds.
REACH, SUPPORT, DISCLOSED = 60, 3, 0.95
#: A combining mark that tells words overlapping a base span from free ones, and the mark that stands for it where a text holds it.
MARK, NEIGHBOUR = "\u1dff", "\u1dfe"
SHOWN = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": ""}


#: Steps of a walk over an array whose results are gathered together; an array that grew by one a step would be copied each time.
STRIDE = 256


def _walk(items: Column, state: str, first, step) -> Column:
    """The states of a walk over ``items``, one for each stretch of ``STRIDE``; ``out`` of a state holds what its stretch added.

    ``first`` makes the state that a stretch begins with from the one before (null at the start).
    """

    def walk(held: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor(F.size(held) / STRIDE).cast("int")), lambda i: F.slice(held, i * STRIDE + 1, F.lit(STRIDE)))
        none = F.array().cast(f"array<{state}>")
        return F.aggregate(stretches, none, lambda a, s: F.concat(a, F.array(F.aggregate(s, first(F.get(a, F.size(a) - 1)).cast(state), step))))

    return F.get(F.transform(F.array(items), walk), F.lit(0))


PLACE = "struct<start:int,end:int,value:string>"


def places(text: Column, pattern: str, length=F.char_length) -> Column:
    """start, end and value of the leftmost matches that do not overlap: pieces between matches give the places, counted by ``length``."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(found.alias("value"), between.alias("gap")), lambda p: p["value"].isNotNull())
    empty = F.array().cast(f"array<{PLACE}>")

    def step(a: Column, p: Column) -> Column:
        start, end = a["at"] + length(p["gap"]), a["at"] + length(p["gap"]) + length(p["value"])
        one = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    start = lambda a: F.struct(F.coalesce(a["at"], F.lit(0)).alias("at"), empty.alias("out"))
    walked = _walk(pairs, f"struct<at:int,out:array<{PLACE}>>", start, step)
    return F.flatten(F.transform(walked, lambda a: a["out"]))


#: Code points of the blocks in which a text is cut where many parts of it are read; a part is found without counting from the start.
BLOCK = 1024


def _parts(text: Column, read) -> Column:
    """``read(part)`` where ``part(start, end)`` is that part of the text, by code points; linear in the text and the parts."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))

    def of(held: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            first = F.floor(start / BLOCK).cast("int")
            few = F.slice(held, first + 1, F.floor(F.greatest(start, end - 1) / BLOCK).cast("int") - first + 1)
            return F.substring(F.array_join(few, ""), start - first * BLOCK + 1, end - start)

        return read(part)

    return F.get(F.transform(F.array(blocks), of), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    """Whether every dotted part is at most 255, however many zeros lead it."""
    bare = lambda part: F.regexp_replace(part, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(F.right(bare(p), F.lit(3)), 3, "0").cast("int") <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind the array of its valid matches."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    valid = {
        "card": lambda m: F.length(_digits(m["value"])).between(16, 19) & F.call_function("luhn_check", _digits(m["value"])),
        "ip": lambda m: _small_parts(m["value"]),
        "phone": lambda m: F.length(_digits(m["value"])).between(8, 15),
    }
    may = {"email": text.contains("@")} | {k: text.rlike(p) for k, p in MAY_HOLD.items()}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    found = {}
    for kind, pattern in patterns.items():
        matches = places(text, pattern)
        found[kind] = F.when(may[kind], F.filter(matches, valid[kind]) if kind in valid else matches).otherwise(none)
    return found


def _windows(text: Column, spans: str) -> Column:
    """For each span its value, its place and the texts within reach before and after it; the column size is the text's length."""

    def windows(part) -> Column:
        def window(span: Column) -> Column:
            low = F.greatest(F.lit(0), span["start"] - REACH)
            return F.struct(
                span["value"].alias("entity"), span["start"].alias("start"), span["end"].alias("end"), low.alias("low"),
                part(low, span["start"]).alias("before"), part(span["end"], span["end"] + REACH).alias("after"),
                (span["end"] + REACH >= F.col("size")).alias("last"),
            )

        return F.transform(spans, window)

    kind = "struct<entity:string,start:int,end:int,low:int,before:string,after:string,last:boolean>"
    return F.when(F.size(spans) > 0, _parts(text, windows)).otherwise(F.array().cast(f"array<{kind}>"))


def _near_terms(window: str) -> Column:
    """Lowered words of a window that are whole there and long enough, with their places in the text."""
    w = lambda name: F.col(f"{window}.{name}")

    def terms(side: Column, offset: Column, whole) -> Column:
        kept = F.filter(places(side, TERM), whole)
        return F.transform(
            kept, lambda m: F.struct((m["start"] + offset).alias("start"), (m["end"] + offset).alias("end"), F.lower(m["value"]).alias("term"))
        )

    before = terms(w("before"), w("low"), lambda m: (m["start"] > 0) | (w("low") == 0))
    after = terms(w("after"), w("end"), lambda m: (m["end"] < F.char_length(w("after"))) | w("last"))
    return F.concat(before, after)


def _based(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), text, the base spans by kind and all of them in the array ``base``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mark"), text.alias("text"))
    found = base_spans(F.col("text"))
    rows = rows.select("doc_id", "mark", "text", *[c.alias(k) for k, c in found.items()])
    return rows.withColumn("base", F.concat(*found))


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark, the places of the base spans by kind, and ``windows``: each span with the texts around it. Written once; texts stay behind."""
    bare = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(kind)
    rows = _based(docs).withColumn("size", F.char_length("text"))
    return cut(rows.select("doc_id", "mark", *[bare(k) for k in KINDS[:-1]], _windows(F.col("text"), "base").alias("windows")))


def _base_places(based: DataFrame) -> DataFrame:
    """d, m and the places of all base spans of the documents that have any, each document once."""
    rows = based.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.concat(*KINDS[:-1]).alias("base"))
    return rows.where(F.size("base") > 0).dropDuplicates(["d", "m"])


def _some_texts(docs: DataFrame, only: DataFrame, *more: str) -> DataFrame:
    """doc_id, mark and text of the documents (d, m) with their ``base`` and the columns ``more`` of ``only``; repeated rows stay repeated."""
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("m"))
    rows = pick(docs, "doc_id", "text").join(only, same)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select("doc_id", F.col("m").alias("mark"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("base", none).alias("base"), *more)


def _mentions(based: DataFrame) -> DataFrame:
    """doc_id, mark and w (a base span with the texts around it) of every mention: short rows, however long the text."""
    return cut(based.select("doc_id", "mark", F.explode("windows").alias("w")).distinct())


#: Width of the buckets in which terms meet the spans that they might overlap; no term reaches over more than one border.
BUCKET = 64


def _contexts(mentions: DataFrame) -> DataFrame:
    """doc_id, mark, entity, at, sign (hash of the set of words) and near (terms with places) of mentions with a free term close by; evidence beside whole documents.

    A term that overlaps any base span is not free. Spans and terms of a text meet
    in buckets of places, so a text with many mentions costs no pairs.
    """
    terms = mentions.select("doc_id", "mark", F.col("w.entity").alias("entity"), F.col("w.start").alias("at"), F.explode(_near_terms("w")).alias("t"))
    terms = terms.withColumn("bucket", F.expr(f"(t.start + {BUCKET}) DIV {BUCKET}"))
    covered = F.explode(F.expr(f"sequence((w.start + {BUCKET - REACH}) DIV {BUCKET}, (w.end - 1 + {BUCKET}) DIV {BUCKET})")).alias("b")
    spans = mentions.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("w.start").alias("s"), F.col("w.end").alias("e"), covered).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("bucket") == F.col("b"))
    free = terms.join(spans, same & (F.col("s") < F.col("t.end")) & (F.col("e") > F.col("t.start")), "left_anti")
    return free.groupBy("doc_id", "mark", "entity", "at").agg(
        F.md5(F.array_join(F.array_sort(F.collect_set("t.term")), " ").cast("binary")).alias("sign"), F.array_sort(F.collect_set("t")).alias("near")
    )


def _marked(based: DataFrame) -> DataFrame:
    """The rows with ``marked``, their text with MARK behind each letter and hyphen of a base span.

    A combining mark starts no word and ends none, so words are the same as without
    it, and exactly those that overlap a base span hold it.
    """
    shown = lambda s: F.regexp_replace(s["value"], "([A-Za-z-])", f"$1{MARK}")
    merged = united(F.array_sort(F.transform("base", lambda s: F.struct(s["start"], s["end"], F.lit("").alias("shown")))))
    rows = based.withColumn("apart", merged).withColumn("plain", _plain("text"))
    value = lambda part: F.transform("apart", lambda s: F.struct(s["start"], s["end"], part(s["start"], s["end"]).alias("value")))
    rows = rows.withColumn("apart", F.when(F.size("base") > 0, _parts(F.col("plain"), value)))
    rows = rows.withColumn("apart", F.transform("apart", lambda s: F.struct(s["start"], s["end"], shown(s).alias("shown"))))
    return rows.withColumn("marked", F.when(F.size("base") > 0, rewritten(F.col("plain"), "apart")).otherwise(F.col("plain")))


def _plain(text: str) -> Column:
    """The text, null as empty, with a MARK of its own turned into its neighbour, as long and as much a mark."""
    return F.translate(F.coalesce(text, F.lit("")), MARK, NEIGHBOUR)


def _words(text: Column) -> Column:
    """Distinct lowered words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _whole(docs: DataFrame, based: DataFrame, mentions: DataFrame) -> DataFrame:
    """entity, term, n_te, contexts: how many documents mention the entity and hold the free term anywhere, and how many differ in their words.

    Only entities with as many mentions as contexts are needed are counted; the others can disclose nothing.
    """
    live = mentions.groupBy("w.entity").agg(F.count("*").alias("k")).where(F.col("k") >= SUPPORT).select("entity")
    held = cut(mentions.select("doc_id", "mark", F.col("w.entity").alias("entity")).distinct().join(live, "entity", "left_semi"))
    base = _base_places(based)
    where = base.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left_semi")
    rows = _marked(_some_texts(docs, broadcast_if_small(cut(where))))
    free = F.filter(F.regexp_extract_all("marked", F.lit(TERM), F.lit(0)), lambda w: ~w.contains(MARK))
    rows = rows.select("doc_id", "mark", F.array_sort(F.array_distinct(F.transform(free, F.lower))).alias("terms")).dropDuplicates(["doc_id", "mark"])
    rows = rows.select("doc_id", "mark", F.md5(F.array_join("terms", " ").cast("binary")).alias("sign"), F.explode("terms").alias("term"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    counted = rows.join(held.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "entity"), same).groupBy("entity", "term", "sign").agg(F.count("*").alias("n"))
    return counted.groupBy("entity", "term").agg(F.count("*").alias("apart"), F.sum("n").alias("n_te"))


def _each_once(docs: DataFrame, based: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the corpus with each doc_id and text once, and how many they are; only rows that are repeated meet in a shuffle."""
    times = based.groupBy("doc_id", "mark").agg(F.count("*").alias("times"))
    held = times.agg(F.count("*").alias("n"), F.max("times").alias("most")).first()
    rows = pick(docs, "doc_id", "text")
    if (held["most"] or 1) == 1:
        return rows, held["n"]
    again = broadcast_if_small(cut(times.where("times > 1").select(F.col("doc_id").alias("d"), F.col("mark").alias("m"))))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("m"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").distinct()), held["n"]


def disclosing(docs: DataFrame, based: DataFrame, mentions: DataFrame, contexts: DataFrame) -> DataFrame:
    """entity, term: the pairs whose term discloses the entity, by the counts of the whole corpus; rows that repeat id and text count once in each."""
    corpus, total = _each_once(docs, based)
    of_entity = mentions.select("doc_id", "mark", "w.entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    close = contexts.select("entity", "sign", F.explode(F.array_distinct("near.term")).alias("term"))
    close = close.groupBy("entity", "term").agg(F.countDistinct("sign").alias("contexts"))
    pairs = _whole(docs, based, mentions).join(close, ["entity", "term"], "left")
    pairs = cut(pairs.where(F.greatest("apart", "contexts") >= SUPPORT).select("entity", "term", "n_te"))
    # All terms are counted where they stand before any is looked up, so what is joined follows the vocabulary and not the corpus.
    of_term = corpus.select(F.explode(_words(_plain("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    joined = pairs.join(of_term, "term").join(of_entity, "entity")
    known = F.log(F.lit(float(total)) / F.col("n_e"))
    told = F.log(F.col("n_te") * F.lit(float(total)) / (F.col("n_t").cast("double") * F.col("n_e")))
    return joined.where((F.col("n_e") < total) & (told >= DISCLOSED * known)).select("entity", "term")


def _told_places(docs: DataFrame, based: DataFrame, told: DataFrame) -> DataFrame:
    """d, m and the sorted places of every free disclosing term, in whichever document it stands; no row for documents without one.

    Documents meet the terms on their distinct words; each is then read with the
    terms that it holds, so only places of disclosing terms are ever rows or cells.
    """
    terms = told.select("term").distinct()
    terms = F.broadcast(terms) if is_small(told) else terms
    rows = pick(docs, "doc_id", "text")
    held = rows.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("m"), F.explode(_words(_plain("text"))).alias("term")).join(terms, "term", "left_semi")
    base = _base_places(based).select(F.col("d").alias("b_d"), F.col("m").alias("b_m"), "base")
    same = F.col("d").eqNullSafe(F.col("b_d")) & (F.col("m") == F.col("b_m"))
    held = cut(held.groupBy("d", "m").agg(F.collect_set("term").alias("told")).join(base, same, "left").select("d", "m", "told", "base"))
    bare = lambda c: F.char_length(F.translate(c, MARK, ""))
    known = lambda w: ~w["value"].contains(MARK) & F.array_contains("told", F.lower(w["value"]))
    found = F.transform(F.filter(places(F.col("marked"), TERM, bare), known), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end")))
    each = _marked(_some_texts(docs, broadcast_if_small(held), "told")).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), found.alias("term"))
    return each.where(F.size("term") > 0).dropDuplicates(["d", "m"])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, mark, the spans of each base kind and of the kind ``term``, of every row; texts stay behind."""
    based = base_table(docs)
    mentions = _mentions(based)
    told = cut(disclosing(docs, based, mentions, _contexts(mentions)))
    rows = based.drop("windows")
    none = F.array().cast("array<struct<start:int,end:int>>")
    if told.isEmpty():
        return rows.withColumn("term", none)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    joined = rows.join(_told_places(docs, based, told), same, "left")
    return joined.select("doc_id", "mark", *KINDS[:-1], F.coalesce("term", none).alias("term"))


def written(kinds: tuple[str, ...]) -> Column:
    """Spans as kind:start:end, by kind, then start, joined by commas."""

    def part(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(part, kinds)), ",")


def united(spans: Column) -> Column:
    """Sorted spans (start, end, shown) with those that overlap made one: first start, last end, ``shown`` of the longest; null for null."""
    one = "struct<start:int,end:int,shown:string,wide:int>"
    wide = lambda s: s["end"] - s["start"]
    alone = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["shown"].alias("shown"), wide(s).alias("wide"))

    def step(a: Column, s: Column) -> Column:
        apart = a["last"].isNull() | (a["last"]["end"] <= s["start"])
        longer = wide(s) > a["last"]["wide"]
        joined = F.struct(
            a["last"]["start"].alias("start"), F.greatest(a["last"]["end"], s["end"]).alias("end"),
            F.when(longer, s["shown"]).otherwise(a["last"]["shown"]).alias("shown"), F.greatest(a["last"]["wide"], wide(s)).alias("wide"),
        )
        out = F.when(apart & a["last"].isNotNull(), F.concat(a["out"], F.array(a["last"]))).otherwise(a["out"])
        return F.struct(F.when(apart, alone(s)).otherwise(joined).alias("last"), out.alias("out"))

    start = lambda a: F.struct(a["last"].alias("last"), F.array().cast(f"array<{one}>").alias("out"))
    walked = _walk(spans, f"struct<last:{one},out:array<{one}>>", start, step)
    end = lambda w: F.concat(
        F.flatten(F.transform(w, lambda a: a["out"])), F.filter(F.array(F.get(w, F.size(w) - 1)["last"]), lambda x: x.isNotNull())
    )
    return F.when(spans.isNotNull(), F.get(F.transform(F.array(walked), end), F.lit(0)))


def rewritten(text: Column, spans: str) -> Column:
    """The text with each of the spans in the named column, in order and apart, replaced by its ``shown``."""
    until = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    length = F.char_length(text)

    def pieces(part) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(spans)),
            lambda i: F.concat(part(until(i), F.coalesce(F.get(spans, i)["start"], length)), F.coalesce(F.get(spans, i)["shown"], F.lit(""))),
        )

    return F.array_join(_parts(text, pieces), "")


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows with their spans replaced in ``text`` and ``n_chars``, if there is one, set to the new length."""
    names = docs.columns
    who, what = (f"c{position_of(names, n)}" for n in ("doc_id", "text"))
    spans = find_spans(docs)

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(SHOWN[kind]).alias("shown")))

    spans = spans.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.array_sort(F.concat(*map(marked, KINDS))).alias("spans"))
    spans = broadcast_if_small(cut(spans.where(F.size("spans") > 0).dropDuplicates(["d", "m"])))
    same = F.col(who).eqNullSafe(F.col("d")) & (F.xxhash64(what) == F.col("m"))
    joined = numbered(docs).join(spans, same, "left").withColumn("spans", united(F.col("spans")))
    clean = joined.withColumn("clean", F.when(F.col("spans").isNull(), F.col(what)).otherwise(rewritten(F.col(what), "spans")))
    out = []
    for k, name in enumerate(names):
        if f"c{k}" == what:
            out.append(F.col("clean").alias(f"c{k}"))
        elif name == "n_chars":
            out.append(F.char_length("clean").cast(docs.schema[k].dataType).alias(f"c{k}"))
        else:
            out.append(F.col(f"c{k}"))
    return clean.select(*out).toDF(*names)
