"""Scalar functions as column expressions: pointers, names, keys and normal forms."""

from __future__ import annotations

from json import dumps, loads

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a search by keyword leaves out.
STOP = (
    "the and for this that with from into not are was were does which each any all one its has have had been being than then there their they them "
    "what when where who will can may must should would could also only such these those some more most under over here used use uses using value "
    "values document documents tool"
).split()
WORD = "[a-z][a-z0-9-]{2,}"


def escape_pointer(token: Column) -> Column:
    """A token as pointers write it."""
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_pointer(token: Column) -> Column:
    """A token of a pointer as it was."""
    return F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def shorten(text: Column, limit: int = 120) -> Column:
    """At most ``limit`` characters of a value, with dots where it was cut."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def text(*parts: str | Column) -> Column:
    """Texts and columns joined into one."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def template(pointer: Column) -> Column:
    """A pointer without its item numbers: the place in the schema."""
    return F.regexp_replace(pointer, "/[0-9]+(?=/|$)", "")


def shown_key(key: Column) -> Column:
    """A composite key as readers see it."""
    parts = F.from_json(key, "array<string>")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit("(absent)"))), " | ")


def parent_pointer(pointer: Column) -> Column:
    """The pointer without its last token; of the root the empty pointer."""
    return F.regexp_replace(pointer, "/[^/]*$", "")


def path_of(href: Column) -> Column:
    """The path of a reference: no scheme, host, query or fragment."""
    return F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def fragment_of(href: Column) -> Column:
    return F.regexp_extract(href, r"#(.*)$", 1)


def file_name(href: Column) -> Column:
    """The last segment of a reference's path, null if empty."""
    tail = F.substring_index(path_of(href), "/", -1)
    return F.when(tail != "", tail)


def stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def normalize(text: Column) -> Column:
    """One kind of quotation mark and dash, and single spaces."""
    marks = F.translate(text, "“”‘’–— ", "\"\"''-- ")
    return F.trim(F.regexp_replace(marks, r"(?U)\s+", " "))


def terms(text: Column) -> Column:
    """Distinct words of a text that are worth searching for."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), F.array(*map(F.lit, STOP)))


#: What normal forms disregard, by the name that reports give it, in the order of application.
FOLDINGS = {
    "a leading '#'": lambda t: F.regexp_replace(t, "^#", ""),
    "case": lambda t: F.lower(F.upper(t)),
    "the separator": lambda t: F.regexp_replace(t, "[-_.]", "-"),
    "zero-padding": lambda t: F.regexp_replace(t, r"0*(\d)", "$1"),
}


def folded(text: Column, *names: str) -> Column:
    """The text after the named foldings, in their order."""
    for name in FOLDINGS:
        text = FOLDINGS[name](text) if name in names else text
    return text


def normal_form(text: Column) -> Column:
    """The text after all foldings (inner zeros go like padding ones, as in the rule that this follows)."""
    return folded(text, *FOLDINGS)


def canonical(json: Column) -> Column:
    """A JSON text with the members of every object in the order of their names and no white space; null if it is no JSON."""
    return _canonical(json)


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else dumps(loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)
