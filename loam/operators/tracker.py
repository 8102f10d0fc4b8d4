"""Areas of HTML tracker pages: the array that a page assigns to `A`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import as_int, strip
from ..schema import TRACKER

# Where the array stands, and the tokens of its text.
ARRAY = r"(?s)var A\s*=\s*(\[.*?\]);"
_TOKEN = regex.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|(?P<key>(?:\p{L}|_)(?:\p{L}|\p{N}|_)*)(?=[ \t]*:)', regex.S)
_TRAILING = regex.compile(r",\s*([}\]])")


def to_json(js: str | None) -> str | None:
    """Bare keys quoted, trailing commas dropped (those inside strings too)."""
    if js is None:
        return None
    quoted = _TOKEN.sub(lambda m: f'"{m["key"]}"' if m["key"] else m[0], js)
    return _TRAILING.sub(r"\1", quoted)


@pandas_udf(StringType())
def js_to_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(to_json)


def areas_json(html: Column) -> Column:
    return js_to_json(F.when(html.rlike(ARRAY), F.regexp_extract(html, ARRAY, 1)))


def render(a: Column) -> Column:
    """An area as text for reading and embedding."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    opt = lambda c, left, right: F.when(some(c), F.concat(F.lit(left), c, F.lit(right))).otherwise("")
    none = F.array().cast("array<string>")

    def item(i: Column) -> Column:
        return F.concat(F.lit("- "), F.coalesce(i["n"], F.lit("")), opt(i["s"], " [", "]"), opt(i["o"], " (owner: ", ")"), opt(i["y"], " (type: ", ")"), opt(i["nt"], ", ", ""))

    def group(g: Column) -> Column:
        head = F.when(some(g["n"]), F.array(F.concat(F.lit("## "), g["n"]))).otherwise(none)
        return F.concat(head, F.coalesce(F.transform(g["it"], item), none), F.array(F.lit("")))

    def block(title: str, rows: Column) -> Column:
        return F.when(F.size(rows) > 0, F.concat(F.array(F.lit(title)), rows, F.array(F.lit("")))).otherwise(none)

    head = F.concat(F.array(F.concat(F.lit("# "), F.coalesce(a["n"], F.lit("Untitled")))), F.when(some(a["tg"]), F.array(F.concat(F.lit("Scope: "), a["tg"]))).otherwise(none), F.array(F.concat(F.lit("Status: "), F.coalesce(a["s"], F.lit("unknown"))), F.lit("")))
    groups = F.coalesce(F.flatten(F.transform(a["sg"], group)), none)
    decisions = block("## Decisions", F.transform(a["d"], lambda d: F.concat(F.lit("- "), F.coalesce(d["x"], F.lit("")))))
    deferred = block("## Deferred", F.transform(a["df"], lambda x: F.concat(F.lit("- "), x)))
    return F.concat_ws("\n", head, groups, decisions, deferred)


def tracker_chunks(pages: DataFrame) -> DataFrame:
    """pages (source_file, html) -> source_file, area_no, section_header, area_number, doc_type, content, error: a
    row for each area, in order; no array or no JSON gives no row; an item without a name is an error of its area."""
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.html\z", "")
    parsed = F.from_json(areas_json(F.col("html")), TRACKER)
    rows = pages.select("source_file", stem.alias("stem"), F.posexplode(parsed).alias("area_no", "a")).filter("a IS NOT NULL")
    kind = F.when(F.col("stem").contains("capability-areas"), "fwk").when(F.col("stem").contains("tracker"), "tracker")
    nameless = F.exists(F.flatten(F.transform("a.sg", lambda g: g["it"])), lambda i: i["n"].isNull())
    content = render(F.col("a"))
    out = rows.select("source_file", "area_no", F.coalesce("a.n", F.lit("Untitled")).alias("section_header"), as_int(F.col("a.id")).alias("area_number"), kind.alias("doc_type"), content.alias("content"), F.when(nameless, "an item has no name").alias("error"))
    return out.filter(strip(F.col("content")) != "")
