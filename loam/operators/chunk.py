"""Sections and bounded chunks of markdown bodies.

All of it happens inside a row: a body is split by headings, too long sections by sub-headings, and what is
still too long at soft breaks. Nothing is shuffled; explode() comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MAX_CHUNK_CHARS, SOFT_BREAK_WINDOW
from ..functions.text import strip

INTRO = "(intro)"


def by_heading(text: Column, level: int) -> Column:
    """array<struct<header, content>>: a line of `level` signs and a space starts a section; what comes before the
    first is the intro; contents are stripped, and empty ones left out."""
    mark = "#" * level + " "
    parts = F.split(text, rf"(?m)(?=^{mark}(?!#))", -1)

    def section(p: Column) -> Column:
        headed = p.startswith(mark) & ~p.startswith(mark + "#")
        line = F.regexp_extract(p, r"\A([^\n]*)", 1)
        return F.struct(
            F.when(headed, strip(F.regexp_replace(line, r"\A[# ]+", ""))).otherwise(INTRO).alias("header"),
            strip(F.when(headed, F.regexp_replace(p, r"\A[^\n]*\n?", "")).otherwise(p)).alias("content"),
        )

    return F.filter(F.transform(parts, section), lambda s: s["content"] != "")


def soft_pieces(text: Column, limit: int = MAX_CHUNK_CHARS, window: int = SOFT_BREAK_WINDOW) -> Column:
    """The pieces of a text that is cut at the last blank line, else line end, else space of the last `window`
    characters of each `limit`, else at the limit; the rest is the last piece."""
    start = max(limit // 2, limit - window)

    def step(state: Column, _: Column) -> Column:
        pos = state["pos"]
        w = F.substring(text, pos + start + 1, F.lit(limit - start))
        back = F.reverse(w)
        para, line, space = F.instr(back, "\n\n"), F.instr(back, "\n"), F.instr(back, " ")
        # a needle's end lies as far from the window's end as its reverse from the start
        cut = F.when(para > 0, limit - para + 1).when(line > 0, limit - line + 1).when(space > 0, limit - space + 1).otherwise(limit)
        left = F.length(text) - pos
        size = F.when(left <= limit, left).otherwise(cut).cast("int")
        return F.when(left <= 0, state).otherwise(F.struct((pos + size).cast("int").alias("pos"), F.concat(state["pieces"], F.array(F.substring(text, pos + 1, size))).alias("pieces")))

    most = F.ceil(F.length(text) / start).cast("int") + 1
    empty = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("pieces"))
    return F.aggregate(F.sequence(F.lit(1), most), empty, step)["pieces"]


def by_size(header: Column, text: Column, limit: int = MAX_CHUNK_CHARS, window: int = SOFT_BREAK_WINDOW) -> Column:
    """array<struct<header, content>> of stripped pieces that are not blank, numbered if there is more than one cut."""
    pieces = F.filter(F.transform(soft_pieces(text, limit, window), strip), lambda p: p != "")
    return F.transform(pieces, lambda p, i: F.struct(F.concat(header, F.when(F.length(text) > limit, F.concat(F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))).otherwise("")).alias("header"), p.alias("content")))


def cascade(body: Column, limit: int = MAX_CHUNK_CHARS) -> Column:
    """array<struct<header, content>>: sections, sub-sections of those above the limit, pieces of those still above."""

    def sub(s: Column) -> Column:
        def fit(t: Column) -> Column:
            header = F.when(t["header"] == INTRO, s["header"]).otherwise(F.concat(s["header"], F.lit(" > "), t["header"]))
            return F.when(F.length(t["content"]) <= limit, F.array(F.struct(header.alias("header"), t["content"].alias("content")))).otherwise(by_size(header, t["content"], limit))

        return F.when(F.length(s["content"]) <= limit, F.array(s)).otherwise(F.flatten(F.transform(by_heading(s["content"], 3), fit)))

    return F.flatten(F.transform(by_heading(body, 2), sub))


def hard_pieces(header: Column, text: Column, limit: int = MAX_CHUNK_CHARS) -> Column:
    """Pieces of exactly `limit` characters, numbered if there is more than one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(limit))
    name = lambda i: F.concat(header, F.when(F.length(text) > limit, F.concat(F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))).otherwise(""))
    return F.transform(starts, lambda s, i: F.struct(name(i).alias("header"), F.substring(text, s, F.lit(limit)).alias("content")))


def preamble(source_file: Column, doc_type: Column, status: Column, area: Column, header: Column) -> Column:
    unknown = F.lit("unknown")
    return F.concat(F.lit("File: "), source_file, F.lit(" · Type: "), F.coalesce(doc_type, unknown), F.lit(" · Status: "), F.coalesce(status, unknown), F.lit(" · Area "), F.coalesce(area.cast("string"), unknown), F.lit(", "), header)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def chunks(docs: DataFrame, body: str = "body", how=cascade) -> DataFrame:
    """docs (.., body) -> a row for each chunk: chunk_no from 0, section_header, content."""
    return docs.select("*", F.posexplode(how(F.col(body)))).select("*", F.col("pos").alias("chunk_no"), F.col("col.header").alias("section_header"), F.col("col.content").alias("content")).drop("pos", "col", body)


