"""Redaction of values assigned to excluded fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An excluded name, not inside a longer one, and what may be assigned to it. The quoted forms are
# written so that Java's engine does not recurse on long values.
NAME = r"(?i)(?<![a-zA-Z0-9_])({})([\"']?)"
QUOTED = NAME + r"""(\s*[:=]\s*)("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
BARE = NAME + r"""(\s*=\s*)(?![^\s,;}}\]\n"']*\[REDACTED:)([^\s,;}}\]\[\n"']+)"""
MARK = "[REDACTED:"


def _name(field: str) -> str:
    return re.escape(field)


def scrub(content: Column, fields: tuple[str, ...]) -> Column:
    """Values of the fields replaced by [REDACTED:field]; twice gives the same as once; no fields change nothing."""
    for form in (QUOTED, BARE):
        for f in fields:
            pattern = form.format(_name(f))
            # a quoted value that is redacted already has no bracket before its end
            if form is QUOTED:
                pattern = pattern.replace("(\\s*[:=]\\s*)(", "(\\s*[:=]\\s*)(?![\"'][^\"']*\\[REDACTED:)(")
            content = F.regexp_replace(content, pattern, rf"$1$2$3[REDACTED:{f.lower()}]".replace("[", r"\[").replace("]", r"\]"))
    return content


def _hits(content: Column, pattern: str, field: str) -> Column:
    hits, parts = F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), F.split(content, pattern, -1)
    length = lambda texts, n: F.aggregate(F.slice(texts, F.lit(1), n), F.lit(0), lambda a, p: a + F.length(p))
    # what stands before the n-th match: the parts between matches, and the matches before it
    found = F.transform(hits, lambda h, i: F.struct((length(parts, i + 1) + length(hits, i)).alias("offset"), F.lit(field).alias("field"), h.alias("match")))
    return F.filter(found, lambda s: ~s["match"].contains(MARK))


def violations(content: Column, fields: tuple[str, ...]) -> Column:
    """array<struct<offset, field, match>>, by offset: what scrub() would redact of the text as it is."""
    found = [_hits(content, form.format(_name(f)), f.lower()) for form in (QUOTED, BARE) for f in fields]
    if not found:
        return F.array().cast("array<struct<offset:int,field:string,match:string>>")
    return F.array_sort(F.concat(*found))


def unscrubbed(content: Column, fields: tuple[str, ...]) -> Column:
    """The coarse test for stored content: an assignment is there and nothing at all is redacted."""
    if not fields:
        return F.lit(False)
    names = "|".join(map(_name, fields))
    quoted = rf"""(?i)(?<![a-zA-Z0-9_])({names})["']?\s*[:=]\s*("[^"]+"|'[^']+')"""
    bare = rf"""(?i)(?<![a-zA-Z0-9_])({names})["']?\s*=\s*[^\s,;}}\]\[\n"']+"""
    return (content.rlike(quoted) | content.rlike(bare)) & ~content.contains(MARK)


def verify_scrub(chunks: DataFrame, fields: tuple[str, ...], sample: int = 20) -> tuple[int, list]:
    """(number of unscrubbed chunks, a few of them)."""
    bad = chunks.filter(unscrubbed(F.col("content"), fields))
    return bad.count(), bad.select("source_file", "section_header", F.substring("content", 1, 200).alias("snippet")).orderBy("source_file", "section_header").limit(sample).collect()
