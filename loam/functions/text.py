"""Text functions as columns, with the white space and line ends that Unicode text processing knows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regex classes, for Java's engine.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def unquote(c: Column) -> Column:
    """Without quote characters at either end."""
    return F.regexp_replace(c, r"""\A["']+|["']+\z""", "")


def lines(c: Column) -> Column:
    """The lines of a text; none for an empty one, and no empty line after a last line end."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def rfind(text: Column, needle: Column | str) -> Column:
    """The place of the last needle, counted from 0; -1 if there is none."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.instr(F.reverse(text), F.reverse(needle))
    return F.when(at > 0, F.length(text) - at + 1 - F.length(needle)).otherwise(F.lit(-1))


def slugify(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), r"\A-+|-+\z", "")


def null_if_spelled(c: Column, nulls: tuple[str, ...]) -> Column:
    """Null spellings to null; else without spaces and then quotes at the ends."""
    return F.when(c.isin(*nulls), None).otherwise(unquote(strip(c)))


def iso_date(c: Column) -> Column:
    """YYYY-MM-DD or YYYYMMDD as a date, else null."""
    plain = F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(c, "yyyy-MM-dd")).when(c.rlike(r"\A\d{8}\z"), F.try_to_date(c, "yyyyMMdd"))
    return plain


def as_int(c: Column) -> Column:
    """A whole number with an optional sign, else null."""
    s = strip(c)
    return F.when(s.rlike(r"\A[+-]?\d+\z"), s.try_cast("int"))


def last_struct(c: Column, cond) -> Column:
    return F.try_element_at(F.filter(c, cond), F.lit(-1))
