"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be quoted with up to e errors. Cut into e + 1 pieces, one of them is quoted
without error; so all pieces of all items are looked for at once, exactly, and around each hit Myers'
bit-parallel algorithm gives the least edit distance between the item and any passage of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Errors allowed for each character of an item. A piece is then some 1 / ERROR_RATE characters long.
ERROR_RATE = 0.08
#: Shorter items would be met by chance in the middle of words or with an error: they are looked for as they stand, with
#: no letter or digit before or after them.
SHORTEST = 24
#: Characters of items that are looked for in one pass over the documents; a larger benchmark takes more passes. The
#: automaton takes some 50 bytes for each.
PASS_CHARS = 2_000_000


def normal(text: str | None) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join(text.lower().split()) if text else ""


def budget(length: int) -> int:
    return int(ERROR_RATE * length) if length >= SHORTEST else 0


def bounded(text: str, a: int, b: int) -> bool:
    """Whether neither text[a:b] nor what is beside it goes on with a letter or digit."""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces that make up the item."""
    n = budget(len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def nearest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of a pattern of m characters to any passage of text, the first end of such a passage)."""
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up <<= 1
        down <<= 1
        vertical = eq | minus
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """Items (id, text) to look for in whole texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, masks(t)) for i, t in sorted({(i, normal(t)) for i, t in items}, key=lambda x: (x[0] is None, x[0] or 0, x[1])) if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, _) in enumerate(self.items):
            for offset, piece in pieces(item):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, value in places.items():
            self.automaton.add_word(piece, (len(piece), value))
        if places:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normal text) of each item that the text quotes within its budget."""
        if not self.items or not text:
            return []
        text = normal(text)
        hits: dict[int, set[int]] = {}
        for end, (size, value) in self.automaton.iter(text):
            for k, offset in value:
                hits.setdefault(k, set()).add(end - size + 1 - offset)
        found: dict[int, tuple[int, int]] = {}
        for k, starts in hits.items():
            item_id, item, peq = self.items[k]
            m, e = len(item), budget(len(item))
            if m < SHORTEST:
                own = [s + m for s in starts if bounded(text, s, s + m)]
                if own and (item_id not in found or (0, min(own)) < found[item_id]):
                    found[item_id] = 0, min(own)
                continue
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - e), min(len(text), s + m + e)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                distance, at = nearest(peq, m, text[a:b])
                if distance <= e and (item_id not in found or (distance, a + at) < found[item_id]):
                    found[item_id] = distance, a + at
        return [(i, *v) for i, v in found.items()]


def _matches(items: list[tuple[int, str]]):
    def run(batches):
        matcher = Matcher(items)
        for batch in batches:
            out = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for hit in matcher(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["doc_id", "item_id", "distance", "stop"])

    return run


def _clean(items: list[tuple[int, str]]):
    def run(batches):
        matcher = Matcher(items)
        for batch in batches:
            yield batch.filter(pa.array([not matcher(t.as_py()) for t in batch.column("text")], pa.bool_()))

    return run


def blocks(benchmark: DataFrame, pass_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of at most about pass_chars characters; one block is on the driver at a time."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / pass_chars))
    for k in range(n):
        yield [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]


def clean(docs: DataFrame, benchmark: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of docs that quote no item (see contaminated); a null text quotes none, a null id changes nothing, and
    all columns of docs are kept. Each block but the first works on a table of what the one before it left."""
    for k, block in enumerate(blocks(benchmark, pass_chars)):
        docs = (saved(docs, "clean") if k else docs).mapInArrow(_clean(block), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, distance, stop: a row for each item that
    a document quotes, with the least distance and the first end of a passage at that distance (characters of
    the normal text).

    Items below SHORTEST normal characters are met only as they stand, at word bounds; empty items and null texts match
    nothing; items that share an id are one item of several wordings; a null id is reported as null; a repeated
    document reports its items for each row; extra columns are ignored; empty tables give no rows. The benchmark is the
    stated query set: it goes to the tasks in blocks of at most about pass_chars characters, found from its size; a
    block's matches are in a table before the next block is read."""
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    out = None
    for block in blocks(benchmark, pass_chars):
        done = saved(out, "matches") if out is not None else None
        found = texts.mapInArrow(_matches(block), "doc_id long, item_id long, distance long, stop long")
        out = found if done is None else done.unionByName(found)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
