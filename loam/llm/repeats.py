"""Exact removal of repeated passages with suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. The strings are too many to
sort them all, so the shards are made such that equal strings meet in one:

1. Winnowing: the least hash of the GRAM-byte grams of a string is the same wherever the string stands. Strings
   that follow each other and share it are one run. Only runs whose hash occurs in two places can matter.
2. The texts of those runs go to shards by hash. Each shard builds the suffix array of its distinct runs by
   Larsson-Sadakane refinement, and Kasai's common prefixes tell which strings start twice in it.
3. The runs of one hash may be more than a shard holds. They are then made distinct by a shuffle and dealt into blocks;
   a task gets two blocks, builds their suffix arrays, and merges them by binary search of the strings of one in the
   other, so that all blocks of a hash meet in pairs and no task holds more than two.
4. The strings found are joined with their documents and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved, with_counts
from .suffixes import common_prefixes, find, suffix_array

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
#: Strings of a run at most, bytes of a shard, and runs of a hash that are in one shard together; with more, they are
#: dealt in blocks of so many.
RUN, SHARD, RUNS = 1024, 2_000_000, 1000
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 18
_M = np.uint64(0xBF58476D1CE4E5B9)
_BYTE = np.random.default_rng(9).integers(0, 2**64, 256, np.uint64)
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(8)]


def _slide(h: np.ndarray, pick) -> np.ndarray:
    """pick (minimum or maximum) over each WINDOW values in a row."""
    size = 1
    while 2 * size <= WINDOW:
        h = pick(h[:-size], h[size:])
        size *= 2
    rest = WINDOW - size
    return pick(h[:-rest], h[rest:]) if rest else h


def _least(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string that starts in raw, the least hash of its grams; and the hashes that are the least of a
    string in two of its places."""
    h, size, level = _BYTE[raw], 1, 0
    while size < GRAM:
        h = h[:-size] * _STEP[level] + h[size:]
        size, level = 2 * size, level + 1
    h = (h ^ (h >> np.uint64(31))) * _M
    h ^= h >> np.uint64(29)
    least = _slide(h, np.minimum)
    # a gram is the least of some string if no string that holds it has only greater or lower ones
    edge = np.zeros(WINDOW - 1, np.uint64)
    chosen = h[h == _slide(np.concatenate([edge, least, edge]), np.maximum)]
    return least, chosen[1:][chosen[1:] == chosen[:-1]]


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, twice) of the runs of strings that start at first to last; twice: the run itself may
    hold a string two times."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    text = np.frombuffer(raw, np.uint8)
    blocks = [_least(text[at : at + BLOCK + LENGTH - 1]) for at in range(0, n, BLOCK)]
    least = np.concatenate([x for x, _ in blocks])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[first, n])
    twice = size > WINDOW
    if len(again := np.concatenate([x for _, x in blocks])):
        twice |= np.isin(least[first], again)
    if size.max() > RUN:
        parts = (size + RUN - 1) // RUN
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, twice = np.repeat(first, parts) + inner * RUN, np.repeat(twice, parts)
    last = np.r_[first[1:], n] - 1
    return least[first].view(np.int64), first, last, twice


#: What tells a row from all others: two hashes of 64 bits.
ROW = ["u", "v"]


def _run_rows(batches):
    schema = pa.schema([("hash", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("twice", pa.bool_())])
    for batch in batches:
        held, size = [], 0
        for u, v, text in zip(*(batch.column(c).to_pylist() for c in ROW), batch.column("text").cast(pa.binary()), strict=True):
            h, first, last, twice = runs(text.as_py())
            if len(h):
                held.append((h, np.full(len(h), u), np.full(len(h), v), first.astype(np.int32), last.astype(np.int32), twice))
                size += len(h)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)


def _pieces(batches):
    """Candidate texts with their runs -> the runs' bytes and digests."""
    schema = pa.schema([("hash", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("first", pa.int32()), ("piece", pa.binary()), ("digest", pa.binary())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        out, size = [], 0
        for u, v, text, some in zip(*(batch.column(c).to_pylist() for c in ROW), batch.column("text").cast(pa.binary()), batch.column("runs"), strict=True):
            raw, own = text.as_py(), some.values
            for h, a, b in sorted(set(zip(*(own.field(n).to_pylist() for n in ("hash", "first", "last")), strict=True))):
                piece = raw[a : b + LENGTH]
                out.append((h, u, v, a, piece, xxhash.xxh3_128_digest(piece)))
                size += len(piece)
                if size > 4_000_000:
                    yield rows(out)
                    out, size = [], 0
        if out:
            yield rows(out)


class Shard:
    """The suffix array of some distinct runs, and which of their strings start twice or more."""

    def __init__(self, pieces: list[bytes]):
        self.begins = np.cumsum([0, *map(len, pieces)])
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        own = np.ones(len(self.text), bool)  # starts of whole strings
        for end in self.begins[1:]:
            own[end - LENGTH + 1 : end] = False
        order, group = suffix_array(self.text, LENGTH)
        shared = common_prefixes(self.text, order, group, LENGTH)
        number = np.cumsum(shared < LENGTH)
        mine = own[order]
        #: Starts in the order of their strings, and a number for each different string.
        self.order, number = order[mine].astype(np.int32), number[mine]
        self.number = np.unique(number, return_inverse=True)[1].astype(np.int32)
        self.twice = np.bincount(self.number, minlength=1) > 1

    def merge(self, other: Shard) -> None:
        """Mark what both hold, by binary search of the other's different strings in this one's suffix array."""
        _, place = np.unique(other.number, return_index=True)
        at = find(self.text, self.order, other.text, other.order[place], LENGTH)
        met = at >= 0
        other.twice[other.number[place[met]]] = True
        self.twice[self.number[at[met]]] = True

    def marked(self) -> list[np.ndarray]:
        """For each run, which of its strings start twice or more."""
        out = np.zeros(len(self.text), bool)
        out[self.order[self.twice[self.number]]] = True
        return [out[a : b - LENGTH + 1] for a, b in zip(self.begins, self.begins[1:], strict=False)]


def spans_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """Marked starts -> the bytes that their strings cover, as (begin, end)."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > LENGTH)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + LENGTH).tolist(), strict=True))


def _sharded(shard_bytes: int):
    def run(batches):
        """Runs, those of one hash together -> (u, v, begin, end) of repeated bytes."""
        out: list[tuple[int, int, int, int]] = []
        held: dict[bytes, list[tuple[int, int, int]]] = {}  # run -> its places
        size, key = 0, None

        def close():
            nonlocal held, size
            for marks, places in zip(Shard(list(held)).marked(), held.values(), strict=True):
                spans = spans_of(marks | (len(places) > 1))
                out.extend((u, v, first + a, first + b) for u, v, first in places for a, b in spans)
            held, size = {}, 0

        def batch_of():
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], [*ROW, "begin", "end"])
            out.clear()
            return got

        for batch in batches:
            for h, u, v, first, piece in zip(*(batch.column(n).to_pylist() for n in ("hash", "u", "v", "first", "piece")), strict=True):
                if h != key:
                    if size > shard_bytes:
                        close()
                    key = h
                if piece not in held:
                    held[piece] = []
                    size += len(piece)
                held[piece].append((u, v, first))
            if len(out) > 50_000:
                yield batch_of()
        if held:
            close()
        yield batch_of()

    return run


def _merged(batches):
    """Distinct runs (hash, i, j, block, digest, piece, copies), those of one (hash, i, j) together -> (hash, digest,
    begin, end) of bytes of a run that also stand in another, or in another place of the same."""
    schema = pa.schema([("hash", pa.int64()), ("digest", pa.binary()), ("begin", pa.int64()), ("end", pa.int64())])
    key, held, out = None, {}, []

    def close():
        shards = {block: Shard([piece for _, piece, _ in rows]) for block, rows in held.items()}
        if len(shards) == 2:
            one, other = shards.values()
            one.merge(other)
        for block, shard in shards.items():
            for marks, (digest, _, copies) in zip(shard.marked(), held[block], strict=True):
                out.extend((key[0], digest, a, b) for a, b in spans_of(marks | (copies > 1)))
        held.clear()

    def rows_of():
        got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(schema.types)], schema=schema)
        out.clear()
        return got

    for batch in batches:
        for h, i, j, block, digest, piece, copies in zip(*(batch.column(n).to_pylist() for n in ("hash", "i", "j", "block", "digest", "piece", "copies")), strict=True):
            if (h, i, j) != key:
                if held:
                    close()
                key = h, i, j
            held.setdefault(block, []).append((digest, piece, copies))
        if len(out) > 50_000:
            yield rows_of()
    if held:
        close()
    yield rows_of()


def _dealt(places: DataFrame, most: int) -> DataFrame:
    """The runs of hashes that have many -> spans. Equal runs become one first; the distinct runs of a hash are dealt into
    blocks of about `most`, and each two blocks meet in a task."""
    distinct = saved(places.groupBy("hash", "digest").agg(F.first("piece").alias("piece"), F.count("*").alias("copies")), "distinct-runs")
    sizes = saved(distinct.groupBy("hash").agg(F.count("*").alias("n")), "hash-sizes")
    d = with_counts(distinct, sizes, "hash").withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    d = d.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("hash", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "digest", "piece", "copies")
    spans = d.repartition("hash", "i", "j").sortWithinPartitions("hash", "i", "j").mapInArrow(_merged, "hash long, digest binary, begin long, end long").distinct()
    # a run with very many copies makes this join skewed, not large: AQE splits its side of places
    found = places.select("hash", "digest", *ROW, "first").join(spans, ["hash", "digest"])
    return found.select(*ROW, (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))


def repeated_spans(texts: DataFrame, shard_bytes: int = SHARD, most: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """texts (u, v, text) -> (spans (u, v, begin, end) of repeated bytes, which may overlap; candidates (u, v, text): the
    texts that may have any)."""
    rows = saved(texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(_run_rows, "hash long, u long, v long, first int, last int, twice boolean"), "runs")
    often = saved(rows.groupBy("hash").agg(F.count("*").alias("n"), F.max("twice").alias("again")).filter("n > 1 OR again").select("hash", "n"), "hashes")
    found = with_counts(rows.drop("twice"), often, "hash").groupBy(*ROW).agg(F.collect_set(F.struct("hash", "first", "last", "n")).alias("runs"))
    candidates = saved(texts.join(found, ROW), "candidates")
    drop_saved(rows)
    drop_saved(often)

    def places(cond) -> DataFrame:
        some = candidates.withColumn("runs", F.filter("runs", cond)).filter(F.size("runs") > 0)
        return some.mapInArrow(_pieces, "hash long, u long, v long, first int, piece binary, digest binary")

    few = places(lambda r: r["n"] <= most).select("hash", *ROW, "first", "piece")
    spans = few.repartition("hash").sortWithinPartitions("hash").mapInArrow(_sharded(shard_bytes), "u long, v long, begin long, end long")
    if not candidates.filter(F.exists("runs", lambda r: r["n"] > most)).isEmpty():
        spans = spans.unionByName(_dealt(places(lambda r: r["n"] > most), most))
    return spans, candidates.select(*ROW, "text")


def _cut(batches):
    """Texts with spans -> what is left: u, v, n_removed, n_spans, and the digest of the kept text."""
    for batch in batches:
        out = []
        for u, v, text, spans in zip(*(batch.column(c).to_pylist() for c in ROW), batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
            raw, merged = text.as_py(), []
            for a, b in sorted(zip(spans.values.field("begin").to_pylist(), spans.values.field("end").to_pylist(), strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            out.append((u, v, len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], [*ROW, "n_removed", "n_spans", "kept_sha256"])


def with_row(docs: DataFrame) -> DataFrame:
    """u and v: the same for rows that are the same, and for no others; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("u"), F.xxhash64(F.lit(1), text, "doc_id").alias("v"))


def remove_repeats(docs: DataFrame, **limits) -> DataFrame:
    """docs with doc_id, text -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each of docs.

    A null text is empty; a text below LENGTH bytes loses nothing; repeated rows are texts of their own, so from
    LENGTH bytes on both lose all; null ids keep their rows; extra columns are ignored; no rows give no rows.
    Cuts are made between bytes, inside a character too, so what is left is told by its digest."""
    rows = with_row(docs)
    spans, candidates = repeated_spans(rows.select(*ROW, "text"), **limits)
    cuts = spans.groupBy(*ROW).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    cut = candidates.join(cuts, ROW).mapInArrow(_cut, "u long, v long, n_removed long, n_spans long, kept_sha256 string").distinct()
    whole = rows.select("doc_id", *ROW, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all_sha256"))
    out = whole.join(cut, ROW, "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"))
