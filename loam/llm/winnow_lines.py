"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that are not blank, each without white space at its ends. In every
WINDOW lines in a row the least hash (the last of equals) is picked as a fingerprint, so that any two runs of
WINDOW equal lines share one. Only windows whose fingerprint is picked at two places are candidates; a
candidate is then known by a hash of all its lines (128 bits), so that equal candidates are equal runs however frequent a
line among them is. Fewer lines than WINDOW that hold LONG words or more together are candidates too, each with
its own hash as fingerprint. The first place of a candidate, by id and place, stays; its lines are deleted at
every later one. Longer runs are the candidates that overlap or touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, with_counts

WINDOW = 3
#: Words from which a run counts however few its lines are.
LONG = 50
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_hashes(text: str | None) -> np.ndarray:
    """Two 64-bit halves of a hash of each line that is not blank: fingerprints are picked by the first, runs told by both."""
    lines = (x.strip() for x in (text or "").split("\n"))
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines if x]), np.int64).reshape(-1, 2)


def least_places(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The place of the least hash of each window, the last of equals; none if there are fewer lines."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.int64)
    least, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, window):
        lower = hashes[k : k + n] <= least
        least[lower] = hashes[k : k + n][lower]
        at[lower] = np.flatnonzero(lower) + k
    return at


def picks(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each window, each once."""
    return np.unique(least_places(hashes, window))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` lines in a row, in their order, from one half of the lines' hashes."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(32))) * _MIX + hashes[k : k + n].view(np.uint64)
    return out.view(np.int64)


def long_runs(text: str | None, hashes: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, both hashes) of the runs that hold LONG words, for each number of lines under `window`."""
    # LONG words take as many characters and the spaces between them
    if len(text or "") < 2 * LONG - 1:
        return []
    counts = np.array([len(x.encode("utf-8", "surrogatepass").split()) for x in text.split("\n") if x.strip()], np.int64)
    before = np.r_[0, np.cumsum(counts)]
    out = []
    for size in range(1, min(window, len(hashes) + 1)):
        at = np.flatnonzero(before[size:] - before[:-size] >= LONG)
        out.append((at, np.column_stack([run_hashes(hashes[:, k], size)[at] for k in range(2)])))
    return out


def _prints(window: int):
    def run(batches):
        for batch in batches:
            found = [np.empty(0, np.int64)]
            for text in batch.column("text").to_pylist():
                hashes = line_hashes(text)
                found += [hashes[picks(hashes[:, 0], window), 0], *(h[:, 0] for _, h in long_runs(text, hashes, window))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["print"])

    return run


def _candidates(window: int):
    def run(batches):
        """A row for each candidate: its fingerprint, its own hash in two halves, and where it starts and stops."""
        for batch in batches:
            found = [np.empty((0, 6), np.int64)]
            for k, text in enumerate(batch.column("text").to_pylist()):
                hashes = line_hashes(text)
                at = least_places(hashes[:, 0], window)
                first = np.arange(len(at))
                found.append(np.column_stack([np.full(len(at), k), hashes[at, 0], *(run_hashes(hashes[:, h], window) for h in range(2)), first, first + window]))
                for size, (first, own) in enumerate(long_runs(text, hashes, window), 1):
                    found.append(np.column_stack([np.full(len(first), k), own[:, 0], own, first, first + size]))
            rows = np.concatenate(found).T
            ids = [batch.column(c).take(pa.array(rows[0])) for c in ("doc_id", "uid")]
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, rows[1:4]), *(pa.array(x.astype(np.int32)) for x in rows[4:])], ["doc_id", "uid", "print", "run", "run2", "first", "stop"])

    return run


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, uid, text) -> doc_id, uid, first, stop: later runs of lines, by their places among the lines
    that are not blank. Rows of one document may overlap."""
    twice = docs.mapInArrow(_prints(window), "print long").groupBy("print").agg(F.count("*").alias("n")).filter("n > 1")
    twice = saved(twice, "prints")
    every = docs.mapInArrow(_candidates(window), "doc_id long, uid long, print long, run long, run2 long, first int, stop int")
    found = saved(with_counts(every, twice, "print").drop("print", "n"), "candidates")
    anchors = found.groupBy("run", F.col("run2").alias("anchor_run2")).agg(F.min(F.struct("doc_id", "uid", "first")).alias("anchor"), F.count("*").alias("n")).filter("n > 1")
    # of runs that share the first half of their hash each meets the anchors of all, and keeps its own
    later = with_counts(found, saved(anchors, "anchors"), "run").filter((F.col("run2") == F.col("anchor_run2")) & ~F.struct("doc_id", "uid", "first").eqNullSafe(F.col("anchor")))
    return later.select("doc_id", "uid", "first", "stop")


def _cut(batches):
    for batch in batches:
        out = []
        for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            full = [k for k, x in enumerate(lines) if x.strip()]
            gone, n_runs, end = set(), 0, -1
            for r in sorted(runs or [], key=lambda r: (r["first"], r["stop"])):
                n_runs += r["first"] > end
                end = max(end, r["stop"])
                gone.update(range(full[r["first"]], full[r["stop"] - 1] + 1))
            left = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
            out.append((doc_id, len(full), sum(k in gone for k in full), n_runs, left))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], ["doc_id", "n_lines", "n_removed", "n_runs", "text"])


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with doc_id, text -> doc_id, n_lines, n_removed, n_runs, text (what is left), a row for each of docs.

    n_lines and n_removed count lines that are not blank; blank lines inside a deleted run go with it; runs that
    touch are one of n_runs. A null text stays null and has no lines; a text of fewer than `window` lines loses
    only lines of LONG words together; rows repeated exactly are one document and lose the same lines; ids that tie go by a hash of id and
    text, a null id comes first; extra columns are ignored; no rows give no rows."""
    rows = docs.select("doc_id", "text").withColumn("uid", F.xxhash64("doc_id", "text"))
    runs = repeated_runs(rows, window).groupBy("doc_id", "uid").agg(F.collect_set(F.struct("first", "stop")).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("r_doc"), F.col("uid").alias("r_uid"), "runs")
    joined = rows.join(runs, (F.col("uid") == F.col("r_uid")) & F.col("doc_id").eqNullSafe(F.col("r_doc")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, n_lines long, n_removed long, n_runs long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    left = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_runs", left.alias("kept_sha256"))

