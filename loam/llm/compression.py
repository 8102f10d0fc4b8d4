"""Quality rules by compression bands.

Repetitive text compresses far better than prose, and encoded or random text far worse. Each text is
compressed with zstandard as a whole and again in fixed chunks; the ratio (compressed bytes to bytes)
must lie in a band. A short text has little to refer back to, so the band depends on the length.

Random letters and hexadecimal digits use few symbols and so compress about as well as prose does, but not for
the order they stand in: with their bytes transposed they compress as well as before, and prose far worse. A
chunk is also out if its order gains it nothing.

The bands are wide, since they hold for any collection. What is repetitive beside its peers shows in the collection
itself: of all texts in a class of length the median ratio and the spread around it are found from histograms, and a
text that lies many spreads off is out too.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Bytes from which a band holds, and its lowest and highest ratio. The highest lies between prose (0.79 at 350
#: bytes, 0.59 at 2 kB, 0.44 at 16 kB at most) and base64 text (0.89, 0.76, 0.75), the lowest above lines of one template.
BANDS = ((0, 0.38, 0.86), (400, 0.38, 0.82), (512, 0.34, 0.78), (700, 0.34, 0.74), (1024, 0.29, 0.70), (2048, 0.25, 0.66), (4096, 0.22, 0.60), (8192, 0.22, 0.55), (16384, 0.19, 0.50), (65536, 0.16, 0.45))
#: Bytes of a chunk (a rest below half of that joins the chunk before it), its band, and the share of a
#: text's chunks that may lie outside.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 2048, (0.25, 0.66), 0.34
#: Bytes of a chunk from which a limit of its size to its size transposed holds, and that limit: random text has 0.977 and
#: more at this level. Below the first, prose has as much.
ORDER, ORDER_LEVEL = ((1024, 0.972), (1536, 0.96)), 9
#: Columns of the transposition.
COLUMNS = 17
LEVEL = 3
#: Spreads below and above (1.4826 times the median distance from the median, and LEAST_SPREAD at least) that a ratio may lie off those
#: of its class of length; and how many texts the fixed band weighs in a class's limits, so that they pass over from the band
#: to the peers as a class grows.
SPREADS, LEAST_SPREAD, BAND_WEIGHT = (5.0, 7.0), 0.005, 5
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"

FIELDS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_bytes", "long"), ("ratio", "double"), ("n_chunks", "int"), ("n_chunks_out", "int"), ("band", "int"))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, its first place included."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = (h[:-2] * _MIX[0] + h[1:-1]) * _MIX[1] + h[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def chunks(raw: bytes, size: int = CHUNK) -> list[bytes]:
    n = max(1, (len(raw) + size // 2) // size)
    return [raw[i * size : (i + 1) * size if i + 1 < n else len(raw)] for i in range(n)]


@lru_cache(maxsize=4)
def _at_level(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)


def unordered(raw: bytes) -> bool:
    """Whether the order of the bytes of a chunk gains it nothing."""
    k = bisect_right(ORDER, (len(raw), 2.0)) - 1
    if k < 0:
        return False
    squeeze = _at_level(ORDER_LEVEL)
    return len(squeeze.compress(raw)) > ORDER[k][1] * len(squeeze.compress(b"".join(raw[i::COLUMNS] for i in range(COLUMNS))))


def measure(text: str | None, squeeze: zstandard.ZstdCompressor) -> tuple:
    """The values of FIELDS for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MOST_REPEATED * n
    ratio, parts, out = 0.0, [], 0
    if raw:
        ratio = len(squeeze.compress(raw)) / len(raw)
        parts = chunks(raw)
        ratios = [ratio] if len(parts) == 1 else [len(squeeze.compress(x)) / len(x) for x in parts]
        out = sum((len(raw) >= CHUNK and not CHUNK_BAND[0] <= x <= CHUNK_BAND[1]) or unordered(p) for p, x in zip(parts, ratios, strict=True))
    band = bisect_right(BANDS, (len(raw), 2.0)) - 1
    _, low, high = BANDS[band]
    kept = not failed and low <= ratio <= high and out <= CHUNK_SHARE * len(parts)
    return n, len(text or "") - (len(raw) - len(raw.translate(None, SPACE))), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, kept, len(raw), ratio, len(parts), out, band


def _batches(batches):
    squeeze = _at_level(LEVEL)
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    for batch in batches:
        rows = [measure(x.as_py(), squeeze) for x in batch.column("text")]
        columns = list(zip(*rows, strict=True)) or [[] for _ in FIELDS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, FIELDS, strict=True))], ["doc_id", *(n for n, _ in FIELDS)])


def usual(measured: DataFrame, spreads: tuple[float, float] = SPREADS, weight: float = BAND_WEIGHT) -> DataFrame:
    """What _batches gave -> band, low, high: a row for each class of length that has texts which pass the base rules.
    What the median and the spread of n texts allow counts n, the fixed band `weight`. Medians come from histograms in
    steps of a thousandth, so that a class is a few hundred rows."""
    cells = measured.filter(~F.col("base_failed")).groupBy("band", F.round(F.col("ratio") * 1000).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    mid = cells.groupBy("band").agg(F.expr("percentile(cell, 0.5, n)").alias("mid"), F.sum("n").alias("texts"))
    far = cells.join(mid, "band").groupBy("band", "mid", "texts").agg(F.expr("percentile(abs(cell - mid), 0.5, n)").alias("far"))
    spread, mid = F.greatest(F.col("far") * 1.4826 / 1000, F.lit(LEAST_SPREAD)), F.col("mid") / 1000
    fixed = [F.array(*(F.lit(b[k]) for b in BANDS))[F.col("band")] for k in (1, 2)]
    shared = lambda own, band: (F.col("texts") * own + F.lit(float(weight)) * band) / (F.col("texts") + F.lit(float(weight)))
    return far.select("band", shared(mid - spreads[0] * spread, fixed[0]).alias("low"), shared(mid + spreads[1] * spread, fixed[1]).alias("high"))


def compression_bands(docs: DataFrame, spreads: tuple[float, float] = SPREADS, weight: float = BAND_WEIGHT) -> DataFrame:
    """docs with doc_id, text -> doc_id and FIELDS, a row for each of docs.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. kept: not base_failed,
    and whole-text and chunk ratios within their bands, and chunks in an order that gains, and the whole-text ratio within
    the limits of its class of length (`band`): `spreads` around the median of its texts in docs, drawn towards the fixed
    band as if that were `weight` texts; a text alone is held to its band, for a tenth of a class the limits move by what
    its median, spread and share of that weight do. A null or empty text has
    no words and fails; a null id stays null; repeated rows are judged alike, each by itself; extra columns are ignored;
    no rows give no rows. A text is compressed whole, whatever its length."""
    measured = docs.select("doc_id", "text").mapInArrow(_batches, "doc_id long, " + ", ".join(f"{n} {k}" for n, k in FIELDS))
    measured = saved(measured, "ratios")
    # one row for each of BANDS
    rows = measured.join(F.broadcast(usual(measured, spreads, weight)), "band", "left")
    within = F.coalesce(F.col("ratio").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.withColumn("kept", F.col("kept") & within).select("doc_id", *(n for n, _ in FIELDS))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return compression_bands(table(spark, sf_dir, "documents"))
