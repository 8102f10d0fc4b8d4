"""Vector code compression: integer parts of vectors, each named by the nearest entry of a small codebook.

A vector's components become integers, and the vector is cut into parts. Equal parts at one position are one
row with a weight, and Lloyd's rounds run over those distinct rows alone: a task sums what it has by position and
entry, so that a round sends a few hundred rows, whatever the data. Codes and errors are then joined back to
the vectors; parts that very many vectors share are broadcast for that.

Arithmetic is exact: in 64 bits where that holds all squares and sums, else in Python's integers.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved, table, with_rows

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Errors stop at the greatest long.
MOST = 2**63 - 1
_EXACT = pa.decimal128(38, 0)


def _fits(largest: int, *factors: int) -> bool:
    """Whether the product of a largest value and its factors leaves room in 63 bits."""
    for f in factors:
        largest *= max(1, int(f))
    return largest < 2**62


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each part and the squared distance; of equals the lower index."""
    best = code = None
    for k, e in enumerate(entries):
        d = ((parts - e) ** 2).sum(1)
        if best is None:
            best, code = d, np.zeros(len(parts), np.int64)
        else:
            nearer = (d < best).astype(bool)
            best, code = np.where(nearer, d, best), np.where(nearer, k, code)
    return code, best


def _positions(batch, width: int, codebooks: list[list[tuple[int, ...]]]):
    """(position, rows of it, their parts, its entries) for each position of a batch, as numbers that hold all distances."""
    at = batch.column("pos").to_numpy()
    flat = batch.column("part").combine_chunks() if isinstance(batch.column("part"), pa.ChunkedArray) else batch.column("part")
    values = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for pos in np.unique(at):
        rows = np.nonzero(at == pos)[0]
        own, entries = values[rows], codebooks[pos]
        reach = max(abs(int(own.max())), abs(int(own.min())), *(abs(x) for e in entries for x in e))
        kind = np.int64 if _fits(4 * reach * reach, width) else object
        yield int(pos), rows, own.astype(kind), np.array(entries, dtype=kind).reshape(-1, width)


def _sums(width: int, codebooks):
    """Distinct parts -> for each position and entry of a task the weight, and the weighted sum of each component."""

    def run(batches):
        n: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            weights = batch.column("n").to_numpy()
            for pos, rows, own, entries in _positions(batch, width, codebooks):
                w = weights[rows]
                if own.dtype != object and not _fits(int(np.abs(own).max()), int(w.sum())):
                    own = own.astype(object)
                code, _ = nearest(own, entries)
                for k in np.unique(code):
                    some = code == k
                    key = (pos, int(k))
                    n[key] = n.get(key, 0) + int(w[some].sum())
                    sums = (own[some] * w[some, None]).sum(0)
                    total[key] = [a + int(b) for a, b in zip(total.get(key, [0] * width), sums, strict=True)]
        keys = sorted(n)
        cells = [(p, e, j, n[p, e], Decimal(x)) for p, e in keys for j, x in enumerate(total[p, e])]
        columns = list(zip(*cells, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), _EXACT), strict=True)], ["pos", "entry", "j", "n", "total"])

    return run


def _codes(width: int, codebooks):
    """Distinct parts -> pos, part, n with their code and error."""

    def run(batches):
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for _, rows, own, entries in _positions(batch, width, codebooks):
                code[rows], d = nearest(own, entries)
                error[rows] = d if d.dtype != object else [min(int(x), MOST) for x in d]
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), batch.column("n"), pa.array(code), pa.array(error)], ["pos", "part", "n", "code", "err"])

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label) -> uid, vec_id, label, v, dims of the vectors that can be coded: as integers,
    floor(SCALE * x). Vectors that are null or empty, hold null or a component that is not finite or whose integer is
    no long, or don't divide into PARTS, go."""
    held = vectors.select("vec_id", "label", "embedding").filter(F.forall("embedding", lambda x: F.abs(x.cast("double")) < float(2**63 // SCALE)) & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return held.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", v.alias("v"), F.size("embedding").alias("dims"))


def _clipped(total):
    return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def compressed(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256, a row for each vector kept.

    The codebook of each position starts as that part of the smallest `entries` different vec_ids (fewer if there are
    fewer; null is the greatest; of rows with one id the least vector) and is moved `rounds` times. See
    integers() for what is left out; vectors of another length than the smallest vec_id's go too. Rows that repeat
    stay and weigh as often; a null label is a label of its own; errors stop at the greatest long; extra columns are
    ignored; no vectors give no rows."""
    spark = vectors.sparkSession
    rows = saved(integers(vectors), "vectors")
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "dims")).alias("m")).first()["m"]
    if first is None:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    rows, width = rows.filter(F.col("dims") == first["dims"]), first["dims"] // PARTS
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    chosen = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    start = {r["vec_id"]: r["v"] for r in rows.filter(chosen).groupBy("vec_id").agg(F.min("v").alias("v")).collect()}
    codebooks = [[tuple(start[i][p * width : (p + 1) * width]) for i in ids] for p in range(PARTS)]

    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.slice("v", k * width + 1, F.lit(width)))
    parts = rows.select("uid", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct = saved(parts.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds):
        moved = distinct.mapInArrow(_sums(width, codebooks), "pos int, entry int, j int, n long, total decimal(38,0)")
        moved = moved.groupBy("pos", "entry", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        cells = {(r["pos"], r["entry"], r["j"]): int(r["total"]) // r["n"] for r in moved}
        codebooks = [[tuple(cells.get((p, k, j), x) for j, x in enumerate(e)) for k, e in enumerate(book)] for p, book in enumerate(codebooks)]
    digest = hashlib.sha256(",".join(str(x) for book in codebooks for e in book for x in e).encode()).hexdigest()

    coded = saved(distinct.mapInArrow(_codes(width, codebooks), "pos int, part array<long>, n long, code long, err long"), "codes")
    drop_saved(distinct)
    each = with_rows(parts, coded, ["pos", "part"])
    bits = F.expr(f"shiftleft(code, 8 * ({PARTS - 1} - pos))")
    each = each.groupBy("uid", "vec_id", "label").agg(F.sum(bits).alias("bits"), _clipped(F.sum(F.col("err").cast("decimal(38,0)"))).alias("error"))
    each = saved(each.select("vec_id", "label", F.lpad(F.lower(F.hex("bits")), 2 * PARTS, "0").alias("code"), "error"), "coded")
    by_label = saved(each.groupBy("label").agg(_clipped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count("*").alias("n")), "labels")
    return with_rows(each, by_label, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Each round as a table of its own, over all parts: nothing is weighted."""
    near = "SELECT row, vec_id, label, p.pos, part, arg_min(entry, struct_pack(d := d, e := entry)) AS code, min(d) AS err FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(part, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {c} c USING (pos)) p GROUP BY ALL"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT row, vec_id, label, CAST(pos AS INT) AS pos, list_slice(v, CAST(pos * (len(v) // {PARTS}) + 1 AS BIGINT), CAST((pos + 1) * (len(v) // {PARTS}) AS BIGINT)) AS part FROM v, range({PARTS}) t(pos))",
        f"f AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT pos, entry, part AS e FROM p JOIN f USING (row))",
    ]
    for k in range(ROUNDS):
        ctes.append(f"a{k} AS MATERIALIZED ({near.format(c=f'c{k}')})")
        ctes.append(f"m{k} AS (SELECT pos, code, list(x ORDER BY i) AS e FROM (SELECT pos, code, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT pos, code, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM a{k}) GROUP BY pos, code, i) GROUP BY pos, code)")
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c.pos, c.entry, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN m{k} m ON m.pos = c.pos AND m.code = c.entry)")
    ctes.append(f"z AS MATERIALIZED ({near.format(c=f'c{ROUNDS}')})")
    ctes.append("r AS (SELECT row, vec_id, label, string_agg(printf('%02x', CAST(code AS INT)), '' ORDER BY pos) AS code, CAST(sum(err) AS BIGINT) AS error FROM z GROUP BY row, vec_id, label)")
    ctes.append(f"h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM (SELECT pos, entry, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM c{ROUNDS}))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"


ORACLE = _oracle()
