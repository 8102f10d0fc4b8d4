"""Hybrid search over chunks: vector similarity and lexical rank, authority filters, top k."""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_K, LEXICAL_WEIGHT, LOGGED_ERROR, LOGGED_QUERY, MAX_K, MIN_SIMILARITY, STALE_HOURS, VECTOR_WEIGHT
from ..functions import lexical
from ..functions.vectors import cosine, literal
from ..sources.shared import shared_dir
from .scrub import scrub

#: Queries of a batch that go to the tasks at once.
QUERY_BLOCK = 2048
#: Similarities that a task works out at once: 4 MB of them.
SCORES = 500_000
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def clamp_k(k: int) -> int:
    return max(1, min(k, MAX_K))


def authority(status: str | None = None, area: int | None = None, doc_type: str | None = None, include_superseded: bool = False) -> Column:
    """What of a chunk's document has to hold. Asking for superseded documents without including them finds none."""
    c = F.lit(True)
    if status:
        c = c & (F.col("status") == status)
    if area is not None:
        c = c & (F.col("area_number") == area)
    if doc_type:
        c = c & (F.col("doc_type") == doc_type)
    return c if include_superseded else c & (F.col("status").isNull() | (F.col("status") != "superseded"))


def banner(content: Column, status: Column, target: Column) -> Column:
    return F.when(status == "superseded", F.concat(F.lit("[SUPERSEDED, see "), F.coalesce(target, F.lit("(target not declared)")), F.lit("]\n\n"), content)).when(status == "needs-review", F.concat(F.lit("[NEEDS REVIEW, flagged by hygiene loop]\n\n"), content)).otherwise(content)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def rank(scored: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc("content_hash")).limit(clamp_k(k))


def hybrid(chunks: DataFrame, query: str, vector, k: int = DEFAULT_K, stems: bool = False, **filters) -> DataFrame:
    """The k best chunks that are similar enough or hold all of the query's lexemes: content with its banner, score.

    A chunk without a vector has similarity 0. The vector goes along as a literal, and similarity is worked out
    once for each chunk that the authority filters let through."""
    c = chunks.filter(authority(**filters)).withColumn("lexemes", lexical.lexemes(F.col("content"), stems))
    asked = chunks.sparkSession.range(1).select(lexical.lexemes(F.lit(query), stems).alias("q")).first()["q"]
    c = lexical.bm25(c, asked)
    words = F.array(*(F.lit(t) for t in asked)) if asked else F.array().cast("array<string>")
    return shown(best(c, vector, lexical.matches_all(F.col("lexemes"), words), k))


def best(rows: DataFrame, vector, holds: Column, k: int) -> DataFrame:
    """rows (content_hash, embedding, lex, ...) -> the k best by both arms, of those that are similar enough or for which
    `holds` is true, with score."""
    c = rows.withColumn("vec", F.coalesce(cosine(F.col("embedding"), literal(vector)), F.lit(0.0)))
    c = c.filter((F.col("vec") >= MIN_SIMILARITY) | holds)
    return rank(c.withColumn("score", VECTOR_WEIGHT * F.col("vec") + LEXICAL_WEIGHT * F.col("lex")), k)


def shown(hits: DataFrame) -> DataFrame:
    """Chunks with a score as an answer shows them."""
    return hits.select("content_hash", "source_file", "section_header", "area_number", "doc_type", "status", "supersedes", banner(F.col("content"), F.col("status"), F.col("supersedes")).alias("content"), stamp(F.col("updated_at")).alias("updated_at"), "score")


def vectors_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of an Arrow column's vectors of a length, and those vectors as rows; a null within one is no number."""
    at = np.flatnonzero(pc.equal(pc.list_value_length(column), dims).fill_null(False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return at, flat.astype(float).reshape(-1, dims)


def best_of(query: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k greatest scores, query by query; equal scores by the lesser tie."""
    order = np.lexsort((tie, -score, query))
    of = query[order]
    begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    return order[np.arange(len(of)) - np.repeat(begins, np.diff(np.r_[begins, len(of)])) < k]


def raised(kth: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> None:
    """Bring each query's k-th score up to what best_of() has kept of all; fewer than k leave it."""
    n = np.bincount(query, minlength=len(kth))
    full = n >= k
    kth[full] = score[np.cumsum(n)[full] - 1]


def _best(item_id: str, query_ids: list, vectors: np.ndarray, k: int):
    """Arrow batches of (id, v) -> the k most similar of a task's items for each query. At most SCORES similarities are held
    at once; of those only what reaches a query's k-th so far is looked at again."""

    def unit(x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches):
        q = unit(vectors)
        step = max(1, SCORES // max(1, len(q)))
        own, ids, scores, kth = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(q), -np.inf)
        for batch in batches:
            at, x = vectors_of(batch.column("v"), q.shape[1])
            items = batch.column(item_id).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            for i in range(0, len(at), step):
                s = q @ unit(x[i : i + step]).T
                # what is no number reaches nothing
                row, col = np.nonzero(s >= kth[:, None])
                own, ids, scores = np.concatenate([own, row]), np.concatenate([ids, items[i + col]]), np.concatenate([scores, s[row, col]])
                keep = best_of(own, scores, ids, k)
                own, ids, scores = own[keep], ids[keep], scores[keep]
                raised(kth, own, scores, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(query_ids, np.int64)[own]), pa.array(ids), pa.array(scores)], ["query_id", item_id, "score"])

    return run


def by_blocks(queries: DataFrame, run, empty: DataFrame) -> DataFrame:
    """What run(rows) returns for blocks of about QUERY_BLOCK rows of queries (query_id, ...). Only one block is with the
    driver at a time: what it gives is written before the next is fetched."""
    spark = queries.sparkSession
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    for b in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if blocks == 1:
            return run(some) if some else empty
        if some:
            run(some).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)


def ranked(hits: DataFrame, k: int, item_id: str) -> DataFrame:
    """Each task's best (query_id, id, score) -> the k best of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item_id)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def batch_topk(items: DataFrame, queries: DataFrame, k: int, item_id: str = "id") -> DataFrame:
    """items (id, v), queries (query_id, q) -> query_id, id, score, rank of the k most similar items of each query.

    The queries are the stated set, held against all items in blocks of about QUERY_BLOCK: a block goes to the tasks,
    each task keeps its k best for each query, and only those are shuffled. Vectors that are null, of another
    length or of length 0 have no similarity."""
    empty = items.sparkSession.createDataFrame([], f"query_id long, {item_id} long, score double")

    def one(block: list) -> DataFrame:
        by_size: dict[int, list] = {}
        for r in block:
            by_size.setdefault(len(r["q"]), []).append(r)
        found = [items.select(item_id, "v").mapInArrow(_best(item_id, [r["query_id"] for r in rows], np.array([r["q"] for r in rows], float), k), empty.schema) for rows in by_size.values()]
        return reduce(DataFrame.unionByName, found)

    return ranked(by_blocks(queries.filter("q IS NOT NULL").select("query_id", "q"), one, empty), k, item_id)


def log_rows(asked: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """asked (query, ids, latency_ms, caller, error) -> rows for the query log: queries without excluded values, and the
    error where there was one, both cut."""
    text = F.substring(scrub(F.col("query"), fields), 1, LOGGED_QUERY)
    error = F.concat(F.lit(" [error: "), F.substring("error", 1, LOGGED_ERROR), F.lit("]"))
    ids = F.coalesce("ids", F.array()).cast("array<string>")
    return asked.select(F.concat(text, F.coalesce(error, F.lit(""))).alias("query_scrubbed"), ids.alias("top_k_ids"), F.col("latency_ms").cast("int").alias("latency_ms"), "caller", F.current_timestamp().alias("created_at"))


def log_row(spark, query: str, ids: list[str], latency_ms: int, caller: str, fields: tuple[str, ...] = (), error: str | None = None) -> DataFrame:
    """One search as a row for the query log."""
    one = spark.createDataFrame([(query, ids, latency_ms, caller, error or None)], "query string, ids array<string>, latency_ms int, caller string, error string")
    return log_rows(one, fields)


def index_health(chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """A row for each file: chunks, first and last update, stale after STALE_HOURS; the oldest first."""
    g = chunks.groupBy("source_file").agg(F.count("*").alias("chunk_count"), F.min("updated_at").alias("first_updated"), F.max("updated_at").alias("last_updated"))
    return stored_health(g, now)


def stored_health(stats: DataFrame, now: Column | None = None) -> DataFrame:
    """The same from the rows that a store keeps for each file, so that no chunk is read."""
    now = F.current_timestamp() if now is None else now
    s = stats.select("source_file", "chunk_count", "first_updated", "last_updated")
    return s.withColumn("is_stale", F.col("last_updated") < now - F.expr(f"INTERVAL {STALE_HOURS} HOURS")).orderBy("last_updated", "source_file")


def health_totals(health: DataFrame) -> DataFrame:
    return health.agg(F.sum("chunk_count").alias("total_chunks"), F.count("*").alias("total_files"), F.count_if("is_stale").alias("stale_files"))


def field_coverage(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks carry each field, in one pass."""
    n = F.count("*")
    part = lambda cond: F.count_if(cond) / F.nullif(n, F.lit(0))
    return chunks.agg(n.alias("total"), F.count_if(~F.col("content").startswith("File: ")).alias("without_preamble"), part(F.col("git_sha").isNotNull()).alias("git_share"), part(F.col("status").isNotNull()).alias("status_share"), part(F.size("depends_on") > 0).alias("depends_share"))
