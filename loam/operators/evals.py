"""Retrieval quality: expected documents against ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_K, MAX_K


def validate(goldens: list[dict]) -> list[dict]:
    """Goldens with their defaults; a query is required, and k is a whole number from 1 to MAX_K."""
    out = []
    for i, g in enumerate(goldens):
        k = g.get("k", DEFAULT_K)
        if not g.get("query"):
            raise ValueError(f"golden {g.get('id', i)}: no query")
        if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MAX_K:
            raise ValueError(f"golden {g.get('id', i)}: k must be a whole number from 1 to {MAX_K}")
        expect = g.get("expect") or {}
        out.append({"id": str(g.get("id", i)), "query": g["query"], "k": k, "source_files": list(expect.get("source_files") or []), "top_status": list(expect.get("top_status") or []), "filters": g.get("filters") or {}})
    return out


def score(results: DataFrame, goldens: DataFrame) -> DataFrame:
    """results (id, rank, source_file, status), goldens (id, source_files, top_status) -> a row for each golden.

    An expected slug is met by the first result that is it or starts with it and a hyphen."""
    bare = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.md\z", "")
    r = results.select(F.col("id").alias("r_id"), "rank", bare.alias("slug"), "status")
    e = goldens.select("id", F.explode(F.array_distinct("source_files")).alias("expected"))
    hits = e.join(r, (F.col("id") == F.col("r_id")) & ((F.col("slug") == F.col("expected")) | F.startswith(F.col("slug"), F.concat("expected", F.lit("-")))), "left").groupBy("id", "expected").agg(F.min("rank").alias("rank"))
    per = hits.groupBy("id").agg(F.count("rank").alias("found"), F.min("rank").alias("first_rank"))
    top = r.filter("rank = 1").select(F.col("r_id").alias("id"), F.col("status").alias("top"))
    g = goldens.select("id", F.size(F.array_distinct("source_files")).alias("n"), "top_status").join(per, "id", "left").join(top, "id", "left")
    found = F.coalesce("found", F.lit(0))
    ok = F.when((F.size("top_status") > 0) & F.col("top").isNotNull(), F.array_contains("top_status", F.col("top")))
    return g.select("id", F.when((F.col("n") > 0) & (found == F.col("n")), 1.0).otherwise(0.0).alias("hit_at_k"), F.when(F.col("n") > 0, found / F.col("n")).otherwise(1.0).alias("recall_at_k"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), ok.alias("top_status_ok"))


def aggregate(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("goldens"), F.avg("hit_at_k").alias("hit_at_k"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.col("top_status_ok").cast("double")).alias("top_status"))
