"""Stored indexes against exact search over the chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import search
from loam.sources import indexes, store

WORDS = "trash trashing run running runs cat cats hope hopeful able token plan planned vector store stores".split()


def chunks(spark, ids, seed=1, dims=8):
    r = random.Random(seed)
    rows = []
    for k in ids:
        v = [r.gauss(0, 1) for _ in range(dims)]
        v = None if k % 17 == 3 else [0.0] * dims if k % 17 == 4 else v[:4] if k % 17 == 5 else v
        rows.append((f"p/docs/f{k % 40}.md", "H", k % 5, ("spec", "dec")[k % 2], " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 60))) if k % 23 else "", f"h{k:04d}", v, ("complete", "superseded", None, "needs-review")[k % 4], None))
    df = spark.createDataFrame(rows, "source_file string, section_header string, area_number int, doc_type string, content string, content_hash string, embedding array<float>, status string, supersedes string")
    return df.withColumns({"updated_at": F.timestamp_seconds(F.lit(0)), **{c: F.lit(None).cast(t) for c, t in (("doc_date", "date"), ("git_sha", "string"), ("git_committed_at", "timestamp"), ("depends_on", "array<string>"), ("feeds_into", "array<string>"), ("also_touches", "array<int>"))}})


def answers(df):
    return [(r.content_hash, r.content, r.status, r.updated_at, round(r.score, 9)) for r in df.collect()]


QUERIES = [("running cats", {}), ("Hopeful planning, stores!", {"include_superseded": True}), ("the of", {}), ("nobody says this", {"area": 2}), ("trash", {"status": "complete", "doc_type": "spec"}), ("vector store plan token", {"doc_type": "dec"})]


def test_hybrid_search_over_indexes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"), buckets=8)
    s.commit({"doc_chunks": chunks(spark, range(300))})
    words = indexes.LexicalIndex(s)
    assert words.refresh() == 8 and words.refresh() == 0
    vector = [0.3, -1.0, 0.5, 0.1, 0.9, -0.2, 0.4, 0.0]
    for query, filters in QUERIES:
        assert answers(indexes.hybrid(s, query, vector, 7, **filters)) == answers(search.hybrid(s.read("doc_chunks"), query, vector, 7, stems=True, **filters)), query
    plan = words.postings(["cat"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,cat)]" in plan
    assert len({f.rsplit("/", 2)[1] for f in words.postings(["cat"]).inputFiles()}) > 1  # all that there are; those of other parts are pruned
    assert {r.term for r in words.postings(["cat", "run"]).collect()} == {"cat", "run"}

    # a sync leaves the index of other buckets as it is
    gone = spark.createDataFrame([("p/docs/f3.md",)], "source_file string")
    new = chunks(spark, range(400, 420)).filter("source_file = 'p/docs/f5.md'").withColumn("source_file", F.lit("p/docs/f3.md"))
    store.replace(s, gone, {}, lambda stored: new, new.select("content_hash"))
    assert words.stale() == s.buckets_of(gone, "source_file") and words.refresh() == 1
    for query, filters in QUERIES[:3]:
        assert answers(indexes.hybrid(s, query, vector, 7, **filters)) == answers(search.hybrid(s.read("doc_chunks"), query, vector, 7, stems=True, **filters)), query
    plain = indexes.LexicalIndex(s, stems=False)
    plain.refresh()


def test_vector_lists(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"), buckets=2)
    index = indexes.VectorIndex(s)
    queries = spark.createDataFrame([(k, [float(np.cos(k * (j + 1))) for j in range(8)]) for k in range(30)] + [(90, None), (91, [0.0] * 8), (92, [1.0])], "query_id long, q array<double>")
    assert index.refresh() == 0 and index.batch_topk(queries, 3).count() == 0 and index.near([1.0] * 8).count() == 0
    s.commit({"doc_chunks": chunks(spark, range(600)).unionByName(chunks(spark, range(700, 760), seed=9).withColumn("embedding", F.array(*[F.lit(0.5).cast("float")] * 8)))})
    assert index.refresh(lists=12) == 2 and index.refresh() == 0
    told = index.told()
    assert told["lists"] == 12 and 1 <= told["probes"] <= 12 and told["recall"] >= 0.95 and told["dims"] == 8
    rows = {r.content_hash: r.embedding for r in s.read("doc_chunks").collect() if r.embedding and len(r.embedding) == 8 and any(r.embedding)}
    hashes = sorted(rows)
    x = indexes._unit(np.array([rows[h] for h in hashes], float))
    exact = {}
    for r in queries.collect():
        if r.q and len(r.q) == 8 and any(r.q):
            score = x @ indexes._unit(np.array([r.q]))[0]
            exact[r.query_id] = [hashes[i] for i in np.lexsort((np.arange(len(hashes)), -np.round(score, 12)))[:5]]

    def got(probes=None):
        out = {}
        for r in index.batch_topk(queries, 5, probes).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.content_hash)
        return out

    whole = got(12)
    assert whole.keys() == exact.keys() and all(whole[q] == exact[q] for q in exact)
    some = got()
    assert sum(len({*some[q]} & {*exact[q]}) for q in exact) >= 0.9 * 5 * len(exact)
    one = index.near([1.0] * 8, 1)
    assert {"h0700", "h0759"} <= {r.content_hash for r in one.collect()} and "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString()
    indexes.LexicalIndex(s).refresh()
    for query, filters in QUERIES[:2]:
        exactly = answers(search.hybrid(s.read("doc_chunks"), query, [0.5] * 8, 7, stems=True, **filters))
        assert answers(indexes.hybrid(s, query, [0.5] * 8, 7, probes=12, **filters)) == exactly

    # new chunks are filed without training; training anew files all
    store.replace(s, spark.createDataFrame([("p/docs/f3.md",)], "source_file string"), {})
    before = index.told()["folder"]
    assert index.refresh() == 1 and index.told()["folder"] == before
    assert s.read("vectors").filter("source_file = 'p/docs/f3.md'").count() == 0 and index.refresh(lists=4, retrain=True) == 2 and index.told()["lists"] == 4


def test_batches_of_queries_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    items = spark.createDataFrame([(k, x) for k, x in enumerate(r.normal(size=(50, 4)).tolist())], "id long, v array<double>")
    queries = items.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    rows = lambda: sorted(map(str, search.batch_topk(items, queries, 3).collect()))
    whole = rows()
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    assert rows() == whole and len(whole) == 150
    assert search.batch_topk(items, queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("stems", [True, False])
def test_counted_lexemes(spark, stems):
    from loam.functions import lexical

    texts = ["Running runs, run! the RUN", "", None, "cats cat"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.c and {x.term: x.tf for x in r.c} for r in df.select("k", lexical.counted(F.col("t"), stems).alias("c")).collect()}
    want = {r.k: r.w for r in df.select("k", lexical.lexemes(F.col("t"), stems).alias("w")).collect()}
    assert got[2] is None and want[2] is None and got[1] == [] and got[0] == ({"run": 4} if stems else {"running": 1, "runs": 1, "run": 2})
    assert all(sum(got[k].values()) == len(want[k]) for k in (0, 3))
