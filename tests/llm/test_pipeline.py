"""The pipeline, stage by stage, against plain Python over the same rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import decontaminate

R = random.Random(8)
EN = ["the", "and", "ing", "of", "wh", "er", "th", "ation", "he", "is"]
FR = ["éau", "que", "eux", "oi", "ment", "ré", "tion", "le", "çon", "dans"]


def prose(syllables, n):
    return " ".join("".join(R.choice(syllables) for _ in range(R.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    items = [(k, prose(EN, 14)) for k in range(4)]
    docs = [(i, prose(EN if i % 3 else FR, 80), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(60)]
    docs += [(60, None, "en", "s0"), (61, "", None, None), (62, "123 ?!", "en", "s1"), (63, prose(EN, 70), None, None)]
    docs += [(70 + k, docs[k][1], docs[k][2], "s9") for k in range(8)] + [(80, docs[20][1] + " one more", "en", "s0"), (21, docs[21][1], "en", "s1")]
    docs += [(90 + k, prose(EN, 30) + " " + items[k][1].replace(" ", "  ", 1) + " " + prose(EN, 30), "en", "s2") for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, items


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark, tables):
    root, docs, items = tables
    now = spark.read.parquet(f"{root}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, now, root), name)
        if name != "token_output":
            assert out.columns == now.columns
            results.append(sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str))
            now = out
    langs, unique, clean, mixed = results
    # language ID: what has letters stays
    assert langs == sorted(((i, t, s) for i, t, _, s in docs if t and any(c.isalpha() for c in t)), key=str)
    # near-dedup: the smallest id of each class, once
    sets = {}
    for i, t, _ in langs:
        sets.setdefault(i, set()).add(shingles(t))
    boss = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and any(100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                boss[b] = min(boss[b], boss[a])
    keep = {i for i in sets if boss[i] == i}
    assert [i for i, *_ in unique] == [i for i, *_ in sorted({(i, t, s) for i, t, s in langs if i in keep}, key=str)]
    # decontamination: no item is quoted
    quotes = lambda t: any(decontaminate.normal(x) in decontaminate.normal(t) for _, x in items)
    assert clean == [r for r in unique if not quotes(r[1])] and len(unique) - len(clean) == 3
    # mixing: targets by weight, at most three times
    size, words = defaultdict(int), {r: len(r[1].encode().split()) for r in clean}
    for r in clean:
        size[r[2]] += words[r]
    names = sorted((s for s in size if s), key=str.encode) + [None] * (None in size)
    weight, full = {s: k % 3 + 1 for k, s in enumerate(names)}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] >= 3 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * size[s] if s in full else share[s] for s in names}
    times = Counter(mixed)
    assert set(times) <= set(clean) and max(times.values()) <= 3
    for s in names:
        largest = max(words[r] for r in clean if r[2] == s)
        assert abs(sum(words[r] * n for r, n in times.items() if r[2] == s) - target[s]) <= largest / 2
    # token output: ids in the library's own encoding
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for _, x, _ in sorted(mixed, key=lambda r: r[0])]
    got = sorted(out.collect(), key=lambda r: r.start)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
    assert [r.start for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables[0]).collect()
    assert got and got[0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, corpus_pipeline.run(spark, tables[0]).collect()))


def test_empty(spark, tables, tmp_path):
    root = tables[0]
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{root}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches(spark, tables, monkeypatch):
    """However long texts are, a stage is handed a few megabytes of them at once; a run leaves the session as it was."""

    def bounded(items):
        def run(batches):
            for batch in batches:
                assert batch.nbytes < 10_000_000
                yield batch

        return run

    monkeypatch.setattr(decontaminate, "_clean", bounded)
    long = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 250_000).alias("text"))
    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.orc.columnarReaderBatchSize"]
    before = [spark.conf.get(n) for n in names]
    try:
        assert corpus_pipeline.decontamination(spark, long, tables[0]).count() == 40
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
    corpus_pipeline.run(spark, tables[0])
    assert [spark.conf.get(n) for n in names] == before
