"""What failed, or took too much, on larger tables."""

import time

from pyspark.sql import functions as F

from loam.operators import decisions, outline
from loam.plans import catalogue


def test_long_cycles_and_lines(spark):
    """Longer than a recursive query may go, beside a line and a tail that leads into the cycle."""
    ring = [(f"c{i}", f"c{(i + 1) % 150}") for i in range(150)]
    line = [(f"l{i}", f"l{i + 1}") for i in range(300)]
    rows = spark.createDataFrame([*ring, *line, ("tail", "c7"), ("self", "self"), (None, "c1"), ("end", None)], "decision_key string, supersedes string")
    got = {r.decision_key: r.path for r in decisions.cycles(rows).collect()}
    assert got.keys() == {k for k, _ in ring} | {"self"} and got["self"] == ["self", "self"]
    assert all(got[f"c{i}"] == [f"c{(i + k) % 150}" for k in range(151)] for i in range(150))
    assert decisions.cycles(rows.filter("startswith(decision_key, 'l')")).count() == 0


def test_outline_of_many_lines(spark):
    body = "\n".join(("# T", "## A b", "plain", "### A b", "text", "## c")[i % 6] for i in range(1200))
    df = spark.createDataFrame([("f", body)], "source_file string, body string")
    began = time.monotonic()
    got = df.select(outline.outline(F.col("body")).alias("o")).first()["o"]
    assert time.monotonic() - began < 60
    rows = outline.outlines(df).orderBy("char_start").collect()
    assert [tuple(o) for o in got] == [(r.level, r.header, r.anchor, r.char_start, r.char_end) for r in rows]


def test_outline_levels(spark, tmp_path):
    texts = [(1, "\n".join(f"line {i}" for i in range(3000))), (2, "one"), (3, ""), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sections for r in catalogue.outline_levels(spark, str(tmp_path)).collect()}
    assert got == {1: len([i for i in range(3000) if i % 7 == 3]), 2: 0, 3: 0}


def test_similarities_at_once(spark, monkeypatch):
    """Many queries against many items of a batch in little memory, with copies, zeros and nulls among them."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from loam.operators import search
    from loam.sources import indexes

    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (6000, 8)).astype(float)
    v[1000:2000] = v[:1000]
    items = [None if i % 97 == 0 else x.tolist()[: 7 if i % 101 == 0 else 8] for i, x in enumerate(v)]
    for i in (5, 2000):
        items[i][3] = None
    q = v[rng.permutation(6000)[:1500]] + 0.25
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 3000)), pa.array(items[a : a + 3000], pa.list_(pa.float32()))], ["id", "v"]) for a in (0, 3000)]
    tracemalloc.start()
    (got,) = search._best("id", list(range(1500)), q, 5)(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000  # a score of each query and item of a batch would be 36 MB, five times over
    ok = [i for i, x in enumerate(items) if x and len(x) == 8 and None not in x and any(x)]
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(norm(q) @ norm(np.array([items[i] for i in ok], np.float32).astype(float)).T, 9)
    found: dict = {}
    for a, b, s in zip(*(got.column(c).to_pylist() for c in ("query_id", "id", "score")), strict=True):
        found.setdefault(a, []).append((-round(s, 9), b))
    for n in range(0, 1500, 7):
        want = sorted(zip((-scores[n]).tolist(), ok, strict=True))[:5]
        assert [s for s, _ in sorted(found[n])] == [s for s, _ in want]
    lists = np.arange(3000, dtype=np.int32) // 1500
    plain = [pa.RecordBatch.from_arrays([pa.array(lists), pa.array([f"{i:05d}" for i in range(a, a + 3000)]), pa.array((v[a : a + 3000] + 0.5).tolist(), pa.list_(pa.float32()))], ["list", "content_hash", "v"]) for a in (0, 3000)]
    tracemalloc.start()
    (near,) = indexes._nearest(norm(q), list(range(1500)), np.ones((1500, 2), bool), 5)(iter(plain))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000 and near.num_rows == 7500
    scores = np.round(norm(q) @ norm(v + 0.5).T, 9)
    found = {}
    for a, s in zip(near.column("query_id").to_pylist(), near.column("score").to_pylist(), strict=True):
        found.setdefault(a, []).append(round(s, 9))
    for n in range(0, 1500, 7):
        assert sorted(found[n], reverse=True) == sorted(scores[n].tolist(), reverse=True)[:5]


def test_registry_on_all_cores(spark):
    """One partition of documents is read as YAML by many tasks, and once."""
    text = F.concat(F.lit("---\narea: 3\ndecisions:\n  - key: k"), F.col("id").cast("string"), F.lit("\n    decision: d\n    current_value: 1\n---\n"))
    docs = spark.range(200).coalesce(1).select(F.concat(F.lit("03-dec-d"), F.col("id").cast("string"), F.lit(".md")).alias("name"), text.alias("text"))
    rows = decisions.collect(docs)
    assert len(rows.inputFiles()) > 4 and "ArrowEvalPython" not in rows._jdf.queryExecution().toString()
    assert {r.decision_key for r in rows.filter("error IS NULL AND area = 3").collect()} == {f"k{i}" for i in range(200)}


def test_one_block_of_decisions_at_a_time():
    """A worker that goes from block to block holds one automaton, and of each decision few chunks."""
    import gc
    from types import SimpleNamespace

    import pyarrow as pa

    from loam.operators import drift

    def chunks():
        for a in (300, 200, 100, 0):
            yield pa.RecordBatch.from_pydict({"source_file": [f"f{i:03d}" for i in range(a + 99, a - 1, -1)], "section_header": [None] * 100, "low": ["a settled matter"] * 100})

    for token in ("one", "two", "three"):
        block = SimpleNamespace(token=token, value=[("k" + token, "settled", "done", "own")])
        (got,) = drift._hits(block)(chunks())
        assert got.to_pydict() == {"decision_key": ["k" + token] * 5, "source_file": [f"f{i:03d}" for i in range(5)], "section_header": [None] * 5}
        gc.collect()
        assert sum(isinstance(x, drift._Mentions) for x in gc.get_objects()) == 1


def test_postings_in_blocks(spark, tmp_path):
    """A term is a row for each block, not for each chunk that has it; all counts are there, and nulls and stop words."""
    from test_indexes import chunks

    from loam.functions import lexical
    from loam.sources import indexes, store

    s = store.Store(spark, str(tmp_path / "store"), buckets=2)
    rows = chunks(spark, range(400)).withColumn("content", F.when(F.col("content_hash") == "h0007", None).when(F.col("content_hash") == "h0008", "The ÉCOLES of y's: hoping, 42 hopes").otherwise(F.col("content")))
    s.commit({"doc_chunks": rows})
    index = indexes.LexicalIndex(s)
    index.refresh()
    want = {(r.content_hash, t.term): t.tf for r in rows.select("content_hash", lexical.counted(F.col("content")).alias("c")).collect() for t in r.c or []}
    terms = sorted({t for _, t in want})
    got = index.postings(terms).join(s.read("lengths"), ["block", "no"]).collect()
    assert {(r.content_hash, r.term): r.tf for r in got} == want and len(got) == len(want) and ("h0008", "écoles") in want
    assert s.read("postings").count() * 5 < len(want)
    lengths = {r.content_hash: r.n for r in s.read("lengths").collect()}
    assert len(lengths) == 400 and lengths["h0007"] is None and lengths["h0008"] == 5


def test_stems_of_many_words():
    """Published examples of the algorithm; a word takes some microseconds, as made-up ones are many."""
    from loam.functions import lexical

    told = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit radically:radic vietnamization:vietnam hopefulness:hope formaliti:formal triplicate:triplic electrical:electr goodness:good revival:reviv allowance:allow adjustment:adjust adoption:adopt probate:probat rate:rate cease:ceas controll:control roll:roll yields:yield"
    assert {w: lexical.stem(w) for w, _, _ in (x.partition(":") for x in told.split())} == dict(x.split(":") for x in told.split())


def test_report_goes_over_texts_once(spark):
    from loam.operators import audit

    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(f"00-dec-d{i}.md", "no block" if i % 2 else "---\nfile: 1\n---\n") for i in range(20)] + [("track-x.md", "")], "name string, text string")
    rows = audit.audit(docs)
    text = audit.report(docs, rows.mapInArrow(told, rows.schema))
    assert seen.value == rows.count() > 20
    assert text.startswith(audit.report_head(docs, rows) + "\n## Violations\n\n### 00-dec-d0.md\n") and text.endswith("## Clean files\n\n- track-x.md\n")
    assert "- Total: 21\n- Clean: 1\n- With violations: 20\n" in text


def test_words_are_hashed_once(monkeypatch):
    """Each different word once over all texts, and the same vectors as hashing word by word gives."""
    import hashlib

    import numpy as np

    from loam.operators import embed

    asked, plain = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda x, **k: asked.append(x) or plain(x, **k))
    texts = ["To be or not to be", "be É be be", "", "be"]
    got = embed.HashedWords(8)(texts)
    assert sorted(asked) == sorted(x.encode() for x in ["to", "be", "or", "not", "é", "to be", "be or", "or not", "not to", "to be", "be é", "é be", "be be"])
    for t, v in zip(texts, got, strict=True):
        want, words = np.zeros(8), t.lower().split()
        for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            h = int.from_bytes(plain(w.encode(), digest_size=8).digest(), "little")
            want[h % 8] += 1 if h >> 63 else -1
        assert v == (want / max(np.linalg.norm(want), 1e-12)).tolist()
