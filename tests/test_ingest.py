"""Storing, syncing, streaming and asking: whole paths over small collections."""

import datetime
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loam.api import Tools
from loam.config import Settings
from loam.operators import decisions, drift
from loam.operators.embed import HashedWords
from loam.plans import ingest
from loam.sources import corpus, indexes, store
from loam.streaming import ingest as stream

SETTINGS = Settings(repo_prefix="p", excluded_fields=("token",))


def doc(i, body, deps="[]", status="complete", supersedes="null"):
    return f"---\nfile: 0{i}-dec-d{i}\narea: {i}\ntype: dec\nstatus: {status}\ndepends-on: {deps}\nfeeds-into: []\nsupersedes: {supersedes}\n---\n{body}"


@pytest.fixture
def files(tmp_path):
    root = tmp_path / "docs"
    (root / "TEMPLATES").mkdir(parents=True)
    (root / "01-dec-d1.md").write_text(doc(1, '## Trial length\nfourteen days, token="abc"\n## Other\nmore text here', "[02-dec-d2, gone]"))
    (root / "02-dec-d2.md").write_text(doc(2, "## Price\nten euros", status="superseded"))
    (root / "03-dec-d3.md").write_text(doc(3, "## Price\ntwelve euros", supersedes="02-dec-d2.md"))
    (root / "TEMPLATES" / "t.md").write_text("## template")
    (root / "tracker.html").write_text('<script>var A = [{id: 4, n: "Area four", s: "live",}];</script>')
    return root


def rows(df):
    return sorted((r.source_file, r.section_header, r.content_hash) for r in df.select("source_file", "section_header", "content_hash").collect())


def indexed(spark, files):
    return ingest.index(corpus.markdown(spark, str(files), "p"), SETTINGS, corpus.html(spark, str(files), "p"))


def test_reindex_and_sync(spark, files, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    calls = []

    class Counting(HashedWords):
        def __call__(self, texts):
            calls.append(len(texts))
            return super().__call__(texts)

    ingest.reindex(s, indexed(spark, files), HashedWords(16))
    chunks = s.read("doc_chunks")
    assert {r.source_file for r in chunks.collect()} == {"p/docs/01-dec-d1.md", "p/docs/02-dec-d2.md", "p/docs/03-dec-d3.md", "p/docs/tracker.html"}
    first = chunks.filter("section_header = 'Trial length'").first()
    assert first.content.startswith("File: p/docs/01-dec-d1.md · Type: dec · Status: complete · Area 1, Trial length\n\n") and "[REDACTED:token]" in first.content and len(first.embedding) == 16
    assert s.read("doc_outlines").count() == 3 and s.read("doc_relationships").count() == 3

    # one file changes, one goes, one comes: the same as all anew
    (files / "01-dec-d1.md").write_text(doc(1, "## Trial length\nthirty days"))
    (files / "02-dec-d2.md").unlink()
    (files / "05-dec-d5.md").write_text(doc(5, "## New\nnews"))
    md = corpus.markdown(spark, str(files), "p")
    changed = md.filter(F.col("name").isin("01-dec-d1.md", "05-dec-d5.md"))
    gone = spark.createDataFrame([("p/docs/02-dec-d2.md",)], "source_file string")
    ingest.sync(s, ingest.index(changed, SETTINGS), gone, HashedWords(16))
    again = store.Store(spark, str(tmp_path / "again"))
    ingest.reindex(again, indexed(spark, files), HashedWords(16))
    for t, key in (("doc_chunks", "content_hash"), ("doc_relationships", "target"), ("doc_outlines", "source_file")):
        assert sorted(map(str, s.read(t).select("source_file", key).collect())) == sorted(map(str, again.read(t).select("source_file", key).collect()))

    # what is stored under the same hash is not embedded again
    fresh = ingest.fresh(indexed(spark, files).chunks, s.read("doc_chunks").filter("section_header <> 'New'"), lambda texts: [[9.0]] * len(texts))
    assert [r.section_header for r in fresh.collect() if r.embedding == [9.0]] == ["New"]
    assert store.delete_files(s, spark.createDataFrame([("p/docs/05-dec-d5.md",)], "source_file string")) == 1
    s.append("query_log", spark.range(0).select(F.lit("q").alias("query_scrubbed"), F.array().cast("array<string>").alias("top_k_ids"), F.lit(1).alias("latency_ms"), F.lit("c").alias("caller"), F.current_timestamp().alias("created_at")))
    s.wipe()
    assert s.read("doc_chunks").count() == 0


def test_empty_files_lose_their_chunks(spark, files, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    ingest.reindex(s, indexed(spark, files), HashedWords(4))
    none = spark.createDataFrame([], "source_file string")
    emptied = spark.createDataFrame([("p/docs/03-dec-d3.md", doc(3, "\n"))], "source_file string, text string")
    kept = Settings(repo_prefix="p", parity=True)
    ingest.sync(s, ingest.index(emptied, kept), none, HashedWords(4))
    assert s.read("doc_chunks").filter("source_file = 'p/docs/03-dec-d3.md'").count() == 1
    ingest.sync(s, ingest.index(emptied, SETTINGS), none, HashedWords(4))
    assert s.read("doc_chunks").filter("source_file = 'p/docs/03-dec-d3.md'").count() == 0


def test_stream(spark, files, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    args = (spark, str(files), s, SETTINGS, HashedWords(4), str(tmp_path / "cp"))
    stream.start(*args).awaitTermination(120)
    assert s.read("doc_chunks").select("source_file").distinct().count() == 3
    (files / "06-dec-d6.md").write_text(doc(6, "## Six\nsix"))
    stream.start(*args).awaitTermination(120)
    assert s.read("doc_chunks").select("source_file").distinct().count() == 4
    before = rows(s.read("doc_chunks"))
    stream.upsert(s, SETTINGS, HashedWords(4))(corpus.markdown(spark, str(files), "p").select("source_file", "text"), 9)
    assert rows(s.read("doc_chunks")) == before


def bytes_below(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_small_syncs_write_few_buckets(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"), buckets=128)
    text = lambda k: doc(k % 9, f"## One {k}\n" + f"words of file {k} " * 200 + f"\n## Two\nmore {k}")
    many = spark.createDataFrame([(f"p/docs/f{k}.md", text(k)) for k in range(300)], "source_file string, text string")
    ingest.reindex(s, ingest.index(many, SETTINGS, store=s), HashedWords(16))
    tables = ("doc_chunks", "doc_outlines", "doc_relationships", "file_stats", "chunk_hashes")
    size = lambda: {t: bytes_below(tmp_path / "store" / t) for t in tables}
    whole, before = size(), s.manifest()["tables"]
    few = spark.createDataFrame([("p/docs/f7.md", text(9000)), ("p/docs/new.md", text(9001))], "source_file string, text string")
    gone = spark.createDataFrame([("p/docs/f8.md",)], "source_file string")
    ingest.sync(s, ingest.index(few, SETTINGS, store=s), gone, HashedWords(16))
    after = s.manifest()["tables"]
    changed = {t: sum(before[t].get(b) != after[t].get(b) for b in before[t].keys() | after[t].keys()) for t in tables}
    assert all(0 < changed[t] <= 3 for t in ("doc_chunks", "doc_outlines", "file_stats")) and changed["chunk_hashes"] <= 8
    wrote = size()
    assert wrote["doc_chunks"] - whole["doc_chunks"] <= 0.05 * whole["doc_chunks"]
    assert s.read("doc_chunks").count() == 600 and s.read("chunk_hashes").count() == 600 and s.read("file_stats").agg(F.sum("chunk_count")).first()[0] == 600
    assert store.delete_files(s, spark.createDataFrame([("p/docs/new.md",), ("p/docs/none.md",)], "source_file string")) == 2
    assert sorted(r.source_file for r in s.read_keys("doc_outlines", ["p/docs/f7.md", "p/docs/new.md"]).collect()) == ["p/docs/f7.md"]
    s.clear(keep=1)
    assert s.read("doc_chunks").count() == 598 and not (tmp_path / "store" / "work").exists() or not list((tmp_path / "store" / "work").iterdir())


def test_a_chunk_moves_to_the_file_that_has_it_last(spark, tmp_path):
    """Without a preamble two files can hold the same chunk: one row, of the later file."""
    lite = Settings(repo_prefix="p", lite=True)
    s = store.Store(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], "source_file string")
    frame = lambda *r: spark.createDataFrame(r, "source_file string, text string")
    ingest.sync(s, ingest.index(frame(("p/docs/a.md", "## H\nsame"), ("p/docs/c.md", "## H\nother")), lite), none, HashedWords(4))
    ingest.sync(s, ingest.index(frame(("p/docs/b.md", "## H\nsame")), lite), none, HashedWords(4))
    assert {(r.source_file, r.content) for r in s.read("doc_chunks").collect()} == {("p/docs/b.md", "same"), ("p/docs/c.md", "other")}
    assert {r.source_file for r in s.read("chunk_hashes").collect()} == {r.source_file for r in s.read("file_stats").collect()} == {"p/docs/b.md", "p/docs/c.md"}


def test_a_folder_tells_what_has_changed(spark, files, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    go = lambda: ingest.sync_folder(spark, str(files), s, SETTINGS, HashedWords(4))
    assert go() == {"added": 3, "changed": 0, "deleted": 0, "same": 0}
    version = len(s._numbers())
    assert go() == {"added": 0, "changed": 0, "deleted": 0, "same": 3} and len(s._numbers()) == version
    (files / "sub").mkdir()
    (files / "sub" / "01-dec-d1.md").write_text(doc(1, "## Sub\nof the same name"))
    (files / "01-dec-d1.md").write_text(doc(1, "## Trial length\nthirty days"))
    (files / "02-dec-d2.md").unlink()
    os.utime(files / "03-dec-d3.md", (1, 1))
    assert go() == {"added": 1, "changed": 1, "deleted": 1, "same": 1}
    again = store.Store(spark, str(tmp_path / "again"))
    ingest.reindex(again, ingest.index(corpus.markdown(spark, str(files), "p"), SETTINGS), HashedWords(4))
    assert rows(s.read("doc_chunks")) == rows(again.read("doc_chunks"))
    assert go() == {"added": 0, "changed": 0, "deleted": 0, "same": 3}


def test_a_batch_is_done_once(spark, files, tmp_path, monkeypatch):
    """A stream dies between what it has written and the manifest that names it, and comes again; then one batch comes twice."""
    s = store.Store(spark, str(tmp_path / "store"))
    args = (spark, str(files), s, SETTINGS, HashedWords(4), str(tmp_path / "cp"))
    (files / "sub").mkdir()
    (files / "sub" / "01-dec-d1.md").write_text(doc(1, "## Sub\nof the same name"))

    def dies(manifest):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(s, "_point", dies)
        with pytest.raises(Exception, match="gone"):
            stream.start(*args).awaitTermination(120)
    assert s.read("doc_chunks").isEmpty() and s.manifest()["batches"] == {}
    stream.start(*args).awaitTermination(120)
    assert s.manifest()["batches"] == {str(tmp_path / "cp"): 0}
    assert {r.source_file for r in s.read("doc_chunks").collect()} == {f"p/docs/{n}.md" for n in ("01-dec-d1", "02-dec-d2", "03-dec-d3", "sub/01-dec-d1")}
    version = len(s._numbers())
    done = []
    monkeypatch.setattr(stream, "sync", lambda *a: done.append(a[-1]))
    run = stream.upsert(s, SETTINGS, HashedWords(4), str(tmp_path / "cp"))
    run(spark.createDataFrame([("p/docs/x.md", "## New\nnever seen")], "source_file string, text string"), 0)
    assert len(s._numbers()) == version and not done
    run(spark.createDataFrame([("p/docs/x.md", "## New\nnever seen")], "source_file string, text string"), 1)
    assert done == [(str(tmp_path / "cp"), 1)]


def test_log_days_and_epochs(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    row = lambda q, day: spark.createDataFrame([(q, [], 1, "c", datetime.datetime(2024, 1, day))], "query_scrubbed string, top_k_ids array<string>, latency_ms int, caller string, created_at timestamp")
    asked = lambda: sorted(r.query_scrubbed for r in s.read("query_log").collect())
    assert asked() == []
    s.append("query_log", row("a", 1))
    s.compact_log()  # what the current epoch holds is left for the next time
    s.append("query_log", row("b", 1))
    s.append("query_log", row("c", 2))
    (tmp_path / "store" / "query_log" / "epoch=1" / "torn").mkdir(parents=True)
    assert asked() == ["a", "b", "c"]
    s.compact_log()
    assert asked() == ["a", "b", "c"] and s.manifest()["log"]["days"].keys() == {"2024-01-01"}
    days = s.manifest()["log"]["days"]
    s.compact_log()
    assert asked() == ["a", "b", "c"] and s.manifest()["log"]["days"].keys() == {"2024-01-01", "2024-01-02"} and s.manifest()["log"]["days"]["2024-01-01"] != days["2024-01-01"]
    s.clear(keep=1)
    assert asked() == ["a", "b", "c"] and not (tmp_path / "store" / "query_log" / "epoch=0").exists()
    with pytest.raises(ValueError):
        s.append("decisions", row("x", 1))


def test_tools(spark, files, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    ingest.reindex(s, indexed(spark, files), HashedWords(16))
    d = spark.createDataFrame([(1, "price", 2, "How much", "ten", "02-dec-d2", "2025-01-01", 2), (2, "price-2", 3, "How much now", "twelve", "03-dec-d3", None, None)], "id int, decision_key string, area int, decision string, current_value string, source_doc string, decided_on string, superseded_by int")
    d = d.withColumn("decided_on", F.col("decided_on").cast("date")).withColumn("cross_refs", F.array().cast("array<string>")).withColumn("updated_at", F.current_timestamp())
    s.commit({"decisions": store.merge_decisions(s.read("decisions"), d.select(*s.read("decisions").columns))})
    vendor = drift.stale_strings(spark.createDataFrame([("docs/01-x.md", "ten euros")], "file string, text string"), (__import__("loam.config").config.Pattern("euros", "c", "r"),))
    t = Tools(s, SETTINGS, HashedWords(16), docs=lambda: [drift.stale_signal(vendor)])
    got = t.search_docs("twelve euros", k=3)
    assert got[0]["section_header"] == "Price" and got[0]["source_file"] == "p/docs/03-dec-d3.md" and all(r["status"] != "superseded" for r in got)
    assert t.search("twelve euros", 1)["count"] == 1
    indexes.LexicalIndex(s, stems=False).refresh()
    plain = lambda rows: [{**r, "score": round(r["score"], 9)} for r in rows]
    assert plain(t.search_docs("twelve euros", k=3)) == plain(got)
    with pytest.raises(ValueError):
        t.search("x", 0)
    assert s.read("query_log").count() == 3
    assert t.get_decision(1)["banner"] == "[SUPERSEDED by `price-2` on unknown date]" and [r["id"] for r in t.get_decision("price")["supersedes_chain"]] == [2]
    assert t.get_decision("much now")["banner"] == "[DRAFT]" and t.get_decision("zzz")["banner"] == "[NOT FOUND]"
    n = t.get_doc_neighborhood("p/docs/01-dec-d1.md")
    assert [x["ref"] for x in n["depends_on"]] == ["02-dec-d2", "gone"] and n["warnings"] == ["depends_on `gone` does not resolve to a known doc"]
    assert [c["ref"] for c in t.get_doc_neighborhood("03-dec-d3")["supersedes_chain"]] == ["02-dec-d2"]
    assert [x["ref"] for x in t.get_doc_neighborhood("02-dec-d2")["depended_on_by"]] == ["01-dec-d1"]
    i = t.get_impact_targets("price")
    assert (i["anchor_kind"], i["neighborhood"]["filename"], i["decision"]["id"]) == ("decision", "02-dec-d2", 1) and t.get_impact_targets("no-key")["anchor_kind"] == "doc"
    assert [o["header"] for o in t.get_doc_outline("01-dec-d1")["outline"]] == ["Trial length", "Other"] and t.get_doc_outline("01-dec-d1", 1)["outline"] == []
    r = t.get_drift_report()
    assert (r["total"], r["by_signal"]) == (1, {"stale-string": 1}) and t.get_drift_report(area=2)["total"] == 0
    h = t.check_index_health()
    assert h["total_files"] == 4 and h["stale_files"] == []
    broken = Tools(s, SETTINGS, lambda texts: 1 / 0).search_docs("x")
    assert broken["results"] == [] and broken["error"]
    t.store = None
    assert t.search_docs("x")["error"] and t.unlogged == 1 and t.unlogged_because


def test_sources(spark, files, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(files.parent), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    git = {r.source_file: r for r in corpus.git_provenance(spark, str(files.parent), "p").collect()}
    assert len(git["p/docs/01-dec-d1.md"].git_sha) == 40 and git["p/docs/01-dec-d1.md"].git_committed_at
    assert corpus.git_provenance(spark, str(tmp_path / "none"), "p").count() == 0
    assert sorted((r.path, r.op) for r in corpus.change_set(spark, "a.md b.md", "c.md").collect()) == [("a.md", "changed"), ("b.md", "changed"), ("c.md", "deleted")]
    (tmp_path / "m.json").write_text(json.dumps({"renames": {"a": "b"}, "delete_refs": "x"}))
    assert corpus.rename_map(str(tmp_path / "m.json")).renames == {"a": "b"} and corpus.rename_map(str(tmp_path / "m.json")).delete_refs == () and corpus.rename_map("/nowhere").renames == {}
    (tmp_path / "g.yaml").write_text("goldens:\n  - query: q\n    expect: {source_files: [a]}\n")
    assert corpus.goldens(str(tmp_path / "g.yaml"))[0]["k"] == 10
    (files / "handoff").mkdir()
    (files / "handoff" / "x.md").write_text("x")
    assert {r.file for r in corpus.scanned(spark, str(files)).collect()} == {"docs/01-dec-d1.md", "docs/02-dec-d2.md", "docs/03-dec-d3.md", "docs/TEMPLATES/t.md"}
    assert decisions.collect(corpus.decision_docs(spark, str(files))).count() == 0
    store.export_json(drift.top(drift.collect(drift.stale_signal(drift.stale_strings(corpus.scanned(spark, str(files)), ())))), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == []


def test_versions_of_a_file_and_of_the_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "versions"))
    run = stream.upsert(s, SETTINGS, HashedWords(4))
    early, late = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    run(spark.createDataFrame([("p/docs/a.md", "## H\nnew", late), ("p/docs/a.md", "## H\nold", early)], "source_file string, text string, arrived timestamp"), 0)
    assert [r.content.endswith("new") for r in s.read("doc_chunks").collect()] == [True]
    for _ in range(3):
        s.wipe()
    s.clear(keep=1)
    assert s.read("doc_chunks").isEmpty() and not list((tmp_path / "versions" / "doc_chunks").iterdir())


def test_a_batch_deals_out_some_buckets_at_once_and_leaves_no_shuffles(spark, tmp_path, monkeypatch):
    """In groups of one bucket the tables are those of all at once; what a batch has shuffled is off the disk when it is done."""
    lite = Settings(repo_prefix="p", lite=True)
    text = lambda k: doc(k % 9, f"## One {k}\nwords of file {k}\n## One {k}\nwords of file {k}\n## Same\nin each third file {k % 3}\n###\n# Two\ttabs")
    frame = lambda ks: spark.createDataFrame([(f"p/docs/f{k}.md", text(k)) for k in ks], "source_file string, text string")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in local.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    s, seen, groups = store.Store(spark, str(tmp_path / "store"), buckets=3), shuffled(), []
    monkeypatch.setattr(s, "stage_groups", lambda some, made: groups.append(len(some)) or store.Store.stage_groups(s, some, made))
    with monkeypatch.context() as m:
        m.setattr(store, "AT_ONCE", 1)
        ingest.reindex(s, ingest.index(frame(range(0, 20, 2)), lite, store=s), HashedWords(4))
        ingest.sync(s, ingest.index(frame(range(1, 20, 2)), lite, store=s), frame([2, 99]).select("source_file"), HashedWords(4))
    assert groups == [3, 3] and not shuffled() - seen
    again = store.Store(spark, str(tmp_path / "again"))
    ingest.reindex(again, ingest.index(frame(sorted({*range(20)} - {2})), lite), HashedWords(4))
    for t, columns in (("doc_chunks", ("content_hash", "content", "embedding")), ("doc_outlines", ("source_file", "outline")), ("doc_relationships", ("source_file", "relation", "target"))):
        assert sorted(map(str, s.read(t).select(*columns).collect())) == sorted(map(str, again.read(t).select(*columns).collect()))
    pairs = sorted(map(tuple, s.read("doc_chunks").select("content_hash", "source_file").collect()))
    assert len(pairs) == 22 and pairs == sorted(map(tuple, s.read("chunk_hashes").select("content_hash", "source_file").collect()))
