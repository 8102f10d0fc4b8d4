"""Fuzzy lookup, contradictions and chains against brute force over every pair."""

import random
import re

from pyspark.sql import functions as F

from loam.operators import decisions, drift, graph


def like(pattern, text):
    body = "".join({"%": ".*", "_": "."}.get(p) or re.escape(p[1:] if len(p) == 2 else p) for p in re.findall(r"\\.|.", pattern, re.S))
    return text is not None and re.fullmatch(body.lower(), text.lower(), re.S) is not None


def shape(df):
    return df._jdf.queryExecution().executedPlan().toString()


def registry(r, n):
    words = ["Trial", "length", "price", "éa", "İx", "50% off", "under_score", "a\\b", "", "Zz"]
    text = lambda: r.choice([None, " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))])
    return [(k, f"key-{k}", text(), text()) for k in range(n)]


def test_fuzzy_lookup(spark):
    r = random.Random(1)
    rows = registry(r, 80)
    d = spark.createDataFrame(rows, "id int, decision_key string, decision string, current_value string")
    asked = ["trial", "L", "le", "%", "", "_", "______", "_" * 60, "t%l", "50\\% O", "r_s", "é", "İ", "price%price", "zzz", "nothing here", "a\\\\b", "3", "key-4", "999", "%_%", "ial len", "zz", None, "trial"]
    q = spark.createDataFrame([(x,) for x in asked], "query string")
    got = {}
    for row in decisions.lookup(q, d).orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append((row["rank"], row["id"], row["matched_by"]))
    for x in {*asked} - {None}:
        if x in ("3", "key-4"):
            want = [(1, int(x[-1]), "id" if x == "3" else "key")]
        else:
            met = [(len(t) if t is not None else -1, key, i) for i, key, t, v in rows if like(f"%{x}%", t) or like(f"%{x}%", v)]
            want = [(n, i, "text") for n, (_, _, i) in enumerate(sorted(met)[:5], 1)]
        assert got.get(x, []) == want, x
    assert decisions.lookup(q.limit(0), d).count() == 0 and decisions.lookup(q, d.limit(0)).count() == 0
    plan = shape(decisions.lookup(q, d))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contradictions_of_all_decisions(spark, monkeypatch):
    r = random.Random(2)
    words = ["trial length", "Price list", "hundred% sure", "under_scored", "éclair case", "many words here", "back\\slash it"]
    rows = [(f"k{k}", r.choice([None, "%%%%%%%%", *words]), r.choice([None, "ten", "50%", "x_y", "a longer value that goes on and on, past what is looked for"]), r.choice([None, "d1", "d2"]), r.choice([None, None, 1])) for k in range(40)]
    bits = ["TRIAL length", "price LIST", "hundred per cent sure", "hundred% sure", "under-scored", "Éclair case", "many words here", "ten", "50 of", "x-y", "backslash it", "back\\slash it"]
    chunks = [(r.choice([None, *(f"p/docs/d{k}.md" for k in range(30))]), r.choice([None, "a", "b"]), r.choice([None, " ".join(r.choice(bits) for _ in range(r.randrange(4)))])) for _ in range(120)]
    d = spark.createDataFrame(rows, "decision_key string, decision string, current_value string, source_doc string, superseded_by int")
    c = spark.createDataFrame(chunks, "source_file string, section_header string, content string")
    want = []
    for key, text, value, doc, gone in rows:
        if None in (text, value, doc) or gone is not None or not 8 <= len(text) <= 80:
            continue
        met = [(f, s is not None, s or "") for f, s, t in chunks if f and t is not None and f != f"p/docs/{doc}.md" and like(f"%{text}%", t) and not like(f"%{value[:40]}%", t)]
        want += [(f, s if told else None, value) for f, told, s in sorted(met)[:5]]
    got = lambda most=None: sorted(((x.file, x.snippet, x.suggested_replacement) for x in drift.contradictions(d, c, "p", most).collect()), key=str)
    assert got() == sorted(want, key=str) and len(want) > 50
    assert len(got(most=3)) < len(want)
    monkeypatch.setattr(drift, "MENTIONED", 4)
    assert got() == sorted(want, key=str)
    plan = shape(drift.contradictions(d, c, "p"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert drift.contradictions(d.limit(0), c, "p").count() == 0 and drift.contradictions(d, c.limit(0), "p").count() == 0


def test_chains_by_doubling(spark):
    r = random.Random(3)
    # lines longer than any chain, rings, loops, ends that nobody knows
    after = {k: k + 1 for k in range(40)} | {50: 51, 51: 52, 52: 50, 53: 50, 60: 60, 61: 60, 70: 999} | {k: r.randrange(100, 140) for k in range(100, 140)}
    ids = sorted(after) + [40]
    d = spark.createDataFrame([(k, after.get(k)) for k in ids], "id int, superseded_by int")
    want = []
    for k in ids:
        at, seen, hop = k, set(), 0
        while at not in seen and at in after and after[at] in ids and hop < 10:
            seen.add(at)
            at, hop = after[at], hop + 1
            want.append((k, hop, at))
    assert sorted(map(tuple, decisions.successors(d).collect())) == sorted(want)
    some = d.filter("id IN (3, 53, 61)")
    assert sorted(map(tuple, decisions.successors(d, starts=some).collect())) == sorted(w for w in want if w[0] in (3, 53, 61))
    name = lambda k: f"p/docs/{k}.md"
    meta = spark.createDataFrame([(name(k), f"{after[k]}.md" if k in after else None, "complete") for k in ids], "source_file string, supersedes string, status string")
    want = []
    for k in ids:
        at, seen, hop = k, {k}, 0
        while at in after and after[at] not in seen and hop < 10:
            at, hop = after[at], hop + 1
            seen.add(at)
            want.append((name(k), hop, str(at), name(at), None if at not in ids else "complete", at not in ids))
    assert sorted(map(str, map(tuple, graph.supersedes_chain(meta, "p").collect()))) == sorted(map(str, want))
    one = graph.supersedes_chain(meta, "p", meta.filter(F.col("source_file") == name(3))).collect()
    assert len(one) == 10 and graph.supersedes_chain(meta.limit(0), "p").count() == 0
    assert decisions.successors(d, depth=1).count() == len([k for k in ids if after.get(k) in ids])


def test_lines_with_wildcards_as_they_stand(spark, tmp_path):
    """Documents' lines are looked for as they are, as in the SQL: their %, _ and \\ are no wildcards."""
    from loam.plans import catalogue

    texts = [(0, "All 100% sure_of it\nback\\slash% it"), (1, "all 100 per cent sure of it"), (2, "so: ALL 100% SURE_OF IT"), (3, "all 100% sureXof it"), (4, "backslash it"), (5, "x back\\slash% it"), (6, "back\\slash or it"), (7, "settled value 1, all 100% sure_of it")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.suggested_replacement, int(r.file.rsplit("-", 1)[1][:-3])) for r in catalogue.drift_contradict(spark, str(tmp_path)).collect())
    assert got == [("settled value 1", 0), ("settled value 1", 2), ("settled value 2", 0), ("settled value 2", 5)]
    counts = {r.signal: r["items"] for r in catalogue.drift_by_signal(spark, str(tmp_path)).collect()}
    assert counts["decision-contradict"] == 4
