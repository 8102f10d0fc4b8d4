"""Operators of the collection on examples worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loam.config import Pattern, RenameMap, Settings
from loam.functions import lexical, text, vectors
from loam.operators import audit, chunk, decisions, drift, embed, evals, frontmatter, graph, outline, scrub, search, tracker

DOC = """---
file: 03-dec-stack
area: 3
area-name: Engineering
type: dec
title: "Stack"
status: complete
date: 2025-01-02
depends-on:
  - 01-str-plan
  - "area-3-engineering"
feeds-into: [02-spec-x, '04-res-y']
also-touches: [4, six, 6]
supersedes: 02-dec-old.md
decisions:
  - key: vector-store
    decision: Where vectors live
    current_value: one database
    decided_on: 2025-01-02
    supersedes: older-store
  - key: api
    decision: API style
    current_value: 3
    status: draft
---

## One
text

### Sub
more
## Two #
"""


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("c")).first()["c"]


def test_text(spark):
    assert one(spark, text.lines(F.col("t")), t="a\r\nb\x0bc\x85\n") == ["a", "b", "c", ""]
    assert one(spark, text.lines(F.col("t")), t="") == []
    assert one(spark, text.strip(F.col("t")), t="　 x\n y\xa0\t") == "x\n y"
    assert one(spark, text.rfind(F.col("t"), "ab"), t="abxab😀") == 3 and one(spark, text.rfind(F.col("t"), "z"), t="ab") == -1
    assert one(spark, text.slugify(F.col("t")), t=" Über_uns & mehr! -") == "über-uns-mehr"
    assert [str(one(spark, text.iso_date(F.col("t")), t=x)) for x in ("2025-01-02", "20250102", "2025-13-01", "x")] == ["2025-01-02", "2025-01-02", "None", "None"]


def test_vectors(spark):
    a = vectors.cosine(vectors.literal([1, 0]), vectors.literal([1, 1]))
    assert abs(one(spark, a) - 2**-0.5) < 1e-9
    assert one(spark, vectors.cosine(vectors.literal([1, 0]), vectors.literal([0, 0]))) is None
    assert one(spark, vectors.cosine(vectors.literal([1, 0]), vectors.literal([1, 0, 0]))) is None


def test_frontmatter(spark):
    rows = {"a": DOC, "b": "no block", "c": "---\nopen", "d": "---\nstatus: ~\ndate: nope\ndepends-on: solo\n---\n"}
    df = spark.createDataFrame(list(rows.items()), "source_file string, text string")
    got = {r.source_file: r for r in frontmatter.parse(df).collect()}
    a = got["a"]
    assert (a.area_number, a.doc_type, a.status, str(a.doc_date), a.supersedes) == (3, "dec", "complete", "2025-01-02", "02-dec-old")
    assert (a.depends_on, a.feeds_into, a.also_touches) == (["01-str-plan", "area-3-engineering"], ["02-spec-x", "04-res-y"], [4, 6])
    assert a.body.startswith("## One") and got["b"].body == "no block" and got["c"].body == "---\nopen" and got["c"].depends_on == []
    assert got["d"].status is None and got["d"].doc_date is None and got["d"].depends_on == ["solo"]
    nested = frontmatter.parse(df.filter("source_file = 'a'"), nested=True).first()
    assert nested.status == "draft" and nested.supersedes == "older-store"


def test_chunks(spark):
    body = "intro\n## A\nx\n## #B\ny\n## Empty\n\n## C\n" + "### D\nd\n### E\n" + "word " * 1700
    df = spark.createDataFrame([(body,)], "body string")
    got = [(r.section_header, len(r.content)) for r in chunk.chunks(df).orderBy("chunk_no").collect()]
    assert [h for h, _ in got] == ["(intro)", "A", "C > D", "C > E (part 1)", "C > E (part 2)", "C > E (part 3)"]
    assert all(n <= 4000 for _, n in got)


@pytest.mark.parametrize("t", ["x" * 4000, "x" * 4001, "a" * 3500 + "\n\n" + "b" * 300 + "\n" + "c" * 400 + " " + "d" * 900, "a" * 3100 + "\n\n" + "b " * 2000, "😀" * 3999 + " " + "y" * 10, " " * 9000, ("line of text\n" * 900)])
def test_soft_cuts(spark, t):
    rest, want = t, []
    while rest:
        n = len(rest)
        if n > 4000:
            w = rest[3200:4000]
            n = next((3200 + w.rfind(x) + len(x) for x in ("\n\n", "\n", " ") if x in w), 4000)
        want.append(n)
        rest = rest[n:]
    assert [len(p) for p in one(spark, chunk.soft_pieces(F.col("t")), t=t)] == want


def test_hard_pieces(spark):
    got = one(spark, chunk.hard_pieces(F.lit("h"), F.col("t")), t="z" * 8001)
    assert [(p.header, len(p.content)) for p in got] == [("h (part 1)", 4000), ("h (part 2)", 4000), ("h (part 3)", 1)]
    assert one(spark, chunk.hard_pieces(F.lit("h"), F.col("t")), t="z")[0].header == "h"


SCRUB = [
    ('ssn: "123-45-6789"', "ssn: [REDACTED:ssn]"), ('{"api_key": "sk-abc123"}', '{"api_key": [REDACTED:api_key]}'), ("user.api_key=sk-xyz;", "user.api_key=[REDACTED:api_key];"),
    ("the `ssn` field", "the `ssn` field"), ("**SSN:** required", "**SSN:** required"), ("my_ssn=1", "my_ssn=1"), ("SSN = 'a\\'b' x", "SSN = [REDACTED:ssn] x"), ('ssn: "[REDACTED:ssn]"', 'ssn: "[REDACTED:ssn]"'),
]


@pytest.mark.parametrize(("t", "want"), SCRUB)
def test_scrub(spark, t, want):
    fields = ("ssn", "api_key")
    got = one(spark, scrub.scrub(F.col("t"), fields), t=t)
    assert got == want and one(spark, scrub.scrub(F.col("t"), fields), t=got) == want
    found = one(spark, scrub.violations(F.col("t"), fields), t="é " + t)
    assert bool(found) == (t != want) and all(("é " + t)[v.offset :].startswith(v.match) for v in found)
    assert one(spark, scrub.scrub(F.col("t"), ()), t=t) == t


def test_outline(spark):
    body = "# T\nx\n## A b\n### A b\n## A b\n#### no\n#\n## !!\nend"
    got = one(spark, outline.outline(F.col("t")), t=body)
    assert [(o.level, o.header, o.anchor) for o in got] == [(1, "T", "t"), (2, "A b", "a-b"), (3, "A b", "a-b-1"), (2, "A b", "a-b-2"), (2, "!!", "section-4")]
    assert [body[o.char_start : o.char_end] for o in got][1] == "## A b\n### A b\n" and got[0].char_end == len(body)
    df = spark.createDataFrame([("f", body)], "source_file string, body string")
    rows = outline.outlines(df).orderBy("char_start").collect()
    assert [(r.level, r.header, r.anchor, r.char_start, r.char_end) for r in rows] == [tuple(o) for o in got]
    assert one(spark, F.size(outline.up_to_level(outline.outline(F.col("t")), 0)), t=body) == 1


def test_tracker(spark):
    js = 'var A = [{id: "2", n: "Area: x", s: "live", sg: [{n: "G", it: [{n: "i, \\"q\\"", s: "done", nt: "n",},],}], df: ["z",],}];'
    rows = [("p/tracker-a.html", f"<b>{js}</b>"), ("p/x.html", "none"), ("p/y.html", "var A = [{n: }];"), ("p/capability-areas.html", 'var A = [{sg: [{it: [{s: "x"}]}]}];')]
    got = {r.source_file: r for r in tracker.tracker_chunks(spark.createDataFrame(rows, "source_file string, html string")).collect()}
    a = got["p/tracker-a.html"]
    assert (a.section_header, a.area_number, a.doc_type) == ("Area: x", 2, "tracker")
    assert a.content == '# Area: x\nStatus: live\n\n## G\n- i, "q" [done], n\n\n## Deferred\n- z\n'
    assert got.keys() == {"p/tracker-a.html", "p/capability-areas.html"} and got["p/capability-areas.html"].error
    assert json.loads(tracker.to_json('[{a_1 : "b: c", d: true,}]')) == [{"a_1": "b: c", "d": True}]


def docs_of(spark, *rows):
    cols = ("source_file", "depends_on", "feeds_into", "also_touches", "supersedes", "status")
    df = spark.createDataFrame([(f"p/docs/{f}.md", d, i, a, s, st) for f, d, i, a, s, st in rows], "source_file string, depends_on array<string>, feeds_into array<string>, also_touches array<int>, supersedes string, status string")
    return df.select(*cols, F.lit(None).cast("date").alias("doc_date"), F.lit(None).cast("timestamp").alias("git_committed_at"))


def test_graph(spark):
    d = docs_of(spark, ("a", ["b", "area-3-x", "gone", "b.md"], ["c"], [4, 4], None, "complete"), ("b", ["a"], None, None, "c", "superseded"), ("c", [" ~ "], [], [], "b.md", None))
    e = graph.edges(d)
    assert {(r.source_file[7:-3], r.relation, r.target) for r in e.collect()} == {("a", "depends_on", "b"), ("a", "depends_on", "area-3-x"), ("a", "depends_on", "gone"), ("a", "feeds_into", "c"), ("a", "also_touches", "4"), ("b", "depends_on", "a"), ("b", "supersedes", "c"), ("c", "supersedes", "b")}
    m = graph.doc_meta(d)
    n = {r.source_file[7:-3]: r for r in graph.neighborhoods(e, m, "p").collect()}
    assert [x.ref for x in n["a"].depends_on] == ["area-3-x", "b", "gone"] and n["a"].warnings == ["depends_on `gone` does not resolve to a known doc"]
    assert not n["a"].depended_on_by and n["a"].also_touches == [4] and [x.ref for x in n["c"].feeds_from] == ["a"]
    both = {r.source_file[7:-3]: r for r in graph.neighborhoods(e, m, "p", include_superseded=True).collect()}
    assert [x.ref for x in both["a"].depended_on_by] == ["b"]
    chain = [(r.source_file[7:-3], r.hop, r.ref) for r in graph.supersedes_chain(m, "p").collect()]
    assert sorted(chain) == [("b", 1, "c"), ("c", 1, "b")]
    keys = spark.createDataFrame([("trial-length",), ("01-dec-x",), ("a/b",), ("x.md",), ("",)], "v string")
    assert [r[0] for r in keys.select(graph.is_decision_key(F.col("v"))).collect()] == [True, False, False, False, False]


def test_decisions(spark):
    docs = spark.createDataFrame([("03-dec-stack.md", DOC), ("04-dec-bad.md", "---\narea: x\ndecisions:\n  - key: k\n    decision: d\n---\n"), ("05-spec-no.md", DOC)], "name string, text string")
    got = {r.decision_key: r for r in decisions.collect(docs).collect()}
    assert got.keys() == {"vector-store", "api", "k"} and got["vector-store"].error is None and got["api"].current_value == "3"
    assert str(got["vector-store"].decided_on) == "2025-01-02" and got["k"].error == "area is not an integer"
    rows = [("a", "x", 1, "c"), ("b", "x", 2, None), ("c", "x", 3, "b"), ("r1", "x", 4, "r2"), ("r2", "x", 5, "r1"), ("s", "x", 6, "s"), ("t", "x", 7, "nobody"), ("u", "x", 8, "r1")]
    d = spark.createDataFrame(rows, "decision_key string, source_doc string, position int, supersedes string").withColumns({"area": F.lit(1), "decision": F.concat(F.lit("about "), "decision_key"), "current_value": F.lit("50% off"), "decided_on": F.lit(None).cast("date"), "cross_refs": F.array().cast("array<string>")})
    assert {r.decision_key: len(r.path) - 1 for r in decisions.cycles(d).collect()} == {"r1": 2, "r2": 2, "s": 1}
    assert [r.decision_key for r in decisions.unresolved(d).collect()] == ["t"]
    w = decisions.wire(d)
    ids = {r.decision_key: (r.id, r.superseded_by) for r in w.collect()}
    assert ids["b"][1] == ids["c"][0] and ids["c"][1] == ids["a"][0] and ids["a"][1] is None
    banners = {r.decision_key: r.banner for r in decisions.with_banner(w).collect()}
    assert banners["b"] == "[SUPERSEDED by `a` on unknown date]" and banners["a"] == "[DRAFT]"
    hops = [(r.id, r.hop, r.successor) for r in decisions.successors(w).collect()]
    assert max(h for i, h, _ in hops if i == ids["b"][0]) == 2 and max((h for i, h, _ in hops if i == ids["s"][0]), default=0) == 1
    q = spark.createDataFrame([("2",), ("c",), ("T r%",), ("0%",), ("zzz",)], "query string")
    found = {}
    for r in decisions.lookup(q, w).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r["rank"], r.id, r.matched_by))
    assert found["2"] == [(1, 2, "id")] and found["c"] == [(1, ids["c"][0], "key")] and len(found["0%"]) == 5 and [i for _, i, _ in found["T r%"]] == [ids["r1"][0], ids["r2"][0]] and "zzz" not in found
    some = w.filter(F.col("id") == ids["b"][0])
    assert [r.banner for r in decisions.with_banner(some, registry=w).collect()] == [banners["b"]]
    assert {(r.hop, r.successor) for r in decisions.successors(w, starts=some).collect()} == {(h, s) for i, h, s in hops if i == ids["b"][0]}


def test_audit(spark):
    good = DOC.replace("06", "6")
    bad = "---\nfile: x\narea: true\ntype: nope\nstatus: 5\ndate: 3\ndepends-on: one\nfeeds-into:\n  - 7\n  - area-x\n  - missing-doc\n---\n#### deep\n"
    big = "---\ntitle: [\n---\n"
    rows = [("03-dec-stack.md", good), ("01-spec-bad.md", bad), ("bad name.md", "x"), ("02-pol-yaml.md", big), ("index.md", "x"), ("track-1.md", "x"), ("01-str-plan.md", "---\na: 1\n---\n## h\n" + "y" * 4001), ("02-spec-x.md", "--- no end"), ("04-res-y.md", "---\n- a\n---\n")]
    v = audit.audit(spark.createDataFrame(rows, "name string, text string"))
    got = {}
    for r in v.collect():
        got.setdefault(r["name"], {}).setdefault(r.category, []).append(r.message)
    assert "03-dec-stack.md" not in got
    b = got["01-spec-bad.md"]
    assert b["filename-pattern"] == ["`file` field `x` does not match filename `01-spec-bad`"] and b["no-h2"] and b["deep-nesting"] == ["has 1 header(s) nested deeper than `###`"]
    assert b["type-invalid"] == ["`type` `nope` not in allowed set ['dec', 'fwk', 'pol', 'res', 'spec', 'str']"] and b["status-invalid"] and b["date-format"] == ["`date` `3` not in YYYY-MM-DD format"]
    assert b["field-type"] == ["`depends-on` must be a list (use `[]` if empty)"] and b["area-ref-malformed"] and b["dangling-ref"] == ["`feeds-into` ref `missing-doc` does not match any existing doc"] and b["other"] == ["`feeds-into` entry `7` is not a string"]
    assert set(got["bad name.md"]) == {"filename-pattern", "frontmatter-missing"} and set(got["02-pol-yaml.md"]) == {"frontmatter-parse"} and set(got["02-spec-x.md"]) == {"frontmatter-missing"} and set(got["04-res-y.md"]) == {"other"}
    assert got["01-str-plan.md"]["oversized-section"] == ["1 section(s) exceed 4000 chars: '## h'=4006ch"]
    assert "index.md" not in got and "track-1.md" not in got
    docs = spark.createDataFrame(rows, "name string, text string")
    text_ = audit.report(docs, v)
    assert text_.index("## Categories") < text_.index("## Violations") < text_.index("## Clean files")


def test_fixes(spark):
    doc = "---\nfile: wrong\nstatus: active\ndepends-on:\n  - gone\n  - old\n  - mine\nfeeds-into:\n  - area-1-x\ntitle: x\n  - old\n---\nbody\n- old\n"
    renames = RenameMap({"old": "new", "mine": "global"}, {"01-str-a.md": {"mine": "own"}}, {"area-1-x": "02-spec-y"}, ("gone",))
    r = audit.fixed(spark.createDataFrame([("01-str-a.md", doc), ("x.md", "plain")], "name string, text string"), renames).orderBy("name").collect()
    assert r[0].new_text == "---\nfile: 01-str-a\nstatus: complete\ndepends-on:\n  - new\n  - own\nfeeds-into:\n  - 02-spec-y\ntitle: x\n  - old\n---\nbody\n- old\n"
    assert r[0].changed and not r[1].changed


def test_drift(spark, monkeypatch):
    docs = spark.createDataFrame([("docs/a.md", "x\nOldVendorName here\nhistorical oldvendorname\n"), ("docs/b.md", "none")], "file string, text string")
    p = (Pattern(r"\bOldVendorName\b", "vendor", "switched", "NewVendor", ("Historical", "rejected")),)
    hits = drift.stale_strings(docs, p)
    assert [(r.file, r.line, r.text) for r in hits.collect()] == [("docs/a.md", 2, "OldVendorName here")] and drift.stale_strings(docs, ()).count() == 0
    d = spark.createDataFrame([("k1", "Trial length", "14 days", "01-dec-t", None), ("k2", "short", "v", "s", None), ("k3", "Gone by now", "v", "s", 1), ("k4", "100% uptime", "v", "s", None)], "decision_key string, decision string, current_value string, source_doc string, superseded_by int")
    c = spark.createDataFrame([(f"p/docs/{i:02d}.md", "h", t) for i, t in enumerate(["the TRIAL length is 30", "trial length: 14 DAYS", "gone by now", "x 100 and uptime"] + ["trial length"] * 6)] + [("p/docs/01-dec-t.md", "h", "trial length")], "source_file string, section_header string, content string")
    got = drift.contradictions(d, c, "p").collect()
    assert sum(r.suggested_replacement == "14 days" for r in got) == 5 and {r.file for r in got if r.suggested_replacement == "v"} == {"p/docs/03.md"}  # % stands for any text
    monkeypatch.setattr(drift, "MENTIONED", 2)
    assert sorted(drift.contradictions(d, c, "p", most=None).collect()) == sorted(got) == sorted(drift.contradictions(d, c, "p", most=4).collect())
    assert {r.suggested_replacement for r in drift.contradictions(d, c, "p", most=1).collect()} == {"14 days"}
    ts = spark.createDataFrame([("a", ["b", "area-1-x", "c.md"], 1), ("b", [], 2), ("c", None, 0), ("d", ["a"], None)], "bare string, depends_on array<string>, t long").withColumn("git_committed_at", F.timestamp_seconds("t"))
    assert [r.file for r in drift.dep_out_of_date(ts).collect()] == ["docs/a.md"]
    items = drift.collect(drift.stale_signal(hits), drift.stale_signal(hits), drift.dep_out_of_date(ts))
    assert items.count() == 2 and [r.signal for r in drift.top(items, 0).collect()] == ["stale-string"]
    assert drift.filtered(items, "dep-out-of-date").count() == 1 and drift.filtered(items, area=3).count() == 0
    cache, made = drift.Cache(ttl=10, clock=iter([0, 5, 20]).__next__), []
    make = lambda: made.append(1) or items
    assert [cache.get(make)[1] for _ in range(3)] == [0, 5, 0] and len(made) == 2


def test_search(spark):
    rows = [("h1", [1.0, 0.0], "alpha beta", "complete", None), ("h2", [0.0, 1.0], "beta gamma", "superseded", "h1"), ("h3", None, "alpha beta gamma", None, None), ("h4", [1.0, 0.1], "other", "needs-review", None)]
    c = spark.createDataFrame([(h, v, t, s, x, f"p/docs/{h}.md") for h, v, t, s, x in rows], "content_hash string, embedding array<float>, content string, status string, supersedes string, source_file string").withColumns({"section_header": F.lit("s"), "area_number": F.lit(0), "doc_type": F.lit("dec"), "updated_at": F.lit("2025-01-01 00:00:00").cast("timestamp")})
    got = search.hybrid(c, "the Beta alpha", [1.0, 0.0], 10).collect()
    assert [r.content_hash for r in got] == ["h1", "h4", "h3"] and got[1].content.startswith("[NEEDS REVIEW") and got[0].updated_at == "2025-01-01T00:00:00Z"
    assert [r.content_hash for r in search.hybrid(c, "zzz", [0.0, 1.0], 0, include_superseded=True).collect()] == ["h2"]
    assert search.hybrid(c, "the of", [0.0, 1.0], status="superseded").count() == 0
    assert search.hybrid(c, "alpha", [1.0, 0.0], area=0).count() == 3 and search.hybrid(c, "alpha", [1.0, 0.0], area=1).count() == 0
    assert search.hybrid(c, "gamma", [0.0, 1.0], include_superseded=True).filter("content_hash = 'h2'").first().content.startswith("[SUPERSEDED, see h1]")
    assert [r.content_hash for r in search.hybrid(c, "alpha", [1.0, 0.0], 2).collect()] == [r.content_hash for r in search.hybrid(c, "alpha", [1.0, 0.0], 3).collect()][:2]
    assert search.clamp_k(0) == 1 and search.clamp_k(21) == 20
    row = search.log_row(spark, 'token="x" ' + "q" * 600, ["a"], 3, "me", ("token",), "boom").first()
    assert row.query_scrubbed.startswith("token=[REDACTED:token]") and row.query_scrubbed.endswith(" [error: boom]")


def test_stems():
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop filing:file happy:happi relational:relat conditional:condit vietnamization:vietnam hopefulness:hope triplicate:triplic formalize:formal electrical:electr goodness:good revival:reviv adjustment:adjust adoption:adopt probate:probat rate:rate controll:control"
    for p in pairs.split():
        w, s = p.split(":")
        assert lexical.stem(w) == s, w


def test_lexemes(spark):
    assert one(spark, lexical.lexemes(F.col("t")), t="The Cats' are running, 2x Élan") == ["cat", "run", "2x", "élan"]


def test_evals(spark):
    g = evals.validate([{"id": "a", "query": "q", "k": 5, "expect": {"source_files": ["02-dec-trial", "x"], "top_status": ["complete"]}}, {"query": "z"}])
    for bad in ({"query": "q", "k": 21}, {"k": 3}, {"query": "q", "k": True}):
        with pytest.raises(ValueError):
            evals.validate([bad])
    gold = spark.createDataFrame([(x["id"], x["source_files"], x["top_status"]) for x in g], "id string, source_files array<string>, top_status array<string>")
    r = spark.createDataFrame([("a", 1, "p/docs/02-dec-trials.md", "draft"), ("a", 2, "p/docs/02-dec-trial-v2.md", "draft")], "id string, rank int, source_file string, status string")
    s = {x.id: x for x in evals.score(r, gold).collect()}
    assert (s["a"].hit_at_k, s["a"].recall_at_k, s["a"].reciprocal_rank, s["a"].top_status_ok) == (0.0, 0.5, 0.5, False)
    assert (s["1"].hit_at_k, s["1"].recall_at_k, s["1"].top_status_ok) == (0.0, 1.0, None)
    assert evals.aggregate(evals.score(r, gold)).first().top_status == 0.0


def test_embedding(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError
        return [[float(len(t))] for t in texts]

    assert embed.in_batches(flaky, ["a", "bb", "ccc"], size=2, sleep=lambda _: None) == [[1.0], [2.0], [3.0]] and calls == [2, 2, 1]
    with pytest.raises(ValueError):
        embed.in_batches(lambda t: [], ["a"])
    with pytest.raises(ValueError):
        Settings(repo_prefix="{{NAME}}")
    df = spark.createDataFrame([("x y",), (None,)], "t string").select(embed.embedded(F.col("t"), embed.HashedWords(8)).alias("v"))
    assert sorted(len(r.v or []) for r in df.collect()) == [0, 8]


def test_batch_topk(spark, monkeypatch):
    import random

    r = random.Random(1)
    vec = {i: [r.gauss(0, 1) for _ in range(5)] for i in range(60)} | {60: None, 61: [0.0] * 5, 62: [1.0, 2.0]}
    items = spark.createDataFrame(list(vec.items()), "id long, v array<float>").repartition(3)
    queries = items.filter("id % 7 = 0").selectExpr("id AS query_id", "v AS q")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {q: sorted((i for i in range(60)), key=lambda i, q=q: (-cos(vec[q], vec[i]), i))[:4] for q in range(0, 60, 7)}
    for size in (2048, 2):
        monkeypatch.setattr(search, "QUERY_BLOCK", size)
        got = {}
        for row in search.batch_topk(items, queries, 4).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append(row.id)
        assert got == want
