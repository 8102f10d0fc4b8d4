"""The seven tools over a store, for one question at a time: thin forms of the set operators.

Answers are small (top k, one document's neighbors), so they are collected.
"""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from .config import CHAIN_DEPTH, DEFAULT_K, DEFAULT_TOP, MAX_K, Settings
from .operators import decisions as dec
from .operators import drift, graph, outline, search
from .operators.embed import Embedder
from .sources import indexes
from .sources.store import Store

#: Files that an answer on index health lists.
HEALTH_FILES = 10_000


class Tools:
    def __init__(self, store: Store, settings: Settings, embedder: Embedder, docs=None, stems: bool = False):
        """docs: a function that gives the drift signals' frames, where there is a collection to compare with. stems: whether
        words are compared by their stems. Searches go over the store's lexical index as long as that is up to date."""
        self.store, self.settings, self.embedder, self.signals, self.stems = store, settings, embedder, docs, stems
        self.cache = drift.Cache()
        #: Searches that couldn't be logged, and the last reason.
        self.unlogged, self.unlogged_because = 0, None

    def search_docs(self, query: str, k: int = DEFAULT_K, status=None, area=None, doc_type=None, include_superseded=False, caller: str = "tool") -> list[dict] | dict:
        """The k best chunks (k is brought into 1 to 20), or {"error", "results"}; each call is logged."""
        began, error, rows = time.monotonic(), None, []
        try:
            vector = self.embedder([query])[0]
            filters = {"status": status, "area": area, "doc_type": doc_type, "include_superseded": include_superseded}
            if indexes.LexicalIndex(self.store, self.stems).stale():
                got = search.hybrid(self.store.read("doc_chunks"), query, vector, k, self.stems, **filters)
            else:
                got = indexes.hybrid(self.store, query, vector, k, self.stems, **filters)
            rows = [r.asDict() for r in got.collect()]
        except Exception as e:  # the caller gets the error, whatever it is
            error = str(e)
        self._log(query, [r["content_hash"] for r in rows], began, caller, error)
        return {"error": error, "results": []} if error else rows

    def _log(self, query, ids, began, caller, error) -> None:
        try:
            ms = int((time.monotonic() - began) * 1000)
            self.store.append("query_log", search.log_row(self.store.spark, query, ids, ms, caller, self.settings.excluded_fields, error))
        except Exception as e:  # a log that can't be written must not fail a search
            self.unlogged, self.unlogged_because = self.unlogged + 1, e

    def search(self, query: str, k: int = DEFAULT_K, **filters) -> dict:
        """As search_docs, but k has to be from 1 to 20, and the reply counts its results."""
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k must be from 1 to {MAX_K}")
        got = self.search_docs(query, k, caller="rest", **filters)
        return {"results": [], "count": 0, "error": got["error"]} if isinstance(got, dict) else {"results": got, "count": len(got)}

    def get_decision(self, query_or_id: str | int) -> dict:
        d = self.store.read("decisions")
        spark = self.store.spark
        hits = dec.lookup(spark.createDataFrame([(str(query_or_id),)], "query string"), d).orderBy("rank").collect()
        if isinstance(query_or_id, int):
            hits = [r for r in hits if r.matched_by == "id"]
        if not hits:
            return {"decision": None, "alternatives": [], "supersedes_chain": [], "banner": "[NOT FOUND]"}
        row = lambda r: {c: (str(r[c]) if c == "decided_on" and r[c] else r[c]) for c in dec.COLUMNS}
        own = d.filter(F.col("id").isin([r["id"] for r in hits]))
        shown = {r["id"]: r for r in own.collect()}
        found = [shown[r["id"]] for r in hits]
        chain = self._successors(d, found[0])
        hops = spark.createDataFrame([(found[0]["id"], k, r["id"]) for k, r in enumerate(chain, 1)], "id int, hop int, successor int")
        banner = dec.with_banner(own.filter(F.col("id") == found[0]["id"]), hops, d).first()["banner"]
        return {"decision": row(found[0]), "alternatives": [row(r) for r in found[1:]], "supersedes_chain": [row(r) for r in chain], "banner": banner}

    @staticmethod
    def _successors(d, row) -> list:
        """As decisions.successors() of one row, read from the store hop by hop: most chains are short."""
        out, seen = [], set()
        while row and row["superseded_by"] is not None and row["id"] not in seen and len(out) < CHAIN_DEPTH:
            seen.add(row["id"])
            row = d.filter(F.col("id") == row["superseded_by"]).first()
            out += [row] if row else []
        return out

    def get_doc_neighborhood(self, filename: str, include_superseded: bool = False) -> dict:
        prefix = self.settings.repo_prefix
        bare = filename.rsplit("/", 1)[-1].removesuffix(".md")
        full = f"{prefix}/docs/{bare}.md"
        edges = self.store.read("doc_relationships").filter((F.col("source_file") == full) | (F.col("target") == bare))
        meta = self.store.read("file_stats")
        r = graph.neighborhoods(edges, meta, prefix, include_superseded).filter(F.col("source_file") == full).first()
        get = lambda c: [e.asDict() if hasattr(e, "asDict") else e for e in (r[c] or [])] if r else []
        names = ("depends_on", "feeds_into", "also_touches", "depended_on_by", "feeds_from", "warnings")
        return {"filename": bare, "source_file": full, **{n: get(n) for n in names}, "supersedes_chain": self._replaced(full)}

    def _replaced(self, full: str) -> list[dict]:
        """As graph.supersedes_chain() of one document, read hop by hop: most chains are short."""
        out, seen, at = [], {full}, full
        of = lambda f: self.store.read_keys("file_stats", [f]).select("status", graph.normal_target(F.col("supersedes")).alias("ref")).first()
        row = of(full)
        while row and row["ref"] and len(out) < CHAIN_DEPTH:
            ref, at = row["ref"], f"{self.settings.repo_prefix}/docs/{row['ref']}.md"
            if at in seen:
                break
            seen.add(at)
            row = of(at)
            out.append({"source_file": full, "hop": len(out) + 1, "ref": ref, "target_file": at, "status": row and row["status"], "dangling": row is None})
        return out

    def get_impact_targets(self, doc_or_decision: str) -> dict:
        d = self.store.read("decisions")
        a = graph.impact_anchors(self.store.spark.createDataFrame([(doc_or_decision,)], "value string"), d).first()
        row = d.filter(F.col("decision_key") == doc_or_decision).first() if a.anchor_kind == "decision" else None
        return {"anchor": doc_or_decision, "anchor_kind": a.anchor_kind, "decision": row.asDict() if row else None, "neighborhood": self.get_doc_neighborhood(a.anchor_doc)}

    def get_doc_outline(self, filename: str, max_level: int = 3) -> dict:
        full = f"{self.settings.repo_prefix}/docs/{filename.rsplit('/', 1)[-1].removesuffix('.md')}.md"
        r = self.store.read_keys("doc_outlines", [full]).select(outline.up_to_level(F.col("outline"), max_level).alias("o")).first()
        return {"source_file": full, "outline": [e.asDict() for e in r.o] if r and r.o else []}

    def get_drift_report(self, signal: str | None = None, area: int | None = None, top: int = DEFAULT_TOP) -> dict:
        make = lambda: drift.collect(*self.signals()) if self.signals else self.store.spark.createDataFrame([], "file string, line int, signal string, reason string, authoritative_source string, suggested_replacement string, snippet string")
        items, age = self.cache.get(make)
        items = drift.filtered(items, signal, area)
        counts = {r.signal: r["items"] for r in drift.by_signal(items).collect()}
        return {"total": sum(counts.values()), "by_signal": counts, "items": [r.asDict() for r in drift.top(items, top).collect()], "cache_age_seconds": round(age, 1)}

    def check_index_health(self, most: int = HEALTH_FILES) -> dict:
        """Totals over all files, and the files that were updated longest ago, so the stale ones first, up to `most`;
        search.stored_health() has them all as a table."""
        h = search.stored_health(self.store.read("file_stats"))
        rows, t = h.limit(most).collect(), search.health_totals(h).first()
        return {"total_chunks": t.total_chunks or 0, "total_files": t.total_files, "total_stale": t.stale_files, "stale_files": [r.source_file for r in rows if r.is_stale], "files": [r.asDict() for r in rows]}
