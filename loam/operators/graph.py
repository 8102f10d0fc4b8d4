"""The property graph of documents: edges, their resolution, neighborhoods and supersession chains.

Every operator has a set form over all documents; the single-document forms filter it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHAIN_DEPTH, NULLS
from ..functions.text import strip, unquote
from ..sources.shared import written


def to_bare(file: Column) -> Column:
    """The base name without .md."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.md\z", "")


def to_full(bare: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}/docs/"), bare, F.lit(".md"))


def normal_target(ref: Column) -> Column:
    """A reference without white space, quotes and .md; null if it spells none."""
    s = unquote(strip(ref))
    return F.when(s.isin(*NULLS, "None"), None).otherwise(F.regexp_replace(s, r"\.md\z", ""))


def edges(docs: DataFrame) -> DataFrame:
    """docs with source_file, depends_on, feeds_into, also_touches, supersedes -> distinct (source_file, relation, target)."""
    named = lambda relation, refs: F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda r: F.struct(F.lit(relation).alias("relation"), normal_target(r).alias("target")))
    touches = F.transform(F.coalesce("also_touches", F.array().cast("array<int>")), lambda n: n.cast("string"))
    all_ = F.concat(named("depends_on", F.col("depends_on")), named("feeds_into", F.col("feeds_into")), named("also_touches", touches), named("supersedes", F.array("supersedes")))
    return docs.select("source_file", F.explode(all_).alias("e")).select("source_file", "e.relation", "e.target").filter("target IS NOT NULL").distinct()


def doc_meta(chunks: DataFrame) -> DataFrame:
    """One row a document, of what its chunks say."""
    return chunks.groupBy("source_file").agg(*(F.max(c).alias(c) for c in ("status", "supersedes", "doc_date", "git_committed_at")))


def outgoing(edges_: DataFrame, meta: DataFrame, prefix: str) -> DataFrame:
    """depends_on and feeds_into edges with what is known of their targets; dangling: nothing is."""
    e = edges_.filter(F.col("relation").isin("depends_on", "feeds_into")).withColumn("target_file", to_full(F.col("target"), prefix))
    m = meta.select(F.col("source_file").alias("target_file"), F.col("status").alias("target_status"), F.col("doc_date").alias("target_date"), F.col("git_committed_at").alias("target_committed_at"), F.lit(True).alias("known"))
    return e.join(m, "target_file", "left").select("source_file", "relation", "target", "target_file", "target_status", "target_date", "target_committed_at", F.col("known").isNull().alias("dangling"))


def incoming(edges_: DataFrame, meta: DataFrame, prefix: str, include_superseded: bool = False) -> DataFrame:
    """Who points at each document: depended_on_by and feeds_from, without superseded sources unless asked for."""
    e = edges_.filter(F.col("relation").isin("depends_on", "feeds_into")).select(to_full(F.col("target"), prefix).alias("source_file"), F.col("source_file").alias("from_file"), F.when(F.col("relation") == "depends_on", "depended_on_by").otherwise("feeds_from").alias("relation"))
    m = meta.select(F.col("source_file").alias("from_file"), F.col("status").alias("from_status"), F.col("doc_date").alias("from_date"), F.col("git_committed_at").alias("from_committed_at"))
    out = e.join(m, "from_file", "left")
    return out if include_superseded else out.filter(F.coalesce(F.col("from_status") != "superseded", F.lit(True)))


def paths(step: DataFrame, depth: int) -> DataFrame:
    """step (at, next, ...), each `at` once -> at, path: the steps (structs) that follow each other from there, `depth` at
    most. By doubling: a round appends to each path the path of where it ends, so that four rounds make sixteen steps;
    each round is written and read."""
    entry = F.struct(*(c for c in step.columns if c != "at"))
    found, length = written(step.select("at", F.array(entry).alias("path")), "paths"), 1
    while length < depth:
        more = found.select(F.col("at").alias("end"), F.col("path").alias("more"))
        ends = F.when(F.size("path") == length, F.element_at("path", -1)["next"])
        found = written(found.withColumn("end", ends).join(more, "end", "left").select("at", F.concat("path", F.coalesce("more", F.slice("path", 1, 0))).alias("path")), "paths")
        length *= 2
    return found.select("at", F.slice("path", 1, depth).alias("path"))


def first_again(at: Column, path: Column) -> Column:
    """The place, from 1, of the first step of a path that leads to where it has been before; null if none does."""
    been = lambda i: F.concat(F.array(at), F.transform(F.slice(path, F.lit(1), i), lambda p: p["next"]))
    return F.array_min(F.filter(F.transform(path, lambda p, i: F.when(F.array_contains(been(i), p["next"]), i + 1)), lambda i: i.isNotNull()))


def supersedes_chain(meta: DataFrame, prefix: str, starts: DataFrame | None = None, depth: int = CHAIN_DEPTH) -> DataFrame:
    """meta (source_file, supersedes, status) -> source_file, hop from 1, ref, target_file, status, dangling: what each
    document (of starts, if given) replaces, what that replaced, and so on; a document met before ends the chain."""
    m = meta.select("source_file", normal_target(F.col("supersedes")).alias("ref")).filter("ref IS NOT NULL")
    chains = paths(m.select(F.col("source_file").alias("at"), "ref", to_full(F.col("ref"), prefix).alias("next")), depth)
    if starts is not None:
        chains = chains.join(starts.select(F.col("source_file").alias("at")), "at", "left_semi")
    ends = F.coalesce(first_again(F.col("at"), F.col("path")) - 1, F.size("path"))
    hops = chains.select(F.col("at").alias("source_file"), F.posexplode(F.slice("path", F.lit(1), ends)).alias("hop", "p"))
    hops = hops.select("source_file", (F.col("hop") + 1).alias("hop"), "p.ref", F.col("p.next").alias("target_file"))
    known = meta.select(F.col("source_file").alias("target_file"), "status", F.lit(True).alias("known"))
    return hops.join(known, "target_file", "left").select("source_file", "hop", "ref", "target_file", "status", F.col("known").isNull().alias("dangling"))


def neighbors(edges_: DataFrame, meta: DataFrame, prefix: str, include_superseded: bool = False) -> DataFrame:
    """The same as neighborhoods() with a row for each neighbor: source_file, side, ref, neighbor_file, status, doc_date,
    git_committed_at, dangling. However many documents point at one, they stay rows."""
    facts = lambda who, more: [F.col(f"{who}_status").alias("status"), F.col(f"{who}_date").alias("doc_date"), F.col(f"{who}_committed_at").alias("git_committed_at"), more.alias("dangling")]
    out = outgoing(edges_, meta, prefix).select("source_file", F.col("relation").alias("side"), F.col("target").alias("ref"), F.col("target_file").alias("neighbor_file"), *facts("target", F.col("dangling")))
    inc = incoming(edges_, meta, prefix, include_superseded)
    return out.unionByName(inc.select("source_file", F.col("relation").alias("side"), to_bare(F.col("from_file")).alias("ref"), F.col("from_file").alias("neighbor_file"), *facts("from", F.lit(False))))


def neighborhoods(edges_: DataFrame, meta: DataFrame, prefix: str, include_superseded: bool = False) -> DataFrame:
    """All documents' neighborhoods: a row for each, with sorted arrays of what it points at, what points at it,
    the areas it touches, and warnings for targets that no document answers to."""
    out = outgoing(edges_, meta, prefix)
    entry = F.struct(F.col("target").alias("ref"), F.col("target_file").alias("source_file"), F.col("target_status").alias("status"), F.col("target_date").alias("doc_date"), F.col("target_committed_at").alias("git_committed_at"), "dangling")
    side = lambda r: F.array_sort(F.collect_list(F.when(F.col("relation") == r, entry)))
    warn = F.when(F.col("dangling") & ~F.col("target").startswith("area-"), F.concat(F.col("relation"), F.lit(" `"), F.col("target"), F.lit("` does not resolve to a known doc")))
    o = out.groupBy("source_file").agg(side("depends_on").alias("depends_on"), side("feeds_into").alias("feeds_into"), F.array_sort(F.collect_list(warn)).alias("warnings"))
    inc = incoming(edges_, meta, prefix, include_superseded)
    entry_in = F.struct(to_bare(F.col("from_file")).alias("ref"), F.col("from_file").alias("source_file"), F.col("from_status").alias("status"), F.col("from_date").alias("doc_date"), F.col("from_committed_at").alias("git_committed_at"))
    side_in = lambda r: F.array_sort(F.collect_list(F.when(F.col("relation") == r, entry_in)))
    i = inc.groupBy("source_file").agg(side_in("depended_on_by").alias("depended_on_by"), side_in("feeds_from").alias("feeds_from"))
    areas = edges_.filter("relation = 'also_touches'").groupBy("source_file").agg(F.array_sort(F.collect_set(F.col("target").try_cast("int"))).alias("also_touches"))
    files = meta.select("source_file").union(edges_.select("source_file")).distinct()
    return files.join(o, "source_file", "left").join(i, "source_file", "left").join(areas, "source_file", "left")


def is_decision_key(value: Column) -> Column:
    """Not empty, no .md, no path, and not a document's NN- name."""
    return (value != "") & ~value.endswith(".md") & ~value.contains("/") & ~value.rlike(r"\A\d\d-")


def impact_anchors(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """values (value) -> value, anchor_kind, anchor_doc: a decision's document if the value is a key that is known."""
    d = decisions.select(F.col("decision_key").alias("value"), "source_doc")
    found = values.join(d, "value", "left")
    hit = is_decision_key(F.col("value")) & F.col("source_doc").isNotNull()
    return found.select("value", F.when(hit, "decision").otherwise("doc").alias("anchor_kind"), to_bare(F.when(hit, F.col("source_doc")).otherwise(F.col("value"))).alias("anchor_doc"))


def impacts(values: DataFrame, decisions: DataFrame, edges_: DataFrame, meta: DataFrame, prefix: str, include_superseded: bool = False) -> DataFrame:
    """The anchors of all values, each with the neighborhood of its document; that is null where the document is not known."""
    anchors = impact_anchors(values, decisions).withColumn("source_file", to_full(F.col("anchor_doc"), prefix))
    return anchors.join(neighborhoods(edges_, meta, prefix, include_superseded), "source_file", "left")
