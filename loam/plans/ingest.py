"""Indexing: from files to chunks, outlines and edges, and from those into the store's buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import strip
from ..operators import chunk, frontmatter, graph, outline, scrub, tracker
from ..operators.embed import Embedder, embedded
from ..schema import OUTLINE
from ..sources import corpus
from ..sources.store import Store, file_stats, replace


@dataclass
class Indexed:
    """written: the chunks, and what outlines and edges are made of, stand in a store's work folder, so that they may be
    read more than once."""

    chunks: DataFrame
    outlines: DataFrame
    edges: DataFrame
    files: DataFrame
    written: bool = False


#: What a chunk has of its document, and all that is stored of one but for its vector.
OF_FILE = ["source_file", "area_number", "doc_type", "status", "supersedes", "doc_date", "git_sha", "git_committed_at", "depends_on", "feeds_into", "also_touches"]
STORED = ["source_file", "section_header", "area_number", "doc_type", "content", "content_hash", "status", "supersedes", "doc_date", "git_sha", "git_committed_at", "depends_on", "feeds_into", "also_touches"]


def pieces(settings: Settings) -> Column:
    """array<struct<content_hash, no, section_header, content>> of a parsed document: its chunks as they are stored, equal
    ones once."""
    body = F.col("body")
    cut = F.flatten(F.transform(chunk.by_heading(body, 2), lambda s: chunk.hard_pieces(s["header"], s["content"]))) if settings.lite else chunk.cascade(body)

    def stored(p: Column, i: Column) -> Column:
        clean = scrub.scrub(p["content"], settings.excluded_fields)
        full = clean if settings.lite else F.concat(chunk.preamble(F.col("source_file"), F.col("doc_type"), F.col("status"), F.col("area_number"), p["header"]), F.lit("\n\n"), clean)
        return F.struct(i.alias("no"), p["header"].alias("section_header"), full.alias("content"))

    hashed = F.transform(F.transform(cut, stored), lambda p: F.struct(chunk.content_hash(p["content"]).alias("content_hash"), p["no"].alias("no"), p["section_header"].alias("section_header"), p["content"].alias("content")))
    # an array of one, so that a lambda's variable holds the sorted pieces
    first = lambda a: F.filter(a, lambda p, i: (i == 0) | ~F.get(a, i - 1)["content_hash"].eqNullSafe(p["content_hash"]))
    return F.transform(F.array(F.array_sort(hashed)), first)[0]


def cut_up(parsed: DataFrame, settings: Settings, git: DataFrame | None = None) -> DataFrame:
    """Parsed documents with their chunks and headings in place of their bodies."""
    if git is not None:
        parsed = parsed.join(git, "source_file", "left")
    else:
        parsed = parsed.withColumn("git_sha", F.lit(None).cast("string")).withColumn("git_committed_at", F.lit(None).cast("timestamp"))
    return parsed.select(*OF_FILE, (strip(F.col("body")) == "").alias("blank"), outline.heads(F.col("body")).alias("heads"), pieces(settings).alias("pieces"))


def md_chunks(docs: DataFrame, *more: str) -> DataFrame:
    """Documents that are cut up -> chunks as they are stored, but for the vectors. Equal chunks of one document are one."""
    c = docs.select(*OF_FILE, *more, F.explode("pieces").alias("p"))
    return c.select(*OF_FILE, *more, "p.section_header", "p.content", "p.content_hash").select(*STORED, *more)


def html_chunks(pages: DataFrame, settings: Settings, git: DataFrame | None = None) -> DataFrame:
    """Tracker pages -> chunks; they have no edges and no outline."""
    t = tracker.tracker_chunks(pages).filter("error IS NULL")
    none = {c: F.lit(None).cast(k) for c, k in (("status", "string"), ("supersedes", "string"), ("doc_date", "date"), ("depends_on", "array<string>"), ("feeds_into", "array<string>"), ("also_touches", "array<int>"))}
    t = t.withColumns(none)
    clean = scrub.scrub(F.col("content"), settings.excluded_fields)
    t = t.withColumn("content", F.concat(chunk.preamble(F.col("source_file"), F.col("doc_type"), F.col("status"), F.col("area_number"), F.col("section_header")), F.lit("\n\n"), clean)).withColumn("content_hash", chunk.content_hash(F.col("content")))
    t = t.join(git, "source_file", "left") if git is not None else t.withColumn("git_sha", F.lit(None).cast("string")).withColumn("git_committed_at", F.lit(None).cast("timestamp"))
    return t.select(*STORED).dropDuplicates(["content_hash"])


def each_once(chunks: DataFrame, store: Store) -> DataFrame:
    """Written chunks (.., row: what tells those of one hash apart) without those that an earlier file has too. Only hashes
    are shuffled; texts are where so many hashes are held twice that Spark doesn't broadcast them."""
    at = F.struct("source_file", "row")
    twice = chunks.groupBy("content_hash").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = chunks.join(store.cut(twice, "twice"), "content_hash", "left")
    return rows.filter(F.col("first").isNull() | (F.col("first") == at)).select(*STORED)


def outlines(parsed: DataFrame) -> DataFrame:
    """Parsed documents (body, or heads of documents that are cut up) -> source_file, outline, updated_at; a document
    without headings has an empty outline."""
    o = outline.sections(parsed.select("source_file", "heads")) if "heads" in parsed.columns else outline.outlines(parsed.select("source_file", "body"))
    entry = F.struct("section_no", "level", "header", "anchor", "char_start", "char_end")
    o = o.groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("section_no")).alias("outline"))
    each = parsed.select("source_file").distinct().join(o, "source_file", "left")
    return each.select("source_file", F.coalesce("outline", F.array().cast(OUTLINE)).alias("outline"), F.current_timestamp().alias("updated_at"))


def index(docs: DataFrame, settings: Settings, pages: DataFrame | None = None, git: DataFrame | None = None, store: Store | None = None) -> Indexed:
    """docs (source_file, text), pages (source_file, html) -> the new rows of all tables. store: where documents are
    written once as they are cut up, so that no table parses them again."""
    parsed = frontmatter.parse(docs.select("source_file", "text"), nested=settings.parity).drop("text", "metadata")
    parsed = cut_up(parsed, settings, git)
    html = None if pages is None else html_chunks(pages, settings, git)
    if store is not None:
        parsed = store.cut(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")
        chunks = md_chunks(parsed, "row")
        if html is not None:
            chunks = chunks.unionByName(store.cut(html.withColumn("row", -1 - F.monotonically_increasing_id()), "trackers"))
        chunks = each_once(chunks, store)
    else:
        chunks = md_chunks(parsed)
        chunks = (chunks if html is None else chunks.unionByName(html)).dropDuplicates(["content_hash"])
    files = docs.select("source_file")
    if pages is not None:
        files = files.union(pages.select("source_file"))
    if settings.parity:  # what is stored of files edited to nothing stays
        empty = parsed.filter("blank").select("source_file")
        files, parsed = (d.join(empty, "source_file", "left_anti") for d in (files, parsed))
    return Indexed(chunks, outlines(parsed), graph.edges(parsed), files.distinct(), store is not None)


def fresh(chunks: DataFrame, stored: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks with vectors: those already stored under the same hash keep theirs, the rest are embedded."""
    have = stored.filter("embedding IS NOT NULL").select("content_hash", F.col("embedding").alias("had")).dropDuplicates(["content_hash"])
    rows = chunks.join(have, "content_hash", "left")
    vector = F.coalesce("had", embedded(F.when(F.col("had").isNull(), F.col("content")), embedder))
    return rows.withColumn("embedding", vector).drop("had").withColumn("updated_at", F.current_timestamp())


def reindex(store: Store, new: Indexed, embedder: Embedder) -> None:
    """The whole collection anew: what is stored but wasn't read goes; decisions and the log stay."""
    with store.shuffles_deleted():
        chunks = new.chunks if new.written else store.cut(new.chunks, "chunks")
        had = store.cut(store.vectors(chunks.select("content_hash"), store.read("doc_chunks")), "vectors")
        every = set(range(store.manifest()["buckets"]))
        tables = lambda some: {"doc_chunks": fresh(store.of(chunks, some), had, embedder), "doc_outlines": store.of(new.outlines, some), "doc_relationships": store.of(new.edges, some)}
        staged = store.stage_groups(store.groups(every, {}), tables)
        rows = store.staged("doc_chunks", staged["doc_chunks"])
        staged |= store.stage_all({"file_stats": file_stats(rows), "chunk_hashes": rows.select("content_hash", "source_file")})
        store.publish(staged, {})
        store.tidy()


def sync(store: Store, new: Indexed, deleted: DataFrame, embedder: Embedder, batch: tuple[str, int] | None = None, snapshot: DataFrame | None = None) -> None:
    """Changed files give up their rows for the new ones; deleted files give theirs up. The same files in any
    batches end in the same tables as all at once. batch: a stream and its number, stored with what it did."""
    with store.shuffles_deleted():
        gone = new.files.unionByName(deleted.select("source_file"))
        chunks = new.chunks if new.written else store.cut(new.chunks, "chunks")
        tables = {"doc_outlines": new.outlines, "doc_relationships": new.edges}
        replace(store, gone, tables, lambda stored: fresh(chunks, stored, embedder), chunks.select("content_hash", "source_file"), batch, snapshot)


def sync_folder(spark: SparkSession, root: str, store: Store, settings: Settings, embedder: Embedder) -> dict[str, int]:
    """Bring the store up to what lies below root: the snapshot of the last time tells which files have come, changed and
    gone. Only files whose length or time differ are read, and of those only the ones whose text differs are indexed.
    How many there are of each."""
    found = store.cut(corpus.changes(spark, root, settings.repo_prefix, store.read("snapshot"), settings.exclude_globs), "changes")
    texts = corpus.markdown_of(spark, root, settings.repo_prefix, found.filter("op IN ('added', 'changed')"), settings.exclude_globs)
    read = store.cut(texts.withColumn("new_digest", F.sha2(F.col("text"), 256)), "texts")
    rows = found.join(read.select("source_file", "new_digest"), "source_file", "left")
    rows = rows.withColumn("op", F.when((F.col("op") == "changed") & (F.col("new_digest") == F.col("digest")), "same").otherwise(F.col("op")))
    rows = store.cut(rows, "changes")
    n = {r["op"]: r["count"] for r in rows.groupBy("op").count().collect()}
    if n.keys() - {"same"} or rows.filter("new_digest IS NOT NULL").limit(1).count():
        told = rows.filter("op <> 'deleted'").select("source_file", "path", "length", "modified", F.coalesce("new_digest", "digest").alias("digest"))
        docs = read.join(rows.filter("op IN ('added', 'changed')"), "source_file", "left_semi")
        sync(store, index(docs, settings, store=store), rows.filter("op = 'deleted'"), embedder, snapshot=told)
    else:
        store.tidy()
    return {op: n.get(op, 0) for op in ("added", "changed", "deleted", "same")}
