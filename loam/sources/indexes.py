"""Two indexes over stored chunks, kept bucket by bucket: after a sync only the buckets it wrote are indexed anew.

Lexical: for each lexeme the chunks that have it, with counts; in folders by a hash of the term and sorted by it, so that
a search reads the folders of its terms alone. A row holds a term's chunks of one block (some hundred thousand words of
one bucket) as numbers; what a number stands for, its length and what authority filters ask of are in a row for each chunk.

Vectors: inverted lists. Centroids are trained on a bounded sample, every chunk with a vector is filed under the nearest,
and a search reads the lists of the centroids nearest to its query. How many lists that takes is measured: on a
sample of the vectors, against exact search over all of them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import lexical
from ..operators import search
from ..schema import LENGTHS, POSTINGS
from .store import Store

#: Folders of a bucket that terms are dealt out to.
TERM_PARTS = 8
#: Lists: one in ROWS_PER_LIST vectors, within bounds; vectors of each list that centroids are trained on, rounds of that.
ROWS_PER_LIST, FEWEST_LISTS, MOST_LISTS = 1000, 16, 4096
TRAINED, ROUNDS = 64, 8
#: Recall that the number of lists read is set for, the sample it is measured on, and the neighbors of each that count.
RECALL, MEASURED, NEIGHBORS = 0.95, 256, 10
#: Bytes of words that a block of postings begins with; a chunk is never dealt to two.
BLOCK_BYTES = 4_000_000
_FILTERS = ("source_file", "status", "area_number", "doc_type")


class _Derived:
    """Tables that follow doc_chunks."""

    name = ""

    def __init__(self, store: Store):
        self.store = store

    def _built(self, m: dict) -> dict[str, str]:
        return m.get("built", {}).get(self.name, {})

    def stale(self) -> set[int]:
        """Buckets whose chunks are not those that were indexed."""
        m = self.store.manifest()
        now, then = m["tables"].get("doc_chunks", {}), self._built(m)
        return {int(b) for b in now.keys() | then.keys() if now.get(b) != then.get(b)}

    def _publish(self, staged, buckets: set[int], **told) -> None:
        m = self.store.manifest()
        built = m.get("built", {}) | {self.name: m["tables"].get("doc_chunks", {})}
        self.store.publish(staged, dict.fromkeys(staged, buckets), told={"built": built} | told)


def _blocks(stems: bool, schema: pa.Schema):
    """Batches of chunks (bucket, content_hash, filters, words) -> their rows of lengths, and those of postings; `of` says
    which. A batch's chunks of one bucket make a block for each BLOCK_BYTES."""

    def rows(size: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in schema], schema=schema)

    def block(some: pa.RecordBatch, kept: dict) -> list[pa.RecordBatch]:
        number, texts = uuid.uuid4().int >> 65, some.column("words").to_pylist()
        lexemes = lexical.Lexemes(stems, kept)
        of = [np.array([lexemes[w] for w in (t or "").split()], np.int64) for t in texts]
        of = [x[x >= 0] for x in of]
        sizes = np.array([len(x) for x in of])
        bucket = some.column("bucket")[0].as_py()
        same = lambda v, n, t: pa.array(np.full(n, v), t)
        told = {c: some.column(c) for c in ("content_hash", *_FILTERS)}
        n = pa.array(sizes, pa.int32(), mask=np.array([t is None for t in texts]))
        out = [rows(len(texts), of=same(0, len(texts), pa.int32()), bucket=same(bucket, len(texts), pa.int32()), block=same(number, len(texts), pa.int64()), no=pa.array(np.arange(len(texts), dtype=np.int32)), n=n, **told)]
        pairs, tfs = np.unique(np.concatenate(of) * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
        if len(pairs):
            term, nos = pairs // len(texts), pairs % len(texts)
            begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            ends = pa.array(np.r_[begins, len(pairs)], pa.int32())
            lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32)))
            terms = pa.array([lexemes.terms[k] for k in term[begins].tolist()], pa.string())
            out.append(rows(len(begins), of=same(1, len(begins), pa.int32()), bucket=same(bucket, len(begins), pa.int32()), block=same(number, len(begins), pa.int64()), term=terms, nos=lists(nos), tfs=lists(tfs)))
        return out

    def run(batches):
        kept: dict[str, str] = {}
        for b in batches:
            buckets = b.column("bucket").to_numpy()
            lengths = pc.fill_null(pc.binary_length(b.column("words")), 0).to_numpy(zero_copy_only=False)
            for one in np.unique(buckets):
                own = np.flatnonzero(buckets == one)
                cuts = np.cumsum(lengths[own], dtype=np.int64) // BLOCK_BYTES
                for c in np.unique(cuts):
                    yield from block(b.take(pa.array(own[cuts == c])), kept)

    return run


class LexicalIndex(_Derived):
    """stems: whether lexemes are stemmed; an index keeps to one."""

    def __init__(self, store: Store, stems: bool = True):
        super().__init__(store)
        self.stems, self.name = stems, f"lexical-blocks-{'stems' if stems else 'words'}"

    def refresh(self) -> int:
        """Index what is stale; how many buckets that was."""
        buckets = self.stale()
        if buckets:
            rows = self.store.read("doc_chunks", buckets)
            rows = rows.select(self.store.bucket(F.col("source_file")).alias("bucket"), "content_hash", *_FILTERS, lexical.spaced(F.col("content")).alias("words"))
            own = self.store.spark.createDataFrame([], f"{POSTINGS}, {LENGTHS.replace('block long, ', '')}, bucket int, of int").schema
            made = self.store.cut(rows.mapInArrow(_blocks(self.stems, to_arrow_schema(own)), own), "blocks")
            part = ("part", F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int"))
            staged = {"postings": self.store.stage("postings", made.filter("of = 1"), part, "term", "bucket"), "lengths": self.store.stage("lengths", made.filter("of = 0"), bucket="bucket")}
            self._publish(staged, buckets)
            self.store.tidy()
        return len(buckets)

    def asked(self, query: str) -> list[str]:
        words = self.store.spark.range(1).select(lexical.lexemes(F.lit(query), self.stems).alias("q")).first()["q"]
        return sorted(set(words))

    def postings(self, terms: list[str]) -> DataFrame:
        """term, block, no, tf of the chunks that have each of some terms; the folders of other terms are not read."""
        m = self.store.manifest()
        some = self.store.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int"))
        rows = self.store.load("postings", m["tables"].get("postings", {}))
        if "part" in rows.columns:
            rows = rows.filter(F.col("part").isin([r[0] for r in some.collect()]) & F.col("term").isin(terms))
        return rows.select("term", "block", F.explode(F.arrays_zip("nos", "tfs")).alias("p")).select("term", "block", F.col("p.nos").alias("no"), F.col("p.tfs").alias("tf"))

    def scores(self, terms: list[str], **filters) -> DataFrame:
        """content_hash, lex (the BM25 rank in 0 to 1 as the exact search has it, over the chunks that the filters let
        through) and held (how many of the terms it has) of the chunks that have any."""
        allowed = self.store.read("lengths").filter(search.authority(**filters)).select("block", "no", "content_hash", "n")
        stats = allowed.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
        hits = self.postings(terms).join(allowed, ["block", "no"])
        df = {r["term"]: r["count"] for r in hits.groupBy("term").count().collect()}
        weights = F.lit(0.0)
        for t, n in df.items():
            weights = F.when(F.col("term") == t, lexical.weight(stats["n"], n)).otherwise(weights)
        s = hits.groupBy("content_hash").agg(F.sum(weights * lexical.gain(F.col("tf").cast("double"), F.col("n"), stats["mean"])).alias("s"), F.count("*").alias("held"))
        return s.select("content_hash", (F.col("s") / (1 + F.col("s"))).alias("lex"), "held")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The list of each vector, of which at most search.SCORES similarities are held at once."""
    step = max(1, search.SCORES // max(1, len(centroids)))
    return np.concatenate([np.zeros(0, int), *((x[i : i + step] @ centroids.T).argmax(1) for i in range(0, len(x), step))])


def trained(vectors: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of length 1 for vectors compared by their cosine."""
    x = _unit(vectors)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        own = _closest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where((np.bincount(own, minlength=len(c)) > 0)[:, None], _unit(sums), c)
    return c


def _filed(centroids: np.ndarray):
    """Batches with v -> the same rows with the list of each."""

    def run(batches):
        for b in batches:
            _, x = search.vectors_of(b.column("v"), centroids.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_closest(_unit(x), centroids).astype(np.int32))], [*b.schema.names, "list"])

    return run


def _nearest(queries: np.ndarray, ids: list, probed: np.ndarray, k: int):
    """Batches of (list, content_hash, v) -> the k most similar of a task's chunks for each query, from the lists it probes."""

    def run(batches):
        best: dict[int, list[tuple[float, str]]] = {}
        kth = np.full(len(queries), -np.inf)
        for b in batches:
            lists = b.column("list").to_numpy()
            _, x = search.vectors_of(b.column("v"), queries.shape[1])
            x, hashes = _unit(x), b.column("content_hash").to_pylist()
            # equal scores by id: its place among the batch's
            place = np.empty(len(hashes), int)
            place[sorted(range(len(hashes)), key=hashes.__getitem__)] = np.arange(len(hashes))
            own, rows, scores = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for one in np.unique(lists):
                filed, asking = np.flatnonzero(lists == one), np.flatnonzero(probed[:, one])
                step = max(1, search.SCORES // max(1, len(asking)))
                for i in range(0, len(filed), step):
                    some = filed[i : i + step]
                    s = queries[asking] @ x[some].T
                    row, col = np.nonzero(s >= kth[asking][:, None])
                    own, rows, scores = np.concatenate([own, asking[row]]), np.concatenate([rows, some[col]]), np.concatenate([scores, s[row, col]])
                    keep = search.best_of(own, scores, place[rows], k)
                    own, rows, scores = own[keep], rows[keep], scores[keep]
            found: dict[int, list[tuple[float, str]]] = {}
            for q, r, s in zip(own.tolist(), rows.tolist(), scores.tolist(), strict=True):
                found.setdefault(q, []).append((-s, hashes[r]))
            for q, hits in found.items():
                best[q] = sorted([*best.get(q, []), *hits])[:k]
                if len(best[q]) == k:
                    kth[q] = -best[q][-1][0]
        flat = [(ids[q], h, -s) for q, hits in best.items() for s, h in hits]
        columns = list(zip(*flat, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["query_id", "content_hash", "score"])

    return run


class VectorIndex(_Derived):
    name = "vectors"

    def _rows(self, buckets: set[int] | None, dims: int | None = None) -> DataFrame:
        """Chunks whose vector has a direction."""
        c = self.store.read("doc_chunks", buckets).select("content_hash", F.col("embedding").alias("v"), *_FILTERS)
        c = c.filter(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
        return c.filter(F.size("v") == dims) if dims else c

    def told(self) -> dict:
        """lists, probes, recall and dims as they were trained and measured; empty before the first refresh."""
        return self.store.manifest().get("vector_lists", {})

    def centroids(self) -> np.ndarray:
        rows = self.store.spark.read.parquet(f"{self.store.root}/{self.told()['folder']}").orderBy("list").collect()
        return np.array([r["c"] for r in rows], float)

    def refresh(self, lists: int | None = None, retrain: bool = False) -> int:
        """File the chunks of stale buckets (of all, if centroids are trained anew); how many buckets that was. The first
        time, and with retrain, centroids are trained and the lists that a search reads are measured. lists: how many."""
        buckets, told = self.stale(), self.told()
        if told and not retrain and not buckets:
            return 0
        if retrain or not told:
            buckets |= {int(b) for b in self.store.manifest()["tables"].get("doc_chunks", {})}
            rows = self._rows(None)
            first = rows.select(F.size("v").alias("n"), F.xxhash64("content_hash").alias("h")).orderBy("h").limit(1).collect()
            if not first:
                return 0
            dims = first[0]["n"]
            n = self._rows(None, dims).count()
            lists = lists or min(MOST_LISTS, max(FEWEST_LISTS, n // ROWS_PER_LIST))
            sample = self._rows(None, dims).orderBy(F.xxhash64("content_hash"), "content_hash").limit(TRAINED * lists).select("v").collect()
            c = trained(np.array([r["v"] for r in sample], float), lists)
            folder = f"vectors/centroids-{uuid.uuid4().hex}"
            self.store.spark.createDataFrame([(k, x) for k, x in enumerate(c.tolist())], "list int, c array<double>").coalesce(1).write.parquet(f"{self.store.root}/{folder}")
            told = {"folder": folder, "lists": len(c), "dims": dims} | self._measured(c, dims)
        else:
            c = self.centroids()
        schema = "content_hash string, v array<float>, source_file string, status string, area_number int, doc_type string, list int"
        rows = self._rows(buckets, told["dims"]).mapInArrow(_filed(c), schema)
        self._publish({"vectors": self._stage(rows)}, buckets, vector_lists=told)
        return len(buckets)

    def _stage(self, rows: DataFrame) -> dict[str, str]:
        version = f"version={uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self.store.bucket(F.col("source_file"))).hint("rebalance", "bucket", "list")
        dealt.write.partitionBy("bucket", "list").parquet(f"{self.store.root}/vectors/{version}")
        return {n.removeprefix("bucket="): version for n in self.store._names(f"{self.store.root}/vectors/{version}") if n.startswith("bucket=")}

    def _measured(self, c: np.ndarray, dims: int) -> dict:
        """How many lists a search has to read for RECALL of the neighbors that exact search finds, on a sample."""
        rows = self._rows(None, dims).select(F.xxhash64("content_hash").alias("query_id"), F.col("content_hash"), "v")
        sample = rows.orderBy("query_id", "content_hash").limit(MEASURED).select("query_id", F.col("v").alias("q"))
        exact = search.batch_topk(rows.select(F.col("query_id").alias("id"), "v"), sample, NEIGHBORS).select("query_id", "id")
        found = exact.join(sample, "query_id").join(rows.select(F.col("query_id").alias("id"), "v"), "id").select("q", "v").collect()
        q, v = (_unit(np.array([r[n] for r in found], float).reshape(-1, dims)) for n in ("q", "v"))
        own = (v @ c.T).argmax(1)
        near = q @ c.T
        place = np.sort((near > near[np.arange(len(own)), own][:, None]).sum(1) + 1)
        probes = int(place[min(len(place) - 1, int(np.ceil(RECALL * len(place))) - 1)])
        return {"probes": probes, "recall": float((place <= probes).mean())}

    def _load(self) -> DataFrame:
        return self.store.load("vectors", self.store.manifest()["tables"].get("vectors", {}))

    def near(self, vector: list[float], probes: int | None = None) -> DataFrame:
        """content_hash, v and what filters ask of, of the chunks in the lists nearest to a vector; no other list is read."""
        told = self.told()
        if not told:
            return self.store.read("vectors")
        order = np.argsort(-(self.centroids() @ np.array(vector, float)), kind="stable")[: probes or told["probes"]]
        rows = self._load()
        return rows.filter(F.col("list").isin(order.tolist())).select(self.store.schema("vectors").names)

    def batch_topk(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """queries (query_id, q) -> query_id, content_hash, score, rank: as search.batch_topk() but from the lists that each
        query probes. Queries go to the tasks in blocks; what a block finds is written before the next."""
        told, spark = self.told(), self.store.spark
        empty = spark.createDataFrame([], "query_id long, content_hash string, score double")
        if not told:
            return search.ranked(empty, k, "content_hash")
        c, rows = self.centroids(), self._load()

        def one(block: list) -> DataFrame:
            some = [r for r in block if r["q"] is not None and len(r["q"]) == told["dims"] and any(r["q"])]
            q = _unit(np.array([r["q"] for r in some], float).reshape(-1, told["dims"]))
            order = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, : probes or told["probes"]]
            probed = np.zeros((len(q), len(c)), bool)
            np.put_along_axis(probed, order, True, 1)
            read = rows.filter(F.col("list").isin(np.unique(order).tolist())).select("list", "content_hash", "v")
            return read.mapInArrow(_nearest(q, [r["query_id"] for r in some], probed, k), empty.schema)

        return search.ranked(search.by_blocks(queries, one, empty), k, "content_hash")


def hybrid(store: Store, query: str, vector, k: int = search.DEFAULT_K, stems: bool = True, probes: int | None = None, **filters) -> DataFrame:
    """search.hybrid() over a store's indexes: the same rows, read from the postings of the query's terms, the vectors, and
    the few chunks that are shown. probes: read only as many lists of vectors, and so find what is near in those."""
    index = LexicalIndex(store, stems)
    terms = index.asked(query)
    lex = index.scores(terms, **filters)
    chunks = store.read("doc_chunks")
    if probes:
        held = chunks.join(lex.filter(F.col("held") == len(terms)).select("content_hash"), "content_hash", "left_semi")
        rows = VectorIndex(store).near(vector, probes).withColumnRenamed("v", "embedding")
        rows = rows.unionByName(held.select(*rows.columns)).dropDuplicates(["content_hash"])
    else:
        rows = chunks.select("content_hash", "embedding", *_FILTERS)
    rows = rows.filter(search.authority(**filters)).join(lex, "content_hash", "left").withColumns({"lex": F.coalesce("lex", F.lit(0.0)), "held": F.coalesce("held", F.lit(0))})
    best = search.best(rows, vector, (F.col("held") == len(terms)) & F.lit(bool(terms)), k).select("content_hash", "source_file", "score").collect()
    hits = store.spark.createDataFrame([(r["content_hash"], r["score"]) for r in best], "content_hash string, score double")
    shown = store.read("doc_chunks", store.buckets_of(store.spark.createDataFrame([(r["source_file"],) for r in best], "f string"), "f")) if best else chunks.limit(0)
    return search.shown(shown.join(F.broadcast(hits), "content_hash")).orderBy(F.desc("score"), "content_hash")
