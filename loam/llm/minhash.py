"""Near-duplicate groups by min-max hashing.

A document is its set of distinct 5-word shingles. Under each permutation of the shingles' hashes both the
smallest and the largest value are kept: two unbiased values for one evaluation. Bands of four values (of
four different permutations, so that they are independent in small sets too) bring together what may be
alike; two sets with a similarity of 0.75 share no band with a probability of 0.684**32, about 5 in a million.

What shares a band is confirmed on the full sets, without all pairs of a band:
1. Documents with equal sets are one node.
2. In each band bucket, every node is compared with the bucket's smallest node alone.
3. The links found are joined into components. A bucket whose nodes are now in one component is done. The nodes
   of the others are joined exactly by prefixes: in the order of their frequency among these nodes, two sets with
   that similarity share one of their rarest quarter of shingles. A node whose prefix no other node shares has no
   partner, however many nodes look like it; of the rest, nodes of different components that share a prefix
   shingle are confirmed too. So each two nodes of a bucket are in one component or are known not to be alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, giving_back, saved, with_counts
from .components import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Sketches (a byte of each of the 128 values) that agree in less than this share are not confirmed. Of two sets with a
#: similarity of 0.75 so few agree with a probability of 6 in 10**10, far less than that of sharing no band.
SKETCH_SHARE = 0.48
#: Nodes of a prefix shingle that are compared at once.
BLOCK = 256
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**32, (PERMUTATIONS, 1), np.uint32) | np.uint32(1), rng.integers(0, 2**32, (PERMUTATIONS, 1), np.uint32)


_A, _B = _constants()
_FIRST = np.arange(0, PERMUTATIONS, 2)
#: Where the values of each band stand among all minima and then all maxima.
_BAND = np.stack([_FIRST, _FIRST + 1, PERMUTATIONS + (_FIRST + 2) % PERMUTATIONS, PERMUTATIONS + (_FIRST + 3) % PERMUTATIONS], 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mixed(out * _M1 + h[i : i + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of all permutations."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 16384):
        y = _A * x[at : at + 16384] + _B
        np.minimum(low, y.min(1), out=low)
        np.maximum(high, y.max(1), out=high)
    return np.concatenate([low, high])


def bands(signatures: np.ndarray) -> np.ndarray:
    """(documents, 2 * PERMUTATIONS) -> (documents, BANDS) keys that tell the band too."""
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS))
    for i in range(ROWS):
        out = mixed(out * _M1 + signatures[:, _BAND[:, i]].astype(np.uint64))
    return out


def _signed(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sizes, digests, signatures = [], [], []
            for text in part.column("text"):
                s = shingles(text.as_py())
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                signatures.append(signature(s))
            sig = np.array(signatures, np.uint32).reshape(len(sizes), 2 * PERMUTATIONS)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS)
            keys = pa.ListArray.from_arrays(offsets, pa.array(bands(sig).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), keys, pa.array([bytes(x) for x in sig.astype(np.uint8)], pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )


def _alike(batches):
    """Pairs with sketches -> pairs whose sketches agree enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
        near = (x == y).mean(1) >= SKETCH_SHARE if batch.num_rows else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))


def _confirmed(batches):
    """Pairs with texts, those of one a together -> links."""
    last, s = None, None
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if a != last:
                last, s = a, shingles(a)
            t = shingles(b)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(DENOMINATOR * both >= NUMERATOR * (len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) -> those whose full sets are alike. Both sides grow with the corpus, so neither is broadcast."""
    sketch = lambda c: nodes.select(F.col("rep").alias(c), F.col("sketch").alias(f"sketch_{c}")).hint("merge")
    near = saved(pairs.join(sketch("a"), "a").join(sketch("b"), "b").mapInArrow(_alike, "a long, b long").distinct(), "pairs")
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    return near.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(giving_back(_confirmed), "a long, b long").distinct()


def _sets(batches):
    for batch in batches:
        at, sets, size = 0, [], 0

        def rows():
            reps = batch.column("rep").slice(at, len(sets))  # noqa: B023
            return pa.RecordBatch.from_arrays([reps, pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "n", "set", "shingles"])  # noqa: B023

        for text in batch.column("text"):
            sets.append(shingles(text.as_py()).view(np.int64))
            size += len(sets[-1])
            if size > 1_000_000:
                yield rows()
                at, sets, size = at + len(sets), [], 0
        yield rows()


def prefixes(texts: DataFrame) -> DataFrame:
    """(rep, text) -> (rep, n, place, shingle): of each set of n the shingles of its prefix that another set holds
    too, with their places in the order.

    Shingles are ordered by their frequency among these sets. Those of one set alone come first and can't meet
    any other, so they are only counted."""
    rows = texts.mapInArrow(giving_back(_sets), "rep long, n long, set long, shingles array<long>").select("rep", "n", "set", F.explode("shingles").alias("shingle"))
    held = saved(rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    shared = with_counts(rows, held, "shingle", "df")
    own = Window.partitionBy("rep", "set")
    by_df = own.orderBy("df", "shingle")
    shared = shared.withColumn("place", F.row_number().over(by_df) + F.col("n") - F.count("*").over(own))
    # sets of which one has n shingles share NUMERATOR / DENOMINATOR of them at least
    length = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    return shared.filter(F.col("place") <= length).select("rep", "n", "place", "shingle").distinct()


def _across(batches):
    """Rows (shingle, i, j, block, rep, component, n, place), those of one (shingle, i, j) together -> pairs of
    different components that can be alike: no more of both sets than what follows the first shingle that they
    share, and that itself, is common to them. (Of later shared shingles still less follows.)"""

    def pairs(rows):
        rep, comp, block, n, place = (np.array(c) for c in zip(*(r[:5] for r in rows), strict=True))
        other, left = rows[0][5] != rows[0][6], n - place + 1
        for k in range(len(rows) - 1):
            rest = slice(k + 1, None)
            fits = (comp[rest] != comp[k]) & ((DENOMINATOR + NUMERATOR) * np.minimum(left[rest], left[k]) >= NUMERATOR * (n[rest] + n[k]))
            if other:
                fits &= block[rest] != block[k]
            for m in rep[rest][fits].tolist():
                yield min(int(rep[k]), m), max(int(rep[k]), m)

    def out(found):
        a, b = zip(*found, strict=True) if found else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    key, rows, found = None, [], set()
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for k, *row in zip(zip(c["shingle"], c["i"], c["j"], strict=True), c["rep"], c["component"], c["block"], c["n"], c["place"], c["i"], c["j"], strict=True):
            if k != key:
                if len(rows) > 1:
                    found.update(pairs(rows))
                key, rows = k, []
                if len(found) > 20_000:
                    yield out(found)
                    found = set()
            rows.append(row)
    if len(rows) > 1:
        found.update(pairs(rows))
    yield out(found)


def across(prefix: DataFrame, label: DataFrame) -> DataFrame:
    """Prefixes and (rep, component) -> pairs of different components that share a prefix shingle. A shingle's
    nodes are compared in blocks, so that none of them makes a task hold more than two blocks."""
    placed = prefix.join(label.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("nodes")).filter("lo <> hi")
    placed = with_counts(placed, saved(sizes.select("shingle", "nodes"), "prefix-sizes"), "shingle", "nodes")
    placed = placed.withColumn("blocks", F.ceil(F.col("nodes") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("shingle", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "rep", "component", "n", "place")
    return placed.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j").mapInArrow(_across, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with doc_id, text -> doc_id, n_shingles, component_id, kept, a row for each of docs.

    A null or empty text, or one of white space, has an empty set and is linked with nothing. Rows with the same
    id are one document, linked through any of their texts. A row without id is linked with nothing: its
    component_id is null and it is kept. Extra columns are ignored; no rows give no rows."""
    signed = saved(docs.select("doc_id", "text").mapInArrow(giving_back(_signed), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"), "signed")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = saved(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    nodes = full.join(reps.withColumnRenamed("digest", "d"), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("d"))).select("rep", "bands", "sketch")
    nodes = saved(nodes.dropDuplicates(["rep", "sketch", "bands"]), "nodes")

    rows = nodes.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last"), F.count("*").alias("n")).filter("center <> last")
    shared = saved(shared.select("key", "center", "n"), "bucket-centers")
    members = saved(with_counts(rows, shared, "key").select("rep", "key", "center"), "buckets")
    drop_saved(shared)
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = saved(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi"), "bucket-texts")
    first = saved(members.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = confirm(first, nodes, texts)
    if again := repeated(docs):
        own = full.select("doc_id", "digest").join(reps, "digest").select("doc_id", "rep").distinct()
        least = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a <> last").select("doc_id", "a")
        links = links.unionByName(own.join(least, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))).distinct()
    links = saved(links, "links")
    found = components(links)

    label = found.withColumnRenamed("node", "rep")
    placed = members.join(label.hint("merge"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    rest = placed.join(split.hint("merge"), "key", "left_semi").select("rep").distinct()
    rest_texts = texts.withColumnRenamed("doc_id", "rep").join(rest.hint("merge"), "rep", "left_semi")
    second = across(saved(prefixes(rest_texts), "prefixes"), label)
    second = saved(second.join(first.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        more = saved(confirm(second, nodes, texts), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more))

    out = signed.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("doc_id")))
    if again:  # a row without words belongs to its id's component
        out = out.withColumn("component_id", F.min("component_id").over(Window.partitionBy("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def repeated(docs: DataFrame) -> bool:
    """Whether any id has two rows."""
    return not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each group (see near_duplicates): the one with the smallest id, of repeated rows any
    one, always the same. Rows without id stay."""
    keep = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    out = docs.join(keep, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    if repeated(docs):
        order = Window.partitionBy("doc_id").orderBy(*(c for c in docs.columns if c != "doc_id"))
        out = out.withColumn("row_of_id", F.row_number().over(order)).filter("row_of_id = 1 OR doc_id IS NULL").drop("row_of_id")
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
