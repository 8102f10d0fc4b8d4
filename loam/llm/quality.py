"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network in numpy, and
probabilities calibrated by temperature.

Each token has a sparse random index vector. A token's word vector is the sum of the index vectors of its
neighbours over the whole corpus: every partition adds up its own, the partitions' sums meet by token.
Tokens are a word's lower-cased form and its shape (letters, capitals, digits and signs, with runs
collapsed), both hashed into a fixed number of rows, so that the model is bounded whatever the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket

#: Rows of the table of word vectors, their length, and the entries of an index vector that are not 0.
ROWS, DIM, ENTRIES = 16384, 64, 6
#: Tokens on either side that count as neighbours; each word is two tokens.
NEAR = 2
#: The network is fitted on at most so many labelled documents, those whose ids hash lowest; all other
#: statistics come from all documents.
MOST_LABELLED = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
THRESHOLD = 0.3
_SHAPE = bytes(0x61 if c >= 0x80 or 0x61 <= c <= 0x7A else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def index_vectors() -> np.ndarray:
    """A row for each token and an empty one for the gap between documents."""
    rng = np.random.default_rng(11)
    out = np.zeros((ROWS + 1, DIM), np.int8)
    at = np.argsort(rng.random((ROWS, DIM)), 1)[:, :ENTRIES]
    out[np.arange(ROWS)[:, None], at] = rng.integers(0, 2, (ROWS, ENTRIES), np.int8) * 2 - 1
    return out


class Tokens(dict):
    """A word's two rows, form and shape, in the lower and upper half of one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower()) % ROWS | xxhash.xxh3_64_intdigest(b"\0" + shape) % ROWS << 16
        return value

    def ids(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.__getitem__, words), "<u4", len(words)).view("<u2")


def _contexts(batches):
    index, tokens = index_vectors(), Tokens()
    sums = np.zeros((ROWS + 1, DIM), np.int64)
    gap = np.full(NEAR, ROWS, np.uint16)
    held: list[np.ndarray] = [gap]

    def flush():
        ids = np.concatenate(held)
        for at in range(0, len(ids) - 2 * NEAR, 200_000):
            some = ids[at : at + 200_000 + 2 * NEAR]
            n = len(some) - 2 * NEAR
            context = sum(index[some[k : k + n]] for k in range(2 * NEAR + 1) if k != NEAR)
            center = some[NEAR : NEAR + n]
            order = np.argsort(center, kind="stable")
            ranked = center[order]
            starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            sums[ranked[starts]] += np.add.reduceat(context[order], starts, 0, np.int32)
        held[:] = [gap]

    for batch in batches:
        size = 0
        for text in batch.column("text"):
            held.extend((tokens.ids(text.as_py()), gap))
            size += len(held[-2])
            if size > 400_000:
                flush()
                size = 0
        flush()
    yield from _rows_of(sums[:ROWS])


def _rows_of(sums: np.ndarray):
    rows = np.flatnonzero(sums.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([sums[r].tobytes() for r in rows], pa.binary())], ["row", "vector"])


def _added(batches):
    sums = np.zeros((ROWS, DIM), np.int64)
    for batch in batches:
        if batch.num_rows:
            np.add.at(sums, batch.column("row").to_numpy(), np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int64).reshape(-1, DIM))
    yield from _rows_of(sums)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(ROWS, DIM) vectors of length 1 learned from all texts; a token that was not seen has a zero vector."""
    sums = docs.select("text").filter("text IS NOT NULL").mapInArrow(_contexts, "row int, vector binary")
    got = sums.repartition("row").mapInArrow(_added, "row int, vector binary").toPandas()
    out = np.zeros((ROWS, DIM))
    if len(got):
        out[got.row] = np.frombuffer(b"".join(got.vector), np.int64).reshape(-1, DIM)
        total = out.sum(0)
        out -= np.abs(out).sum(1, keepdims=True) * total / max(np.abs(out).sum(), 1)  # what all tokens have in common
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


N_FEATURES = 6 * DIM + 2


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of a document's forms and shapes each: mean, spread and mean step from one to the next; and its length."""
    out = np.zeros(N_FEATURES, np.float32)
    n = len(ids) // 2
    if n:
        for k in range(2):
            total, square, step, last = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM), None
            for at in range(0, n, 50_000):
                x = vectors[ids[k::2][at : at + 50_000]]
                total += x.sum(0)
                square += (x * x).sum(0)
                if last is not None:
                    step += np.abs(x[0] - last)
                step += np.abs(x[1:] - x[:-1]).sum(0)
                last = x[-1]
            mean = total / n
            out[3 * k * DIM : 3 * (k + 1) * DIM] = np.concatenate([mean, np.sqrt(np.maximum(square / n - mean * mean, 0)), step / max(n - 1, 1)])
        out[-2:] = np.log1p(n), len(np.unique(ids[::2])) / n
    return out


def _features(vectors: np.ndarray):
    def run(batches):
        tokens = Tokens()
        for batch in batches:
            x = [pooled(tokens.ids(t.as_py()), vectors).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "features"])

    return run


class Network:
    """Standardised features, a hidden layer of rectified units, and a logit divided by a temperature."""

    def __init__(self, n: int):
        rng = np.random.default_rng(3)
        self.w1, self.b1 = rng.normal(0, np.sqrt(2 / n), (n, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)
        self.mean, self.spread, self.temperature = np.zeros(n), np.ones(n), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on four fifths of the rows; the temperature, a quarter to 8, that is likeliest on the others."""
        rng = np.random.default_rng(7)
        own = rng.permutation(len(x))
        aside, own = own[: len(x) // 5], own[len(x) // 5 :]
        self.mean, self.spread = x[own].mean(0), x[own].std(0) + 1e-4
        z, t = (x[own] - self.mean) / self.spread, y[own]
        weights = [self.w1, self.b1, self.w2, self.b2]
        first, second, n = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // BATCH)):
                h = np.maximum(z[at] @ self.w1 + self.b1, 0)
                error = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40))) - t[at]) / len(at)
                back = np.outer(error, self.w2) * (h > 0)
                n += 1
                for k, g in enumerate((z[at].T @ back + DECAY * self.w1, back.sum(0), h.T @ error + DECAY * self.w2, error.sum(keepdims=True))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    weights[k] -= RATE * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
        if len(aside):
            logits, t = self.logits(x[aside]), y[aside]
            tried = np.geomspace(0.25, 8, 81)
            self.temperature = float(min(tried, key=lambda c: np.logaddexp(0, np.where(t > 0, -logits, logits) / c).mean()))
        return self


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = MOST_LABELLED) -> Network | None:
    """labels (doc_id, quality): rows without either are left out, and rows whose id has no document; with no
    label of either kind left there is nothing to learn (None)."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").orderBy(order, "doc_id", "quality").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    got = rows.mapInArrow(_features(vectors), "doc_id long, quality int, features binary").toPandas()
    if got.quality.nunique() < 2:
        return None
    got = got.sort_values(["doc_id", "quality", "features"])
    x = np.frombuffer(b"".join(got.features), np.float32).reshape(-1, N_FEATURES).astype(float)
    return Network(N_FEATURES).fit(x, got.quality.to_numpy(float))


def _scored(vectors: np.ndarray, network: Network | None):
    def run(batches):
        tokens = Tokens()
        for batch in batches:
            x = np.array([pooled(tokens.ids(t.as_py()), vectors) for t in batch.column("text")], np.float32).reshape(batch.num_rows, N_FEATURES)
            score = network.score(x.astype(float)) if network else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted, a row for each of docs.

    Labels are learned only from ids whose crc32 modulo 5 is not 0. A null or empty text is scored as a document
    without words; a null id keeps its row; repeated rows score alike; extra columns are ignored; without labels
    every score is 0.5; no rows give no rows. Texts are read whole."""
    held = bucket(F.col("doc_id"), 5) == 0
    vectors = word_vectors(docs)
    network = train(docs, labels.filter(~held), vectors)
    found = docs.select("doc_id", "text").mapInArrow(_scored(vectors, network), "doc_id long, score double")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
