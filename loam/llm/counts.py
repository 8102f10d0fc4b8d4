"""Token counts by lookup in two tiers, where the text lies.

For byte-level BPE a text falls into chunks (see tokens.Encoder) whose numbers of tokens add up. Frequent chunks are
found over all texts: each task sums its own, and hands on those that are at least one in SHARE of what it has read;
only these are shuffled and added up. The MOST_FREQUENT of them with their numbers of tokens are broadcast, MOST_BYTES
together at most. What they lack is encoded by the library and kept in a cache of the worker, of bounded size. No
chunk of the texts is shuffled. Which chunks are frequent changes the time that a count takes, never the count.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, table
from .tokens import Encoder

LIMIT = 512
#: Chunks in the broadcast table, and the bytes of a chunk that can be in it or in a worker's cache.
MOST_FREQUENT, LONGEST = 65_536, 48
MOST_BYTES = MOST_FREQUENT * (LONGEST + 9)
#: A task hands on chunks that are at least one in SHARE of its own, so fewer than SHARE of them.
SHARE = 20_000
#: Different chunks that a task counts at once; beyond it those that were met least go.
COUNTED = 200_000
#: Chunks that a worker keeps beside the table, in each of two generations.
CACHE = 200_000

#: White space that touches a space or an end.
_TOUCHING = re.compile(r" \s|\s |\A\s|\s\Z")


class Lengths(Encoder):
    """Numbers of tokens in place of ids. frequent: chunks whose numbers are known."""

    total = staticmethod(sum)

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache: int = CACHE):
        super().__init__(path, cache + len(frequent or ()))
        self.frequent, self.once = frequent or {}, []
        self.kept = self.fresh()
        self.added = dict.fromkeys(self.added, 1)

    def fresh(self) -> dict[str, int]:
        return dict(self.frequent)

    def keep(self, chunks: list[str], ids: np.ndarray, last) -> None:
        n = [len(ids)] if len(chunks) == 1 else np.diff(last, prepend=-1).tolist()
        self.kept.update(zip(chunks, n, strict=True))
        self.once += [c for c in chunks if len(c) > LONGEST]

    def plain(self, texts: list[str]) -> list[int]:
        """Long chunks are not kept."""
        out = super().plain(texts)
        for c in self.once:
            self.kept.pop(c, None)
            self.older.pop(c, None)
        self.once.clear()
        return out

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, block by block; added tokens are left out."""
        for part in self.parts(text)[::2]:
            for block in self.blocks(part):
                if not block or _TOUCHING.search(block):
                    yield self.joined(block)
                else:
                    s = block.split(" ")
                    s[0] = " " + s[0]
                    yield s


class Library:
    """Whole texts by the library alone, for files whose texts don't fall into chunks."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.count = lambda t: len(model.encode(t))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)

    def each(self, texts: list[str]):
        return map(self.count, texts)


def splits(path: str) -> bool:
    """Whether texts fall into chunks: a .json of byte-level BPE as it comes, nothing normalised, cut by its pattern."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before = told.get("pre_tokenizer") or {}
    return told["model"].get("type", "BPE") == "BPE" and told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told["model"].get("dropout")


def _frequent(path: str):
    """Texts -> the chunks that a task has met often, with how often."""

    def run(batches):
        encoder, met, n = Lengths(path), Counter(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for t in batch.column("text").slice(k, 256).to_pylist():
                    for s in encoder.chunks(t or ""):
                        met.update(s)
                        n += len(s)
                if len(met) > COUNTED:
                    met = Counter(dict(met.most_common(COUNTED // 4)))
        found = [(c, x) for c, x in met.items() if x * SHARE >= n and x > 1 and len(c.encode()) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], ["chunk", "n"])

    return run


def frequent(docs: DataFrame, path: str, most: int = MOST_FREQUENT) -> DataFrame:
    """The most frequent chunks of all texts: chunk, n (as far as tasks have handed it on)."""
    met = docs.select("text").mapInArrow(giving_back(_frequent(path)), "chunk string, n long")
    return met.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(most)


@lru_cache(maxsize=2)
def _lengths(path: str, key: bytes) -> Lengths:
    t = pa.ipc.open_stream(key).read_all()
    return Lengths(path, dict(zip(t.column("chunk").to_pylist(), t.column("tokens").to_pylist(), strict=True)))


def packed(spark: SparkSession, chunks: DataFrame, path: str) -> bytes:
    """Chunks with their numbers of tokens as one Arrow table: text, and a small integer for each."""
    found = [r["chunk"] for r in chunks.select("chunk").collect()]
    known = Lengths(path)
    known.learn(found)
    t = pa.table({"chunk": pa.array(found, pa.string()), "tokens": pa.array([known.kept[c] for c in found], pa.uint8())})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _counted(path: str, known):
    """(doc_id, text, n_bytes) -> doc_id, n_bytes, n_tokens."""

    def run(batches):
        counter = _lengths(path, known.value) if known else Library(path)
        for batch in batches:
            n = [x for k in range(0, batch.num_rows, 256) for x in counter.each([t or "" for t in batch.column("text").slice(k, 256).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit of every whole text, as the tokenizer's library has it.

    A null text is empty: no bytes, no tokens. An added token in a text counts as one, as in the library. Rows stay as
    they are, null and repeated ids too; extra columns are ignored; no rows give no rows. A file whose texts don't
    fall into chunks (see splits()) is left to the library, whole text by whole text."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(packed(spark, frequent(docs, tokenizer), tokenizer)) if splits(tokenizer) else None
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(giving_back(_counted(tokenizer, known)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
