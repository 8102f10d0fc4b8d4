"""Token ids in ORC: integer run-length encoded stripes, row indexes, and Bloom filters on document ids.

Documents are dealt out in ranges of doc_id and sorted, so that each file holds a run of ids: a reader
can skip files and stripes by their minimum and maximum, look up single documents through the Bloom
filters, and read stripes in parallel. Each row carries its shard and its ids; offsets follow from the
sums of the shards, which are as few as the files.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, new_path, saved, table

END_ID = 2
#: Chunks of text whose ids a Python worker keeps when it makes room, which it does at twice as many: some 80 MB.
CACHE = 250_000
#: Characters of a chunk that is kept then, and on average of all that are kept.
LONGEST, USUAL = 64, 16
#: Characters that are cut into chunks at once.
BLOCK = 1_000_000
#: New chunks that are encoded as one text.
JOINED = 100
#: Characters of texts that are encoded at once, and runs without letters whose ids a worker keeps.
TOGETHER, MARKS = 4_000_000, 20_000
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(8 << 20), "orc.encoding.strategy": "SPEED", "compression": "zstd"}


@lru_cache(maxsize=2)
def encoder(path: str, cache: int = CACHE, together: int = TOGETHER) -> Ids:
    return Ids(path, cache, together)


#: A place between chunks.
_APART = re.compile(r"\S(?= \S)")
#: Letters, and signs that the pattern of byte-level pre-tokenization always breaks from them. An apostrophe isn't: "'s" is one piece.
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ſ", r"0-9!-&(-/:-@\[-`{-~"
_WORD, _PARTS = re.compile(f"[{_LETTER}]+"), re.compile(f"[{_LETTER}]+|[^{_LETTER}]+")
#: Words and signs; a single line end between them is a piece by itself.
_MADE = re.compile(f"[{_LETTER}{_SIGN}]+(?:\n[{_LETTER}{_SIGN}]+)*")


class Encoder:
    """Whole texts to ids, as the library encodes them, with the ids of frequent chunks kept. It is for byte-level
    BPE files whose added tokens are taken as they stand.

    A chunk is a run of text from one space to the next that neither starts nor ends in white space. Byte-level
    pre-tokenization breaks before a space that such a run follows, so a text's ids are its chunks' ids in
    turn; where a chunk would touch other white space it is joined with its neighbours. An added token in a text
    (such as the end of a document) is its own id, as the library has it, and breaks the text too.

    Chunks are known by what follows their space; what has none, or more than one, by itself after a space."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.breaks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)

    @staticmethod
    def touching(chunk: str) -> bool:
        """Whether a run between two spaces is empty or has white space at an end."""
        own = chunk[1:] if chunk[:1] == " " else chunk
        return not own or own[0].isspace() or own[-1].isspace()

    @staticmethod
    def joined(text: str) -> list[str]:
        """The chunks of a text in which white space touches a space or an end."""
        out, held = [], ""

        def close():
            out.append(held[1:] if held[0] == " " and len(held) > 1 and not held[1].isspace() and not held[-1].isspace() else " " + held)

        for k, part in enumerate(text.split(" ")):
            if not part:
                held += " " if k else ""
                continue
            if held and not part[0].isspace() and not held[-1].isspace():
                close()
                held = " " + part
            else:
                held += " " + part if k else part
        if held:
            close()
        return out

    def learn(self, missing: list[str]) -> None:
        """Keep the ids of new chunks. Chunks after a space are encoded many at a time as one text, whose ids are cut
        where the bytes of a chunk end; a token never reaches over a chunk's end."""
        usual = [c for c in missing if c[0] != " " and not c[-1].isspace()]
        for c in {*missing}.difference(usual):
            whole = c[1:] if c[0] == " " else " " + c
            self.keep([c], np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, "<u4"), [-1])
        for i in range(0, len(usual), JOINED):
            some = usual[i : i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.n_bytes[ids])
            self.keep(some, ids, np.searchsorted(ends, np.cumsum([1 + len(c.encode()) for c in some]), "left"))

    def keep(self, chunks: list[str], ids: np.ndarray, last) -> None:
        """Keep chunks that follow each other: their ids together, and the place of each one's last."""
        raw, at = ids.tobytes(), 0
        for c, k in zip(chunks, last, strict=True):
            cut = 4 * int(k) + 4 or len(raw)
            self.kept[c] = raw[at:cut]
            at = cut

    #: What becomes of the chunks of a text.
    total = staticmethod(b"".join)

    def fresh(self) -> dict:
        """What a new generation of kept chunks starts with."""
        return {}

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without added tokens."""
        split = [(" " + t).split(" ") for t in texts]
        for s in split:
            s[:2] = [" " + s[1]]
        missing = set().union(*split).difference(self.kept)
        if bad := set(filter(self.touching, missing)):
            split = [s if bad.isdisjoint(s) else self.joined(t) for s, t in zip(split, texts, strict=True)]
            missing = set().union(*split).difference(self.kept)
        if missing:
            for c in missing & self.older.keys():
                self.kept[c] = self.older[c]
            self.learn(list(missing.difference(self.older)))
        out = [self.total(map(self.kept.__getitem__, s)) for s in split]
        if len(self.kept) > self.cache:
            self.kept, self.older = self.fresh(), self.kept
        return out

    @staticmethod
    def blocks(text: str) -> Iterator[str]:
        """A text of any length, cut into blocks between chunks."""
        at = 0
        while len(text) - at > BLOCK and (cut := _APART.search(text, at + BLOCK - 1)):
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def parts(self, text: str) -> list[str]:
        """A text as stretches without added tokens, and between them the added tokens."""
        return self.breaks.split(text) if self.breaks else [text]

    def __call__(self, text: str) -> bytes:
        """The ids of a text, as unsigned 32-bit little-endian integers."""
        return self.total(self.added[p] if k % 2 else self.total(self.plain([b])[0] for b in self.blocks(p)) for k, p in enumerate(self.parts(text)))

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; those without added tokens some at a time, of BLOCK characters together."""
        held, size = [], 0
        for t in texts:
            usual = len(t) <= BLOCK and not (self.breaks and self.breaks.search(t))
            if held and (not usual or size + len(t) > BLOCK):
                yield from self.plain(held)
                held, size = [], 0
            if usual:
                held.append(t)
                size += len(t)
            else:
                yield self(t)
        if held:
            yield from self.plain(held)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all stretches, one after another."""
    ends = np.cumsum(lengths)
    out = np.repeat((starts - ends + lengths).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Ids(Encoder):
    """Many texts at once. Arrow splits them and tells their chunks apart, so that only different chunks are looked up; the
    ids of those that are kept lie in one array, from which the ids of the texts are taken together.

    A new chunk of letters is one pre-token, which the library's model takes as it is. One of words and signs is put together from
    its parts, since pre-tokenization breaks between them. All others are left to the library as they stand."""

    def __init__(self, path: str, cache: int = CACHE, together: int = TOGETHER):
        super().__init__(path, cache)
        self.together = together
        mapped = lambda t: self.tokenizer.pre_tokenizer.pre_tokenize_str(t)[0][0]
        self.space = mapped(" a")[:-1]
        self.letters = {k: mapped(chr(k)) for k in range(128, 384) if _WORD.match(chr(k))}
        self.tokenize = self.tokenizer.model.tokenize
        #: The n-th chunk of kept has the ids from ends[n] to ends[n + 1] in pool.
        self.kept: dict[str, int] = {}
        self.pool, self.ends, self.uses = array("I"), array("i", [0]), np.zeros(0, np.int32)
        self.marks: dict[str, list[int]] = {}
        self.size = 0

    def put(self, chunk: str, ids: list[int]) -> None:
        self.kept[chunk] = len(self.kept)
        self.pool.extend(ids)
        self.ends.append(len(self.pool))
        self.size += len(chunk)

    def keep(self, chunks: list[str], ids: np.ndarray, last) -> None:
        at = 0
        for c, k in zip(chunks, last, strict=True):
            cut = int(k) + 1 or len(ids)
            self.put(c, ids[at:cut].tolist())
            at = cut

    def word(self, text: str, space: bool) -> list[int]:
        """The ids of letters alone."""
        text = text if text.isascii() else text.translate(self.letters)
        return [t.id for t in self.tokenize(self.space + text if space else text)]

    def part(self, text: str, space: bool) -> list[int]:
        """The ids of a word, or of signs, that is part of a chunk."""
        if _WORD.match(text):
            chunk = text if space else " " + text
            if (n := self.kept.get(chunk)) is not None:
                return self.pool[self.ends[n] : self.ends[n + 1]]
            self.put(chunk, ids := self.word(text, space))
            return ids
        text = " " + text if space else text
        if (ids := self.marks.get(text)) is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(text) <= LONGEST:
                if len(self.marks) >= MARKS:
                    self.marks.clear()
                self.marks[text] = ids
        return ids

    def learn(self, missing: list[str]) -> None:
        rest, kept, tokenize, mark = [], self.kept, self.tokenize, self.space
        for c in missing:
            if c in kept:  # as a part of one before
                continue
            space = c[0] != " "
            text = c if space else c[1:]
            if text.isalpha() and text.isascii():
                self.put(c, [t.id for t in tokenize(mark + text if space else text)])
            elif text.isalpha() and _WORD.fullmatch(text):
                self.put(c, self.word(text, space))
            elif _MADE.fullmatch(text):
                ids = []
                for p in _PARTS.findall(text):
                    ids += self.part(p, space)
                    space = False
                self.put(c, ids)
            else:
                rest.append(c)
        super().learn(list(dict.fromkeys(rest)))

    def make_room(self) -> None:
        """Of all chunks, keep those that were used most, and none of the long ones."""
        names = list(self.kept)
        usual = np.flatnonzero(np.fromiter(map(len, names), np.int64, len(names)) <= LONGEST)
        if len(usual) > self.cache:
            usual = np.sort(usual[np.argpartition(-self.uses[usual], self.cache)[: self.cache]])
        ends = np.array(self.ends)
        lengths = ends[usual + 1] - ends[usual]
        pool = np.array(self.pool, np.uint32)[_ragged(ends[usual], lengths)]
        self.kept = {names[k]: n for n, k in enumerate(usual.tolist())}
        self.pool, self.ends = array("I", pool.tobytes()), array("i", np.append(0, np.cumsum(lengths)).astype(np.int32).tobytes())
        self.uses, self.size = self.uses[usual] // 2, sum(map(len, self.kept))

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without added tokens, one text after another, and how many each has."""
        if len(self.kept) > 2 * self.cache or self.size > 2 * self.cache * USUAL:
            self.make_room()
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        heads = pc.binary_join_element_wise(pa.scalar(" ", texts.type), pc.list_element(split, 0), pa.scalar("", texts.type))
        told = pc.dictionary_encode(pa.concat_arrays([split.values, heads]))
        order = told.indices.to_numpy().copy()
        order[bounds[:-1]] = order[bounds[-1] :]
        order = order[: bounds[-1]]
        chunks = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self.kept.get, chunks, repeat(-1)), np.int32, len(chunks))
        new = np.flatnonzero(slots < 0)
        fresh = [chunks[k] for k in new.tolist()]
        usual = ~np.fromiter(map(self.touching, fresh), bool, len(fresh))
        fresh = fresh if usual.all() else [c for c, u in zip(fresh, usual.tolist(), strict=True) if u]
        self.learn(fresh)
        slots[new[usual]] = np.fromiter(map(self.kept.__getitem__, fresh), np.int32, len(fresh))
        counts = np.bincount(order, minlength=len(chunks))
        bad = slots < 0
        seq = slots[order]
        if bad.any():
            parts, lengths, at = [], np.diff(bounds), 0
            for k in np.unique(np.searchsorted(bounds, np.flatnonzero(bad[order]), "right") - 1).tolist():
                own = self.joined(texts[k].as_py())
                self.learn([c for c in own if c not in self.kept])
                parts += [seq[at : bounds[k]], np.array([self.kept[c] for c in own], np.int32)]
                lengths[k], at = len(own), bounds[k + 1]
            seq, bounds = np.concatenate([*parts, seq[at:]]), np.append(0, np.cumsum(lengths))
        self.uses = np.append(self.uses, np.zeros(len(self.kept) - len(self.uses), np.int32))
        self.uses[slots[~bad]] += counts[~bad].astype(np.int32)
        pool, ends = np.frombuffer(self.pool, np.uint32), np.frombuffer(self.ends, np.int32)
        starts = ends[seq]
        lengths = ends[seq + 1] - starts
        before = np.append(0, np.cumsum(lengths))
        return pool[_ragged(starts, lengths)], np.diff(before[bounds])

    def plain(self, texts: list[str]) -> list[bytes]:
        ids, lengths = self.many(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])]

    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts, and how many each has, for some texts after another: `together` characters of those without added tokens."""
        size = pc.binary_length(texts).to_numpy()
        single = size > BLOCK
        if self.breaks:
            single |= pc.match_substring_regex(texts, self.breaks.pattern).to_numpy(zero_copy_only=False)
        held = n = 0
        for k, (alone, x) in enumerate(zip(single.tolist(), size.tolist(), strict=True)):
            if k > held and (alone or n + x > self.together):
                yield self.many(texts.slice(held, k - held))
                held, n = k, 0
            n += x
            if alone:
                ids = np.frombuffer(self(texts[k].as_py()), "<u4")
                yield ids, np.array([len(ids)])
                held, n = k + 1, 0
        if held < len(texts):
            yield self.many(texts.slice(held))


def _encode(path: str, end_id: int, cache: int, together: int = TOGETHER):
    def run(batches):
        encode, n = encoder(path, cache, together), 0
        for batch in batches:
            at = 0
            for ids, lengths in encode.runs(pc.fill_null(batch.column("text"), "")):
                part, at = batch.slice(at, len(lengths)), at + len(lengths)
                ends = np.cumsum(lengths)
                offsets = np.append(0, ends + np.arange(1, len(ends) + 1)).astype(np.int32)
                flat = pa.array(np.insert(ids, ends, end_id).view(np.int32))
                numbers = pa.array(np.arange(n, n := n + len(lengths)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("shard"), numbers, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "shard", "row", "ids"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None, cache: int = CACHE, together: int = TOGETHER) -> None:
    """Write docs (doc_id, text) as ORC (doc_id, shard, row, ids): one file a range of doc_id, in ascending order; row is
    the place in the file, from 0.

    A null text is empty and has the end id alone; null ids come first; rows with the same id stay together, in
    the order of their texts; extra columns are ignored; no rows make a readable table without rows. `shards`:
    the number of ranges (the session's shuffle partitions if none). `cache`, `together`: see CACHE and TOGETHER; they
    change the time and memory that a task takes, not what it writes."""
    rows = docs.select("doc_id", "text")
    dealt = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    dealt = dealt.withColumn("shard", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(giving_back(_encode(tokenizer, end_id, cache, together)), "doc_id long, shard int, row long, ids array<int>").write.options(**ORC).orc(path)


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        view = memoryview(np.ascontiguousarray(flat)).cast("B")
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("shard"), batch.column("row"), pa.array([b - a for a, b in spans], pa.int64()), pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in spans], pa.int64())], ["doc_id", "shard", "row", "n_tokens", "ids_crc32"]
        )


def index(tokens: DataFrame) -> DataFrame:
    """What write() wrote -> doc_id, start, n_tokens, ids_crc32. start: the ids of all documents before it.

    The ids are read once; what is left of each row is kept in a table. Offsets run within a shard, by the rows' places in the file; the shards'
    own offsets come from one sum for each (there are as many as files, so they fit a broadcast)."""
    rows = saved(tokens.mapInArrow(giving_back(_checksums), "doc_id long, shard int, row long, n_tokens long, ids_crc32 long"), "token-rows")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(sums), F.col("shard") == F.col("s")).select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """The tokens of single documents: files, stripes and row groups without them are not read."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids))


def encode_table(docs: DataFrame, tokenizer: str, cache: int = CACHE, together: int = TOGETHER) -> DataFrame:
    """Write docs into the shared folder, read the files back and index them."""
    spark = docs.sparkSession
    path = new_path(spark, "orc")
    write(docs, path, tokenizer, cache=cache, together=together)
    rows = spark.read.schema("doc_id long, shard int, row long, ids array<int>").orc(path)
    return index(rows)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
