"""The stored tables: Parquet in hash buckets, and one manifest that says which folder holds each bucket of each table.

A batch writes the buckets that hold its files or hashes anew, beside the old ones, and then a manifest with the next
number, which takes its name in one rename. Readers take the manifest with the greatest number, so that at any moment
they see all of a batch or none, and a batch that fails leaves no trace; buckets that a batch doesn't touch keep their
folder. That holds on file systems whose rename is atomic and fails where the name is taken (HDFS, local ones); on an
object store without it let one writer at a time commit.

Beside the tables of the collection there are two that only speed things up: chunk_hashes says which file has a chunk
(so that a batch finds the buckets of its hashes), file_stats has a row for each file with what health and
neighborhoods ask of its chunks. The query log is appended to, a folder for each append, and compacted by day.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEYS, TABLES

#: Buckets of a new store; a sync of few files writes about one in BUCKETS of the bytes for each.
BUCKETS = 64
#: Bytes of Parquet that a batch deals out to buckets at once: what their shuffles take on disk goes before the next are dealt out.
AT_ONCE = 256 << 20
#: Texts take a third less than with Parquet's default.
COMPRESSION = "zstd"
#: Spark's own setting by which a query's shuffle files go when it is done, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """buckets: into how many a new store is dealt; one that exists keeps its own."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._new_buckets, self._buckets = spark, root.rstrip("/"), buckets, None
        self._work = f"{self.root}/work/{uuid.uuid4().hex}"

    # --- files and manifests

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _bytes(self, path: str) -> int:
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _pointed(self, number: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT/{number}", wholetext=True).first()[0])

    def _numbers(self) -> list[str]:
        return sorted((n for n in self._names(f"{self.root}/CURRENT") if n.isdigit()), key=int)

    def manifest(self) -> dict:
        """buckets; tables: the folder of each bucket that has rows; batches: the last of each stream; log."""
        found = self._numbers()
        if found:
            return self._pointed(found[-1])
        return {"buckets": self._new_buckets, "tables": {}, "batches": {}, "log": {"days": {}, "from": 0, "current": 0}}

    def _point(self, manifest: dict) -> None:
        found = self._numbers()
        n = int(found[-1]) + 1 if found else 1
        fs, aside = self._fs(f"{self.root}/CURRENT/.new-{uuid.uuid4().hex}")
        _, p = self._fs(f"{self.root}/CURRENT/{n:09d}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(aside, p):
            raise OSError(f"another batch has become version {n} of {self.root}")

    def clear(self, keep: int = 2) -> None:
        """Delete all but the last `keep` manifests, and the folders that only older ones name."""
        numbers = self._numbers()
        all_ = [self._pointed(n) for n in numbers]
        folders = lambda ms: {f"{t}/{folder}/bucket={b}" for m in ms for t, bs in m["tables"].items() for b, folder in bs.items()} | {f"query_log/{f}" for m in ms for f in m["log"]["days"].values()}
        used = folders(all_[-keep:])
        for folder in folders(all_[:-keep]) - used:
            self._delete(f"{self.root}/{folder}")
        live = {u.rsplit("/", 1)[0] for u in used}
        for folder in {f.rsplit("/", 1)[0] for f in folders(all_[:-keep]) if not f.startswith("query_log/")} - live:
            self._delete(f"{self.root}/{folder}")
        for epoch in range(min((m["log"]["from"] for m in all_[-keep:]), default=0)):
            self._delete(f"{self.root}/query_log/epoch={epoch}")
        for n in numbers[:-keep]:
            self._delete(f"{self.root}/CURRENT/{n}")

    # --- reading and writing buckets

    def schema(self, table: str):
        return self.spark.createDataFrame([], TABLES[table]).schema

    def bucket(self, key: Column) -> Column:
        if self._buckets is None:
            self._buckets = self.manifest()["buckets"]
        return F.pmod(F.xxhash64(key), F.lit(self._buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, key: str) -> set[int]:
        """The buckets that rows belong to by a column; no more numbers than the store has buckets."""
        return {r[0] for r in rows.select(self.bucket(F.col(key)).alias("b")).distinct().collect()}

    def _load(self, table: str, folders: dict[str, str]) -> DataFrame:
        return self.load(table, folders).select(self.schema(table).names)

    def load(self, table: str, folders: dict[str, str]) -> DataFrame:
        """Some buckets, with what their folders say too."""
        paths = [f"{self.root}/{table}/{v}/bucket={b}" for b, v in folders.items()]
        reader = self.spark.read.schema(self.schema(table)).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema(table))

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """A table as the newest manifest has it; only some buckets of it if they are named."""
        m = self.manifest()
        if table == "query_log":
            return self._log(m)
        return self._load(table, {b: v for b, v in m["tables"].get(table, {}).items() if buckets is None or int(b) in buckets})

    def read_keys(self, table: str, keys: list[str]) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        some = self.spark.createDataFrame([(k,) for k in keys], "k string")
        return self.read(table, self.buckets_of(some, "k")).filter(F.col(KEYS[table]).isin(keys))

    def stage(self, table: str, rows: DataFrame, part: tuple[str, Column] | None = None, order: str | None = None, bucket: str | None = None) -> dict[str, str]:
        """Write rows in buckets that no manifest names yet -> the folder of each bucket that has any. part: a name and a
        column by which buckets have folders of their own; order: what rows are sorted by there; bucket: the column that
        has a row's bucket, where that of its table's key is not in the rows."""
        version = f"version={uuid.uuid4().hex}"
        by = ["bucket"] + ([part[0]] if part else [])
        own = self.bucket(F.col(KEYS[table])) if bucket is None else F.col(bucket)
        dealt = rows.withColumn("bucket", own).to(self.schema(table).add("bucket", "integer"))
        dealt = (dealt.withColumn(*part) if part else dealt).hint("rebalance", *by)
        if order:
            dealt = dealt.sortWithinPartitions(*by, order)
        dealt.write.partitionBy(*by).parquet(f"{self.root}/{table}/{version}", compression=COMPRESSION)
        return {n.removeprefix("bucket="): version for n in self._names(f"{self.root}/{table}/{version}") if n.startswith("bucket=")}

    def stage_all(self, tables: dict[str, DataFrame]) -> dict[str, dict[str, str]]:
        """stage() of tables that don't wait for each other, at once."""
        with ThreadPoolExecutor(len(tables) or 1) as pool:
            return dict(zip(tables, pool.map(self.stage, tables, tables.values()), strict=True))

    def groups(self, buckets: set[int], tables: dict[str, set[int]]) -> list[set[int]]:
        """buckets in groups of about AT_ONCE bytes, by what cut() has written and by what some buckets of tables hold."""
        named = self.manifest()["tables"]
        paths = [self._work] + [f"{self.root}/{t}/{v}/bucket={b}" for t, some in tables.items() for b, v in named.get(t, {}).items() if int(b) in some]
        n = min(len(buckets), 1 + sum(map(self._bytes, paths)) // AT_ONCE)
        return [set(sorted(buckets)[i::n]) for i in range(n)]

    def of(self, rows: DataFrame, buckets: set[int]) -> DataFrame:
        """The rows (source_file) of some buckets."""
        own = self.bucket(F.col("source_file"))
        return rows if len(buckets) == self._buckets else rows.filter(own.isin(*buckets))

    def stage_groups(self, groups: list[set[int]], tables: Callable[[set[int]], dict[str, DataFrame]]) -> dict[str, dict[str, str]]:
        """stage_all() of what tables() gives for each group of buckets, one group after the other."""
        staged: dict[str, dict[str, str]] = {}
        for some in groups:
            for table, folders in self.stage_all(tables(some)).items():
                staged[table] = staged.get(table, {}) | folders
        return staged

    @contextmanager
    def shuffles_deleted(self) -> Iterator[None]:
        """Within, shuffle files go as soon as the query that wrote them is done: all that a batch works out is written."""
        before = self.spark.conf.get(SHUFFLES_GO, None)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SHUFFLES_GO, before) if before is not None else self.spark.conf.unset(SHUFFLES_GO)

    def vectors(self, hashes: DataFrame, stored: DataFrame) -> DataFrame:
        """content_hash and embedding of stored chunks that have one of some hashes."""
        return stored.select("content_hash", "embedding").join(hashes, "content_hash", "left_semi")

    def staged(self, table: str, folders: dict[str, str]) -> DataFrame:
        return self._load(table, folders)

    def publish(self, staged: dict[str, dict[str, str]], touched: dict[str, set[int] | None], batch: tuple[str, int] | None = None, told: dict | None = None) -> None:
        """Let the next manifest name what was staged in place of the touched buckets (all if None), the batch of a
        stream that did it, and what else is told."""
        m = self.manifest() | (told or {})
        for table, folders in staged.items():
            gone = touched.get(table)
            kept = {} if gone is None else {b: v for b, v in m["tables"].get(table, {}).items() if int(b) not in gone}
            m["tables"][table] = kept | folders
        if batch:
            m["batches"][batch[0]] = batch[1]
        self._point(m)

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Whole tables anew."""
        self.publish(self.stage_all(tables), {})

    def has_batch(self, stream: str, number: int) -> bool:
        return self.manifest()["batches"].get(stream, -1) >= number

    def wipe(self) -> None:
        """Chunks, outlines, edges and what was derived from them go; decisions and the query log stay."""
        self.publish({t: {} for t in ("doc_chunks", "doc_outlines", "doc_relationships", "chunk_hashes", "file_stats", "snapshot")}, {})

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write an intermediate table into the store's work folder and read it again."""
        path = f"{self._work}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=COMPRESSION)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Delete what cut() has written."""
        self._delete(self._work)

    # --- the query log

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to the log, in a folder of their own below the epoch that is current."""
        if table != "query_log":
            raise ValueError(f"{table} is not appended to")
        df.to(self.schema(table)).write.parquet(f"{self.root}/query_log/epoch={self.manifest()['log']['current']}/{uuid.uuid4().hex}")

    def _appended(self, first: int, last: int | None = None) -> list[str]:
        """The folders of all appends from one epoch to another, that have been written to their end."""
        top = f"{self.root}/query_log"
        epochs = [n for n in self._names(top) if n.startswith("epoch=") and first <= int(n[6:]) and (last is None or int(n[6:]) <= last)]
        return [f"{top}/{e}/{n}" for e in epochs for n in self._names(f"{top}/{e}") if "_SUCCESS" in self._names(f"{top}/{e}/{n}")]

    def _log(self, m: dict) -> DataFrame:
        paths = [f"{self.root}/query_log/{f}" for f in m["log"]["days"].values()] + self._appended(m["log"]["from"])
        return self.spark.read.schema(self.schema("query_log")).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema("query_log"))

    def compact_log(self) -> None:
        """Fold the appends of all epochs but the current one into a folder for each day, and begin an epoch. A day that
        gets no rows is not touched. An append that began before the last compaction has to be done by the next."""
        m = self.manifest()
        log = m["log"]
        dated = lambda paths: self.spark.read.schema(self.schema("query_log")).parquet(*paths).withColumn("day", F.coalesce(F.to_date("created_at").cast("string"), F.lit("none")))
        loose = self._appended(log["from"], log["current"] - 1)
        days = {r["day"] for r in dated(loose).select("day").distinct().collect()} if loose else set()
        if days:
            old = [f"{self.root}/query_log/{log['days'][d]}" for d in days & log["days"].keys()]
            name = f"days-{uuid.uuid4().hex}"
            dated(loose + old).repartition("day").write.partitionBy("day").parquet(f"{self.root}/query_log/{name}")
            log["days"] |= {d: f"{name}/day={d}" for d in days}
        log["from"], log["current"] = log["current"], log["current"] + 1
        self._point(m)


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those that have their keys; new has each key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def file_stats(chunks: DataFrame) -> DataFrame:
    """A row for each file, of what its chunks say."""
    told = (F.max(c).alias(c) for c in ("status", "supersedes", "doc_date", "git_committed_at"))
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunk_count"), F.min("updated_at").alias("first_updated"), F.max("updated_at").alias("last_updated"), *told)


def replace(store: Store, gone: DataFrame, tables: dict[str, DataFrame], chunks=None, hashes: DataFrame | None = None, batch: tuple[str, int] | None = None, snapshot: DataFrame | None = None) -> None:
    """One batch: all rows of the files in gone (source_file) go, and those of tables (outlines and edges of such files)
    come. chunks: a function of stored vectors (content_hash, embedding) that gives the new chunks of such files; hashes: their
    content_hash, which other files' rows lose, and source_file, which is read from the chunks if it isn't there. snapshot: the
    new snapshot, whole. Only the buckets of these files and hashes are read and written, some at a time; what goes is told
    from files and hashes alone, so that texts are shuffled once, to be dealt out, unless too much goes to be broadcast."""
    with store.shuffles_deleted():
        gone = store.cut(gone.select("source_file").distinct(), "gone")
        own = store.buckets_of(gone, "source_file")
        pair = lambda df: df.select("content_hash", "source_file")
        stored = pair(store.read("doc_chunks", own))
        leaving = stored.join(gone, "source_file", "left_semi")
        held = stored.limit(0)
        if hashes is not None:
            known = store.read("chunk_hashes", store.buckets_of(hashes, "content_hash"))
            held = pair(known).unionByName(stored).join(hashes, "content_hash", "left_semi").distinct()
        held = store.cut(held, "held")
        touched = own | store.buckets_of(held, "source_file")
        had = store.cut(store.vectors(held.select("content_hash"), store.read("doc_chunks", touched)), "vectors")
        # of each table the files that it has, so that a batch of new files takes no old row through a join
        leavers = {t: store.cut(store.read(t, own).select("source_file").join(gone, "source_file", "left_semi").distinct(), "leaving") for t in ("doc_chunks", "doc_outlines", "doc_relationships")}

        def group(some: set[int]) -> dict[str, DataFrame]:
            without = lambda table, some: store.read(table, some).join(store.of(leavers[table], some), "source_file", "left_anti")
            new = {"doc_chunks": without("doc_chunks", some).join(store.of(held, some), ["content_hash", "source_file"], "left_anti")}
            if chunks is not None:
                new["doc_chunks"] = new["doc_chunks"].unionByName(store.of(chunks(had), some).select(*new["doc_chunks"].columns))
            for name in ("doc_outlines", "doc_relationships") if some & own else ():
                new[name] = without(name, some & own)
                if name in tables:
                    new[name] = new[name].unionByName(store.of(tables[name], some).select(*new[name].columns))
            return new

        where: dict[str, set[int] | None] = {"doc_outlines": own, "doc_relationships": own, "doc_chunks": touched, "file_stats": touched}
        staged = store.stage_groups(store.groups(touched, {"doc_chunks": touched, "doc_outlines": own}), group)
        if snapshot is not None:
            staged["snapshot"], where["snapshot"] = store.stage("snapshot", snapshot), None

        signed = lambda df, n: pair(df).withColumn("n", F.lit(n))
        rows = store.staged("doc_chunks", staged.get("doc_chunks", {}))
        moved = signed(leaving.unionByName(held).distinct(), -1)
        if hashes is not None:
            moved = moved.unionByName(signed(hashes if "source_file" in hashes.columns else rows.join(hashes, "content_hash", "left_semi"), 1))
        moved = store.cut(moved.groupBy("content_hash", "source_file").agg(F.sum("n").alias("n")).filter("n <> 0"), "hashes")
        where["chunk_hashes"] = store.buckets_of(moved, "content_hash")
        less, more = (store.cut(pair(moved.filter(f"n {sign} 0")), "hashes") for sign in "<>")
        known = store.read("chunk_hashes", where["chunk_hashes"]).join(less, ["content_hash", "source_file"], "left_anti")
        staged |= store.stage_all({"file_stats": file_stats(rows), "chunk_hashes": known.unionByName(more)})
        store.publish(staged, where, batch)
        store.tidy()


def delete_files(store: Store, files: DataFrame) -> int:
    """Drop all that is stored of some files; the number of chunks that go."""
    files = files.select("source_file").distinct()
    stats = store.read("file_stats", store.buckets_of(files, "source_file")).join(files, "source_file", "left_semi")
    n = stats.agg(F.sum("chunk_count")).first()[0] or 0
    replace(store, files, {})
    return n


def merge_decisions(old: DataFrame, new: DataFrame, prune: bool = False) -> DataFrame:
    """Decisions keyed by decision_key: new ones in place of old ones. prune: those that no document declares go."""
    return new if prune else keyed_merge(old, new, ["decision_key"])


def export_json(items: DataFrame, path: str) -> None:
    """A bounded list as one indented JSON file, for people to read, at a path of any file system."""
    rows = [json.loads(r) for r in items.toJSON().collect()]
    text = json.dumps([{c: r.get(c) for c in items.columns} for r in rows], indent=2, ensure_ascii=False)
    p = items.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(items.sparkSession._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def counters(rows: DataFrame) -> DataFrame:
    """rows (status) of a run -> how many of each."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))
