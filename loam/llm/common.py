"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more rows than HOT and more than one in MOST_HOT of all rows, so that there are at most
#: MOST_HOT hot keys, whatever the data.
HOT, MOST_HOT = 1000, 50_000
#: A word, wherever a contract counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local session, as in tests, gets one of its
    own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loam-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loam/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there, and a lost
    executor costs only the tasks it ran, not what was done before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files behind a table that saved() has returned, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Hand memory that Python no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def giving_back(run):
    """A task's function over batches that gives memory back when it ends: workers are used again, by other stages too."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def with_counts(rows: DataFrame, counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The inner join of rows with counts, which has one row for each long key, with how many rows have it in n. counts
    is a saved table. Hot keys are few (see MOST_HOT), so that their rows of counts are broadcast, and their rows stay
    spread over all partitions; all other rows are shuffled by key."""
    least = max(HOT, (counts.agg(F.sum(n)).first()[0] or 0) // MOST_HOT)
    side = lambda cond, name: counts.filter(cond).select(F.col(key).alias(f"_{name}_key"), F.struct(*(c for c in counts.columns if c != key)).alias(f"_{name}"))
    out = rows.join(F.broadcast(side(F.col(n) > least, "hot")), F.col(key) == F.col("_hot_key"), "left")
    # a hot row may go anywhere: if its number happens to be another key, its own counts still come first
    out = out.withColumn("_to", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    out = out.join(side(F.col(n) <= least, "rest").hint("merge"), F.col("_to") == F.col("_rest_key"), "left")
    out = out.withColumn("_found", F.coalesce("_hot", "_rest")).filter("_found IS NOT NULL")
    return out.select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in counts.columns if c != key))


def n_words(text):
    """Words of a text as a column: null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def bucket(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo; null ids count as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(modulus))


def with_rows(rows: DataFrame, side: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The inner join of rows with side on keys of any types, null being equal to null. side is a saved table with one
    row for each key and in n how many rows have it. As in with_counts(), hot keys are few and their rows of side are
    broadcast; their rows of `rows` stay spread over all partitions."""
    least = max(HOT, (side.agg(F.sum(n)).first()[0] or 0) // MOST_HOT)
    more = [c for c in side.columns if c not in (*keys, n)]
    pick = lambda cond, name: side.filter(cond).select(F.struct(*keys).alias(f"_{name}_key"), F.struct(*more).alias(f"_{name}"))
    out = rows.join(F.broadcast(pick(F.col(n) > least, "hot")), F.struct(*keys) == F.col("_hot_key"), "left")
    out = out.withColumn("_to", F.when(F.col("_hot_key").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(*rows.columns)))
    rest = pick(F.col(n) <= least, "rest").withColumn("_at", F.xxhash64(*(F.col(f"_rest_key.{k}") for k in keys)))
    out = out.join(rest.hint("merge"), (F.col("_to") == F.col("_at")) & (F.struct(*keys) == F.col("_rest_key")), "left")
    out = out.withColumn("_found", F.coalesce("_hot", "_rest")).filter("_found IS NOT NULL")
    return out.select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in more))
