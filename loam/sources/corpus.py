"""Readers of document collections."""

from __future__ import annotations

import json
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SKIP_DIRS, Pattern, RenameMap
from ..schema import GIT


def _read(spark: SparkSession, root: str, glob: str, recursive: bool) -> DataFrame:
    files = spark.read.text(root, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def relative(root: str):
    """The path below root, whatever the store's URI looks like."""
    tail = root.rstrip("/").split("://")[-1]
    return F.url_decode(F.substring_index("path", tail + "/", -1))


def markdown(spark: SparkSession, root: str, prefix: str, recursive: bool = True, exclude: tuple[str, ...] = ("TEMPLATES",)) -> DataFrame:
    """source_file, name, text of the *.md files below root, one file a row."""
    d = _read(spark, root, "*.md", recursive).withColumn("rel", relative(root))
    for part in exclude:
        d = d.filter(~F.array_contains(F.split("rel", "/"), part))
    return d.select(F.concat(F.lit(f"{prefix}/docs/"), "rel").alias("source_file"), F.element_at(F.split("rel", "/"), -1).alias("name"), "text")


#: Files that are read by name; beyond it the whole folder is read and the rest left out.
NAMED = 10_000


def changes(spark: SparkSession, root: str, prefix: str, snapshot: DataFrame, exclude: tuple[str, ...] = ("TEMPLATES",)) -> DataFrame:
    """What lies below root against a snapshot (source_file, path, length, modified, digest) -> source_file, path, length,
    modified, digest (the snapshot's) and op: added, changed (length or time differ), deleted or same. Files are listed,
    not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    d = d.select("path", F.col("modificationTime").alias("modified"), "length").withColumn("rel", relative(root))
    for part in exclude:
        d = d.filter(~F.array_contains(F.split("rel", "/"), part))
    now = d.select(F.concat(F.lit(f"{prefix}/docs/"), "rel").alias("source_file"), "path", "length", "modified")
    was = snapshot.select("source_file", *(F.col(c).alias(f"old_{c}") for c in ("path", "length", "modified")), "digest", F.lit(True).alias("known"))
    both = now.withColumn("there", F.lit(True)).join(was, "source_file", "full_outer")
    same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    op = F.when(F.col("known").isNull(), "added").when(F.col("there").isNull(), "deleted").when(same, "same").otherwise("changed")
    return both.select("source_file", *(F.coalesce(c, f"old_{c}").alias(c) for c in ("path", "length", "modified")), "digest", op.alias("op"))


def markdown_of(spark: SparkSession, root: str, prefix: str, files: DataFrame, exclude: tuple[str, ...] = ("TEMPLATES",)) -> DataFrame:
    """source_file, text of some files (source_file, path) below root."""
    some = [r["path"] for r in files.select("path").limit(NAMED + 1).collect()]
    if not some:
        return spark.createDataFrame([], "source_file string, text string")
    if len(some) > NAMED:
        return markdown(spark, root, prefix, exclude=exclude).join(files.select("source_file"), "source_file", "left_semi").select("source_file", "text")
    d = spark.read.text([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in some], wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return d.select(F.concat(F.lit(f"{prefix}/docs/"), relative(root)).alias("source_file"), "text")


def html(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    d = _read(spark, root, "*.html", True).withColumn("rel", relative(root))
    return d.select(F.concat(F.lit(f"{prefix}/docs/"), "rel").alias("source_file"), F.col("text").alias("html"))


def scanned(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """file, text for the stale-string scan: everything but what lies in a skipped folder."""
    d = _read(spark, root, "*.md", True).withColumn("rel", relative(root))
    return d.filter(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, skip)))).select(F.concat(F.lit("docs/"), "rel").alias("file"), "text")


def decision_docs(spark: SparkSession, root: str) -> DataFrame:
    from ..operators.decisions import FILE_NAME

    return markdown(spark, root, "x", recursive=False).select("name", "text").filter(F.col("name").rlike(FILE_NAME))


def change_set(spark: SparkSession, changed: str = "", deleted: str = "") -> DataFrame:
    """Two lists of paths, parted by spaces -> (path, op)."""
    rows = [(p, "changed") for p in changed.split()] + [(p, "deleted") for p in deleted.split()]
    return spark.createDataFrame(rows, "path string, op string")


def git_provenance(spark: SparkSession, repo: str, prefix: str, timeout: int = 60) -> DataFrame:
    """source_file, git_sha, git_committed_at of each file's last commit, from one `git log`; no rows if git fails."""
    rows: dict[str, tuple] = {}
    try:
        log = subprocess.run(["git", "-C", repo, "log", "--pretty=format:%x01%H %cI", "--name-only"], capture_output=True, text=True, check=True, timeout=timeout).stdout
        for part in log.split("\x01")[1:]:
            head, *files = part.splitlines()
            sha, when = head.split(" ", 1)
            for f in filter(None, files):
                rows.setdefault(f, (sha, when))
    except (OSError, subprocess.SubprocessError):
        rows = {}
    df = spark.createDataFrame([(f"{prefix}/{f}", *v) for f, v in rows.items()], "source_file string, git_sha string, at string")
    return df.select("source_file", "git_sha", F.to_timestamp("at").alias("git_committed_at")).to(spark.createDataFrame([], GIT).schema)


def rename_map(path: str) -> RenameMap:
    """A JSON object of four parts; a part of another shape, or a file that can't be read, is empty."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        data = {}
    get = lambda k, kind: data[k] if isinstance(data, dict) and isinstance(data.get(k), kind) else kind()
    return RenameMap(get("renames", dict), get("per_file_renames", dict), get("area_redirects", dict), tuple(get("delete_refs", list)))


def goldens(path: str) -> list[dict]:
    import yaml

    from ..operators.evals import validate

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return validate(data.get("goldens") or [])


def patterns(rows: list[dict]) -> tuple[Pattern, ...]:
    return tuple(Pattern(r["regex"], r["category"], r["reason"], r.get("replacement"), tuple(r.get("excludes") or ())) for r in rows)
