"""A governed collection derived from a table of plain documents, by the same SQL in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "corpus"

#: Columns of document `d`, in SQL that Spark and the oracle both run.
COLUMNS = """doc_id, text, CAST(doc_id % 9 AS INT) AS area,
  CASE doc_id % 6 WHEN 0 THEN 'spec' WHEN 1 THEN 'res' WHEN 2 THEN 'str' WHEN 3 THEN 'dec' WHEN 4 THEN 'pol' ELSE 'fwk' END AS doc_type,
  lpad(CAST(doc_id % 9 AS STRING), 2, '0') || '-' || CASE doc_id % 6 WHEN 0 THEN 'spec' WHEN 1 THEN 'res' WHEN 2 THEN 'str' WHEN 3 THEN 'dec' WHEN 4 THEN 'pol' ELSE 'fwk' END || '-doc-' || CAST(doc_id AS STRING) AS bare,
  'corpus/docs/' || lpad(CAST(doc_id % 9 AS STRING), 2, '0') || '-' || CASE doc_id % 6 WHEN 0 THEN 'spec' WHEN 1 THEN 'res' WHEN 2 THEN 'str' WHEN 3 THEN 'dec' WHEN 4 THEN 'pol' ELSE 'fwk' END || '-doc-' || CAST(doc_id AS STRING) || '.md' AS source_file,
  CASE WHEN doc_id % 10 < 5 THEN 'complete' WHEN doc_id % 10 = 5 THEN 'in-progress' WHEN doc_id % 10 = 6 THEN 'draft' WHEN doc_id % 10 = 7 THEN 'superseded' WHEN doc_id % 10 = 8 THEN 'needs-review' END AS status,
  DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS doc_date,
  CAST(floor(doc_id / 2) AS BIGINT) AS dep_id, 3 * doc_id + 1 AS feed_id, CAST((doc_id % 9 + 1) % 9 AS INT) AS touch,
  CASE WHEN doc_id % 10 = 8 THEN doc_id - 1 END AS old_id"""


def name_sql(i: str) -> str:
    """The bare name of the document with id i."""
    return f"lpad(CAST({i} % 9 AS STRING), 2, '0') || '-' || CASE {i} % 6 WHEN 0 THEN 'spec' WHEN 1 THEN 'res' WHEN 2 THEN 'str' WHEN 3 THEN 'dec' WHEN 4 THEN 'pol' ELSE 'fwk' END || '-doc-' || CAST({i} AS STRING)"


#: As a CTE for oracle queries: syn.
CTE = f"syn AS (SELECT {COLUMNS}, {name_sql('CAST(floor(doc_id / 2) AS BIGINT)')} AS dep, {name_sql('(3 * doc_id + 1)')} AS feed, CASE WHEN doc_id % 10 = 8 THEN {name_sql('(doc_id - 1)')} END AS old FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a frame."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    exprs = f"{COLUMNS}, {name_sql('CAST(floor(doc_id / 2) AS BIGINT)')} AS dep, {name_sql('(3 * doc_id + 1)')} AS feed, CASE WHEN doc_id % 10 = 8 THEN {name_sql('(doc_id - 1)')} END AS old"
    return spark.sql(f"SELECT {exprs} FROM {{docs}}", docs=docs)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that frontmatter.parse would give."""
    return corpus(spark, sf_dir).select("doc_id", "source_file", "bare", "text", F.col("area").alias("area_number"), "doc_type", "status", F.col("old").alias("supersedes"), "doc_date", F.array("dep").alias("depends_on"), F.array("feed").alias("feeds_into"), F.array("touch").alias("also_touches"))


def headed(text):
    """A text with headings on every seventh and eleventh line, counted from 0."""
    rows = F.split(text, "\n", -1)
    return F.array_join(F.transform(rows, lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("## "), x)).when(i % 11 == 5, F.concat(F.lit("### "), x)).otherwise(x)), "\n")


def as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, name and a whole markdown text with frontmatter. Each 13th document lacks a field, each 17th has
    another status, each 19th another file name in it."""
    c = corpus(spark, sf_dir)
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\n"))
    items = lambda k, v: F.concat(F.lit(f"{k}:\n  - "), v, F.lit("\n"))
    front = F.concat(
        F.lit("---\n"),
        line("file", F.when(F.col("doc_id") % 19 == 4, "other").otherwise(F.col("bare"))),
        line("area", F.col("area").cast("string")),
        F.when(F.col("doc_id") % 13 == 5, "").otherwise("area-name: some area\n"),
        line("type", F.col("doc_type")),
        line("title", F.concat(F.lit('"Doc '), F.col("doc_id").cast("string"), F.lit('"'))),
        line("status", F.when(F.col("doc_id") % 17 == 3, "done").otherwise(F.coalesce("status", F.lit("null")))),
        line("date", F.col("doc_date").cast("string")),
        items("depends-on", F.col("dep")),
        F.concat(F.lit("feeds-into: ["), F.col("feed"), F.lit("]\n")),
        F.concat(F.lit("also-touches: ["), F.col("touch").cast("string"), F.lit(", x]\n")),
        line("supersedes", F.coalesce(F.concat("old", F.lit(".md")), F.lit("~"))),
        F.lit("---\n"),
    )
    return c.select("doc_id", "source_file", F.concat("bare", F.lit(".md")).alias("name"), F.concat(front, headed(F.col("text"))).alias("text"))
