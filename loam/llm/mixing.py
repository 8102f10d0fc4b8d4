"""Mix sources to target weights with hash-threshold histograms.

Every row has a 60-bit hash of its id. A source's mix at threshold h holds its rows with a hash below h,
so the mixes of growing budgets are nested, and reruns agree. To find the threshold at which a source
reaches its budget, sizes are summed by (source, leading hash bits); the one bucket in which the running
sum crosses the budget is refined by the next bits, and so on until it holds a single hash. Sums of at
most 2**BITS buckets a source are compared in each round: no row is sorted.

A source with a target above its size is taken whole as often as it fits, and the rest by threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, saved

#: Hash bits that one round of the histogram resolves, and the bits in all.
BITS, ALL_BITS = 12, 60
#: Up to so many sources their plan is broadcast; with more it is joined by a shuffle.
MOST_BROADCAST = 100_000
#: A target stops at so many times its source's size.
MOST_COPIES = 3


def row_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text; a null id counts as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, ALL_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> also weight and target. Sources by code point, null last, weigh 1, 2, 3,
    repeating, and share all of the size; a target stops at `most` times its source's size and the excess
    goes to the others by weight, until none is above (sources of size 0 get 0).

    Water filling without a loop: with cap/weight ascending, the sources that reach their cap come first.
    A source reaches it if its cap/weight is at most the share that is then left for each unit of weight.
    The frame has one row a source: small, but still no driver-side list."""
    byte_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("weight", ((F.row_number().over(byte_order) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    share = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # at the first source below its cap the share stays the same for all that follow
    ranked = ranked.withColumn("share", share).withColumn("full", F.col("level") <= F.col("share"))
    free = F.min(F.when(~F.col("full"), F.struct("level", "share"))).over(Window.partitionBy())["share"]
    return ranked.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(free * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, small=F.broadcast) -> DataFrame:
    """rows (source, hash, size), goals (source, budget) -> (source, threshold): the rows of the source with a
    hash below the threshold sum to its budget as nearly as its hash order allows (a tie takes fewer). small: what
    marks a table of a row for each source for a join."""
    # below: the sum of all rows before the open bucket; prefix: its leading bits
    open_ = goals.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    done = None
    for used in range(0, ALL_BITS, BITS):
        rest = ALL_BITS - used - BITS
        hist = (
            rows.alias("r").join(small(open_.select(F.col("source").alias("s"), F.col("prefix").alias("p"))), F.col("r.source").eqNullSafe(F.col("s")) & (F.shiftright("hash", rest + BITS) == F.col("p")))
            .groupBy("source", F.shiftright("hash", rest).alias("cell"))
            .agg(F.sum("size").cast("double").alias("cell_size"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        )
        run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("cell_size").over(run), F.lit(0.0)))
        o = open_.select(F.col("source").alias("s"), "budget", "below")
        crossing = hist.join(small(o), F.col("source").eqNullSafe(F.col("s"))).withColumn("before", F.col("before") + F.col("below"))
        # the first cell whose end reaches the budget
        crossing = crossing.filter(F.col("before") + F.col("cell_size") >= F.col("budget")).groupBy("source").agg(F.min(F.struct("cell", "lo", "hi", "before", "cell_size", "budget")).alias("c")).select("source", "c.*")
        crossing = saved(crossing, "mix-cells")
        single = (F.col("lo") == F.col("hi")) | F.lit(rest == 0)
        take = F.col("before") + F.col("cell_size") - F.col("budget") < F.col("budget") - F.col("before")
        found = crossing.filter(single).select("source", F.when(take, F.col("hi") + 1).otherwise(F.col("lo")).alias("threshold"))
        done = found if done is None else done.unionByName(found)
        open_ = crossing.filter(~single).select("source", "budget", F.col("cell").alias("prefix"), F.col("before").alias("below"))
        if open_.isEmpty():
            break
    return done


def plan(rows: DataFrame, most: int = MOST_COPIES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """rows (source, hash, size) -> source, source_size, target, copies, threshold: a row of a source is taken
    `copies` times, and once more if its hash is below the threshold. It comes marked for a broadcast if there are at
    most `most_broadcast` sources."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = saved(targets(sizes, most), "mix-targets")
    small = F.broadcast if goals.count() <= most_broadcast else lambda df: df.hint("merge")
    goals = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    part = thresholds(rows, goals.filter((F.col("budget") > 0) & (F.col("source_size") > 0)).select("source", "budget"), small)
    goals = goals.alias("p").join(small(part.withColumnRenamed("source", "s")), F.col("p.source").eqNullSafe(F.col("s")), "left")
    return small(goals.select("p.source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(-1)).alias("threshold")))


def taken_times(most: int = MOST_COPIES) -> Column:
    """How often a row of (hash, copies, threshold) is taken."""
    return F.least(F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long"), F.lit(most))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("hash"))


def mix(docs: DataFrame, most: int = MOST_COPIES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with doc_id, text, source -> doc_id, size, source_size, target, taken, times, source, a row for each of docs.

    taken: the words that the mix takes of the document, repeats counted; at most `most` times its size.
    Null text and text without words have size 0 and are taken 0 words of; a null source is a source of its own;
    a null id is hashed as 'null'; rows with the same id share a hash and are taken alike; extra columns are
    ignored; no rows give no rows. Any number of sources will do."""
    rows = saved(sized(docs), "mix-rows")
    chosen = plan(rows, most, most_broadcast).withColumnRenamed("source", "s")
    out = rows.join(chosen, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * taken_times(most)).alias("taken"), taken_times(most).alias("times"), "source")


def mixed(docs: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """The rows of docs themselves, each as often as the mix takes it (see mix); the texts are not shuffled."""
    rows = saved(docs.select("source", n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("hash")), "mix-rows")
    names = docs.columns
    c = plan(rows, most).select(F.col("source").alias("mix_source"), F.struct("copies", "threshold").alias("mix_plan"))
    out = docs.withColumn("mix_hash", row_hash(F.col("doc_id"))).join(c, F.col("source").eqNullSafe(F.col("mix_source")))
    times = F.least(F.col("mix_plan.copies") + (F.col("mix_hash") < F.col("mix_plan.threshold")).cast("long"), F.lit(most))
    return out.withColumn("mix_times", times).filter("mix_times > 0").withColumn("mix_nth", F.explode(F.expr("sequence(1L, mix_times)"))).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
fill(round, source, source_size, weight, full_) AS (
  SELECT 0, source, source_size, weight, FALSE FROM w
  UNION ALL
  SELECT round + 1, source, source_size, weight, full_ OR weight * rest / weights >= 3.0 * source_size FROM (
    SELECT f.*, (sum(source_size) OVER ()) - sum(CASE WHEN full_ THEN 3.0 * source_size ELSE 0 END) OVER () AS rest,
           sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS weights FROM fill f) WHERE round < 25),
z AS (SELECT *, sum(source_size) OVER () - sum(CASE WHEN full_ THEN 3.0 * source_size ELSE 0 END) OVER () AS rest,
           sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS weights FROM fill WHERE round = 25),
t AS (SELECT source, source_size, CASE WHEN full_ THEN 3.0 * source_size ELSE rest / weights * weight END AS target FROM z),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS copies FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * least(3, copies + CASE WHEN budget > 0 AND (upto < budget OR (upto - own < budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
