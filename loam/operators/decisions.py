"""The decision registry: collecting, checking, looking up and following decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHAIN_DEPTH, FUZZY_MATCHES
from ..sources.shared import numbered, spread, written
from .frontmatter import registry_yaml
from .graph import first_again, normal_target, paths

#: A decision document's name.
FILE_NAME = r"\A\d{2}-dec-[a-z0-9-]+\.md\z"
#: Characters of the stretches by which a lookup finds candidates.
GRAM = 3
BLOCK = "struct<area:string,decisions:array<struct<key:string,decision:string,current_value:string,decided_on:string,cross_refs:array<string>,supersedes:string>>>"
COLUMNS = ("id", "decision_key", "area", "decision", "current_value", "source_doc", "decided_on", "cross_refs", "superseded_by")


def collect(docs: DataFrame) -> DataFrame:
    """docs (name, text) of decision documents -> a row for each declared decision, and `error` for what is wrong
    with it: a document without an integer area, or a decision without key, text or value, or a key twice.

    The blocks are read as YAML once, on all cores, and what they say is written."""
    named = spread(docs.select("name", "text").filter(F.col("name").rlike(FILE_NAME)), "name").withColumn("y", registry_yaml(F.col("text")))
    told = written(named.select(F.regexp_replace("name", r"\.md\z", "").alias("source_doc"), "y.error", "y.json"), "decisions")
    rows = told.select("source_doc", "error", F.from_json("json", BLOCK).alias("b"))
    rows = rows.select("source_doc", F.col("b.area").try_cast("int").alias("area"), F.col("error").alias("doc_error"), F.posexplode("b.decisions").alias("position", "d"))
    rows = rows.select("source_doc", "area", "doc_error", "position", F.col("d.key").alias("decision_key"), "d.decision", "d.current_value", F.to_date("d.decided_on").alias("decided_on"), F.coalesce("d.cross_refs", F.array().cast("array<string>")).alias("cross_refs"), normal_target(F.col("d.supersedes")).alias("supersedes"))
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), n) for n, c in (("key", "decision_key"), ("decision", "decision"), ("current_value", "current_value")))))
    twice = F.count("*").over(Window.partitionBy("decision_key")) > 1
    error = F.when(F.col("doc_error").isNotNull(), F.col("doc_error")).when(F.col("area").isNull(), "area is not an integer").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(twice, F.concat(F.lit("duplicate key "), F.col("decision_key")))
    return rows.withColumn("error", error).drop("doc_error")


def wire(rows: DataFrame) -> DataFrame:
    """Collected decisions -> with id, by document and place, and superseded_by: the one that names it."""
    placed = numbered(rows, ["source_doc", "position"], "id")
    later = placed.filter("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("decision_key")).agg(F.min("id").alias("superseded_by"))
    return placed.join(later, "decision_key", "left").select(*COLUMNS, "supersedes")


def counts(rows: DataFrame) -> DataFrame:
    """Collected decisions -> for each document how many it declares and how many of them have an error."""
    return rows.groupBy("source_doc").agg(F.count("*").alias("declared"), F.count("error").alias("failed"))


def unresolved(rows: DataFrame) -> DataFrame:
    """Decisions that supersede a key that no decision has."""
    keys = rows.select(F.col("decision_key").alias("supersedes"))
    return rows.filter("supersedes IS NOT NULL").join(keys, "supersedes", "left_anti").select("decision_key", "supersedes")


def _looping(step: DataFrame) -> DataFrame:
    """step (at, next), each `at` once -> those of its rows that lie on a cycle. By doubling: a round leaves the keys that
    lead on for twice as many steps and are led to by as many; on cycles all do, lines run out. When a round leaves them all, they
    are cycles. Each round is written and read."""
    far = written(step.join(step.select(F.col("next").alias("at")).distinct(), "at", "left_semi"), "loops")
    left, before = far.count(), -1
    while left and left != before:
        on = far.join(far.select(F.col("next").alias("at")).distinct(), "at", "left_semi")
        far = written(on.join(far.select(F.col("at").alias("next"), F.col("next").alias("then")), "next").select("at", F.col("then").alias("next")), "loops")
        left, before = far.count(), left
    return step.join(far.select("at"), "at", "left_semi")


def cycles(rows: DataFrame) -> DataFrame:
    """(decision_key, path) of the keys that supersede themselves over others; each key supersedes one at most.

    What lies on no cycle is left out first. Then paths double until they come back to where they began: as many rounds as
    the longest cycle's length has binary digits, and no more rows than keys."""
    step = rows.filter("decision_key IS NOT NULL AND supersedes IS NOT NULL").select(F.col("decision_key").alias("at"), F.col("supersedes").alias("next")).distinct()
    open_ = written(_looping(step).select("at", F.array("next").alias("path")), "cycles")
    closed = []
    while True:
        back = F.array_position("path", F.col("at"))
        closed.append(open_.filter(back > 0).select(F.col("at").alias("decision_key"), F.concat(F.array("at"), F.slice("path", F.lit(1), back.cast("int"))).alias("path")))
        open_ = open_.filter(back == 0)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        # of a cycle all paths are open or none
        more = open_.select(F.col("at").alias("end"), F.col("path").alias("more"))
        open_ = written(open_.withColumn("end", F.element_at("path", -1)).join(more, "end").select("at", F.concat("path", "more").alias("path")), "cycles")


def successors(decisions: DataFrame, depth: int = CHAIN_DEPTH, starts: DataFrame | None = None) -> DataFrame:
    """decisions (id, superseded_by, ...) -> id, hop from 1, successor: who replaced each (or each of starts), and who
    replaced that; the hop that leads to a decision met before is the last."""
    step = decisions.select(F.col("id").alias("at"), F.col("superseded_by").alias("next")).filter("next IS NOT NULL")
    chains = paths(step.join(decisions.select(F.col("id").alias("next")), "next", "left_semi"), depth)
    if starts is not None:
        chains = chains.join(starts.select(F.col("id").alias("at")), "at", "left_semi")
    ends = F.coalesce(first_again(F.col("at"), F.col("path")), F.size("path"))
    hops = chains.select(F.col("at").alias("id"), F.posexplode(F.slice("path", F.lit(1), ends)).alias("hop", "p"))
    return hops.select("id", (F.col("hop") + 1).alias("hop"), F.col("p.next").alias("successor"))


def with_banner(decisions: DataFrame, chain: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """Adds the banner: current, draft (no date), or superseded by the end of its chain. registry: where chains lead,
    if decisions are some of it only."""
    registry = decisions if registry is None else registry
    chain = successors(registry, starts=decisions) if chain is None else chain
    last = chain.groupBy("id").agg(F.max(F.struct("hop", "successor")).alias("e")).select("id", F.col("e.successor").alias("last_id"))
    target = registry.select(F.col("id").alias("last_id"), F.col("decision_key").alias("last_key"), F.col("decided_on").alias("last_date"))
    d = decisions.join(last, "id", "left").join(target, "last_id", "left")
    gone = F.when(F.col("last_key").isNotNull(), F.concat(F.lit("[SUPERSEDED by `"), F.col("last_key"), F.lit("` on "), F.coalesce(F.col("last_date").cast("string"), F.lit("unknown date")), F.lit("]"))).otherwise(F.concat(F.lit("[SUPERSEDED by id="), F.col("superseded_by").cast("string"), F.lit("]")))
    return d.withColumn("banner", F.when(F.col("superseded_by").isNotNull(), gone).when(F.col("decided_on").isNull(), "[DRAFT]").otherwise("[CURRENT]")).drop("last_id", "last_key", "last_date")


def grams(text: Column, size: int) -> Column:
    """The different stretches of `size` characters of a text."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _sized(size: int):
    return lambda text: grams(text, size)


def _candidates(asked: DataFrame, d: DataFrame) -> DataFrame:
    """asked (query), d (id, decision, current_value, ...) -> query with the decisions that may hold it: those that have its
    rarest stretch of three characters, or of two or one if it has no longer stretch between its wildcards."""
    pieces = F.split(F.lower("query"), r"(?s)\\.|[%_]|\\", -1)
    longest = F.least(F.array_max(F.transform(pieces, lambda p: F.length(p))), F.lit(GRAM))
    of = F.when(F.lit(False), F.array().cast("array<string>"))
    for size in range(1, GRAM + 1):
        of = of.when(longest == size, F.flatten(F.transform(pieces, _sized(size))))
    q = written(asked.select("query", F.explode(of).alias("gram")).distinct(), "grams")
    wanted = q.select("gram").distinct()
    texts = F.array(F.lower(F.coalesce("decision", F.lit(""))), F.lower(F.coalesce("current_value", F.lit(""))))
    held = F.array_distinct(F.flatten(F.concat(*(F.transform(texts, _sized(size)) for size in range(1, GRAM + 1)))))
    postings = written(d.select("id", F.explode(held).alias("gram")).join(wanted, "gram", "left_semi"), "grams")
    n = postings.groupBy("gram").agg(F.count("*").alias("n"))
    # a query with a stretch that nobody has finds nothing
    rarest = q.join(n, "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return rarest.join(postings, "gram").select("query", "id").join(d, "id")


def _anything(asked: DataFrame, d: DataFrame) -> DataFrame:
    """asked (query) that are wildcards alone: they hold for every text of so many characters. Of the decisions of each
    length the first few will do."""
    own = F.greatest(F.length("decision"), F.length("current_value"))
    few = d.withColumn("most", own).filter("most IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("most").orderBy(F.length("decision"), "decision_key"))).filter(F.col("n") <= FUZZY_MATCHES)
    few = written(few.drop("n"), "lengths")
    most = few.agg(F.max("most")).first()[0] or 0
    least = F.length("query") - F.length(F.replace("query", F.lit("_")))
    return asked.select("query", F.explode(F.sequence(least, F.greatest(least, F.lit(most)))).alias("most")).join(few, "most").drop("most")


def lookup(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """queries (query) -> query, rank from 1, id, matched_by: by id if the query is a number, else or failing that by
    key, else the shortest decisions whose text or value holds it, in any case (% and _ stand for any text and
    character). Rank 1 is the answer, the rest its alternatives; a query without an answer has no row.

    Ids and keys are joined. What they leave of the queries meets the decisions that have its rarest stretch of up to GRAM
    characters, where the pattern is confirmed; patterns of wildcards alone go by the lengths of the texts."""
    d = decisions.select("id", "decision_key", "decision", "current_value")
    queries = queries.select("query").filter("query IS NOT NULL").distinct()
    numbers = queries.filter(F.col("query").rlike(r"\A[0-9]+\z")).withColumn("id", F.col("query").try_cast("int"))
    by_id = numbers.join(d.select("id"), "id").select("query", "id", F.lit(1).alias("kind"))
    by_key = queries.withColumn("decision_key", F.col("query")).join(d.select("id", "decision_key"), "decision_key").select("query", "id", F.lit(2).alias("kind"))
    exact = by_id.unionByName(by_key)
    first = exact.groupBy("query").agg(F.min(F.struct("kind", "id")).alias("m")).select("query", F.lit(1).alias("rank"), F.col("m.id").alias("id"), F.when(F.col("m.kind") == 1, "id").otherwise("key").alias("matched_by"))
    rest = written(queries.join(first.select("query"), "query", "left_anti"), "queries")
    bare = F.col("query").rlike(r"\A[%_]*\z")
    like = F.concat(F.lit("%"), F.col("query"), F.lit("%"))
    met = _candidates(rest.filter(~bare), d).unionByName(_anything(rest.filter(bare), d), allowMissingColumns=True)
    met = met.filter(F.ilike(F.col("decision"), like) | F.ilike(F.col("current_value"), like))
    by = Window.partitionBy("query").orderBy(F.length("decision"), "decision_key")
    fuzzy = met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= FUZZY_MATCHES)
    return first.unionByName(fuzzy.select("query", "rank", "id", F.lit("text").alias("matched_by")))
