"""Drift: four signals that the collection disagrees with itself, as rows of one schema."""

from __future__ import annotations

import math
import re
import time
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONTRADICTION_HITS, CONTRADICTION_LENGTHS, CONTRADICTION_PREFIX, CONTRADICTION_REASON, DEFAULT_TOP, DRIFT_TTL_SECONDS, MAX_TOP, SIGNALS, Pattern
from ..functions.text import lines, strip
from .graph import normal_target, to_full

#: Decisions that are looked for at once.
MENTIONED = 100_000


def _items(df: DataFrame, signal: str, **c: Column) -> DataFrame:
    get = lambda n: c.get(n, F.lit(None).cast("string"))
    return df.select(get("file").alias("file"), c.get("line", F.lit(None).cast("int")).alias("line"), F.lit(signal).alias("signal"), get("reason").alias("reason"), get("source").alias("authoritative_source"), get("replacement").alias("suggested_replacement"), get("snippet").alias("snippet"))


def stale_strings(docs: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """docs (file, text) -> a row for each line and pattern that it matches, in any case and with no excuse in it.
    The patterns are one array of columns, so that each text is read and split once."""
    rows = docs.select("file", F.posexplode(lines(F.col("text"))).alias("line_no", "text"))

    def hit(p: Pattern) -> Column:
        free = F.lit(True)
        for x in p.excludes:
            free = free & ~F.lower("text").contains(x.lower())
        return F.when(F.col("text").rlike(f"(?i){p.regex}") & free, F.struct(F.lit(p.category).alias("category"), F.lit(p.reason).alias("reason"), F.lit(p.replacement).cast("string").alias("replacement")))

    if not patterns:
        rows = rows.withColumn("p", F.lit(None).cast("struct<category:string,reason:string,replacement:string>")).filter("p IS NOT NULL")
    else:
        rows = rows.withColumn("p", F.explode(F.array_compact(F.array(*map(hit, patterns)))))
    return rows.select("file", (F.col("line_no") + 1).alias("line"), strip(F.col("text")).alias("text"), "p.category", "p.reason", "p.replacement")


def stale_signal(hits: DataFrame) -> DataFrame:
    return _items(hits, "stale-string", file=F.col("file"), line=F.col("line"), reason=F.col("reason"), replacement=F.col("replacement"), snippet=F.substring("text", 1, 200))


def dangling_signal(violations: DataFrame) -> DataFrame:
    """From the audit's own rows: references that no document answers to."""
    hits = violations.filter((F.col("category") == "dangling-ref") & F.col("message").rlike("^`(depends-on|feeds-into)` ref"))
    return _items(hits, "dangling-ref", file=F.concat(F.lit("docs/"), "name"), reason=F.col("message"))


def dep_out_of_date(docs: DataFrame) -> DataFrame:
    """docs (bare, depends_on, git_committed_at) -> documents that depend on one committed later."""
    d = docs.filter("git_committed_at IS NOT NULL")
    refs = d.select("bare", F.col("git_committed_at").alias("a_ts"), F.explode("depends_on").alias("ref")).withColumn("ref", normal_target(F.col("ref"))).filter("ref IS NOT NULL AND NOT startswith(ref, 'area-')")
    base = d.select(F.col("bare").alias("ref"), F.col("git_committed_at").alias("b_ts"))
    late = refs.join(base, "ref").filter("b_ts > a_ts")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    reason = F.concat(F.lit("depends-on `"), "ref", F.lit("` was committed at "), iso("b_ts"), F.lit(" (newer than this doc's "), iso("a_ts"), F.lit(")"))
    return _items(late, "dep-out-of-date", file=F.concat(F.lit("docs/"), "bare", F.lit(".md")), reason=reason, source=F.concat(F.lit("docs/"), "ref", F.lit(".md")))


def _like(pattern: str):
    """A LIKE pattern, already in lower case, as a test whether a text holds it: what stands between its % is looked for
    one after the other, so that no text is gone over again."""
    pieces = [""]
    for p in re.findall(r"\\.|[%_]|[^%_\\]+|\\", pattern, re.S):
        if p == "%":
            pieces.append("")
        else:
            pieces[-1] += "." if p == "_" else re.escape(p[1:] if len(p) == 2 and p[0] == "\\" else p)
    searches = [re.compile(x, re.S).search for x in pieces if x]

    def holds(text: str) -> bool:
        at = 0
        for search in searches:
            m = search(text, at)
            if not m:
                return False
            at = m.end()
        return True

    return holds


def _literal(pattern: str) -> str:
    """The longest stretch of a LIKE pattern that a match holds as it stands."""
    return max(re.split(r"\\.|[%_]|\\", pattern, flags=re.S), key=len)


class _Mentions:
    """All decisions of a block in one automaton."""

    def __init__(self, decisions: list[tuple]):
        import ahocorasick

        wild = re.compile(r"[%_\\]").search
        self.rows, by_text = decisions, {}
        self.always = []
        for k, (_, text, *_) in enumerate(decisions):
            literal = _literal(text) if wild(text) else text
            if literal:
                by_text.setdefault(literal, []).append(k)
            else:
                self.always.append(k)
        self.confirm = {k: _like(text) for k, (_, text, *_) in enumerate(decisions) if wild(text)}
        self.value = [_like(v) if wild(v) else None for _, _, v, _ in decisions]
        # a text that many decisions share is met once
        self.automaton, self.sharing = ahocorasick.Automaton(), list(by_text.values())
        for i, text in enumerate(by_text):
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()

    def of(self, source_file: str, low: str):
        """The numbers of the decisions that a chunk mentions without their value."""
        texts = {i for _, i in self.automaton.iter(low)} if len(self.automaton) else ()
        for k in (k for ks in (*(self.sharing[i] for i in texts), self.always) for k in ks):
            _, _, value, own = self.rows[k]
            held = self.value[k](low) if self.value[k] else value in low
            if own != source_file and not held and (k not in self.confirm or self.confirm[k](low)):
                yield k


#: The automaton that a worker holds: that of its last block, by token.
_KEPT: dict[str, _Mentions] = {}


def _mentions(block) -> _Mentions:
    if block.token not in _KEPT:
        # the one before goes first: never two at once
        _KEPT.clear()
        _KEPT[block.token] = _Mentions(block.value)
    return _KEPT[block.token]


class _Block:
    """A broadcast block, told apart by its token."""

    def __init__(self, spark, rows: list[tuple]):
        self.token, self.rows = uuid.uuid4().hex, spark.sparkContext.broadcast(rows)

    @property
    def value(self):
        return self.rows.value


def _hits(block: _Block):
    """Chunks (source_file, section_header, low) -> for each decision the first chunks of a task that contradict it."""

    def run(batches):
        mentions, best = _mentions(block), {}
        for b in batches:
            for file, section, low in zip(*(b.column(n).to_pylist() for n in ("source_file", "section_header", "low")), strict=True):
                for k in mentions.of(file, low):
                    some = best.setdefault(k, [])
                    some.append((file, section is not None, section or ""))
                    if len(some) > 2 * CONTRADICTION_HITS:
                        best[k] = sorted(some)[:CONTRADICTION_HITS]
        rows = [(mentions.rows[k][0], file, section if told else None) for k, some in best.items() for file, told, section in sorted(some)[:CONTRADICTION_HITS]]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["decision_key", "source_file", "section_header"])

    return run


def _as_it_stands(text: Column) -> Column:
    """A LIKE pattern that a text answers to only where it holds this one."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def contradictions(decisions: DataFrame, chunks: DataFrame, prefix: str, most: int | None = None, literal: bool = False) -> DataFrame:
    """Chunks that mention a current decision's text but not its value, in any case (% and _ in them stand for any text
    and character, or with `literal` for themselves). All decisions are looked for, or the first `most` by key (the
    surveyed system: the first CONTRADICTION_DECISIONS), those of moderate length among them.

    Decisions become one automaton, which goes to the tasks in blocks of MENTIONED at most (of CONTRADICTION_LENGTHS, so
    of a known size): one pass over the chunks for each. A task keeps the first few chunks of a decision."""
    d = decisions.filter("superseded_by IS NULL")
    if most is not None:
        d = d.orderBy("decision_key").limit(most)
    d = d.filter(F.length("decision").between(*CONTRADICTION_LENGTHS)).select("decision_key", "decision", "current_value", "source_doc", to_full(F.col("source_doc"), prefix).alias("own"))
    asked = d.filter("current_value IS NOT NULL AND own IS NOT NULL").select("decision_key", F.lower("decision").alias("text"), F.lower(F.substring("current_value", 1, CONTRADICTION_PREFIX)).alias("value"), "own")
    if literal:
        asked = asked.withColumns({c: _as_it_stands(F.col(c)) for c in ("text", "value")})
    blocks = max(1, math.ceil(asked.count() / (MENTIONED / 2)))
    c = chunks.filter("source_file IS NOT NULL AND content IS NOT NULL").select("source_file", "section_header", F.lower("content").alias("low"))
    spark, hits = chunks.sparkSession, None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("decision_key"), F.lit(blocks)) == b)
        found = c.mapInArrow(_hits(_Block(spark, [tuple(r) for r in some.collect()])), "decision_key string, source_file string, section_header string")
        hits = found if hits is None else hits.unionByName(found)
    order = Window.partitionBy("decision_key").orderBy("source_file", "section_header")
    hits = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= CONTRADICTION_HITS).join(d, "decision_key")
    reason = F.concat(F.lit("chunk mentions `"), "decision", F.lit("` but not the current value (`"), F.substring("current_value", 1, CONTRADICTION_REASON), F.lit("…` per `"), "source_doc", F.lit("`)"))
    return _items(hits, "decision-contradict", file=F.col("source_file"), reason=reason, source=F.concat(F.lit("docs/"), "source_doc", F.lit(".md")), replacement=F.col("current_value"), snippet=F.col("section_header"))


def collect(*signals: DataFrame) -> DataFrame:
    """All items once by file, line, signal and reason; of what else they say the least, so that reruns agree."""
    out = signals[0]
    for s in signals[1:]:
        out = out.unionByName(s)
    key, rest = ["file", "line", "signal", "reason"], ["authoritative_source", "suggested_replacement", "snippet"]
    return out.groupBy(*key).agg(F.min(F.struct(*rest)).alias("least")).select(*key, "least.*")


def priority(signal: Column) -> Column:
    out = F.lit(99)
    for i, s in enumerate(SIGNALS):
        out = F.when(signal == s, i).otherwise(out)
    return out


def filtered(items: DataFrame, signal: str | None = None, area: int | None = None) -> DataFrame:
    if signal:
        items = items.filter(F.col("signal") == signal)
    if area is not None:
        name, start = F.element_at(F.split("file", "/"), -1), f"{area:02d}-"
        items = items.filter(name.startswith(start) | name.startswith(start.lstrip("0")))
    return items


def top(items: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """The first n (1 to MAX_TOP), by priority, file and line."""
    return items.orderBy(priority(F.col("signal")), "file", F.coalesce("line", F.lit(0)), "reason").limit(max(1, min(n, MAX_TOP)))


def by_category(hits: DataFrame) -> DataFrame:
    """What stale_strings() found -> how many lines and files each category has; the most first."""
    return hits.groupBy("category").agg(F.count("*").alias("hits"), F.count_distinct("file").alias("files")).orderBy(F.desc("hits"), "category")


def by_signal(items: DataFrame) -> DataFrame:
    return items.groupBy("signal").agg(F.count("*").alias("items"))


class Cache:
    """Keeps a collected frame for a while."""

    def __init__(self, ttl: float = DRIFT_TTL_SECONDS, clock=time.monotonic):
        self.ttl, self.clock, self.frame, self.since = ttl, clock, None, 0.0

    def get(self, make) -> tuple[DataFrame, float]:
        """(the frame, its age in seconds)."""
        now = self.clock()
        if self.frame is None or now - self.since >= self.ttl:
            if self.frame is not None:
                self.frame.unpersist()
            self.frame, self.since = make().persist(), now
        return self.frame, now - self.since
