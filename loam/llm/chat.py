"""Chat formatting by event-sourced reconstruction.

A log holds one row for each thing that happened to a message: `start` (a role speaks), `delta` (text is
appended), `edit` (the text so far is replaced) and `regenerate` (the text so far is thrown away and the
role speaks anew). The log is partitioned by conversation, sorted by sequence and folded in one streaming
pass, so that a task holds one message at a time, however long its conversation is; what is finished is
rendered at once.

Template: <s>[ROLE:role][INST]text[/INST] for each turn, and </s> after an assistant's. A backslash goes before
each control string inside a role or text and before each backslash, so that rendered text can be read
back; the loss mask is a span of each turn, an assistant's text and nothing else.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, FOOT, END = "<s>", "[INST]", "[/INST]", "</s>"
#: What a text must not hold unescaped. Each starts with a character that is escaped by a backslash.
CONTROL = (OPEN, END, HEAD, FOOT, "[ROLE:")
_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_UNESCAPE = re.compile(r"\\(\\|[<\[])")
#: One rendered turn: role, then text up to a control string that no backslash precedes.
_TURN = re.compile(r"<s>\[ROLE:((?:[^\\\]]|\\.)*)\]\[INST\]((?:[^\\\[]|\\.|\[(?!/INST\]))*)\[/INST\](</s>)?", re.S)
KINDS = ("start", "delta", "edit", "regenerate")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"{OPEN}[ROLE:{escape(role).replace(']', chr(92) + ']')}]{HEAD}{escape(text)}{FOOT}" + END * (role == "assistant")


def loss_span(role: str, rendered: str) -> tuple[int, int]:
    """The part of a rendered turn that is learned: an assistant's text as it is written there, else nothing."""
    if role != "assistant":
        return 0, 0
    return rendered.index("]" + HEAD) + 1 + len(HEAD), len(rendered) - len(FOOT + END)


def parse(rendered: str) -> list[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of each turn of what render() has returned, one or many turns."""
    out, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            raise ValueError(f"not a rendered turn at {at}: {rendered[at : at + 40]!r}")
        out.append((unescape(m[1].replace("\\]", "]")), unescape(m[2]), bool(m[3])))
        at = m.end()
    return out


def fold(events):
    """Sorted (conv_id, message, kind, role, text) -> (conv_id, role, text) of each message as it ended.

    An event before any start opens a message of role `unknown`; a new message number does so too. edit
    replaces the text, regenerate empties it (and sets the role if it names one); a null text is empty."""
    key, role, parts = None, "unknown", []
    begun = False
    for conv, message, kind, who, text in events:
        if not begun or (conv, message) != key:
            if begun:
                yield key[0], role, "".join(parts)
            key, role, parts, begun = (conv, message), who or "unknown", [], True
        if kind in ("edit", "regenerate"):
            parts = []
        if kind in ("start", "regenerate") and who:
            role = who
        if text and kind in KINDS:
            parts.append(text)
    if begun:
        yield key[0], role, "".join(parts)


def _rows(batches):
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in ("conv_id", "message", "kind", "role", "text")), strict=True)


def _rendered(batches):
    """A row for each final message: conv_id, turn_no, rendered, loss_start, loss_end."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    out, size, last, n = [], 0, object(), 0
    for conv, role, text in fold(_rows(batches)):
        n = n + 1 if conv == last else 0
        last = conv
        turn = render(role, text)
        out.append((conv, n, turn, *loss_span(role, turn)))
        size += len(turn)
        if size > 4_000_000 or len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def reconstruct(events: DataFrame) -> DataFrame:
    """events with conv_id, seq, message, kind, role, text -> conv_id, turn_no, rendered, loss_start, loss_end: a
    row for each final message, in order within its partition; the span is in characters of rendered.

    Sequence ties go by message, kind, role, text; nulls come first. Rows repeated exactly are one event. A
    conversation without id is one conversation; an unknown kind changes nothing but opens its message;
    extra columns are ignored; no events give no rows."""
    log = events.select("conv_id", "seq", "message", "kind", "role", "text").dropDuplicates()
    return log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "role", "text").mapInArrow(_rendered, "conv_id long, turn_no long, rendered string, loss_start long, loss_end long")


def _digests(batches):
    """Reads rendered turns back: a row for each conversation."""
    names = (("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))
    done, key, state = [], None, None

    def closed():
        n, turns, chars, loss, formatted = state
        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for b in batches:
        for conv, rendered, start, end in zip(*(b.column(n).to_pylist() for n in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
            if state is None or conv != key:
                if state is not None:
                    closed()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _ in parse(rendered):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            learned = unescape(rendered[start:end])
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(rendered)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, (_, t) in enumerate(names)], [n for n, _ in names])
            done.clear()
    if state is not None:
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, (_, t) in enumerate(names)], [n for n, _ in names])


def digests(turns: DataFrame) -> DataFrame:
    """What reconstruct() returned -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished turns as a log that would have led to them: a start, then the text in two deltas; of each four turns (by
    a hash) one is begun wrong and regenerated, one streamed in part and then edited as a whole, and one edited in the
    middle and then streamed on. Rows that share a turn number are messages of their own, in the order of role and
    text."""
    from pyspark.sql import Window

    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("nth", F.row_number().over(same))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    draft = F.concat(F.lit("draft "), F.coalesce(F.reverse("text"), F.lit("")))
    event = lambda step, kind, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    start = event(0, "start", F.lit(None))
    which = F.pmod(F.xxhash64("conv_id", "turn", "nth"), F.lit(4))
    e = (
        F.when(which == 0, F.array(start, event(1, "delta", draft), event(2, "regenerate", F.lit(None)), event(3, "delta", first), event(4, "delta", rest)))
        .when(which == 1, F.array(start, event(1, "delta", first), event(2, "edit", F.col("text"))))
        .when(which == 2, F.array(start, event(1, "delta", draft), event(2, "edit", first), event(3, "delta", rest)))
        .otherwise(F.array(start, event(1, "delta", first), event(2, "delta", rest)))
    )
    c = c.select("conv_id", "turn", "nth", "role", F.explode(e).alias("e"))
    at = F.struct("turn", "nth")
    return c.select("conv_id", F.struct("turn", "nth", F.col("e.step").alias("step")).alias("seq"), at.alias("message"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digests(reconstruct(as_events(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))))
