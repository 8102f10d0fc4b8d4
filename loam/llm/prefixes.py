"""A trie of rebuilt conversations, family by family.

Texts become digests before anything is shuffled. The conversations of a family (a base id and the ids after it) meet
in one task, in order; the base's first turns, at most HEAD - 1, are kept, and each conversation is rebuilt from them
and its own turns in one streaming pass. A node is known by a digest over its turns in order; what the conversations
of a family share is summed in the task, and only those sums are shuffled and merged over all families.

What concerns a subtree is a sum over a node's members, so that no round is needed for its depth. Along a conversation
the smallest member of the nodes falls to itself at some depth and stays so: before that depth the conversation saves
the bytes of its turns, from there on the nodes (and, at its end, perhaps a leaf) are its own. A second pass
adds that up for the nodes with more than one member; a node with one is a chain down to a leaf.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved, table, with_rows

#: A family: an id divisible by FAMILY and those up to the next. A conversation takes less than HEAD turns from its base.
FAMILY, HEAD = 5, 9
#: Nodes of a family that a task sums before it hands them on, so that no conversation is too long.
HELD = 50_000
#: Bytes of joined ids in a row, on the way to their digest.
JOINED = 64_000
ROOT = b""
NEVER = 2**62
_NODES = (("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("bytes", pa.int64()), ("path", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()), ("deeper", pa.int64()), ("ends", pa.bool_()))
_SUMS = (("k1", pa.int64()), ("k2", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()))


def _schema(columns) -> str:
    return ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in columns)


def _batch(rows: list[tuple], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])


def taken(conv: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % HEAD


def step(key: bytes, turn: bytes) -> bytes:
    """The digest of a sequence of turns and one more."""
    return hashlib.blake2b(key + turn, digest_size=16).digest()


def longs(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", key) if key else (0, 0)


def rebuilt(rows):
    """(base, conv, facts, turn, bytes) in order -> (base, conv, facts, turns) of each conversation, rebuilt: turns gives
    (turn, bytes), and has to be used up before the next. A row without a turn brings facts about its conversation."""
    rows = iter(rows)
    row = next(rows, None)
    base, head = None, []
    while row is not None:
        if row[0] != base:
            base, head = row[0], []
        conv, facts = row[1], None
        if row[3] is None:
            facts, row = row[2], next(rows, None)

        def turns(conv=conv, base=base, head=head):
            nonlocal row
            own, h = 0, taken(conv)
            if conv != base:
                yield from head[:h]
            while row is not None and row[1] == conv:
                turn = row[3], row[4]
                row = next(rows, None)
                own += 1
                if conv == base and own < HEAD:
                    head.append(turn)
                if conv == base or own > h:
                    yield turn

        yield base, conv, facts, turns()


def path(turns):
    """Turns -> (depth, key, key above, bytes, bytes of the path, whether it goes deeper), from the root on."""
    last = (0, ROOT, ROOT, 0, 0)
    for turn, size in turns:
        yield *last, True
        last = (last[0] + 1, step(last[1], turn), last[1], size, last[4] + size)
    yield *last, False


def _rows(batches, facts: bool):
    for b in batches:
        turns = [b.column(n).to_pylist() for n in ("base", "conv", "turn_key", "bytes")]
        told = zip(*(b.column(n).to_pylist() for n in ("owned", "shared", "alone", "leaf")), strict=True) if facts else [None] * b.num_rows
        for (base, conv, turn, size), f in zip(zip(*turns, strict=True), told, strict=True):
            yield base, conv, f, turn, size


def _family_nodes(batches):
    """The nodes of each family's trie with the family's members counted; and a row for where each conversation ends."""
    held, ends, family = {}, [], None

    def flushed():
        out = [(*longs(k), *v) for k, v in held.items()] + ends
        held.clear()
        ends.clear()
        return _batch(out, _NODES)

    for base, conv, _, turns in rebuilt(_rows(batches, False)):
        if base != family:
            family = base
            if len(held) + len(ends) > HELD // 10:
                yield flushed()
        for depth, key, above, size, far, deeper in path(turns):
            # within a family conversations come in ascending order, so the first one at a node is the smallest
            old = held.get(key)
            if old is None:
                held[key] = [*longs(above), depth, size, far, 1, conv, int(deeper), False]
            else:
                old[5] += 1
                old[6] = min(old[6], conv)
                old[7] |= deeper
            if not deeper:
                ends.append((*longs(key), *longs(above), depth, size, far, 1, conv, 0, True))
            if len(held) > HELD:
                yield flushed()
    if held or ends:
        yield flushed()


def _family_sums(batches):
    """For the nodes of each family's trie that more than one conversation has: children, leaves and saved bytes that
    the family's members bring."""
    held, family = {}, None

    def flushed():
        out = [(*longs(k), *v) for k, v in held.items()]
        held.clear()
        return _batch(out, _SUMS)

    for base, _, (owned, shared, alone, leaf), turns in rebuilt(_rows(batches, True)):
        if base != family:
            family = base
            if len(held) > HELD // 10:
                yield flushed()
        before = 0
        for depth, key, _, _, far, deeper in path(turns):
            if depth < alone:
                sums = held.setdefault(key, [0, 0, 0])
                sums[0] += deeper and depth + 1 >= owned
                sums[1] += leaf
                sums[2] += max(0, shared - before)
                before = far
            if len(held) > HELD:
                yield flushed()
    if held:
        yield flushed()


def _joined(batches):
    """Sorted (k1, k2, conv) -> k1, k2, first, ids: runs of a node's ids, joined."""
    names = (("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string()))
    out, key, ids, size = [], None, [], 0
    for b in batches:
        for k1, k2, conv in zip(*(b.column(n).to_pylist() for n in ("k1", "k2", "conv")), strict=True):
            if ids and ((k1, k2) != key or size > JOINED):
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            key = (k1, k2)
            ids.append(conv)
            size += len(str(conv)) + 1
        if len(out) > 1000:
            yield _batch(out, names)
            out = []
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    if out:
        yield _batch(out, names)


def _digests(batches):
    """Sorted (k1, k2, first, ids) -> k1, k2, ends_sha256."""
    names = (("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string()))
    out, key, digest = [], None, None
    for b in batches:
        for k1, k2, ids in zip(*(b.column(n).to_pylist() for n in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == key:
                digest.update(b",")
            else:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256()
            digest.update(ids.encode())
        if len(out) > 1000:
            yield _batch(out, names)
            out = []
    if key:
        out.append((*key, digest.hexdigest()))
    if out:
        yield _batch(out, names)


def turn_keys(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> base, conv, turn, turn_key, bytes: a digest in place of role and text."""
    c = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    return c.select((F.col("conv") - F.pmod("conv", F.lit(FAMILY))).alias("base"), "conv", "turn", key.alias("turn_key"), F.octet_length("text").cast("long").alias("bytes"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends (k1, k2, conv) -> k1, k2, ends_sha256. Ids are sorted in ranges over all nodes and joined there, so that of a
    node where very many conversations end a task gets their text in large pieces, which it digests in turn."""
    pieces = ends.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").mapInArrow(_joined, "k1 long, k2 long, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a row for each node of the trie of rebuilt conversations: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by number, null first, those with one number by a digest of role and text; rows that repeat are turns of
    their own; a null role or text is empty; rows without a conversation go; of a negative id the base is below it. An
    absent base gives no turns; a rebuilt conversation without turns is a member of the root. Extra columns are
    ignored; no conversations have no nodes."""
    turns = saved(turn_keys(conversations), "turns")
    order = ["base", "conv", F.asc_nulls_first("turn"), "turn_key"]
    met = saved(turns.repartition("base").sortWithinPartitions(*order).mapInArrow(_family_nodes, _schema(_NODES)), "family-nodes")
    same = ["k1", "k2", "p1", "p2", "depth", "bytes", "path"]
    nodes = saved(met.filter("NOT ends").groupBy(*same).agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("deeper").alias("deeper")), "nodes")
    ends = met.filter("ends").select("k1", "k2", "conv", "path")

    # what the second pass has to know of a conversation: from which depth on nodes are its own, the bytes before that,
    # from which depth on nobody else has them, and whether it ends in a leaf of its own
    own = nodes.select("conv", F.col("depth").alias("owned"), (F.col("path") - F.col("bytes")).alias("shared"), F.when(F.col("n") == 1, F.col("depth")).alias("alone"), (1 - F.col("deeper")).alias("leaf"), F.lit(None).cast("long").alias("whole"))
    none = [F.lit(None).cast("long").alias(c) for c in ("owned", "shared", "alone", "leaf")]
    facts = own.unionByName(ends.select("conv", *none, F.col("path").alias("whole"))).groupBy("conv").agg(F.min("owned").alias("owned"), F.min("shared").alias("shared"), F.min("alone").alias("alone"), F.max("leaf").alias("leaf"), F.max("whole").alias("whole"))
    facts = facts.select((F.col("conv") - F.pmod("conv", F.lit(FAMILY))).alias("base"), "conv", F.coalesce("owned", F.lit(NEVER)).alias("owned"), F.coalesce("shared", "whole").alias("shared"), F.coalesce("alone", F.lit(NEVER)).alias("alone"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    facts = saved(facts, "facts")
    # facts come before the turns of their conversation, for they have no turn key
    told = turns.unionByName(facts.withColumns({"turn": F.lit(None).cast("long"), "turn_key": F.lit(None).cast("binary"), "bytes": F.lit(0).cast("long")}), allowMissingColumns=True)
    sums = told.repartition("base").sortWithinPartitions("base", "conv", F.col("turn_key").isNotNull(), F.asc_nulls_first("turn"), "turn_key").mapInArrow(_family_sums, _schema(_SUMS))
    sums = sums.groupBy("k1", "k2").agg(*(F.sum(c).alias(c) for c in ("kids", "leaves", "saved")))

    whole = nodes.join(sums, ["k1", "k2"], "left").join(ends_digests(ends.select("k1", "k2", "conv")), ["k1", "k2"], "left")
    alone = F.col("n") == 1
    whole = whole.select(
        *same, "n", "conv", F.when(alone, F.col("deeper")).otherwise(F.col("kids")).alias("n_children"), F.when(alone, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), F.when(alone, F.lit(0)).otherwise(F.col("saved")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    whole = saved(whole, "trie")
    drop_saved(met)
    # below the depth where a conversation's own nodes begin, a node's parent is of the same conversation; only the first has to look for it
    first = whole.join(facts.select(F.col("conv").alias("c"), "owned"), (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("owned")) & (F.col("depth") > 0), "left")
    first = first.withColumn("looks", F.col("c").isNotNull())
    columns = ["conv", "depth", "parent", "n", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kept = first.filter("NOT looks").withColumn("parent", F.when(F.col("depth") > 0, F.col("conv"))).select(*columns)
    above = saved(whole.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"), F.col("n_children").alias("n")), "parents")
    found = with_rows(first.filter("looks").drop("k1", "k2", "c", "owned", "looks", "bytes", "path").withColumnRenamed("n", "members"), above, ["p1", "p2"])
    out = kept.unionByName(found.withColumnRenamed("members", "n").select(*columns))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 of a decimal id, bit by bit: a number from 0 on is a byte that comes in, -1 a shift.
CRC = "xor(list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295), 4294967295)"
#: Whole sequences as keys, and subtrees as pairs of nodes.
ORACLE = f"""WITH o AS (SELECT conv_id AS c, list(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own,
    list(octet_length(encode(coalesce(text, ''))) ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT *, c - ((c % {FAMILY}) + {FAMILY}) % {FAMILY} AS base, CAST({CRC} % {HEAD} AS INT) AS h FROM o),
r AS MATERIALIZED (SELECT h.c, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS seq, list_concat(coalesce(b.size[1:h.h], []), h.size[h.h + 1:]) AS size FROM h LEFT JOIN o b ON b.c = h.base),
n AS MATERIALIZED (SELECT seq[1:d] AS k, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN size[d] ELSE 0 END) AS bytes, coalesce(string_agg(CASE WHEN len(seq) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM r) GROUP BY 1, 2),
p AS MATERIALIZED (SELECT n.*, m.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.k[1:n.depth] = n.k) AS n_children FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.k = n.k[1:n.depth - 1])
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved_tokens, sha256(any_value(a.ends)) AS ends_sha256
FROM p a JOIN p b ON b.depth >= a.depth AND b.k[1:a.depth] = a.k GROUP BY a.k, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children"""
