"""Vector codes, tries of conversations and token counts: odd rows, against brute force on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loam.llm import codebooks, common, counts, prefixes, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ["pos", "part", "n", "code", "uid", "v", "base", "conv", "depth", "chunk", "tokens", "error", "n_tokens"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def least_squares(rows):
    """What compressed() returns, one vector after the other in Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) and abs(x) < 2**51 for x in v) and len(v) % 8 == 0]
    order = lambda i: (i is None, i or 0)
    if not kept:
        return []
    size = min(((order(i), len(v)) for i, v, _ in kept))[1]
    kept = [(i, [math.floor(x * 4096) for x in v], lab) for i, v, lab in kept if len(v) == size]
    ids = sorted({i for i, *_ in kept}, key=order)[:16]
    first, w = [min(v for j, v, _ in kept if j == i) for i in ids], size // 8
    books = [[v[p * w : p * w + w] for v in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(v[p * w : p * w + w], e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        parts = [[[v[p * w : p * w + w] for _, v, _ in kept if near(v, p)[1] == k] for k in range(len(first))] for p in range(8)]
        books = [[[sum(x) // len(some) for x in zip(*some, strict=True)] if some else e for some, e in zip(parts[p], books[p], strict=True)] for p in range(8)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], Counter()
    for i, v, lab in kept:
        ds = [near(v, p) for p in range(8)]
        error = min(sum(min(d, 2**63 - 1) for d, _ in ds), 2**63 - 1)
        total[lab] += error
        out.append((i, "".join(f"{k:02x}" for _, k in ds), error, lab))
    return sorted(((i, c, e, min(total[lab], 2**63 - 1), digest) for i, c, e, lab in out), key=str)


def odd_vectors():
    r = random.Random(7)
    vec = lambda: [r.choice([0.0, r.uniform(-1, 1), r.uniform(-1, 1)]) for _ in range(16)]
    rows = [(k, vec(), k % 3) for k in range(10, 60)]
    rows += [(100 + k, [0.25] * 8 + vec()[:8], 7) for k in range(60)] + [(200, None, 1), (201, [None] + vec()[1:], 1), (202, [math.nan] + vec()[1:], 1), (203, [math.inf] + vec()[1:], 1), (204, [-math.inf] + vec()[1:], 1)]
    return [*rows, (205, [], 1), (206, vec()[:8], 1), (207, vec()[:5], 1), (12, vec(), None), (12, rows[2][1], None), (12, rows[2][1], 5), (None, vec(), None), (208, [-1e-9] * 16, 9)]


def coded(spark, rows, schema="vec_id long, embedding array<double>, label int"):
    got = codebooks.compressed(clashing(spark.createDataFrame(rows, schema)))
    return sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes(spark):
    rows = odd_vectors()
    assert coded(spark, rows) == least_squares(rows)
    assert coded(spark, rows[:4]) == least_squares(rows[:4])
    assert coded(spark, [r for r in rows if r[1] is None]) == [] and codebooks.compressed(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    # one vector alone, and very many rows that repeat
    assert coded(spark, [(None, [1.0] * 8, None)]) == least_squares([(None, [1.0] * 8, None)])
    assert coded(spark, [(k % 3, [float(k % 3)] * 8, 1) for k in range(900)]) == least_squares([(k % 3, [float(k % 3)] * 8, 1) for k in range(900)])


def test_codes_of_large_components(spark):
    """Sums and squares beyond 64 bits, and components whose integer is no long."""
    r = random.Random(3)
    rows = [(k, [r.choice([1e3, 3e6, 2e12, 2.0**50]) * r.uniform(-1, 1) for _ in range(8)], k % 2) for k in range(40)] + [(90, [1e300] + [0.0] * 7, 1), (91, [2.0**51] + [0.0] * 7, 1)]
    assert coded(spark, rows) == least_squares(rows)


def test_codes_of_hot_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    rows = odd_vectors()
    assert coded(spark, rows) == least_squares(rows)


def test_rows_meet_their_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    rows = spark.createDataFrame([(k % 4 or None, "ab"[k % 2] if k % 7 else None, k) for k in range(80)] + [(9, "z", 1)], "a long, b string, x long")
    side = common.saved(rows.filter("a IS NULL OR a <> 9").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("x").alias("most")), "side")
    want = rows.join(side.withColumnsRenamed({"a": "c", "b": "d"}), F.col("a").eqNullSafe(F.col("c")) & F.col("b").eqNullSafe(F.col("d"))).select("a", "b", "x", "most")
    assert sorted(map(str, common.with_rows(rows, side, ["a", "b"]).collect())) == sorted(map(str, want.collect()))


def nodes(rows):
    """What trie() returns, with whole sequences as nodes and every pair of nodes looked at."""
    own = defaultdict(list)
    key = lambda role, text: hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in sorted(whole.items()):
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = {k: sum(len(x) == len(k) + 1 and x[: len(k)] == k for x in members) for k in members}
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return sorted(map(tuple, prefixes.trie(df).collect()), key=str)


def conversations():
    r = random.Random(5)
    rows = []
    for c in [*range(-7, 40), 45, 46, 51, 53, 54, 1000, 1003]:
        if c % 10 != 5:
            rows += [(c, t, ("user", "assistant")[t % 2], r.choice(["hi", "ho", "é", ""])) for t in range(r.choice([0, 1, 2, 3, 5, 9, 14]))]
    rows += [(60, None, "user", "first"), (60, 0, None, "hi"), (60, 1, "user", None), (60, 1, "assistant", "tie"), (60, 1, "assistant", "tie"), (61, 7, "user", "x"), (None, 0, "user", "nobody"), (None, 0, "user", "nobody")]
    return rows


def test_trie(spark):
    rows = conversations()
    got = built(spark, rows)
    assert got == nodes(rows) and any(r[1] == 0 and r[3] == len({c for c, *_ in rows if c is not None}) for r in got)
    assert built(spark, rows[:0]) == [] and built(spark, [(None, 1, "user", "x")]) == []
    # a conversation that is rebuilt from an absent base and has no turns left
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert built(spark, [(c, 0, "user", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    """A third of all conversations are copies, one is long; tasks hand nodes on early, ends are joined in small pieces."""
    monkeypatch.setattr(prefixes, "HELD", 7)
    monkeypatch.setattr(prefixes, "JOINED", 5)
    monkeypatch.setattr(common, "HOT", 2)
    rows = [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(10)] + [(200, t, "user", f"long {t % 5}") for t in range(60)] + conversations()
    assert built(spark, rows) == nodes(rows)


ODD = ["", None, " ", "  a  b ", "a\n\n b", "x" * 3000, "hello world " * 400, "<|endoftext|> a <|endoftext|>", "é東 🎉\t'll don't", "a\x1c b\x85 c　d", "<|endof text|>"]


def test_token_counts(spark, monkeypatch):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    library, pieces = Tokenizer.from_file(PATH), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words.no_truncation()
    ways = {PATH: lambda t: len(library.encode(t, add_special_tokens=False).ids), public_tokenizers.path("piece_bpe_32k.model"): lambda t: len(pieces.encode(t)), public_tokenizers.path("word_bpe_49k.json"): lambda t: len(words.encode(t, add_special_tokens=False).ids)}
    for path, count in ways.items():
        got = sorted(map(tuple, counts.token_counts(df, path).collect()), key=str)
        assert got == sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 512) for i, t in rows), key=str)
        assert counts.token_counts(df.limit(0), path).count() == 0
    assert [counts.splits(p) for p in ways] == [True, False, False]


@pytest.mark.parametrize("known", [[], ["hello", "World", " a", "a\n", "\n", "b"]])
def test_counts_of_chunks_are_the_librarys(monkeypatch, known):
    monkeypatch.setattr(tokens, "BLOCK", 40)
    monkeypatch.setattr(counts, "LONGEST", 12)
    r, library = random.Random(2), counts.Library(PATH)
    learned = counts.Lengths(PATH)
    learned.learn(known)
    own = counts.Lengths(PATH, {c: learned.kept[c] for c in known}, cache=30)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "é", "東", "1", ".", "'s", "'ll", "<|endoftext|>", "<|endof", "　", "\x85", "\x1c", "🎉", "hello", "World", "x" * 20]
    for _ in range(600):
        texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(4)]
        assert list(own.each(texts)) == [library.count(t) for t in texts]
        assert max(map(len, own.kept), default=0) <= 12 or known
    assert len(own.kept) <= 30 + len(known) + 200


def test_frequent_chunks(spark):
    rows = [(k, "often often rare%d <|endoftext|> often" % k) for k in range(300)]
    got = {r.chunk: r.n for r in counts.frequent(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()}
    assert got["often"] == 600 and got[" often"] == 300 and not any(c.startswith("rare") for c in got)
    few = counts.frequent(spark.createDataFrame(rows, "doc_id long, text string"), PATH, most=1).collect()
    assert len(few) == 1 and len(counts.packed(spark, spark.createDataFrame(few), PATH)) < 2000
    assert counts.MOST_BYTES < 4_000_000
