"""Each corpus operator on odd rows, against brute force on small fixtures."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loam.llm import chat, compression, decontaminate, langid, minhash, mixing, quality, repeats, tokens, winnow_lines
from loam.llm.suffixes import common_prefixes, find, suffix_array

rng = random.Random(4)
SYLLABLES = ["the", "an", "ti", "on", "re", "ed", "wha", "ble", "st", "er", "é", "lo"]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


BASE = prose(120, 1)
LONG = prose(40_000, 2)
ROWS = [
    (1, BASE, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, BASE, "en", None), (4, BASE, "fr", "b"), (4, BASE, "fr", "b"),
    (5, BASE.replace("the", "The", 1), "en", "b"), (6, LONG, "en", "hot"), (7, " \n\t ", "en", "hot"), (8, "one two", "de", "hot"), (9, prose(90, 3), "en", "a"),
    (10, "spam eggs " * 300, "en", "a"), (11, BASE + "\n" + prose(10, 5), None, "b"), (12, "1234 ... 56", "en", "b"), (13, prose(60, 6) + "\n" + BASE, "en", "é"), (4, prose(70, 9), "en", "b"),
]
CLASHING = ["size", "hash", "score", "kept", "uid", "rep", "component", "runs", "digest", "lang_pred", "quality", "start", "shard", "threshold", "s", "n", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)




def words(text):
    return (text or "").encode().split()


def test_compression(docs, none):
    got = sorted(compression.compression_bands(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))
    assert len(got) == len(ROWS) and compression.compression_bands(none).count() == 0
    want = []
    for i, t, *_ in ROWS:
        w = words(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [tuple(r)[:7] for r in got] == want
    assert all(not r.kept for r in got if r.base_failed) and {r.doc_id for r in got if r.kept} >= {1, 4, 6, 9}
    noise = "".join(chr(33 + rng.randrange(90)) + " " * (k % 9 == 0) for k in range(9000))
    squeeze = compression.zstandard.ZstdCompressor(level=3)
    assert not compression.measure(noise, squeeze)[6] and not compression.measure(" ".join(f"w{k % 40}" for k in range(3000)), squeeze)[6]


def test_compression_beside_peers(spark):
    """Repetitive beside its peers, and not by its band alone."""
    pick = random.Random(5)
    usual = [(k, prose(400, 3000 + k)) for k in range(60)]
    dull = " ".join(pick.choice(["alpha", "beta", "gamma", "delta", "eps"]) + pick.choice("abcdefgh") for _ in range(500))
    got = {r.doc_id: r for r in compression.compression_bands(spark.createDataFrame([*usual, (900, dull)], "doc_id long, text string"), weight=1).collect()}
    assert all(got[k].kept for k, _ in usual) and not got[900].base_failed and not got[900].kept
    alone = compression.compression_bands(spark.createDataFrame([(900, dull)], "doc_id long, text string")).collect()[0]
    low, high = compression.BANDS[alone.band][1:]
    assert alone.kept == (low <= alone.ratio <= high and alone.n_chunks_out <= compression.CHUNK_SHARE * alone.n_chunks)


def test_compression_verdicts_over_a_table(spark):
    """kept by medians and spreads that numpy works out, for a table and for a tenth of it."""
    pick = random.Random(8)
    kinds = [lambda n, k: prose(n, k), lambda n, k: " ".join(pick.choice("abcdefgh") + pick.choice(["one", "two"]) for _ in range(n)), lambda n, k: "".join(chr(33 + pick.randrange(90)) + " " * (j % 9 == 0) for j in range(5 * n))]
    rows = [(k, kinds[0 if k % 8 else 1 + k % 3 % 2](pick.choice([60, 90, 150, 300, 700]), 7000 + k)) for k in range(320)] + [(900, None), (901, "few words")]
    squeeze = compression._at_level(compression.LEVEL)

    def judged(some):
        values = {i: dict(zip((n for n, _ in compression.FIELDS), compression.measure(t, squeeze), strict=True)) for i, t in some}
        out = {}
        for i, v in values.items():
            peers = np.array([round(p["ratio"] * 1000) for p in values.values() if p["band"] == v["band"] and not p["base_failed"]])
            _, low, high = compression.BANDS[v["band"]]
            if len(peers):
                mid = np.median(peers)
                spread = max(np.median(np.abs(peers - mid)) * 1.4826 / 1000, compression.LEAST_SPREAD)
                w = compression.BAND_WEIGHT
                low, high = ((len(peers) * own + w * band) / (len(peers) + w) for own, band in ((mid / 1000 - compression.SPREADS[0] * spread, low), (mid / 1000 + compression.SPREADS[1] * spread, high)))
            out[i] = v["kept"] and low <= v["ratio"] <= high
        return out

    for some in (rows, [r for r in rows if r[0] % 10 == 0], rows[:1]):
        got = {r.doc_id: r.kept for r in compression.compression_bands(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert got == judged(some)
    assert 0 < sum(judged(rows).values()) < len(rows)


def test_hot_keys_meet_their_counts(spark, monkeypatch):
    from loam.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(200)] + [(99, 1)], "key long, x long")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("most")).filter("key <> 99")
    got = common.with_counts(rows, common.saved(counts, "counts"), "key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(counts, "key").select("key", "x", "n", "most").collect()))


def test_compression_tells_encoded_text_from_prose():
    import base64
    from pydoc_data.topics import topics

    r, squeeze = random.Random(3), compression.zstandard.ZstdCompressor(level=3, write_content_size=False)
    book = "\n".join(topics[k] for k in sorted(topics))
    wrapped = lambda s, n: " ".join(s[k : k + 6] for k in range(0, len(s), 6))[:n]
    kinds = {
        "base64": lambda n: wrapped(base64.b64encode(r.randbytes(n)).decode(), n),
        "hex": lambda n: wrapped(r.randbytes(n).hex(), n),
        "letters": lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))[:n],
        "template": lambda n: "".join(f"The item number {r.randrange(10**5)} costs {r.randrange(1000)} dollars today.\n" for _ in range(n))[:n],
    }
    kept = lambda t: compression.measure(t, squeeze)[6]
    for n in (450, 600, 900, 1500, 3000, 6000, 12_000, 40_000, 100_000):
        for name, make in kinds.items():
            # order tells hex and letters from prose from 1,024 bytes on
            assert n < 1024 and name in ("hex", "letters") or not any(kept(make(n)) for _ in range(10)), (n, name)
        if n <= 12_000:
            some = [book[k : k + n] for k in range(0, len(book) - n, len(book) // 30)]
            some = [t for t in some if not compression.measure(t, squeeze)[5]]
            assert sum(map(kept, some)) >= 0.9 * len(some) > 0, (n, sum(map(kept, some)), len(some))
    for name in ("base64", "hex", "letters"):
        assert not kept(book[:12_000] + kinds[name](9000)), name


def test_chunks_make_up_the_text():
    for n in (0, 1, 1023, 1024, 3071, 3072, 3073, 10_000):
        raw = bytes(rng.randrange(256) for _ in range(n))
        assert b"".join(compression.chunks(raw)) == raw


def test_language_id(docs, none, spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    english = [prose(50, 100 + k) for k in range(40)]
    german = [" ".join(rng.choice(["der", "und", "schl", "ung", "keit", "über", "nicht"]) + rng.choice(["ung", "ein", ""]) for _ in range(50)) for _ in range(40)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in english] + [(t, "de") for t in german])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert {i for i in got if got[i].held_out} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    odd = langid.identify(docs, model).collect()
    assert len(odd) == len(ROWS) and {r.doc_id for r in odd if r.lang_pred == "und"} == {2, 3, 7, 12}
    assert all(r.score == 0 for r in odd if r.lang_pred == "und")
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), model).collect()} == {"und"}


def test_segmentations_are_all_summed():
    from loam.llm.pieces import Pieces, expected_counts, log_likelihoods

    p = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    probs = np.random.default_rng(0).random(p.size + 1)
    probs /= probs.sum()

    def ways(w):
        if not w:
            yield 1.0, []
        for k in range(1, len(w) + 1):
            key = np.zeros(1, np.uint64)
            for c in w[:k]:
                key = key * np.uint64(0x9E3779B97F4A7C55) + np.uint64(ord(c) + 1)
            i = int(p.find(key)[0])
            if i < 0 and k == 1:
                i = p.size
            if i >= 0:
                for q, rest in ways(w[k:]):
                    yield probs[i] * q, [i, *rest]

    for w in ("▁the", "▁schön", "▁日q", "▁internat"):
        all_ways = list(ways(w))
        total = sum(q for q, _ in all_ways)
        assert np.isclose(log_likelihoods(p, probs[None], [w])[0, 0], np.log(total))
        want = defaultdict(float)
        for q, ids in all_ways:
            for i in ids:
                want[i] += 3 * q / total
        got = expected_counts(p, probs, [w], np.array([3.0]))
        assert np.allclose(got[list(want)], list(want.values())) and np.isclose(got.sum(), sum(want.values()))


def test_long_stretches_of_rare_letters(spark):
    from loam.llm.pieces import expected_counts, log_likelihoods, vocabulary

    model = public_tokenizers.path("piece_bpe_32k.model")
    p, han, word = vocabulary(model), "".join(chr(0x4E00 + 37 * k) for k in range(64)), "▁internationalisation" * 3
    for least in (1e-8, 1e-12, 1e-14):
        probs = np.random.default_rng(1).random(p.size + 1) * least
        common = probs.copy()
        common[::7] += 1e-4
        logs = log_likelihoods(p, np.stack([probs, common]), [han, word])
        assert np.isfinite(logs).all()
        # the same in logs, one place after the other
        for row, w in enumerate((han, word)):
            (_, edges), = p.lattices([w])
            for k, m in enumerate((probs, common)):
                known = np.append(m, 0.0)
                want = [0.0]
                with np.errstate(divide="ignore"):
                    for e in edges[1:]:
                        want.append(np.logaddexp.reduce([want[i] + np.log(known[found[0]]) for i, found in e]))
                assert np.isclose(logs[row, k], want[-1], rtol=1e-12)
                counts = expected_counts(p, m, [w], np.array([2.0]))
                lengths = np.zeros(p.size + 1)
                for j, e in enumerate(edges):
                    for i, found in e:
                        lengths[found[0]] = j - i
                # the pieces used make up the word
                assert np.isclose((counts * lengths).sum(), 2 * len(w))
    english = [prose(50, 100 + k) for k in range(40)]
    german = [" ".join(rng.choice(["der", "und", "schl", "ung", "keit", "über", "nicht"]) + rng.choice(["ung", "ein", ""]) for _ in range(50)) for _ in range(40)]
    rows = [(i, t + (" " + han) * (i % 10 == 0), lang) for i, (t, lang) in enumerate([(t, "en") for t in english] + [(t, "de") for t in german])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for learned in (df, df.filter("doc_id % 10 != 0")):
        languages, probs = langid.train(learned, model)
        assert np.isfinite(probs).all()
        # as if of a corpus a million times as large
        probs = np.where(probs < 1e-5, probs * 1e-6, probs)
        got = {r.doc_id: r for r in langid.predict(df, model, languages, probs).collect()}
        assert all(0 <= got[i].score <= 1 for i in got) and all(got[i].lang_pred == lang for i, _, lang in rows if learned is df or i % 10)


def test_words_of_any_length_and_letters_alone(spark, monkeypatch):
    from loam.llm import pieces

    assert [w for some in langid.words("Ab½c ² Ⅷ x_y 1é") for w in some] == ["ab", "c", "x", "y", "é"]
    monkeypatch.setattr(langid, "BLOCK", 5)
    assert Counter(w for some in langid.words("one two  three four5six") for w in some) == Counter(["one", "two", "three", "four", "six"])
    vocabulary = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    draw = np.random.default_rng(4)
    model = draw.random((3, vocabulary.size + 1)) ** 9
    model /= model.sum(1, keepdims=True)
    known, times = ["▁" + "".join(draw.choice(list("etaoinß漢"), n)) for n in (3, 20, 45, 63)], np.array([2.0, 1.0, 3.0, 1.0])
    logs, uses = pieces.log_likelihoods(vocabulary, model, known), pieces.expected_counts(vocabulary, model[0], known, times)
    monkeypatch.setattr(pieces, "LONG_WORD", 1)
    assert np.allclose(logs, pieces.log_likelihoods(vocabulary, model, known)) and np.allclose(uses, pieces.expected_counts(vocabulary, model[0], known, times))
    assert np.isfinite(pieces.log_likelihoods(vocabulary, model, ["▁" + "漢a" * 3000])).all()
    rows = [(k, "the old house", "en") for k in range(9)] + [(10 + k, f"l{k}", f"l{k:03}") for k in range(205)] + [(300, "½ ² Ⅷ 12", "en")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.count() == len(rows) and [r.lang_pred for r in got.filter("doc_id = 300").collect()] == ["und"]


def test_unknown_languages_go(spark):
    from pydoc_data.topics import topics

    r = random.Random(13)
    book = " ".join(" ".join(topics[k] for k in sorted(topics)).split()[:9000]).split()
    french = "le la les un une des et est dans pour que qui avec sur pas plus nous vous ils elle monde temps jour homme femme vie pays ville grand petit ancien nouveau toujours jamais aujourd'hui histoire français école président région".split()
    rows = [(k, " ".join(book[100 * k : 100 * k + 100]), "en") for k in range(90)] + [(100 + k, " ".join(r.choice(french) for _ in range(80)), "fr") for k in range(60)]
    turkish = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в духе братства."
    gibberish = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(80)) for _ in range(5)]
    odd = [(200 + k, t, None) for k, t in enumerate([turkish, russian, *gibberish])]
    kept = langid.recognised(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(map(tuple, kept)) == rows


def shingle_set(text):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows):
    """component of each id by all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingle_set(t))
    boss = {i: i for i in sets}

    def find_(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find_(a), find_(b)))
                boss[y] = x
    return {i: find_(i) for i in sets}


def test_near_duplicates(docs, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and minhash.near_duplicates(none).count() == 0
    want = classes([(i, t) for i, t, *_ in ROWS if i is not None])
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {*want.items()}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = minhash.deduplicated(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter([None, *{*want.values()}]) and kept[0].asDict().keys() == {*docs.columns}


def test_near_duplicate_chains_and_blocks(spark, monkeypatch):
    """A chain of small edits, where the ends are unlike, and a bucket that is compared in blocks."""
    rows, text = [], prose(100, 20).split()
    for i in range(60):
        rows.append((i * 3 % 61, " ".join(text)))
        text[rng.randrange(len(text))] = f"new{i}"
    shared = prose(60, 21)
    rows += [(100 + k, shared + " " + prose(50, 200 + k)) for k in range(60)]
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_near_duplicates_of_generated_copies(spark):
    """Recall and precision against all pairs."""
    pick, rows = random.Random(8), []
    for k in range(40):
        base = prose(pick.randint(6, 120), 5000 + k).split()
        for c in range(4):
            copy = list(base)
            for _ in range(pick.randint(0, 4)):
                copy[pick.randrange(len(copy))] = f"new{pick.randint(0, 9)}"
            rows.append((10 * k + c, " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.lower().split()]]
    least = {i: i for i, _ in rows}
    for _ in rows:
        for (a, _), s in zip(rows, sets, strict=True):
            for (b, _), t in zip(rows, sets, strict=True):
                if a // 10 == b // 10 and 100 * len(s & t) >= 75 * len(s | t):
                    least[a] = least[b] = min(least[a], least[b])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == least


def test_line_dedup(docs, none, spark):
    lines = [prose(6, 300 + k).replace("\n", " ") for k in range(12)]
    rows = [(1, "\n".join(lines[:6])), (2, "\n".join([lines[9], *lines[1:5], lines[8]])), (3, "\n".join([lines[7]] * 5)), (4, "\n".join(lines[:2])), (5, "\n".join(["x", "", *lines[2:5], "", "y"])), (6, "\n".join(lines[6:9] + lines[:6]))]
    got = {r.doc_id: r for r in winnow_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1]
    assert got[2].text == "\n".join([lines[9], lines[8]]) and (got[2].n_removed, got[2].n_runs) == (4, 1)
    assert got[3].text == lines[7] and got[5].text == "x\n\n\ny" and got[6].text == "\n".join(lines[6:9])
    odd = winnow_lines.dedup_lines(docs).collect()
    assert len(odd) == len(ROWS) and winnow_lines.dedup_lines(none).count() == 0
    assert next(r for r in odd if r.doc_id == 2).text is None


def lines_left(rows, window=3, long=50):
    """What brute force leaves of each document: a run of `window` lines or `long` words that stood before goes."""
    seen, left = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for size in range(1, window + 1):
            for k in range(len(lines) - size + 1):
                run = tuple(lines[k : k + size])
                if size == window or sum(len(words(x)) for x in run) >= long:
                    gone |= {*range(k, k + size)} if run in seen else set()
                    seen.add(run)
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return left


def test_line_dedup_of_frequent_lines(spark):
    r = random.Random(11)
    common, rare = ["Licence", "Yes.", "No."], [f"line {k}" for k in range(40)]
    runs = [[r.choice(rare), r.choice(common), r.choice(rare), r.choice(common)][: r.randint(3, 4)] for _ in range(12)]
    rows = [(i, "\n".join(x for _ in range(6) for x in (*r.choice(runs), r.choice(common), f"own {r.random()}"))) for i in range(60)]
    got = {x.doc_id: x.text for x in winnow_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_left(rows)


def test_line_dedup_of_long_lines(spark):
    one, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(49))
    two = [" ".join(f"{c}{k}" for k in range(25)) for c in "ab"]
    rows = [(1, f"{one}\nx\n{two[0]}\n{two[1]}\n{short}"), (2, one), (3, f"p\n{two[0]}\n{two[1]}\nq\n{one}\nr"), (4, "\n".join(two)), (5, short), (6, f"{two[1]}\n{two[0]}"), (7, f"{one}\n{one}")]
    got = {x.doc_id: x for x in winnow_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x.text for i, x in got.items()} == lines_left(rows) == {1: rows[0][1], 2: "", 3: "p\nq\nr", 4: "", 5: short, 6: rows[5][1], 7: ""}
    assert [(got[i].n_removed, got[i].n_runs) for i in (2, 3, 4, 7)] == [(1, 1), (3, 2), (2, 1), (2, 1)]


def test_picks_are_shared_by_equal_windows():
    for _ in range(50):
        h = np.array([rng.randrange(8) for _ in range(30)])
        p = winnow_lines.picks(h, 4)
        for k in range(len(h) - 3):
            least = min(h[k : k + 4])
            assert max(i for i in range(k, k + 4) if h[i] == least) in p


def test_chat(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "\\", "[\\[/INST]", "<s>[ROLE:user][INST]", "", "é\n\n", "a\\<s>", "\\\\[/INST]</s>"]
    for t in texts:
        for role in ("user", "assistant", "we]ird\\", "[ROLE:"):
            turn = chat.render(role, t)
            a, b = chat.loss_span(role, turn)
            assert chat.unescape(turn[a:b]) == (t if role == "assistant" else "")
            assert chat.parse(chat.render(role, t) + chat.render("user", "x")) == [(role, t, role == "assistant"), ("user", "x", False)]
    log = [(1, 1, 1, "start", "user", "he"), (1, 2, 1, "delta", None, "llo"), (1, 3, 2, "start", "assistant", None), (1, 4, 2, "delta", None, "bad"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "good"), (1, 7, 3, "edit", "user", "new"), (1, 7, 3, "edit", "user", "new"), (1, 8, 3, "other", None, "zz"), (2, 1, 1, "delta", None, "x"), (None, 1, 1, "start", "user", "y")]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    turns = chat.reconstruct(df).collect()
    read = {(r.conv_id, r.turn_no): chat.parse(r.rendered)[0][:2] for r in turns}
    assert read == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "new"), (2, 0): ("unknown", "x"), (None, 0): ("user", "y")}
    assert chat.digests(chat.reconstruct(df.limit(0))).count() == 0


def test_chat_digests(spark):
    rows = [(5, 1, "assistant", "b"), (5, 0, "user", None), (5, 2, "assistant", "ç</s>"), (5, 2, "assistant", "ç</s>"), (6, 0, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.reconstruct(chat.as_events(df))).collect()}
    turns = "user\n\nassistant\nb\nassistant\nç</s>\nassistant\nç</s>\n"
    loss = "bç</s>ç</s>"
    assert (got[5].n_turns, got[5].turns_sha256, got[5].loss_chars, got[5].loss_sha256) == (4, hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[6].n_turns, got[6].loss_chars) == (1, 0)
    many = [(k, t, ("user", "assistant")[t % 2], prose(6, 40 * k + t)) for k in range(8) for t in range(6)] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    log = chat.as_events(spark.createDataFrame(many, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    got = {r.conv_id: r for r in chat.digests(chat.reconstruct(log)).collect()}
    for conv in {r[0] for r in many}:
        own = [r for r in many if r[0] == conv]
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_quality(docs, none, spark):
    rows = [(k, prose(60, 500 + k)) for k in range(150)] + [(1000 + k, " ".join(x + "***" for x in prose(60, 700 + k).split())) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(df, labels).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id < 1000) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    odd = quality.quality(docs, labels.limit(0)).collect()
    assert len(odd) == len(ROWS) and {r.score for r in odd} == {0.5} and quality.quality(none, labels).count() == 0


def test_word_vectors(docs):
    index, tokens_of = quality.index_vectors().astype(int), quality.Tokens()
    want = np.zeros((quality.ROWS, quality.DIM))
    for _, text, *_ in ROWS:
        ids = tokens_of.ids(text)
        for i, a in enumerate(ids):
            for j in range(max(0, i - quality.NEAR), min(len(ids), i + quality.NEAR + 1)):
                if i != j:
                    want[a] += index[ids[j]]
    size = np.abs(want).sum()
    want -= np.abs(want).sum(1, keepdims=True) * want.sum(0) / size
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.abs(quality.word_vectors(docs) - want).max() < 1e-5


def test_calibration():
    """Noisy labels make an overtrained network too sure of itself; its temperature brings its scores near the truth."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 10))
    y = (draw.random(4000) < 1 / (1 + np.exp(-x[:, 0] - x[:, 1]))).astype(float)
    network = quality.Network(10).fit(x[:2000], y[:2000])
    score = network.score(x[2000:])
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(score[bins == b].mean() - y[2000:][bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    assert network.temperature > 1 and error < 0.06
    unsure = quality.Network(2)
    unsure.w2 *= 0
    clear = np.repeat([[2.0, 0.0], [-2.0, 0.0]], 500, 0)
    assert 0.25 <= quality.Network(2).fit(clear, (clear[:, 0] > 0).astype(float)).temperature < 1


def test_tokens(docs, none, spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted(tokens.encode_table(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i or 0))
    at = 0
    texts = defaultdict(Counter)
    for i, x, *_ in ROWS:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        texts[i][len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for r in got:
        assert r.start == at
        texts[r.doc_id][r.n_tokens, r.ids_crc32] -= 1
        at += r.n_tokens
    assert not any(any(c.values()) for c in texts.values())
    assert tokens.encode_table(none, path).count() == 0
    tokens.write(docs, f"{tmp_path}/t", path, shards=3)
    one = tokens.lookup(spark, f"{tmp_path}/t", [8]).collect()
    assert len(one) == 1 and t.decode(one[0].ids[:-1]) == "one two" and "PushedFilters: [In(doc_id" in tokens.lookup(spark, f"{tmp_path}/t", [8, 9])._jdf.queryExecution().toString()


def test_starts_are_places_in_the_file(spark):
    """Rows of one id lie in the order of their texts, whatever their lengths and checksums."""
    rows = [(5, "z"), (6, "q"), (5, "a b c d e f"), (5, "m n"), (None, "x y z"), (None, "b")]
    got = tokens.encode_table(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tokens.encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer.encode(t, add_special_tokens=False).ids, tokens.END_ID]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_have_indexes_and_bloom_filters(spark, tmp_path):
    rows = spark.createDataFrame([(3 * k, "a b") for k in range(5000)], "doc_id long, text string")
    tokens.write(rows, f"{tmp_path}/t", public_tokenizers.path("byte_bpe_50k.json"), shards=1)
    (part,) = [f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".orc")]
    orc, path = spark._jvm.org.apache.orc.OrcFile, spark._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/t/{part}")
    reader = orc.createReader(path, orc.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 1000
    kinds = [(x.getKind().toString(), x.getColumn()) for x in reader.rows().readStripeFooter(reader.getStripes()[0]).getStreamsList()]
    assert ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds and reader.getSchema().getFieldNames()[0] == "doc_id"
    assert [r.doc_id for r in tokens.lookup(spark, f"{tmp_path}/t", [9, 10]).collect()] == [9]


def test_chunked_encoding_is_the_librarys(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, library = tokens.encoder(path, 20), Tokenizer.from_file(path)
    library_ids = lambda x: np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    assert np.frombuffer(e("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    monkeypatch.setattr(tokens, "BLOCK", 30)
    some = []
    parts = [" ", "  ", "\n", "a", "b's", "é", "1", "!", "\t", " ", "　", " \n", "x", "<|endoftext|>", "\x1c", "日本"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert e(x) == library_ids(x)
        some.append(x)
    assert list(e.each(some)) == list(map(library_ids, some))


class Watched:
    """A tokenizer that counts the characters it is given as text."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode(self, text, **more):
        self.n += len(text)
        return self.tokenizer.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.n += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **more)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def test_new_words_are_not_pre_tokenized_again():
    """Words and signs go to the library's model as they are: its pre-tokenizer took most of the time."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = tokens.encoder.__wrapped__(path, 1000)
    e.tokenizer = Watched(e.tokenizer)
    word = lambda: "".join(rng.choice(["the", "ein", "ción", "ß", "Éa", "or", "qu"]) for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word() + rng.choice(["", ".", ",", "***", ".\nIn"]) for _ in range(200)) for _ in range(40)]
    assert list(e.each(texts)) == [np.array(e.tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.tokenizer.n * 20 < sum(map(len, texts))


@pytest.mark.parametrize("cache", [20, 5000])
def test_ids_of_many_texts_are_the_librarys(monkeypatch, cache):
    """Letters beside signs, line ends, apostrophes and letters of other scripts; few chunks kept, added tokens, long texts, small blocks."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    for name, n in {"TOGETHER": 200, "BLOCK": 90, "MARKS": 3, "LONGEST": 8}.items():
        monkeypatch.setattr(tokens, name, n)
    e = tokens.encoder.__wrapped__(path, cache)
    ids = lambda t: e.tokenizer.encode(t, add_special_tokens=False).ids
    bits = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "a", "Ä", "ß", "word", "'s", "'ll", "’s", ".", "***", "12", "_", "½", "ª", "ж", "日", "e\u0301", "\x85", "\xa0", "x" * 9, "<|endoftext|>", "<|endof"]
    for _ in range(400):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 12))]
        got = list(e.runs(pa.array(texts, pa.string())))
        want = [ids(t) for t in texts]
        assert np.concatenate([n for _, n in got]).tolist() == list(map(len, want))
        assert np.concatenate([x for x, _ in got]).tolist() == sum(want, [])
        assert len(e.kept) == len(e.ends) - 1 < 2 * cache + 400 and len(e.marks) <= 3
    assert list(e.runs(pa.array([], pa.string()))) == []


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(none).count() == 0
    size = defaultdict(int)
    for _, t, _, s in ROWS:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] >= 3 * size[s]}
        if not over:
            break
        full |= over
    for r in got:
        assert r.source_size == size[r.source] and np.isclose(r.target, 3 * size[r.source] if r.source in full else share[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.times * r.size
    out = Counter((r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    times = Counter()
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.size)), sorted(ROWS, key=lambda x: (str(x[0]), len(words(x[1])))), strict=True):
        times[i, t] += r.times
    assert +times == out


def test_thresholds_refine(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 4)
    rows = [(f"s{k % 3}", rng.getrandbits(60), rng.randint(0, 30)) for k in range(900)] + [("tie", 7, 5)] * 4
    goals = {"s0": 1234.0, "s1": 1.0, "s2": 4000.5, "tie": 11.0}
    df = spark.createDataFrame(rows, "source string, hash long, size long")
    got = {r.source: r.threshold for r in mixing.thresholds(df, spark.createDataFrame(list(goals.items()), "source string, budget double")).collect()}
    for s, goal in goals.items():
        own = [(h, n) for x, h, n in rows if x == s]
        sums = {t: sum(n for h, n in own if h < t) for t in [0, *(h + 1 for h, _ in own)]}
        assert abs(sum(n for h, n in own if h < got[s]) - goal) == min(abs(v - goal) for v in sums.values())


def test_suffix_arrays():
    r = np.random.default_rng(0)
    for trial in range(60):
        n, depth, k = int(r.integers(1, 300)), int(r.integers(8, 60)), int(r.integers(1, 4))
        t = r.integers(97, 97 + k, n).astype(np.uint8)
        t = np.concatenate([t, t[: n // 2], t]) if trial % 3 == 0 else t
        n, raw = len(t), bytes(t)
        order, group = suffix_array(t, depth)
        w = [(raw + b"\0" * depth)[i : i + depth] for i in range(n)]
        assert [w[i] for i in order] == sorted(w)
        shared = common_prefixes(t, order, group, depth)
        for a, b, c in zip(order, order[1:], shared[1:], strict=False):
            x, y = raw[a:][:depth], raw[b:][:depth]
            m = min(len(x), len(y))
            assert c == next((i for i in range(m) if x[i] != y[i]), m)
        own = np.array([i for i in order if i + depth <= n], np.int64)
        u = np.concatenate([t, r.integers(97, 97 + k, depth).astype(np.uint8)])
        starts = np.arange(len(u) - depth + 1)
        have = [raw[i : i + depth] for i in own]
        assert find(t, own, u, starts, depth).tolist() == [have.index(q) if (q := bytes(u)[s : s + depth]) in have else -1 for s in starts]


def removed(rows):
    raws = [(t or "").encode() for _, t in rows]
    c = Counter(r[k : k + 200] for r in raws for k in range(len(r) - 199))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        m = bytearray(len(r))
        for k in range(len(r) - 199):
            if c[r[k : k + 200]] > 1:
                m[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, x in zip(r, m, strict=True) if not x)
        out.append((i, len(r), sum(m), sum(bool(m[k]) and not (k and m[k - 1]) for k in range(len(m))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 1500}, {"most": 2}])
def test_repeats(spark, limits):
    shared = prose(100, 40)
    rows = [(k, prose(40, 800 + k) + " " + shared[k * 7 :] + prose(30, 900 + k)) for k in range(25)] + [(100, "ab" * 400), (101, "x" * 150 + "x" * 51), (102, "z" * 200), (103, shared), (103, shared), (None, shared[:250]), (104, None), (105, "q" * 5000 + shared + "q" * 300)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    assert sorted(map(tuple, got), key=str) == sorted(removed(rows), key=str)


def test_repeats_odd(docs, none):
    got = repeats.remove_repeats(docs).collect()
    small = [(i, t) for i, t, *_ in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(removed(small), key=str) and repeats.remove_repeats(none).count() == 0


def test_repeats_of_very_many_rows_that_are_one(spark):
    """Runs of equal rows are held once, however many rows there are."""
    text, other = prose(60, 91), prose(60, 92)
    rows = [(1, text)] * 1000 + [(k, text + other) for k in range(2, 5)] + [(9, other[:150])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    want = Counter(map(tuple, removed([(1, text)] * 2 + rows[1000:])))
    assert {tuple(r)[:5]: r["count"] for r in got} == {k: 1000 if k[0] == 1 else n for k, n in want.items()}


def edit_distance(pattern, text):
    row, best, at = list(range(len(pattern) + 1)), len(pattern), 0
    for j, c in enumerate(text):
        new = [0]
        for i, a in enumerate(pattern):
            new.append(min(row[i] + (a != c), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] < best:
            best, at = row[-1], j + 1
    return best, at


def test_decontamination(docs, none, spark):
    items, rows = [(k, prose(rng.randint(4, 25), 60 + k)) for k in range(12)] + [(50, "Short one"), (52, "  "), (51, None), (None, prose(12, 99)), (3, prose(12, 98))], []
    for k in range(40):
        quoted = list(rng.choice([t for _, t in items if t]))
        for _ in range(rng.randint(0, 8)):
            quoted[rng.randrange(len(quoted))] = rng.choice("aeé ")
        rows.append((k, prose(10) + " " + "".join(quoted).upper() + "\n" + prose(10)))
    rows += [(60, "a short one."), (61, "a short ones"), (62, "ashort one")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = set()
    for i, t in rows:
        best = {}
        for item, x in items:
            n = decontaminate.normal(x)
            if n and len(n) < decontaminate.SHORTEST:
                at = re.search(rf"(?<![^\W_]){re.escape(n)}(?![^\W_])", decontaminate.normal(t))
                if at:
                    best[item] = 0, at.end()
            elif n:
                d, at = edit_distance(n, decontaminate.normal(t))
                if d <= decontaminate.budget(len(n)):
                    best[item] = min(best.get(item, (d, at)), (d, at))
        want |= {(i, item, *v) for item, v in best.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (10**6, 100):
        assert {tuple(r) for r in decontaminate.contaminated(df, bench, chars).collect()} == want
    assert want and {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {i for i, _ in rows} - {i for i, *_ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.clean(docs, bench).count() == len(ROWS)
