"""English lexemes and lexical ranking.

The ranking is BM25 brought into 0 to 1, which stands in for the rank function of a text-search database; the
weights and the rule that either arm qualifies a chunk are the same. Lexemes are lower-cased words
without stop words, optionally stemmed by Porter's published rules.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# English stop words.
STOP_WORDS = tuple("a about above after again all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own s same she should so some such t than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split())
_STOPS = frozenset(STOP_WORDS)
K1, B = 1.2, 0.75


def words(c: Column) -> Column:
    """Words of a text in order, in lower case, without stop words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


_VOWELS = str.maketrans({chr(c): "v" if chr(c) in "aeiouy" else "c" for c in range(128)})


def _sounds(w: str) -> str:
    """v for each vowel, c for each consonant. A y after a consonant is a vowel; any other y is none. What a word's
    beginning has doesn't hang on its end."""
    if "y" in w:
        w = "".join("b" if c == "y" and (i == 0 or w[i - 1] in "aeiou") else c for i, c in enumerate(w))
    return w.translate(_VOWELS)


def _short(w: str, sounds: str) -> bool:
    return sounds[-3:] == "cvc" and w[-1] not in "wx"


# Porter's suffixes of steps 2, 3 and 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _by_last(table: str) -> dict[str, list[tuple[str, str]]]:
    """The suffixes that end in a letter with what takes their place, the longest first."""
    out: dict[str, list[tuple[str, str]]] = {}
    for end, _, new in sorted((x.partition(":") for x in table.split()), key=lambda x: -len(x[0])):
        out.setdefault(end[-1], []).append((end, new))
    return out


_SWAPPED, _CUT = (_by_last(STEP2), _by_last(STEP3)), _by_last(STEP4)


def stem(w: str) -> str:
    """Porter's algorithm (1980). How many runs of vowels are followed by consonants is the number of vc in the sounds."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    sounds = _sounds(w)
    if w.endswith("eed"):
        w = w[:-1] if "vc" in sounds[:-3] else w
    else:
        end = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if end and "v" in sounds[:-end]:
            w, sounds = w[:-end], sounds[:-end]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and sounds[-1] == "c":
                w = w if w[-1] in "lsz" else w[:-1]
            elif sounds.count("vc") == 1 and _short(w, sounds):
                w += "e"
    sounds = _sounds(w)
    if w.endswith("y") and "v" in sounds[:-1]:
        w = w[:-1] + "i"
        sounds = sounds[:-1] + "v"
    for table in _SWAPPED:
        for end, new in table.get(w[-1:], ()):
            if w.endswith(end):
                if "vc" in sounds[: -len(end)]:
                    w = w[: -len(end)] + new
                    sounds = _sounds(w)
                break
    for end, _ in _CUT.get(w[-1:], ()):
        if w.endswith(end):
            if sounds[: -len(end)].count("vc") > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w, sounds = w[: -len(end)], sounds[: -len(end)]
            break
    if w.endswith("e"):
        m = sounds[:-1].count("vc")
        if m > 1 or m == 1 and not _short(w[:-1], sounds[:-1]):
            w, sounds = w[:-1], sounds[:-1]
    return w[:-1] if w.endswith("ll") and sounds.count("vc") > 1 else w


@pandas_udf(ArrayType(StringType()))
def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    kept: dict[str, str] = {}
    for s in batches:
        if len(kept) > 200_000:
            kept.clear()
        yield s.map(lambda ws: None if ws is None else [kept.setdefault(w, "") or kept.__setitem__(w, stem(w)) or kept[w] for w in ws])


@pandas_udf(ArrayType(StructType().add("term", StringType()).add("tf", IntegerType())))
def _counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    kept: dict[str, str] = {}
    for words_, stems in batches:
        if len(kept) > 200_000:
            kept.clear()
        for ws in words_[stems]:
            kept.update((w, stem(w)) for w in {*(() if ws is None else ws)} - kept.keys())
        yield pd.Series([None if ws is None else [{"term": t, "tf": n} for t, n in Counter(kept[w] if s else w for w in ws).items()] for ws, s in zip(words_, stems, strict=True)])


def counted(c: Column, stems: bool = True) -> Column:
    """array<struct<term, tf>>: the different lexemes of a text, with how often it has each."""
    return _counted(words(c), F.lit(stems))


def spaced(c: Column) -> Column:
    """The words of a text as words() has them, stop words among them, as one string with spaces between."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")


class Lexemes(dict):
    """word -> the number of its lexeme in `terms`, or -1 for a stop word; asked for the first time, a word gets its number.
    kept: stems of words, held from one to the next."""

    def __init__(self, stems: bool, kept: dict[str, str]):
        self.stems, self.kept, self.terms, self._numbers = stems, kept, [], {}

    def __missing__(self, word: str) -> int:
        if word in _STOPS:
            self[word] = -1
            return -1
        term = word
        if self.stems:
            term = self.kept.get(word)
            if term is None:
                if len(self.kept) > 200_000:
                    self.kept.clear()
                term = self.kept[word] = stem(word)
        self[word] = n = self._numbers.setdefault(term, len(self._numbers))
        if n == len(self.terms):
            self.terms.append(term)
        return n


def lexemes(c: Column, stems: bool = True) -> Column:
    return stemmed(words(c)) if stems else words(c)


def matches_all(doc: Column, query: Column) -> Column:
    """Every lexeme of the query is in the document; a query without lexemes matches nothing."""
    return (F.size(query) > 0) & F.forall(query, lambda q: F.array_contains(doc, q))


def _is(term: str):
    return lambda w: w == term


def weight(n_docs: int, df: int) -> float:
    """How much a term counts that df of n_docs documents have."""
    return math.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def gain(tf: Column, length: Column, mean: float | None) -> Column:
    """What a term adds for each unit of its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


def bm25(docs: DataFrame, terms: list[str], lexeme_col: str = "lexemes", into: str = "lex") -> DataFrame:
    """docs with `into`: the BM25 score s of the terms as s / (1 + s). One pass counts what the score needs: the
    number of documents, their mean length and how many hold each term."""
    terms = sorted(set(terms))
    if not terms:
        return docs.withColumn(into, F.lit(0.0))
    held = [F.count_if(F.array_contains(lexeme_col, t)).alias(f"n{i}") for i, t in enumerate(terms)]
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(lexeme_col)).alias("mean"), *held).first()
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = F.size(F.filter(lexeme_col, _is(t))).cast("double")
        score = score + F.lit(weight(stats["n"], stats[f"n{i}"])) * gain(tf, F.size(lexeme_col), stats["mean"])
    return docs.withColumn(into, score / (1 + score))
