"""Language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. A language is a probability for each piece; the
probability of a word is the sum, by a forward pass, over all the ways in which pieces make it up, and
that of a text the product over its words. The probabilities are learned by expectation maximisation: a
forward-backward pass over the distinct words of each partition gives the expected uses of each piece, and
only those are summed across partitions, so what is shuffled and what the driver holds is bounded by
languages times pieces, while every training text counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucket, giving_back
from .pieces import expected_counts, log_likelihoods, vocabulary

ROUNDS, SMOOTHING = 2, 0.01
#: The evidence of a text counts as that of so many characters, so that scores of long texts don't all end at 1.
EVIDENCE = 50
UNKNOWN = "und"
#: Below this score a document's language is not recognised.
LEAST_SCORE = 0.5
#: Nor is it if a character's log-likelihood is by so much below that of the language's training texts.
MOST_BELOW = 2.0
#: Distinct words that a task holds before it passes them on, and characters that are cut into words at once.
HELD, BLOCK = 200_000, 1_000_000
_RUN, _GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def words(text: str | None) -> Iterator[list[str]]:
    """The words of a whole text, in lists of bounded size: runs of letters in lower case. (Other signs that count as
    word characters, such as fractions, are no letters.)"""
    text, at = text or "", 0
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        end = gap.end() if gap else len(text)
        found = _RUN.findall(text[at:end].lower())
        if found and not "".join(found).isalpha():
            found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
        yield found
        at = end


def spelled(found: Iterable[str]) -> list[str]:
    """Words as the vocabulary spells them."""
    return ["▁" + w for w in found]


def _by_language(batches, languages: list[str], add) -> None:
    """Call add(language number, words, times) with what the words of all texts come to."""
    held = {lang: Counter() for lang in languages}

    def flush():
        for k, lang in enumerate(languages):
            if held[lang]:
                add(k, spelled(held[lang]), np.array(list(held[lang].values()), float))
            held[lang].clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for found in words(text.as_py()):
                held[lang].update(found)
            if sum(map(len, held.values())) > HELD:
                flush()
    flush()


def _expected(model_file: str, languages: list[str], model: np.ndarray):
    def run(batches):
        pieces = vocabulary(model_file)
        sums = np.zeros((len(languages), pieces.size + 1))

        def add(k, known, times):
            sums[k] += expected_counts(pieces, model[k], known, times)

        _by_language(batches, languages, add)
        lang, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[lang, piece])], ["lang_no", "piece", "uses"])

    return run


def _fitted(model_file: str, languages: list[str], model: np.ndarray):
    def run(batches):
        sums = np.zeros((2, len(languages)))

        def add(k, known, times):
            logs = log_likelihoods(vocabulary(model_file), model[k : k + 1], known)[:, 0]
            sums[:, k] += (logs * times).sum(), (np.array([len(w) for w in known]) * times).sum()

        _by_language(batches, languages, add)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages)), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], ["lang_no", "log", "chars"])

    return run


def floors(docs: DataFrame, model_file: str, languages: list[str], model: np.ndarray, below: float = MOST_BELOW) -> np.ndarray:
    """What log-likelihood per character a text of each language has at least: that of all training texts, less
    `below`. docs as in train()."""
    if not languages:
        return np.zeros(0)
    labelled = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = labelled.mapInArrow(giving_back(_fitted(model_file, languages, model)), "lang_no int, log double, chars double").groupBy("lang_no").agg(F.sum("log").alias("log"), F.sum("chars").alias("chars")).toPandas()
    out = np.full(len(languages), -np.inf)
    rows = rows[rows.chars > 0]
    out[rows.lang_no] = np.round(rows.log / rows.chars, 6) - below
    return out


def train(docs: DataFrame, model_file: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """docs with text, lang -> (languages, (languages, pieces + 1) probabilities). Rows without a lang are
    left out; languages in order of code point. Without any there are no languages. The driver and each task hold eight
    bytes for each language and piece (a quarter of a megabyte a language)."""
    labelled = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    size = vocabulary(model_file).size + 1
    model = np.full((len(languages), size), 1 / size)
    for _ in range(rounds if languages else 0):
        uses = labelled.mapInArrow(giving_back(_expected(model_file, languages, model)), "lang_no int, piece int, uses double")
        rows = uses.groupBy("lang_no", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        sums = np.zeros((len(languages), size))
        sums[rows.lang_no, rows.piece] = rows.uses
        # sums of doubles depend on their order in the last digits; rounding keeps reruns alike
        sums = np.round(sums, 6) + SMOOTHING
        model = sums / sums.sum(1, keepdims=True)
    return languages, model


def _predict(model_file: str, languages: list[str], model: np.ndarray, keep: list[str], least: np.ndarray | None = None):
    def run(batches):
        pieces = vocabulary(model_file)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                number: dict[str, int] = {}
                counted, start = [], at
                while at < batch.num_rows and len(number) <= HELD // 2:
                    found: Counter = Counter()
                    for some in words(batch.column("text")[at].as_py()):
                        found.update(some)
                    counted.append((np.array([number.setdefault(w, len(number)) for w in found], int), np.array(list(found.values()))))
                    at += 1
                known = spelled(number)
                logs = log_likelihoods(pieces, model, known) if known else np.zeros((0, len(languages)))
                sizes = np.array([len(w) for w in known])
                lang, score = [], []
                for ids, times in counted:
                    if not len(ids) or not languages:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    total, n_chars = times @ logs[ids], times @ sizes[ids]
                    each = total * min(1.0, EVIDENCE / n_chars)
                    best = int(each.argmax())
                    if least is not None and total[best] < least[best] * n_chars:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    lang.append(languages[best])
                    score.append(float(1 / np.exp(each - each[best]).sum()))
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model_file: str, languages: list[str], model: np.ndarray) -> DataFrame:
    """docs with doc_id, text -> doc_id, lang_pred, score, a row for each of docs.

    lang_pred is `und` and score 0 if the text is null or has no letter, or no language was learned; score is the
    share of the best language in the evidence. Repeated rows and null ids keep a row each; extra columns are
    ignored; no rows give no rows. A text is read whole."""
    return docs.select("doc_id", "text").mapInArrow(giving_back(_predict(model_file, languages, model, ["doc_id"])), "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model_file: str, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is recognised: not `und`, with a score of `least` or more among the
    languages learned, and with characters not much less likely than those that its language was learned from. A row
    that names no lang gets the one predicted."""
    learned = docs.filter(bucket(F.col("doc_id"), 3) != 1)
    languages, model = train(learned, model_file)
    floor = floors(learned, model_file, languages, model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = StructType([docs.schema[c] for c in names]).add("lang_pred", "string").add("score", "double")
    found = docs.select(*names).mapInArrow(giving_back(_predict(model_file, languages, model, names, floor)), schema)
    found = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*names)


def identify(docs: DataFrame, model_file: str) -> DataFrame:
    """Train on two thirds of docs by id and predict all: doc_id, held_out, lang_pred, score."""
    held = bucket(F.col("doc_id"), 3) == 1
    found = predict(docs, model_file, *train(docs.filter(~held), model_file))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
