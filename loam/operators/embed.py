"""Embedding of texts behind one small interface."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from ..config import BATCH, RETRIES

#: texts -> one vector for each, in order.
Embedder = Callable[[list[str]], list[list[float]]]


def _digest(gram: str) -> bytes:
    return hashlib.blake2b(gram.encode(), digest_size=8).digest()


class _Digests(dict):
    """The digests of words, worked out the first time that one is asked for."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        self[word] = d = _digest(word)
        return d


class HashedWords:
    """An embedder that needs no service: signed hashes of words and their neighbours, of length 1."""

    def __init__(self, dims: int = 64):
        self.dims, self._digests = dims, _Digests()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            words = t.lower().split()
            grams = [*map(self._digests.__getitem__, words), *map(_digest, map(" ".join, zip(words, words[1:], strict=False)))]
            h = np.frombuffer(b"".join(grams), "<u8")
            out[i] = np.bincount((h % np.uint64(self.dims)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), self.dims)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def in_batches(embedder: Embedder, texts: list[str], size: int = BATCH, retries: int = RETRIES, wait: float = 0.1, sleep=time.sleep) -> list[list[float]]:
    """Vectors of all texts, some at a time; a failed call is tried again after ever longer waits, and a reply of the
    wrong length is an error."""
    out: list[list[float]] = []
    for at in range(0, len(texts), size):
        some = texts[at : at + size]
        for n in range(retries):
            try:
                got = embedder(some)
                break
            except (OSError, TimeoutError):
                if n + 1 == retries:
                    raise
                sleep(wait * 2**n)
        if len(got) != len(some):
            raise ValueError(f"{len(some)} texts, {len(got)} vectors")
        out += got
    return out


def embedded(text: Column, embedder: Embedder) -> Column:
    """Vectors as array<float>, in Arrow batches; null for null."""

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = pd.Series([None] * len(s), dtype=object)
            some = s.notna().to_numpy().nonzero()[0]
            for i, v in zip(some, in_batches(embedder, s.iloc[some].tolist()), strict=True):
                out.iloc[i] = v
            yield out

    return run(text)
