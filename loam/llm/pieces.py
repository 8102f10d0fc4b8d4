"""A fixed vocabulary of text pieces, found by hash in numpy, and sums over all segmentations of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C55)
_SPREAD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SLOTS = 20
#: Words of more characters are segmented one by one, without arrays over all their places.
LONG_WORD = 64
#: A sum below this is raised by a power of two, so that no run of rare characters, however long, ends at 0.
TINY = 2.0**-200
#: Words segmented at once, for one language.
BLOCK = 8192


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Pieces:
    return Pieces(model)


class Pieces:
    """Piece numbers 0 to size - 1; `size` itself stands for a character that no piece covers."""

    def __init__(self, model: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.size = len(names)
        self.numbers = {name: i for i, name in enumerate(names)}
        self.longest = max(map(len, names))
        powers = np.ones(self.longest + 1, np.uint64)
        for k in range(self.longest):
            powers[k + 1 : k + 2] = powers[k : k + 1] * _BASE
        self.powers = powers
        keys = np.zeros(self.size, np.uint64)
        for i, name in enumerate(names):
            for c in name:
                keys[i : i + 1] = keys[i : i + 1] * _BASE + np.uint64(ord(c) + 1)
        #: Two tables of slots: a piece stands in the first, or in the second if its slot there was taken.
        self.slots = np.full((2, 1 << _SLOTS), -1, np.int32)
        rest = np.arange(self.size)
        for table, spread in enumerate(_SPREAD):
            at = (keys[rest] * spread) >> np.uint64(64 - _SLOTS)
            _, own = np.unique(at, return_index=True)
            self.slots[table, at[own]] = rest[own]
            rest = np.delete(rest, own)
        if len(rest):
            raise ValueError(f"{len(rest)} pieces found no slot")
        self.keys = np.append(keys, np.uint64(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of the strings with these keys; -1 where there is none."""
        out = np.full(keys.shape, -1, np.int32)
        for table, spread in enumerate(_SPREAD):
            got = self.slots[table, (keys * spread) >> np.uint64(64 - _SLOTS)]
            np.copyto(out, got, where=(got >= 0) & (self.keys[got] == keys))
        return out

    def lattices(self, words: list[str], block: int = BLOCK):
        """(rows, edges) for blocks of words of one length; edges[j] lists (i, pieces of words[i:j])."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) <= LONG_WORD:
                by.setdefault(len(w), []).append(k)
        for n, rows in by.items():
            for at in range(0, len(rows), block):
                some = rows[at : at + block]
                codes = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), n)
                prefix = np.zeros((n + 1, len(some)), np.uint64)
                for k in range(n):
                    prefix[k + 1] = prefix[k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
                edges = [[]]
                for j in range(1, n + 1):
                    here = []
                    for i in range(max(0, j - self.longest), j):
                        found = self.find(prefix[j] - prefix[i] * self.powers[j - i])
                        if i == j - 1:
                            found[found < 0] = self.size
                        elif (found < 0).all():
                            continue
                        here.append((i, found))
                    edges.append(here)
                yield np.array(some), edges

    def ending_at(self, word: str, j: int) -> list[tuple[int, int]]:
        """(i, piece) of the pieces that make up word[i:j]; a character that none covers counts as one."""
        out = [(i, p) for i in range(max(0, j - self.longest), j) if (p := self.numbers.get(word[i:j])) is not None]
        return out if out and out[-1][0] == j - 1 else [*out, (j - 1, self.size)]


def _forward(pieces: Pieces, model: np.ndarray, word: str):
    """For each place of a word, the sums over all segmentations up to it for each row of model, and the power of two
    that they are too large by."""
    last, power = [np.ones(len(model))], [0]
    yield last[0], 0
    for j in range(1, len(word) + 1):
        total = np.zeros(len(model))
        for i, p in pieces.ending_at(word, j):
            total += last[i - j] * model[:, p] * 2.0 ** (power[-1] - power[i - j])
        step = max(0, -int(np.floor(np.log2(total.max())))) if total.max() < TINY else 0
        last = [*last[1 - pieces.longest :], total * 2.0**step]
        power = [*power[1 - pieces.longest :], power[-1] + step]
        yield last[-1], power[-1]


def _raised(total: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """total, brought up where it is below TINY, and the powers of two by which it is too large now."""
    low = total < TINY
    if not low.any():
        return total, power
    step = np.where(low, -np.floor(np.log2(total)), 0.0)
    return total * np.exp2(step), power + step


def log_likelihoods(pieces: Pieces, model: np.ndarray, words: list[str]) -> np.ndarray:
    """(len(words), languages): log of the summed probability of all segmentations of each word.
    model: (languages, pieces.size + 1) probabilities."""
    out = np.empty((len(words), len(model)))
    padded = np.append(model, np.zeros((len(model), 1)), 1)
    for rows, edges in pieces.lattices(words, max(256, BLOCK // max(1, len(model) // 4))):
        alpha, power = [np.ones((len(model), len(rows)))], [np.zeros((len(model), len(rows)))]
        for j in range(1, len(edges)):
            total = np.zeros((len(model), len(rows)))
            for i, found in edges[j]:
                part = alpha[i] * padded[:, found]
                total += part if power[i] is power[-1] else part * np.exp2(power[-1] - power[i])
            for held, x in zip((alpha, power), _raised(total, power[-1]), strict=True):
                held.append(x)
        out[rows] = (np.log(alpha[-1]) - power[-1] * np.log(2)).T
    for k, w in enumerate(words):
        if len(w) > LONG_WORD:
            # each language by itself: what is common to none of them must not underflow beside a likelier one
            for lang in range(len(model)):
                for total, power in _forward(pieces, model[lang : lang + 1], w):
                    pass
                out[k, lang] = np.log(total[0]) - power * np.log(2)
    return out


def expected_counts(pieces: Pieces, model: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of words weighted by their probabilities under
    model (one language) and by times."""
    counts = np.zeros(pieces.size + 2)
    padded = np.append(model, 0.0)
    for rows, edges in pieces.lattices(words):
        n = len(edges) - 1
        weights, alpha, power = [[]], [np.ones(len(rows))], [np.zeros(len(rows))]
        for j in range(1, n + 1):
            here = [(i, found, padded[found]) for i, found in edges[j]]
            here = [(i, found, p if power[i] is power[-1] else p * np.exp2(power[-1] - power[i])) for i, found, p in here]
            total, now = _raised(sum(alpha[i] * p for i, _, p in here), power[-1])
            # a weight bears the powers between its ends, so that those along any segmentation come to the same
            weights.append(here if now is power[-1] else [(i, found, p * np.exp2(now - power[-1])) for i, found, p in here])
            alpha.append(total)
            power.append(now)
        beta = [np.zeros(len(rows)) for _ in range(n)] + [times[rows] / alpha[n]]
        for j in range(n, 0, -1):
            for i, found, p in weights[j]:
                use = p * beta[j]
                counts += np.bincount(found + 1, alpha[i] * use, pieces.size + 2)
                beta[i] += use
    for k, w in enumerate(words):
        if len(w) > LONG_WORD:
            _long_counts(pieces, model, w, times[k], counts)
    return counts[1:]


def _long_counts(pieces: Pieces, model: np.ndarray, word: str, times: float, counts: np.ndarray) -> None:
    """Add the expected uses of one long word: two numbers are kept for each of its places."""
    forward = [(float(total[0]), power) for total, power in _forward(pieces, model[None], word)]
    beta = np.zeros(len(word) + 1)
    beta[-1] = times / forward[-1][0]
    for j in range(len(word), 0, -1):
        for i, p in pieces.ending_at(word, j):
            use = model[p] * 2.0 ** (forward[j][1] - forward[i][1]) * beta[j]
            counts[p + 1] += forward[i][0] * use
            beta[i] += use
