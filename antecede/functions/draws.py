"""Seeded draws that depend on keys alone, so retries and other partitionings give the same tables."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np

#: Bins of a value in [0, 1], the last one for 1; a bit for each bin's column.
BINS = 4096
#: Rows of this weight at most are drawn from tables; least total weight that is drawn so.
LIGHT, FEW = 16, 256
_WORD = 1 << 16


def stream(*keys: int) -> np.random.Generator:
    """The random numbers of a tuple of integers."""
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([k & 0xFFFFFFFFFFFFFFFF for k in keys])))


class Streams:
    """One generator, set to the stream of a key: as stream(), without the making."""

    def __init__(self, seed: int):
        self.seed, self.bits = seed & 0xFFFFFFFFFFFFFFFF, np.random.PCG64(0)
        self.rng = np.random.Generator(self.bits)

    def of(self, key: int) -> np.random.Generator:
        x = hashlib.blake2b((key & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") + self.seed.to_bytes(8, "little"), digest_size=32).digest()
        state = {"state": int.from_bytes(x[:16], "little"), "inc": int.from_bytes(x[16:], "little") | 1}
        self.bits.state = {"bit_generator": "PCG64", "state": state, "has_uint32": 0, "uinteger": 0}
        return self.rng


def beta(rng: np.random.Generator, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """rows x len(a) draws from Beta(a, b) for counts; (0, b) is 0, (a, 0) is 1, (0, 0) undefined."""
    out = rng.beta(np.maximum(a, 1), np.maximum(b, 1), (rows, len(a)))
    out[:, a == 0] = 0.0
    out[:, b == 0] = 1.0
    out[:, (a == 0) & (b == 0)] = np.nan
    return out


def short(rng: np.random.Generator, *shape: int) -> np.ndarray:
    """Random 16-bit numbers."""
    n = int(np.prod(shape))
    return np.asarray(rng.bit_generator.random_raw(-(-n // 4)), np.uint64).view(np.uint16)[:n].reshape(shape)


class Binned:
    """min(1, c * X) for X from Beta(a, b), drawn as the bin it falls into (place(); BINS - 1: it is 1); inside a bin, where two values
    must be told apart, by within(). A bin is drawn by the alias method: a column of equal chance, of which one part is the
    column's own bin and the rest another. Bins' chances are integrals by eight nodes each, exact to rounding for whole a, b
    of at most the bins that c stretches over."""

    def __init__(self, a: float, b: float, c: float):
        self.a, self.b, self.c = a, b, c
        edges = np.minimum(np.arange(BINS) / (BINS - 1) / c, 1.0)
        rest = np.linspace(edges[-1], 1.0, 513)
        mass = np.concatenate([self._mass(edges), [self._mass(rest).sum()]])
        self.own, self.other = _alias(mass / mass.sum())
        self.least = np.minimum(self.own.astype(np.int64), _WORD - 1).astype(np.uint16)
        self.part = self.own - self.least

    def _mass(self, edges: np.ndarray) -> np.ndarray:
        node, weight = np.polynomial.legendre.leggauss(8)
        half = np.diff(edges)[:, None] / 2
        return (np.exp(_log_beta(self.a, self.b, edges[:-1, None] + half * (node + 1))) * weight * half).sum(1)

    def place(self, rng: np.random.Generator, column: np.ndarray, coin: np.ndarray) -> np.ndarray:
        """Bins, from random columns and 16-bit coins; a coin that falls on the border is thrown again."""
        at = column.astype(np.intp)
        least, out = self.least.take(at), self.other.take(at)
        own = coin < least
        if (border := coin == least).any():
            for k in np.flatnonzero(border).tolist():
                own[k] = rng.random() < self.part[column[k]]
        np.copyto(out, column, where=own)
        return out


def _log_beta(a: np.ndarray | float, b: np.ndarray | float, x: np.ndarray) -> np.ndarray:
    """Logarithm of the density of Beta(a, b), a, b >= 1, without its constant: 0 at its peak."""
    top = np.where(a + b > 2, (a - 1) / np.maximum(a + b - 2, 1), 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = (a - 1) * (np.log(x) - np.log(top)), (b - 1) * (np.log1p(-x) - np.log1p(-top))
    return np.where(a > 1, left, 0.0) + np.where(b > 1, right, 0.0)


def within(a: np.ndarray, b: np.ndarray, c: np.ndarray, places: np.ndarray, tries: np.ndarray) -> tuple[np.ndarray, int]:
    """Values of min(1, c * X) given their bins, by rejection against the density's most in the bin, and how many the tries (pairs of
    uniform numbers, 2 x tries x values) leave open (nan)."""
    low = places / (BINS - 1) / c
    wide = np.minimum(1 / (BINS - 1) / c, 1 - low)
    most = _log_beta(a, b, np.clip(np.where(a + b > 2, (a - 1) / np.maximum(a + b - 2, 1), 0.5), low, low + wide))
    out = np.where(places < BINS - 1, np.nan, 1.0)
    for at, coin in zip(*tries, strict=True):
        left = np.flatnonzero(np.isnan(out))
        if not len(left):
            break
        x = low[left] + at[left] * wide[left]
        with np.errstate(divide="ignore"):
            taken = np.log(coin[left]) <= _log_beta(a[left], b[left], x) - most[left]
        out[left[taken]] = c[left[taken]] * x[taken]
    return out, int(np.isnan(out).sum())


def _alias(chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column 65536 times its own part, and the bin of the rest."""
    own, other = (chance * len(chance)).tolist(), list(range(len(chance)))
    small, large = [k for k, x in enumerate(own) if x < 1], [k for k, x in enumerate(own) if x >= 1]
    while small and large:
        k, at = small.pop(), large[-1]
        other[k] = at
        own[at] -= 1 - own[k]
        if own[at] < 1:
            small.append(large.pop())
    for k in small + large:  # 1 but for rounding
        own[k] = 1.0
    return np.array(own) * _WORD, np.array(other, np.uint16)


@functools.lru_cache(1024)
def binned(a: float, b: float, c: float) -> Binned:
    return Binned(a, b, c)


@functools.lru_cache(256)
def _poisson(mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Poisson numbers by 16 random bits (the largest number: these bits do not tell), and the cumulated chances."""
    term = [np.exp(-mean)]
    while len(term) < 4 * mean + 40:
        term.append(term[-1] * mean / len(term))
    until = np.cumsum(term)
    low, high = (np.searchsorted(until, (np.arange(_WORD) + k) / _WORD, "right") for k in (0, 1))
    return np.where(low == high, low, _WORD - 1).astype(np.uint16), until


def poisson(rng: np.random.Generator, mean: float, rows: int, columns: int) -> np.ndarray:
    table, until = _poisson(mean)
    bits = short(rng, rows * columns)
    out = table.take(bits)
    at = np.flatnonzero(out == _WORD - 1)
    out[at] = np.searchsorted(until, (bits[at] + rng.random(len(at))) / _WORD, "right")
    return out.reshape(rows, columns)


def multinomial(rng: np.random.Generator, draws: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each row is drawn (rows x replicates), draws[k] in replicate k, with chances in proportion to whole weights.

    Heavy rows: binomials, one after the other. Light ones: Poisson numbers of a mean a little below the one expected are, given
    their sum, multinomial; what the sum lacks is drawn one by one. A replicate whose sum is too large is drawn anew."""
    light = weight <= LIGHT
    total, rows = int(weight.sum()), np.flatnonzero(light)
    if not light.all():
        heavy = np.flatnonzero(~light)
        theirs = rng.binomial(draws, weight[heavy].sum() / total)
        out = np.zeros((len(weight), len(draws)), np.int64)
        out[heavy] = rng.multinomial(theirs, weight[heavy] / weight[heavy].sum()).T
        if len(rows):
            out[rows] = multinomial(rng, draws - theirs, weight[rows])
        return out
    unit = np.repeat(np.arange(len(weight)), weight)
    share = max(0.0, np.floor(64 * (1 - 6 / max(total, 1) ** 0.5)) / 64) if total >= FEW else 0.0  # of few values: their tables are kept
    out = np.zeros((len(weight), len(draws)), np.uint16)
    lack = draws.astype(np.int64)
    if share:
        todo = np.arange(len(draws))
        while len(todo):
            for w in np.unique(weight).tolist():
                here = np.flatnonzero(weight == w)
                numbers = poisson(rng, w * share, len(here), len(todo))
                if len(here) == len(weight) and len(todo) == len(draws):
                    out = numbers
                else:
                    out[np.ix_(here, todo)] = numbers
            lack[todo] = draws[todo] - out[:, todo].sum(0, dtype=np.int64)
            todo = todo[lack[todo] < 0]
    picked = unit[rng.integers(0, total, lack.sum())]
    more = np.bincount(picked * len(draws) + np.repeat(np.arange(len(draws)), lack), minlength=out.size)
    return np.add(out, more.reshape(out.shape), out=out, casting="unsafe")


class Split:
    """Bootstrap draws by halving: the draws of a round are dealt to the two halves of the buckets by a binomial in proportion to
    their samples, each half's to its halves, and so on. Jointly the buckets' draws are multinomial, yet a bucket needs only
    the counts: each node's draws come from the node's own stream, so every task finds the same ones.

    counts: buckets (a power of two) x rounds, how many samples."""

    def __init__(self, counts: np.ndarray, replicates: int, seed: int):
        self.levels = [counts]
        while len(self.levels[0]) > 1:
            self.levels.insert(0, self.levels[0].reshape(len(self.levels[0]) // 2, 2, -1).sum(1))
        self.replicates, self.seed, self.known = replicates, seed, {}

    def draws(self, level: int, node: int, it: int) -> np.ndarray:
        """Of each replicate, those of a node of a level."""
        if level == 0:
            return np.full(self.replicates, self.levels[0][0, it])
        if (level, node, it) not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            above, left, right = self.draws(level - 1, node // 2, it), self.levels[level][node & ~1, it], self.levels[level][node | 1, it]
            share = stream(self.seed, it, level, node // 2).binomial(above, left / max(left + right, 1))
            self.known[level, node & ~1, it], self.known[level, node | 1, it] = share, above - share
        return self.known[level, node, it]

    def rounds(self, bucket: int, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each round: its number, the bucket's rows in it and their multiplicities (rows x replicates). weight: rows x rounds,
        how many samples a row stands for, in an order that does not depend on partitions."""
        last = len(self.levels) - 1
        for it in np.flatnonzero(weight.any(0)).tolist():
            inside = np.flatnonzero(weight[:, it])
            yield it, inside, multinomial(stream(self.seed, it, last + 1, bucket), self.draws(last, bucket, it), weight[inside, it].astype(np.int64))

    def multiplicities(self, bucket: int, member: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As rounds() for samples of their own, multiplicities as replicates x samples. member: samples x rounds."""
        for it, inside, many in self.rounds(bucket, member):
            yield it, inside, many.T.astype(np.int64)
