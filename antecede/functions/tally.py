"""Counts of arcs by round and replicate within one task, and the order of mutations that gives them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of a dense table at most; distinct cells of a sparse one before it is given out.
DENSE, SPARSE = 1 << 23, 1 << 21
#: Replicates of a row.
WIDTH = 25


class Tally:
    """Sums over (round, replicate, parent, child), given out as rows of WIDTH replicates each."""

    def __init__(self, rounds: int, replicates: int, genes: int):
        self.rounds, self.replicates, self.genes = rounds, replicates, genes
        self.cells = rounds * replicates * genes * genes
        self.dense = np.zeros(self.cells, np.int64) if self.cells <= DENSE else None
        self.codes, self.counts, self.pending = [], [], 0

    def add(self, cell: np.ndarray, parent: np.ndarray, child: np.ndarray, weight: np.ndarray | None = None) -> None:
        """cell: round * replicates + replicate."""
        code = (cell * self.genes + parent) * self.genes + child
        if self.dense is not None:
            np.add.at(self.dense, code, 1 if weight is None else weight)
            return
        code, back = np.unique(code, return_inverse=True)
        self.codes.append(code)
        self.counts.append(np.bincount(back, weight, len(code)).astype(np.int64))
        self.pending += len(code)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, back = np.unique(np.concatenate(self.codes), return_inverse=True)
        return code, np.bincount(back, np.concatenate(self.counts), len(code)).astype(np.int64)

    def full(self) -> bool:
        """Whether a sparse tally should be given out; what repeats is merged first."""
        if self.dense is not None or self.pending <= 2 * SPARSE:
            return False
        code, count = self._merged()
        self.codes, self.counts, self.pending = [code], [count], len(code)
        return len(code) > SPARSE

    def rows(self) -> Iterator[dict[str, np.ndarray]]:
        """round, block, parent, child and weights (rows x WIDTH), and starts anew."""
        if self.dense is not None:
            code = np.flatnonzero(self.dense)
            count = self.dense[code]
            self.dense[code] = 0
        else:
            code, count = self._merged()
            self.codes, self.counts, self.pending = [], [], 0
        square = self.genes * self.genes
        cell, pair = code // square, code % square
        it, rep = cell // self.replicates, cell % self.replicates
        blocks = -(-self.replicates // WIDTH)
        key, row = np.unique((it * blocks + rep // WIDTH) * square + pair, return_inverse=True)
        for lo in range(0, len(key), 1 << 16):
            here = (row >= lo) & (row < lo + (1 << 16)) if len(key) > 1 << 16 else slice(None)
            part = key[lo : lo + (1 << 16)]
            weights = np.zeros((len(part), WIDTH), np.int64)
            weights[row[here] - lo, rep[here] % WIDTH] = count[here]
            block, pair_ = part // square, part % square
            yield {"iter": block // blocks, "block": block % blocks, "parent": pair_ // self.genes, "child": pair_ % self.genes, "weights": weights}


class Weights:
    """Sums over (round, replicate) of each arc, for tasks whose samples have a number in most cells; given out as Tally does. Cells
    are added up in bytes first."""

    def __init__(self, rounds: int, replicates: int, genes: int):
        self.shape, self.genes = (rounds, replicates), genes
        self.sums, self.bytes, self.held = {}, {}, {}

    def _of(self, code: int) -> np.ndarray:
        if code not in self.sums:
            self.sums[code] = np.zeros(self.shape, np.int64)
        return self.sums[code]

    def add(self, code: int, at, weight: np.ndarray) -> None:
        """weight: replicates of the rounds at (their numbers or a slice). code: parent * genes + child."""
        self._of(code)[at] += weight

    def mark(self, codes: list[tuple[int, np.ndarray]]) -> None:
        """As add() for booleans in all cells."""
        for code, there in codes:
            if self.held.get(code, 255) == 255:
                self._settle(code)
            held = self.bytes[code]
            np.add(held, there, out=held)
            self.held[code] += 1

    def _settle(self, code: int) -> None:
        if code in self.bytes:
            self._of(code)[...] += self.bytes[code]
            self.bytes[code][...] = 0
        else:
            self.bytes[code] = np.zeros(self.shape, np.uint8)
        self.held[code] = 0

    def full(self) -> bool:
        return (len(self.sums) + len(self.bytes)) * self.shape[0] * self.shape[1] > DENSE * 2

    def rows(self) -> Iterator[dict[str, np.ndarray]]:
        for code in list(self.bytes):
            self._settle(code)
        rounds, replicates = self.shape
        blocks = -(-replicates // WIDTH)
        for code, sums in self.sums.items():
            whole = np.zeros((rounds, blocks * WIDTH), np.int64)
            whole[:, :replicates] = sums
            whole = whole.reshape(-1, WIDTH)
            key = np.flatnonzero(whole.any(1))
            same = np.full(len(key), code)
            yield {"iter": key // blocks, "block": key % blocks, "parent": same // self.genes, "child": same % self.genes, "weights": whole[key]}
        self.sums, self.bytes, self.held = {}, {}, {}


def between_tiers(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """D1 and D2 (tiers) of one sample in many cells (mutations x cells, all above 0): parents x children x cells, whether there is an
    arc: the child has as many above it as the parent has at its height or above. Also: mutations x cells, how many are equal."""
    k = len(value)
    above = (value[:, None] > value[None]).view(np.uint8)
    wins, losses = above.sum(1, dtype=np.uint8), above.sum(0, dtype=np.uint8)
    return losses[None] == (k - wins)[:, None], (k - 1) - wins - losses


def ordered_arcs(gene: np.ndarray, ccf: np.ndarray, mode: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """D1 and D2 of many samples of k mutations each (rows x k, genes ascending): rows, parents, children and weights (None: 1 each).
    Undefined and zero ccfs are unobserved."""
    ccf = np.where(ccf > 0, ccf, 0.0)
    order = np.argsort(-ccf, axis=1, kind="stable")
    ccf, gene = np.take_along_axis(ccf, order, 1), np.take_along_axis(gene, order, 1)
    seen = ccf > 0
    tier = np.zeros(ccf.shape, np.int32)
    np.cumsum(ccf[:, 1:] != ccf[:, :-1], axis=1, out=tier[:, 1:])
    k = ccf.shape[1]
    if mode == "tiers":
        for a in range(k - 1):
            for b in range(a + 1, k):
                row = np.flatnonzero((tier[:, b] == tier[:, a] + 1) & seen[:, b])
                if len(row):
                    yield row, gene[row, a], gene[row, b], None
        return
    if mode != "compat":
        raise ValueError(mode)
    size = np.stack([((tier == t) & seen).sum(1) for t in range(k)], 1)
    for j in range(k - 1):  # the gene at position j to the next, by the sizes of tiers j and j + 1
        row = np.flatnonzero(size[:, j + 1] > 0)
        if len(row):
            yield row, gene[row, j], gene[row, j + 1], size[row, j] * size[row, j + 1]
