"""The solver against all rankings of small graphs, and the hand-made cases."""

import itertools
from collections import Counter

import numpy as np
import pytest

from antecede.functions import agony, draws, tally
from antecede.functions.tally import ordered_arcs


def brute(n, u, v, w):
    best, ranks = None, []
    for r in itertools.product(range(n), repeat=n):
        r = np.array(r)
        score = agony.agony(u, v, w, r)
        if best is None or score < best:
            best, ranks = score, [r]
        elif score == best:
            ranks.append(r)
    return best, np.min(ranks, axis=0)


def test_against_all_rankings():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, m = rng.integers(2, 6), rng.integers(1, 12)
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        u, v = u[u != v], v[u != v]
        if not len(u):
            continue
        w = rng.integers(1, 6, len(u))
        names, rank, score, flow = agony.solve(u.tolist(), v.tolist(), w.tolist())
        place = {x: k for k, x in enumerate(names)}
        best, least = brute(len(names), np.array([place[x] for x in u]), np.array([place[x] for x in v]), w)
        assert score == flow == best
        assert (rank == least).all()


@pytest.mark.parametrize(
    ("arcs", "ranks", "score"),
    [
        ([("A", "B", 3), ("B", "A", 1)], [0, 1], 2),
        ([("A", "B", 1), ("B", "C", 1), ("A", "C", 1)], [0, 1, 2], 0),
        ([("A", "B", 1), ("B", "C", 1), ("C", "A", 1)], [0, 0, 0], 3),
    ],
)
def test_hand_made(arcs, ranks, score):
    names, rank, got, flow = agony.solve(*map(list, zip(*arcs, strict=True)))
    assert (names, rank.tolist(), got, flow) == (sorted(names), ranks, score, score)


def test_weight_is_repetition():
    u, v = ["A", "B", "C", "A"], ["B", "C", "A", "C"]
    assert agony.solve(u * 3, v * 3, [1] * 12)[1].tolist() == agony.solve(u, v, [3] * 4)[1].tolist()


def test_large_graph_has_its_certificate():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 60, 900), rng.integers(0, 60, 900)
    keep = u != v
    _, _, score, flow = agony.solve(u[keep].tolist(), v[keep].tolist(), rng.integers(1, 90, keep.sum()).tolist())
    assert score == flow


def arcs_of(genes, ccf, mode):
    out = []
    for row, parent, child, weight in ordered_arcs(np.array(genes), np.array(ccf), mode):
        out += zip(row.tolist(), parent.tolist(), child.tolist(), ([1] * len(row) if weight is None else weight.tolist()), strict=True)
    return sorted(out)


def test_tiers():
    assert arcs_of([[0, 1, 2]], [[0.9, 0.9, 0.2]], "tiers") == [(0, 0, 2, 1), (0, 1, 2, 1)]
    assert arcs_of([[0, 1, 2]], [[0.9, 0.9, 0.2]], "compat") == [(0, 0, 1, 2)]
    assert arcs_of([[0, 1, 2], [3, 4, 5]], [[0.5, 0.0, 0.2], [np.nan, 0.2, 0.7]], "tiers") == [(0, 0, 2, 1), (1, 5, 4, 1)]
    with pytest.raises(ValueError, match="odd"):
        arcs_of([[0, 1]], [[0.1, 0.2]], "odd")


@pytest.mark.parametrize("mode", ["tiers", "compat"])
def test_rows_of_samples_against_one_at_a_time(mode):
    rng = np.random.default_rng(6)
    for k in (2, 3, 5):
        ccf = rng.integers(0, 4, (200, k)) / 4
        genes = np.sort(rng.permuted(np.tile(np.arange(9), (200, 1)), axis=1)[:, :k], axis=1)
        want = []
        for i in range(200):
            seen = sorted((-c, g) for c, g in zip(ccf[i], genes[i], strict=True) if c > 0)
            tiers = [[g for c, g in seen if c == t] for t in sorted({c for c, _ in seen})]
            line = [g for _, g in seen]
            for t in range(len(tiers) - 1):
                if mode == "tiers":
                    want += [(i, a, b, 1) for a in tiers[t] for b in tiers[t + 1]]
                else:
                    want.append((i, line[t], line[t + 1], len(tiers[t]) * len(tiers[t + 1])))
        assert arcs_of(genes, ccf, mode) == sorted((i, int(a), int(b), w) for i, a, b, w in want)


def test_solved_from_the_one_before():
    rng = np.random.default_rng(9)
    u, v = np.array([(i, j) for i in range(12) for j in range(12) if i != j]).T
    weights = rng.integers(0, 30, (len(u), 1)) + rng.integers(0, 8, (len(u), 20))
    weights[rng.random(weights.shape) < 0.2] = 0
    ranks, score, flow = agony.solve_all(12, u, v, weights)
    assert (score == flow).all()
    for k, w in enumerate(weights.T):
        alone = agony.smallest_ranks(12, u, v, w, agony.circulation(12, u, v, w))
        assert ranks[k].tolist() == alone.tolist() and score[k] == agony.agony(u, v, w, alone)


@pytest.mark.parametrize("dense", [1 << 23, 0])
def test_tally(monkeypatch, dense):
    monkeypatch.setattr(tally, "DENSE", dense)
    monkeypatch.setattr(tally, "SPARSE", 50)
    rng, want, got = np.random.default_rng(4), Counter(), Counter()
    t = tally.Tally(3, 60, 5)

    def take():
        for part in t.rows():
            for it, block, p, c, w in zip(*(part[x].tolist() for x in ("iter", "block", "parent", "child", "weights")), strict=True):
                got.update({(it, block * tally.WIDTH + k, p, c): x for k, x in enumerate(w) if x})

    for k in range(20):
        cell, p, c = rng.integers(0, 180, 300), rng.integers(0, 5, 300), rng.integers(0, 5, 300)
        w = None if k % 2 else rng.integers(1, 9, 300)
        t.add(cell, p, c, w)
        for i in range(300):
            want[cell[i] // 60, cell[i] % 60, p[i], c[i]] += 1 if w is None else w[i]
        if t.full():
            take()
    take()
    assert got == want


def test_draws_are_split_exactly_and_evenly():
    counts = np.array([[3, 0], [5, 2], [0, 0], [12, 1]])
    split = draws.Split(counts, 4000, 7)
    every = []
    for bucket in range(4):
        member = np.arange(12)[:, None] < counts[bucket]
        for it, inside, many in split.multiplicities(bucket, member):
            assert many.shape == (4000, counts[bucket, it]) and len(inside) == counts[bucket, it]
            if it == 0:
                every.append(many)
    every = np.hstack(every)
    assert (every.sum(1) == 20).all() and every.shape == (4000, 20)
    assert np.abs(every.mean(0) - 1).max() < 5 * np.sqrt(0.95 / 4000)  # multinomial: variance 1 - 1 / 20, covariance -1 / 20
    spread = np.cov(every.T)
    assert np.abs(np.diag(spread) - 0.95).max() < 0.15
    assert abs(spread[~np.eye(20, dtype=bool)].mean() + 1 / 20) < 0.005


@pytest.mark.parametrize(("a", "b"), [(1, 1), (7, 3), (40, 10), (1, 30)])
def test_beta_moments(a, b):
    n = 100_000
    x = draws.beta(draws.stream(1, a, b), np.array([a]), np.array([b]), n)[:, 0]
    mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    assert abs(x.mean() - mean) < 5 * np.sqrt(var / n)
    assert abs(x.var() / var - 1) < 0.05


def test_beta_limits():
    x = draws.beta(draws.stream(1), np.array([0, 3, 0]), np.array([3, 0, 0]), 2)
    assert (x[:, 0] == 0).all() and (x[:, 1] == 1).all() and np.isnan(x[:, 2]).all()
