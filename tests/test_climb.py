"""The parent searches of one child against all parent sets."""

import itertools

import numpy as np
import pytest

from antecede.functions import climb


def table(seed, rows, cands, rounds=2):
    rng = np.random.default_rng(seed)
    bits = np.array(list(itertools.product((0, 1), repeat=cands + 1)), np.uint8)
    bits = bits[rng.permutation(len(bits))[:rows]]
    return climb.Table(bits[:, :-1], bits[:, -1], rng.integers(0, 60, (len(bits), rounds)))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("penalty", [1.0, 3.5])
def test_exact_is_the_best_of_all_sets_and_bounds_the_searches(seed, penalty):
    t = table(seed, 60, 6)
    for it, allowed in ((0, 0b111111), (1, 0b101101)):
        sets = [m for m in range(64) if m & ~allowed == 0]
        best = max(t.score(m, penalty, it) for m in sets)
        found = climb.exact(t, penalty, it, allowed)
        assert found & ~allowed == 0 and t.score(found, penalty, it) == pytest.approx(best)
        limits, masks = np.array([penalty] * 2), np.array([0b111111, 0b101101], object)
        ends = [climb.restarted(t, {it: starts}, limits, masks)[it] for starts in ([0], [0, allowed, allowed & 0b1100])]
        ends.append(climb.tabu(t, penalty, 0, it=it, allowed=allowed))
        scores = [t.score(m, penalty, it) for m in ends]
        assert all(m & ~allowed == 0 for m in ends) and max(scores) <= best + 1e-9
        assert scores[1] >= scores[0] - 1e-9 and scores[2] >= scores[0] - 1e-9
        for m in ends[:1]:  # no single change helps
            assert all(t.score(m ^ (1 << k), penalty, it) <= t.score(m, penalty, it) + 1e-8 for k in range(6) if allowed >> k & 1)


def test_restarts_and_tabu_find_an_interaction_that_the_climb_misses():
    bits = np.array(list(itertools.product((0, 1), repeat=4)), np.uint8)
    odd = bits[:, 0] ^ bits[:, 1]  # neither alone says anything of the child
    rows, child = np.repeat(bits, 2, axis=0), np.tile([0, 1], 16)
    t = climb.Table(rows, child, np.where(np.repeat(odd, 2) == child, 90, 10)[:, None])
    one, all_ = np.array([2.0]), np.array([0b1111], object)
    assert climb.restarted(t, {0: [0]}, one, all_)[0] == 0
    assert climb.restarted(t, {0: [0, 0b0010, 0b0100]}, one, all_)[0] == 0b0011
    assert climb.tabu(t, 2.0) == 0b0011 == climb.exact(t, 2.0)


def test_many_candidates():
    rng = np.random.default_rng(5)
    bits = (rng.random((400, 22)) < 0.3).astype(np.uint8)
    child = (bits[:, 3] & (rng.random(400) < 0.9)) | (bits[:, 17] & (rng.random(400) < 0.8))
    t = climb.Table(bits, child, np.ones((400, 1)))
    found = climb.restarted(t, {0: [0]}, np.array([3.0]), np.array([(1 << 22) - 1], object))[0]
    assert found >> 3 & 1 and found >> 17 & 1
    config = np.packbits(bits, axis=1)  # the likelihood of more than 16 parents
    want = sum(k * np.log(k / len(x)) for row in np.unique(config, axis=0) for x in (child[(config == row).all(1)],) for k in (x.sum(), len(x) - x.sum()) if k)
    assert t.fill((1 << 22) - 1, np.array([0]))[0] == pytest.approx(want)
