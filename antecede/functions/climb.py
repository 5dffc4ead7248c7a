"""Parent search for one child over its contingency counts: greedy climb, tabu search, and the exact optimum that bounds them."""

from __future__ import annotations

import numpy as np


class Table:
    """Log-likelihoods of a child's parent sets in all rounds, given as bit masks over its candidates. bits: rows x candidates, 0/1;
    child: whether the rows' samples have the child; samples: rows x rounds, how many there are. A parent set's
    configurations are told once, for all the rounds that ask."""

    def __init__(self, bits: np.ndarray, child: np.ndarray, samples: np.ndarray):
        self.bits, self.child, self.samples, self.known = bits, child.astype(np.int64), samples.astype(float), {}
        self.candidates = bits.shape[1]

    def _cells(self, parents: int) -> tuple[np.ndarray, int]:
        """For each row, the place of its configuration and child; how many places."""
        chosen = [k for k in range(self.candidates) if parents >> k & 1]
        if len(chosen) <= 16:
            config = np.zeros(len(self.bits), np.int64)
            for place, k in enumerate(chosen):
                config += self.bits[:, k].astype(np.int64) << place
            return config * 2 + self.child, 2 << len(chosen)
        _, config = np.unique(np.packbits(self.bits[:, chosen].astype(np.uint8), axis=1), axis=0, return_inverse=True)
        config = config.reshape(-1)
        return config * 2 + self.child, 2 * (int(config.max(initial=0)) + 1)

    def fill(self, parents: int, rounds: np.ndarray) -> np.ndarray:
        """Log-likelihoods in the rounds."""
        if parents not in self.known:
            self.known[parents] = np.full(self.samples.shape[1], np.nan)
        known = self.known[parents]
        todo = rounds[np.isnan(known[rounds])]
        if len(todo):
            cell, size = self._cells(parents)
            table = np.stack([np.bincount(cell, self.samples[:, r], size) for r in todo]).reshape(len(todo), -1, 2)
            n = table.sum(2, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(table > 0, table * np.log(table / n), 0.0)
            known[todo] = part.sum((1, 2))
        return known[rounds]

    def score(self, parents: int, penalty: float, it: int = 0) -> float:
        return float(self.fill(parents, np.array([it]))[0]) - penalty * 2.0 ** parents.bit_count()


def climb_all(table: Table, states: list[tuple[int, int]], penalty: np.ndarray, allowed: np.ndarray, most: int = 200) -> list[tuple[int, float]]:
    """Ends and scores of the climbs from states (round, parents), side by side. A move is the best change of one candidate
    that is allowed in the round (masks) and must gain more than 1e-8; equal gains go to the first. penalty: of each round."""
    now, value, active = [p for _, p in states], [0.0] * len(states), list(range(len(states)))
    ends: dict[tuple[int, int], tuple[int, float] | None] = {}
    for k, (it, parents) in enumerate(states):
        value[k] = table.score(parents, penalty[it], it)
    for _ in range(most):
        wanted: dict[int, set[int]] = {}
        for it, parents in {(states[k][0], now[k]) for k in active}:
            if (it, parents) not in ends:
                for b in range(table.candidates):
                    if int(allowed[it]) >> b & 1:
                        wanted.setdefault(parents ^ (1 << b), set()).add(it)
        for parents, its in wanted.items():
            table.fill(parents, np.array(sorted(its)))
        on = []
        for k in active:
            it, parents = states[k][0], now[k]
            if (it, parents) not in ends:
                own = table.score(parents, penalty[it], it)
                gains = [(table.known[m][it] - penalty[it] * 2.0 ** m.bit_count() - own, b) for b in range(table.candidates) if int(allowed[it]) >> b & 1 for m in (parents ^ (1 << b),)]
                better = [(-round(g, 9), b) for g, b in gains if g > 1e-8]
                to = parents ^ (1 << min(better)[1]) if better else None
                ends[it, parents] = None if to is None else (to, table.score(to, penalty[it], it))
            if (move := ends[it, parents]) is not None:
                now[k], value[k] = move
                on.append(k)
        active = on
        if not active:
            break
    return list(zip(now, value, strict=True))


def restarted(table: Table, starts: dict[int, list[int]], penalty: np.ndarray, allowed: np.ndarray, most: int = 200) -> dict[int, int]:
    """For each round the best end of the climbs from all its starts; of equal ones the first start's."""
    states = [(it, s) for it, masks in starts.items() for s in masks]
    best: dict[int, tuple[float, int, int]] = {}
    for k, ((it, _), (parents, value)) in enumerate(zip(states, climb_all(table, states, penalty, allowed, most), strict=True)):
        best[it] = min(best.get(it, (float("inf"), 0, 0)), (-round(value, 9), k, parents))
    return {it: parents for it, (_, _, parents) in best.items()}


def tabu(table: Table, penalty: float, start: int = 0, tenure: int = 10, patience: int = 10, it: int = 0, allowed: int = -1) -> int:
    """The best parent set met. Each turn takes the best change of one candidate that is not tabu (changed within `tenure`
    turns), even a worse one, unless it beats the best so far; ends after `patience` turns without a new best."""
    now = best = start
    score = lambda parents: table.score(parents, penalty, it)
    able = [k for k in range(table.candidates) if allowed >> k & 1]
    until, since = [0] * table.candidates, 0
    for turn in range(1, 1000):
        moves = [(score(now ^ (1 << k)), -k) for k in able]
        moves = [(s, k) for s, k in moves if until[-k] < turn or s > score(best) + 1e-8]
        if not moves:
            break
        value, k = max(moves)
        now ^= 1 << -k
        until[-k] = turn + min(tenure, max(1, len(able) // 2))
        if value > score(best) + 1e-8:
            best, since = now, 0
        else:
            since += 1
        if since >= patience:
            break
    return best


def exact(table: Table, penalty: float, it: int = 0, allowed: int = -1) -> int:
    """The parent set of the highest score, by branch and bound: a set's supersets within a branch have at most the likelihood
    of all its candidates together, and one more parent doubles the penalty. Equal scores (to 1e-9) go to the set met first."""
    able = [1 << k for k in range(table.candidates) if allowed >> k & 1]
    able.sort(key=lambda b: -table.score(b, penalty, it))
    best, value = 0, table.score(0, penalty, it)

    def grow(chosen: int, at: int) -> None:
        nonlocal best, value
        most = float(table.fill(chosen | sum(able[at:]), np.array([it]))[0]) - penalty * 2.0 ** (chosen.bit_count() + 1)
        if at == len(able) or most <= value + 1e-9:
            return
        for k in range(at, len(able)):
            score = table.score(chosen | able[k], penalty, it)
            if score > value + 1e-9:
                best, value = chosen | able[k], score
            grow(chosen | able[k], k + 1)

    grow(0, 0)
    return best
