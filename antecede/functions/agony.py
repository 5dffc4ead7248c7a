"""Minimum-agony ranking of one weighted arc set.

Agony of a ranking r is the sum over arcs u -> v of w * max(r(u) - r(v) + 1, 0). Its minimum equals the largest total flow
of a circulation within the weights (maximum-weight Eulerian subgraph). Start with every arc full; nodes then have too much
or too little inflow; repair by successive shortest paths in the residual graph, where taking a unit off an arc costs 1 and
putting it back gains 1. All numbers are integers, so the result is exact. An optimal flow leaves difference constraints

    flow < weight  =>  r(v) >= r(u) + 1          flow > 0  =>  r(u) >= r(v) - 1

whose solutions are all the optimal rankings, whichever optimal flow was found; the smallest non-negative one is returned.
"""

from __future__ import annotations

import numpy as np


def _distances(n: int, tail: np.ndarray, head: np.ndarray, cost: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Bellman-Ford from all sources at once; no negative cycles."""
    far = np.iinfo(np.int64).max // 4
    dist = np.full(n, far)
    dist[sources] = 0
    for _ in range(n + 1):
        new = dist.copy()
        np.minimum.at(new, head, np.where(dist[tail] < far, dist[tail] + cost, far))
        if (new == dist).all():
            return dist
        dist = new
    raise ArithmeticError("negative cycle")


def circulation(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Largest circulation with 0 <= flow <= w. near: ranks and flow of a similar graph on the same arcs, to start from: full
    where those ranks do not rise, empty where they rise by more than one, else as there."""
    flow = w.astype(np.int64).copy()
    if near is not None:
        rise = near[0][v] - near[0][u]
        flow = np.where(rise > 1, 0, np.where(rise == 1, np.minimum(near[1], flow), flow))
    excess = np.bincount(v, flow, n).astype(np.int64) - np.bincount(u, flow, n).astype(np.int64)
    tail, head = np.r_[v, u], np.r_[u, v]
    cost = np.r_[np.ones(len(u), np.int64), -np.ones(len(u), np.int64)]
    while (excess > 0).any():
        room = np.r_[flow, w - flow]
        open_ = np.flatnonzero(room > 0)
        dist = _distances(n, tail[open_], head[open_], cost[open_], np.flatnonzero(excess > 0))
        # all of this round's pushes use arcs on shortest paths, so later ones stay shortest too
        out: list[list[int]] = [[] for _ in range(n)]
        for e in open_[dist[tail[open_]] + cost[open_] == dist[head[open_]]]:
            out[tail[e]].append(int(e))
        room = room.tolist()
        moved = False
        at = [0] * n
        for s in np.flatnonzero(excess > 0).tolist():
            while excess[s] > 0:
                path, node, on = [], s, {s}
                while not excess[node] < 0:
                    while at[node] < len(out[node]) and (room[out[node][at[node]]] == 0 or int(head[out[node][at[node]]]) in on):
                        at[node] += 1
                    if at[node] == len(out[node]):
                        if not path:
                            break
                        on.discard(node)
                        e = path.pop()
                        node = int(tail[e])
                        at[node] += 1
                        continue
                    e = out[node][at[node]]
                    path.append(e)
                    node = int(head[e])
                    on.add(node)
                if not path or not excess[node] < 0:
                    break
                push = min([int(excess[s]), int(-excess[node]), *(room[e] for e in path)])
                for e in path:
                    k = e % len(u)
                    flow[k] += -push if e < len(u) else push
                    room[e] -= push
                excess[s] -= push
                excess[node] += push
                moved = True
        if not moved:
            raise ArithmeticError("flow cannot be balanced")
    return flow


def constraints(u: np.ndarray, v: np.ndarray, w: np.ndarray, flow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """low, high, gap of every rank(high) >= rank(low) + gap that an optimal ranking keeps."""
    up, back = flow < w, flow > 0
    gap = np.r_[np.ones(up.sum(), np.int64), -np.ones(back.sum(), np.int64)]
    return np.r_[u[up], v[back]], np.r_[v[up], u[back]], gap


def least(rank: np.ndarray, low: np.ndarray, high: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The smallest ranks from the given ones upwards that keep the constraints."""
    for _ in range(len(rank) + 1):
        new = rank.copy()
        np.maximum.at(new, high, rank[low] + gap)
        if (new == rank).all():
            return rank
        rank = new
    raise ArithmeticError("constraints do not hold together")


def smallest_ranks(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, flow: np.ndarray) -> np.ndarray:
    return least(np.zeros(n, np.int64), *constraints(u, v, w, flow))


def agony(u: np.ndarray, v: np.ndarray, w: np.ndarray, rank: np.ndarray) -> int:
    return int((w * np.maximum(rank[u] - rank[v] + 1, 0)).sum())


def solve_all(n: int, u: np.ndarray, v: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks (columns x n), agony and total flow of many graphs on the same arcs. weights: arcs x columns; each graph starts
    from the one before, which changes the time and not the result."""
    near, ranks, scores, flows = None, [], [], []
    for w in weights.T:
        flow = circulation(n, u, v, w, near)
        rank = smallest_ranks(n, u, v, w, flow)
        near = (rank, flow)
        ranks.append(rank)
        scores.append(agony(u, v, w, rank))
        flows.append(int(flow.sum()))
    return np.array(ranks).reshape(-1, n), np.array(scores, np.int64), np.array(flows, np.int64)


def solve(parents: list, children: list, weights: list) -> tuple[list, np.ndarray, int, int]:
    """Nodes in order of label, their ranks, the agony and the total flow (equal: the certificate of optimality)."""
    names = sorted(set(parents) | set(children))
    place = {x: k for k, x in enumerate(names)}
    u, v = (np.array([place[x] for x in side], np.int64) for side in (parents, children))
    w = np.asarray(weights, np.int64)
    flow = circulation(len(names), u, v, w)
    rank = smallest_ranks(len(names), u, v, w, flow)
    return names, rank, agony(u, v, w, rank), int(flow.sum())
