"""The Cox lasso path over tables that do not fit one task (H3-H5): proximal Newton rounds on Spark.

All folds and some lambdas at a time are fitted side by side, as columns. A round reads the compacted rows twice: for the sums at
each distinct time (on the driver up to MAX_TIMES distinct times, else by two-level running sums and a join), and for the gradient of
every step with the second derivatives among the steps at work, BLOCK of them at most. More steps than that take turns, those
furthest from their optimum first; as every pass gives the slope of every step, none is screened out wrongly. A task
gives out one row of sums, and these are combined by treeAggregate; the driver holds steps x columns gradients and BLOCK ** 2 x
columns second derivatives, whatever the number of patients, and solves the small quadratic problems. Second derivatives are exact where the sums at
distinct times of the steps at work fit MAX_TIED numbers, so that few rounds settle a lambda; else they are bounded from above. A
round that makes a column's objective worse is halved for that column. Settled columns leave the passes.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions import lasso
from antecede.operators.running import marks, placed, sums
from antecede.sources.tables import beside, stored

#: Distinct times whose sums the driver holds at most; numbers of a task's sums over times at most.
MAX_TIMES, MAX_TIED = 50_000, 1 << 22
#: Steps whose second derivatives one round takes; lambdas side by side; rows of a dense piece.
BLOCK, TOGETHER, PIECE = 256, 4, 4096


class Batch:
    """Rows of a batch against the coefficients b (steps x columns). A column's model 0 has all folds, model f + 1 all but fold f."""

    def __init__(self, part: pd.DataFrame, b: np.ndarray, model: np.ndarray):
        self.n, columns = len(part), b.shape[1]
        size = part.steps.str.len().to_numpy()
        self.flat = np.concatenate(part.steps.to_numpy()).astype(np.int64) if size.sum() else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), size)
        self.eta = np.stack([np.bincount(self.owner, b[self.flat, c], self.n) for c in range(columns)], 1)
        self.every = part.weight.to_numpy(float)[:, None]
        self.weight = self.every * (part.fold.to_numpy()[:, None] != model[None, :] - 1)
        self.status = part.status.to_numpy(float)[:, None]
        self.raised = np.exp(self.eta)

    def total(self, values: np.ndarray, steps: int) -> np.ndarray:
        """Sums of values (rows x columns) over the rows that show each step."""
        return np.stack([np.bincount(self.flat, values[self.owner, c], steps) for c in range(values.shape[1])], 1)


def summed(rows: DataFrame, add: Callable[[pd.DataFrame, np.ndarray], None], size: int) -> np.ndarray:
    """A vector that add(batch, vector) fills in each task, over all tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in batches:
            if len(part):
                add(part, total)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.mapInPandas(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]))
    return parts.treeAggregate(np.zeros(size), operator.add, operator.add, depth=2)


class Path:
    """Gradients and second derivatives of many columns over stored rows (steps array<int>, time, status, fold, weight)."""

    def __init__(self, rows: DataFrame, steps: int, folds: int, max_times: int = MAX_TIMES):
        self.rows, self.steps, self.models, self.passes = stored(rows), steps, folds + 1, 0
        distinct = self.rows.select("time").distinct()
        self.few = distinct.limit(max_times + 1).count() <= max_times
        self.times = np.sort(distinct.toPandas().time.to_numpy(float)) if self.few else np.zeros(0)
        self.marks = [] if self.few else marks(distinct, "time")
        every = np.arange(self.models)
        held = self.slopes(np.zeros((steps, self.models)), every, None, np.zeros(0, int))
        self.n, self.events = held["n"], held["events"]
        self.scale = lasso.scales(held["curved"] / np.maximum(self.n, 1e-300))  # of the standardised columns; 0: never enters
        self.idle = (self.events == 0) | (self.n == self.n[0])
        self.idle[0] = False

    def hazards(self, b: np.ndarray, model: np.ndarray) -> dict[str, np.ndarray | DataFrame]:
        """hazard: times x columns, or with many times a table (time, hazard array); value and full: log partial likelihood of each
        column over its own folds and over all; with few times also fall and s0, at each time."""
        self.passes += 1
        columns = len(model)
        if not self.few:
            own, value = self._hazards_by_table(b, model, False)
            return {"hazard": own, "value": value, "full": self._hazards_by_table(b, model, True)[1]}
        times = self.times

        def add(part: pd.DataFrame, total: np.ndarray) -> None:
            rows, at = Batch(part, b, model), np.searchsorted(times, part.time.to_numpy(float))
            total = total.reshape(6, len(times), columns)
            for k, weight in enumerate((rows.weight, rows.every * np.ones((1, columns)))):
                died = weight * rows.status
                for j, values in enumerate((weight * rows.raised, died, died * rows.eta)):
                    np.add.at(total[3 * k + j], at, values)

        total = summed(self.rows, add, 6 * len(times) * columns).reshape(2, 3, len(times), columns)
        out = {}
        for k, name in enumerate(("value", "full")):
            e, d, fit = total[k]
            s0 = np.where(d > 0, np.cumsum(e[::-1], 0)[::-1], 1.0)
            out[name] = (fit - d * np.log(s0)).sum(0)
            if not k:
                out |= {"hazard": np.cumsum(d / s0, 0), "fall": d / s0, "s0": s0}
        return out

    def _hazards_by_table(self, b: np.ndarray, model: np.ndarray, everywhere: bool) -> tuple[DataFrame, np.ndarray]:
        columns = range(len(model))
        names = [f"{c}{m}" for c in "edl" for m in columns]

        def per_time(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    rows = Batch(part, b, model)
                    weight = rows.every * np.ones((1, len(model))) if everywhere else rows.weight
                    died = weight * rows.status
                    times, at = np.unique(part.time.to_numpy(float), return_inverse=True)
                    values = np.hstack([weight * rows.raised, died, died * rows.eta])
                    yield pd.DataFrame(np.column_stack([times, *[np.bincount(at, v, len(times)) for v in values.T]]), columns=["time", *names])

        per = self.rows.mapInPandas(per_time, ", ".join(f"{c} double" for c in ["time", *names]))
        per = placed(stored(per.groupBy("time").agg(*[F.sum(c).alias(c) for c in names])), "time", self.marks)
        at_risk = sums(per, "time", {f"e{m}": f"s{m}" for m in columns}, descending=True)
        falls = [F.when(F.col(f"d{m}") > 0, F.col(f"d{m}") / F.col(f"s{m}")).otherwise(0.0).alias(f"h{m}") for m in columns]
        logs = [(F.col(f"l{m}") - F.when(F.col(f"d{m}") > 0, F.col(f"d{m}") * F.log(f"s{m}")).otherwise(0.0)).alias(f"v{m}") for m in columns]
        at_risk = placed(stored(at_risk.select("time", *falls, *logs)), "time", self.marks)
        value = at_risk.agg(*[F.sum(f"v{m}") for m in columns]).first()
        summed_ = sums(at_risk, "time", {f"h{m}": f"c{m}" for m in columns}).select("time", F.array(*[f"c{m}" for m in columns]).alias("hazard"))
        return stored(summed_), np.array([v or 0.0 for v in value])

    def slopes(self, b: np.ndarray, model: np.ndarray, hazards: dict | None, block: np.ndarray) -> dict[str, np.ndarray]:
        """gradient and curved (steps x columns), curvature (columns x block x block), events and n (columns). Without hazards: the
        number of rows (n), of events and, as curved, of rows for each step."""
        self.passes += 1
        steps, columns, counted, times = self.steps, len(model), hazards is None, self.times
        table = hazards["hazard"] if hazards and self.few else None
        tied = len(times) if table is not None and len(times) * len(block) * columns <= MAX_TIED else 0
        place = np.full(steps, -1)
        place[block] = np.arange(len(block))
        sizes = [2 * (steps + 1) * columns, columns * len(block) ** 2, columns * tied * len(block)]

        def add(part: pd.DataFrame, total: np.ndarray) -> None:
            ends, among, later = np.split(total, np.cumsum(sizes)[:-1])
            ends, among = ends.reshape(2, steps + 1, columns), among.reshape(columns, len(block), len(block))
            later = later.reshape(columns, tied, len(block))
            rows, at = Batch(part, b, model), None
            if counted:
                falls = np.zeros((rows.n, columns))
            elif table is not None:
                at = np.searchsorted(times, part.time.to_numpy(float))
                falls = table[at]
            else:
                falls = np.stack(part.hazard.to_numpy())
            risk = rows.weight * rows.raised
            bend = rows.weight if counted else risk * falls
            rest = rows.weight * rows.status - risk * falls
            for k, values in enumerate((rest, bend)):
                ends[k, :steps] += rows.total(values, steps)
                ends[k, steps] += values.sum(0)
            used = place[rows.flat] >= 0
            owner, column = rows.owner[used], place[rows.flat[used]]
            if tied:
                for c in range(columns):
                    np.add.at(later[c], (at[owner], column), risk[owner, c])
            for lo in range(0, rows.n if len(block) else 0, PIECE):
                here = (owner >= lo) & (owner < lo + PIECE)
                x = np.zeros((min(PIECE, rows.n - lo), len(block)))
                x[owner[here] - lo, column[here]] = 1
                for c in range(columns):
                    among[c] += x.T @ (x * bend[lo : lo + PIECE, c, None])

        rows = self.rows if counted or table is not None else beside(self.rows, hazards["hazard"], F.size("hazard"), ["time"], F.col("steps"))
        ends, among, later = np.split(summed(rows, add, sum(sizes)), np.cumsum(sizes)[:-1])
        ends, among = ends.reshape(2, steps + 1, columns), among.reshape(columns, len(block), len(block))
        if not counted and len(block):
            for c in range(columns):
                if tied:
                    x = np.cumsum(later.reshape(columns, tied, len(block))[c][::-1], 0)[::-1] * np.sqrt(hazards["fall"][:, c] / hazards["s0"][:, c])[:, None]
                    among[c] -= x.T @ x
                else:
                    middle = ends[1, block, c]
                    among[c] -= np.outer(middle, middle) / max(ends[1, steps, c], 1e-300)
        return {"gradient": ends[0, :steps], "curved": ends[1, :steps], "events": ends[0, steps], "n": ends[1, steps], "curvature": among}


def fit(rows: DataFrame, steps: int, folds: int, count: int = 100, block: int = BLOCK, turns: int = lasso.TURNS, max_times: int = MAX_TIMES, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the whole table (lambdas x steps) and the held-out deviance of each lambda, over all folds.

    rows: steps (array of numbers below `steps`), time, status, fold, weight. Settled is as in lasso.fit()."""
    work = Path(rows, steps, folds, max_times)
    whole, deviance = [], []
    for found, loss in fitted(work, count, block, turns, together):
        whole.append(found)
        deviance.append(loss)
    return np.array(whole), np.array(deviance)


def fitted(work: Path, count: int, block: int = BLOCK, turns: int = lasso.TURNS, together: int = TOGETHER) -> Iterator[tuple[np.ndarray, float]]:
    """For each lambda the coefficients of the whole table and the held-out deviance."""
    every = np.arange(work.models)
    start = np.zeros((work.steps, work.models))
    none = np.zeros(0, int)
    first = work.slopes(start, every, work.hazards(start, every), none)["gradient"][:, 0] / max(work.n[0], 1e-300)
    grid = lasso.grid(float(lasso.distance(start[:, 0], first, work.scale[:, 0], 0.0).max(initial=0.0)), work.n[0], work.steps, count)
    able = np.flatnonzero(~work.idle)
    together = max(1, min(together, MAX_TIED // max(1, 6 * len(work.times) * len(able)))) if work.few else 1
    for lo in range(0, len(grid), together):
        lams = grid[lo : lo + together]
        model, lam = np.tile(able, len(lams)), np.repeat(lams, len(able))
        b, open_ = start[:, model].copy(), np.arange(len(model))
        scale, n = work.scale[:, model], work.n[model]
        value, full = np.zeros(len(model)), np.zeros(len(model))
        hazards = work.hazards(b, model)
        value[:], full[:] = hazards["value"], hazards["full"]
        worth = lambda b, value, at: -value / n[at] + lam[at] * (scale[:, at] * np.abs(b)).sum(0)
        wanted = none
        for _ in range(turns):
            now = work.slopes(b[:, open_], model[open_], hazards, wanted)
            gap = lambda now, at: lasso.distance(b[:, at], now["gradient"] / n[at], scale[:, at], lam[at])
            off = gap(now, open_)
            if not (off.max(0, initial=0.0) > lasso.KKT * lam[open_]).any():
                break
            least = (off / lam[open_]).max(1)
            need = np.flatnonzero((least > 0) | (b[:, open_] != 0).any(1))
            need = np.sort(need[np.argsort(-least[need], kind="stable")[:block]])
            if not np.isin(need, wanted).all():
                wanted = need
                now = work.slopes(b[:, open_], model[open_], hazards, wanted)
            trial = b[:, open_].copy()
            for c, at in enumerate(open_):
                free = scale[wanted, at] > 0
                on = wanted[free]
                trial[on, c] = lasso.quadratic(now["gradient"][on, c] / n[at], now["curvature"][c][np.ix_(free, free)] / n[at], b[on, at], lam[at] * scale[on, at])
            old = worth(b[:, open_], value[open_], open_)
            while True:
                hazards = work.hazards(trial, model[open_])
                worse = worth(trial, hazards["value"], open_) > old + 1e-12 * np.abs(old)
                if not worse.any() or np.abs(trial - b[:, open_])[:, worse].max(initial=0) < 1e-13:
                    break
                trial[:, worse] = np.where(np.abs(trial - b[:, open_]) > 1e-14, (trial + b[:, open_]) / 2, b[:, open_])[:, worse]
            b[:, open_], value[open_], full[open_] = trial, hazards["value"], hazards["full"]
        else:
            raise RuntimeError(f"the lasso did not settle in {turns} rounds at lambda {lams.max()}")
        for k in range(len(lams)):
            part = slice(k * len(able), (k + 1) * len(able))
            yield b[:, part][:, 0].copy(), float((-2 * (full - value)[part])[able > 0].sum())
        start[:, able] = b[:, -len(able) :]
