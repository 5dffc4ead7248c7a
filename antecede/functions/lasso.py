"""Cox lasso path on compacted rows with sparse 0/1 columns, Breslow ties, and what the path on Spark shares with it.

Coefficients belong to the raw columns; a column's penalty is lambda times its standard deviation, which is the lasso on
standardised columns (the partial likelihood does not see their means). A lambda is settled by one rule, in one task as
on Spark: no step is further from its optimum than KKT times lambda.
"""

from __future__ import annotations

import numpy as np

#: Distance from the optimum, in standardised units and as a share of lambda, at which a step counts as settled.
KKT = 1e-6
#: Newton turns at one lambda until the job stops with an error.
TURNS = 300


def scales(share: np.ndarray) -> np.ndarray:
    """Standard deviations of 0/1 columns with these means; 0 for a constant one, which never enters."""
    out = np.sqrt(np.maximum(share * (1 - share), 0))
    return np.where((share < 1e-12) | (share > 1 - 1e-12), 0.0, out)


def distance(b: np.ndarray, gradient: np.ndarray, scale: np.ndarray, lam: np.ndarray | float) -> np.ndarray:
    """How far each coefficient is from its optimum. gradient: of the mean log partial likelihood."""
    slope = gradient / np.where(scale > 0, scale, np.inf)
    return np.where(b != 0, np.abs(slope - lam * np.sign(b)), np.maximum(np.abs(slope) - lam, 0))


def quadratic(gradient: np.ndarray, h: np.ndarray, start: np.ndarray, penalty: np.ndarray, sweeps: int = 2000) -> np.ndarray:
    """Minimum of -gradient @ (x - start) + (x - start) @ h @ (x - start) / 2 + penalty @ |x|: sweeps of coordinate descent, and
    after each few an attempt to solve for the coordinates at work at once, kept if it is the optimum."""
    h = h + 1e-10 * np.eye(len(h)) * max(float(np.trace(h)) / max(len(h), 1), 1e-12)
    x, rest, bend = start.copy(), gradient.copy(), np.diag(h)
    for sweep in range(sweeps):
        most = 0.0
        for k in range(len(x)):
            pull = rest[k] + bend[k] * x[k]
            new = np.sign(pull) * max(abs(pull) - penalty[k], 0) / bend[k]
            if new != x[k]:
                rest -= h[:, k] * (new - x[k])
                most = max(most, abs(new - x[k]) * np.sqrt(bend[k]))
                x[k] = new
        if most < 1e-13:
            break
        if sweep % 3 == 2:
            on = np.flatnonzero(x)
            side = np.sign(x[on])
            direct = np.zeros_like(x)
            direct[on] = np.linalg.solve(h[np.ix_(on, on)], (gradient + h @ start)[on] - penalty[on] * side)
            left = gradient - h @ (direct - start)
            if (np.sign(direct[on]) == side).all() and (np.abs(left) <= penalty * (1 + 1e-12) + 1e-15)[direct == 0].all():
                return direct
    return x


class Cox:
    """Partial likelihood of weighted rows. steps: the columns that are 1 in each row."""

    def __init__(self, steps: list[np.ndarray], columns: int, time: np.ndarray, status: np.ndarray, weight: np.ndarray):
        order = np.argsort(time, kind="stable")
        size = np.array([len(steps[i]) for i in order], np.int64)
        self.flat = np.concatenate([steps[i] for i in order]).astype(np.int64) if size.sum() else np.zeros(0, np.int64)
        self.owner, self.columns = np.repeat(np.arange(len(order)), size), columns
        by = np.argsort(self.flat, kind="stable")
        self.rows = np.split(self.owner[by], np.cumsum(np.bincount(self.flat, minlength=columns))[:-1])
        self.weight = weight[order].astype(float)
        self.status = status[order] * self.weight
        self.n = self.weight.sum()
        self.scale = scales(self.sums(self.weight) / self.n)
        times, self.at = np.unique(time[order], return_inverse=True)
        self.first = np.searchsorted(self.at, np.arange(len(times)))
        self.deaths = np.bincount(self.at, self.status, len(times))
        self.held = (np.zeros(0, np.int64), np.zeros((len(order), 0)))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of the rows that have each column."""
        return np.bincount(self.flat, values[self.owner], self.columns)

    def dense(self, block: np.ndarray) -> np.ndarray:
        """The columns of the block, kept until another one is asked for."""
        if not np.array_equal(block, self.held[0]):
            x = np.zeros((len(self.weight), len(block)))
            for k, j in enumerate(block):
                x[self.rows[j], k] = 1
            self.held = (block, x)
        return self.held[1]

    def later(self, values: np.ndarray) -> np.ndarray:
        """Sums over the rows at or after each distinct time; rows are in order of time."""
        return np.cumsum(values[::-1], 0)[::-1][self.first]

    def value(self, b: np.ndarray) -> float:
        """Mean log partial likelihood."""
        eta = np.bincount(self.owner, b[self.flat], len(self.weight))
        s0, died = self.later(self.weight * np.exp(eta)), self.deaths > 0
        return float(self.status @ eta - self.deaths[died] @ np.log(s0[died])) / self.n

    def slopes(self, b: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean log partial likelihood, and minus its second derivatives among the columns of the block."""
        risk = self.weight * np.exp(np.bincount(self.owner, b[self.flat], len(self.weight)))
        s0 = self.later(risk)
        fall = np.where(self.deaths > 0, self.deaths / s0, 0.0)
        bend = risk * np.cumsum(fall)[self.at]
        if not len(block):
            return self.sums(self.status - bend) / self.n, np.zeros((0, 0))
        x = self.dense(block)
        tied = np.stack([np.bincount(self.at[self.rows[j]], risk[self.rows[j]], len(s0)) for j in block], 1)
        tied = np.cumsum(tied[::-1], 0)[::-1] * np.sqrt(fall / s0)[:, None]
        return self.sums(self.status - bend) / self.n, (x.T @ (x * bend[:, None]) - tied.T @ tied) / self.n


def fit(cox: Cox, lam: float, start: np.ndarray, gradient: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients that maximise the mean log partial likelihood less lam * scale @ |b|, and the gradient there: Newton turns
    on the columns at work; one that makes things worse is halved."""
    b, none = start.copy(), np.zeros(0, np.int64)
    gradient = cox.slopes(b, none)[0] if gradient is None else gradient
    value = lambda b: cox.value(b) - lam * (cox.scale @ np.abs(b))
    old = value(b)
    for _ in range(TURNS):
        off = distance(b, gradient, cox.scale, lam)
        if off.max(initial=0.0) <= KKT * lam:
            return b, gradient
        block = np.flatnonzero((b != 0) | (off > 0))
        gradient, h = cox.slopes(b, block)
        trial = b.copy()
        trial[block] = quadratic(gradient[block], h, b[block], lam * cox.scale[block])
        new = value(trial)
        while new < old - 1e-12 * abs(old) and np.abs(trial - b).max(initial=0) > 1e-14:
            trial = np.where(np.abs(trial - b) > 1e-14, (trial + b) / 2, b)
            new = value(trial)
        b, old = trial, new
        gradient = cox.slopes(b, none)[0]
    raise RuntimeError(f"the lasso did not settle in {TURNS} turns at lambda {lam}")


def path(cox: Cox, lambdas: np.ndarray) -> np.ndarray:
    """Coefficients for each lambda, each from the one before."""
    b, gradient, out = np.zeros(cox.columns), None, []
    for lam in lambdas:
        b, gradient = fit(cox, lam, b, gradient)
        out.append(b)
    return np.array(out)


def grid(top: float, n: float, columns: int, count: int = 100, ratio: float | None = None) -> np.ndarray:
    """From the least lambda without any coefficient (top) down to ratio of it: 0.01 where rows are fewer than columns and the
    intercept's, else 0.0001."""
    if ratio is None:
        ratio = 0.01 if n < columns + 1 else 1e-4
    return np.geomspace(top, top * ratio, count) if top > 0 else np.zeros(1)


def lambdas(cox: Cox, count: int = 100, ratio: float | None = None) -> np.ndarray:
    """The grid of a table."""
    gradient = cox.slopes(np.zeros(cox.columns), np.zeros(0, np.int64))[0]
    return grid(float(distance(np.zeros(cox.columns), gradient, cox.scale, 0.0).max(initial=0.0)), cox.n, cox.columns, count, ratio)
