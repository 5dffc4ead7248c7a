"""A dense Cox lasso by accelerated proximal gradient, as a reference for the tests."""

from __future__ import annotations

import numpy as np


class Cox:
    """Partial likelihood of weighted rows; x is dense 0/1 columns, standardised inside."""

    def __init__(self, x: np.ndarray, time: np.ndarray, status: np.ndarray, weight: np.ndarray):
        self.weight = weight.astype(float)
        self.n = self.weight.sum()
        self.status = status * self.weight
        mean = (self.weight @ x) / self.n
        self.scale = np.sqrt((self.weight @ (x - mean) ** 2) / self.n)
        self.scale[self.scale == 0] = np.inf  # a constant column never enters
        self.x = (x - mean) / self.scale
        times, self.at = np.unique(time, return_inverse=True)
        self.deaths = np.bincount(self.at, self.status, len(times))

    def value(self, beta: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log partial likelihood and its gradient."""
        eta = self.x @ beta
        top = eta.max(initial=0.0)
        risk = self.weight * np.exp(eta - top)
        s0 = np.cumsum(np.bincount(self.at, risk, len(self.deaths))[::-1])[::-1]
        hazard = np.cumsum(np.where(self.deaths > 0, self.deaths / s0, 0.0))
        value = (self.status @ eta - (self.deaths * (np.log(s0) + top))[self.deaths > 0].sum()) / self.n
        return float(value), (self.x.T @ (self.status - risk * hazard[self.at])) / self.n


def fit(cox: Cox, lam: float, start: np.ndarray, turns: int = 200_000, tolerance: float = 1e-7) -> np.ndarray:
    """Accelerated proximal gradient with backtracking for -value + lam * |beta|_1; an error if it does not settle."""
    beta = z = start.copy()
    step, t = 1.0, 1.0
    for _ in range(turns):
        at, grad = cox.value(z)
        while True:
            new = z + step * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * lam, 0)
            move = new - z
            if -cox.value(new)[0] <= -at - grad @ move + (move @ move) / (2 * step) + 1e-13:
                break
            step /= 2
        if np.abs(new - beta).max(initial=0) < tolerance * max(1.0, np.abs(beta).max(initial=0)):
            return new
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (z - new) @ (new - beta) > 0:
            z, t = new, 1.0
        else:
            z, t = new + (t - 1) / ahead * (new - beta), ahead
        beta = new
        step *= 1.1
    raise RuntimeError(f"the lasso did not settle in {turns} turns at lambda {lam}")


def path(cox: Cox, lambdas: np.ndarray) -> np.ndarray:
    """Coefficients of the standardised columns for each lambda, warm-started."""
    beta, out = np.zeros(cox.x.shape[1]), []
    for lam in lambdas:
        beta = fit(cox, lam, beta)
        out.append(beta)
    return np.array(out)
