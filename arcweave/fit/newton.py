"""Newton's method with step halving, and the derivatives of a logistic log-likelihood."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Derivatives = tuple[float, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class NewtonFit:
    theta: np.ndarray
    se: np.ndarray
    vcov: np.ndarray
    loglik: float
    converged: bool
    iterations: int


def newton_fit(f: Callable[[np.ndarray], Derivatives], start, maxiter: int = 100, tol: float = 1e-8, max_halvings: int = 10) -> NewtonFit:
    """Maximizes f, which returns (value, gradient, Hessian). A step is halved until the value doesn't fall."""
    theta = np.array(start, float)
    value, grad, hess = f(theta)
    converged, k = False, 0
    for k in range(1, maxiter + 1):
        try:
            step = np.linalg.solve(-hess, grad)
        except np.linalg.LinAlgError:
            break
        for _ in range(max_halvings + 1):
            new = f(theta + step)
            if new[0] >= value:
                break
            step = step / 2
        else:
            break  # no way up: theta and its derivatives stay as they are
        gain = new[0] - value
        theta, (value, grad, hess) = theta + step, new
        if gain < tol and np.linalg.norm(grad) < np.sqrt(tol):
            converged = True
            break
    vcov = np.linalg.pinv(-np.atleast_2d(hess))
    return NewtonFit(theta, np.sqrt(np.abs(np.diag(vcov))), vcov, float(value), converged, k)


def logistic_derivatives(x, y, offset=None, weight=None) -> Callable[[np.ndarray], Derivatives]:
    """(value, gradient, Hessian) of sum(y eta - n log(1 + exp(eta))), eta = x beta + offset.

    With `weight`, a row stands for that many trials, y of them ones."""
    x, y = np.atleast_2d(np.asarray(x, float)), np.asarray(y, float)
    if len(y) != len(x):
        raise ValueError(f"y has {len(y)} entries but x has {len(x)} rows")
    shift = np.zeros(len(x)) if offset is None else np.asarray(offset, float)
    if len(shift) != len(x):
        raise ValueError(f"offset has {len(shift)} entries but x has {len(x)} rows")
    n = np.ones(len(x)) if weight is None else np.asarray(weight, float)

    def f(beta: np.ndarray) -> Derivatives:
        eta = x @ beta + shift
        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        value = float(y @ eta - n @ np.logaddexp(0, eta))
        return value, x.T @ (y - n * p), -(x * (n * p * (1 - p))[:, None]).T @ x

    return f
