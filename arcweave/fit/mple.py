"""Maximum pseudolikelihood: a design compressed in Spark, a small solve on the driver."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.fit.model import ERGMModel, ERGMResult
from arcweave.fit.newton import logistic_derivatives, newton_fit
from arcweave.functions.weights import log1pexp, logistic
from arcweave.mcmc.sample import bound_chain, simulated
from arcweave.network import Network
from arcweave.operators.base import Term, TermSet, expanded
from arcweave.plans.blocks import block_pairs, block_sums, corrections
from arcweave.plans.design import LISTED, _changes, mple_design
from arcweave.plans.sparse import few_classes, supported

#: Distinct design rows that are solved on the driver; beyond, each Newton step is one aggregation in Spark.
DRIVER_ROWS = 200_000


def spark_derivatives(design: DataFrame, names: list[str]):
    """What logistic_derivatives gives, as sums over a design that stays in Spark: 1 + p + p(p+1)/2 numbers a step."""
    p = len(names)
    design = design.toDF(*[f"x{k}" for k in range(p)], "n_tot", "n_one")
    x = [F.col(f"x{k}") for k in range(p)]

    def f(beta: np.ndarray):
        eta = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        rows = design.withColumn("eta", eta)
        q = logistic(F.col("eta"))
        each = [F.sum(F.col("n_one") * F.col("eta") - F.col("n_tot") * log1pexp(F.col("eta")))]
        each += [F.sum(F.col(f"x{a}") * (F.col("n_one") - F.col("n_tot") * q)) for a in range(p)]
        each += [F.sum(-F.col(f"x{a}") * F.col(f"x{b}") * F.col("n_tot") * q * (1 - q)) for a in range(p) for b in range(a, p)]
        return _unpacked([float(v or 0) for v in rows.agg(*[e.alias(f"c{k}") for k, e in enumerate(each)]).first()], p)

    return f


def _unpacked(got: list[float], p: int):
    """Log-likelihood, gradient and Hessian from their sums in a row."""
    hess = np.zeros((p, p))
    hess[np.triu_indices(p)] = got[1 + p :]
    return got[0], np.array(got[1 : 1 + p]), hess + np.triu(hess, 1).T


def block_derivatives(net: Network, terms: TermSet):
    """What spark_derivatives gives, for a design that does not compress: pairs of vertex blocks are gone through in
    each step, and a small table puts the touched and unobserved dyads right."""
    p = len(terms)
    listed = spark_derivatives(corrections(net, terms, _changes).cache(), terms.names)
    pairs = block_pairs(net, terms)

    def f(beta: np.ndarray):
        return tuple(a + b for a, b in zip(listed(beta), _unpacked(block_sums(net, terms, pairs, beta), p)))

    return f


def _solve(x: np.ndarray, n_tot: np.ndarray, n_one: np.ndarray):
    return newton_fit(logistic_derivatives(x, n_one, weight=n_tot), np.zeros(x.shape[1]), tol=1e-12)


def _covariance(hess: np.ndarray) -> np.ndarray:
    """Inverse information; all NaN where it is singular."""
    try:
        if np.linalg.cond(hess) < 1e14:
            return np.linalg.inv(-hess)
    except np.linalg.LinAlgError:
        pass
    return np.full(hess.shape, np.nan)


def compressed(design: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = design.toPandas()
    return got.iloc[:, : len(names)].to_numpy(float), got["n_tot"].to_numpy(float), got["n_one"].to_numpy(float)


def mple(model: ERGMModel, se: str = "hessian", n_boot: int = 100, boot_burnin: int | None = None, boot_interval: int | None = None, seed: int | None = None, driver_rows: int = DRIVER_ROWS, by_blocks: bool | None = None) -> ERGMResult:
    """Unobserved dyads are left out. se: hessian, or bootstrap by refits to n_boot networks simulated at the estimate.

    In a large network whose vertices fall into too many classes for a compressed design, as a continuous attribute makes
    them, dyads are summed over pairs of vertex blocks and never listed; `by_blocks` forces or forbids that."""
    if se not in ("hessian", "bootstrap"):
        raise ValueError(f"se must be hessian or bootstrap, not {se!r}")
    net, names = model.network, model.names
    own = expanded(net, model.terms)
    if by_blocks is None:
        by_blocks = net.n_pairs > LISTED and supported(net, own) and not few_classes(net, own)
    if by_blocks and not supported(net, own):
        raise ValueError("a term follows more than its dyad's ends, ties and shared partners; its dyads must be listed")
    design = None if by_blocks else mple_design(net, model.terms).cache()
    try:
        if by_blocks:
            f = block_derivatives(net, own)
            fit = newton_fit(f, np.zeros(len(names)), tol=1e-12)
            design_rows = None
        else:
            design_rows = design.count()
        if design_rows is not None and design_rows <= driver_rows:
            x, n_tot, n_one = compressed(design, names)
            fit, f = _solve(x, n_tot, n_one), logistic_derivatives(x, n_one, weight=n_tot)
        elif design_rows is not None:
            f = spark_derivatives(design, names)
            fit = newton_fit(f, np.zeros(len(names)), tol=1e-12)
        ll, grad, hess = f(fit.theta)
    finally:
        if design is not None:
            design.unpersist()
    cov = _covariance(hess)
    if se == "bootstrap":
        cov = bootstrap_cov(model, fit.theta, n_boot, boot_burnin, boot_interval, seed)
    settled = bool(fit.converged or np.linalg.norm(grad) < 1e-6 * max(1.0, net.n_dyads))
    return ERGMResult(model, fit.theta, cov, ll, "mple", settled, None, se, "available_case" if net.n_missing else "none")


def bootstrap_cov(model: ERGMModel, theta: np.ndarray, n_boot: int, burnin: int | None, interval: int | None, seed: int | None) -> np.ndarray:
    """Covariance of refits to simulated networks. A network is small enough for a chain's task, and its refit costs one
    pass over its dyads, far below the steps that made it; so each is refitted where it is drawn."""
    net, p = model.network, len(model.names)
    burnin = 20 * net.n_dyads if burnin is None else burnin
    interval = max(100, net.n_dyads // 10) if interval is None else interval
    shared = net.spark.sparkContext.broadcast(bound_chain(net, model.terms))

    def refit(batches):
        own = shared.value
        for b in batches:
            out = []
            for sim, arcs in zip(b["sim_id"], b["arcs"]):
                at = np.searchsorted(own.ids, np.array([(x["i"], x["j"]) for x in arcs], np.int64).reshape(-1, 2))
                x, n_tot, n_one = own.design(at)
                out.append((sim, _solve(x, n_tot, n_one).theta.tolist()))
            yield pd.DataFrame(out, columns=["sim_id", "theta"])

    got = simulated(model, theta, n_boot, burnin, interval, seed).mapInPandas(refit, "sim_id int, theta array<double>").toPandas()
    return np.cov(np.array(got["theta"].tolist(), float).reshape(-1, p), rowvar=False).reshape(p, p)


def fit_ergm(net: Network, terms: Iterable[Term], method: str = "mple", **options) -> ERGMResult:
    from arcweave.fit.mcmle import mcmle

    methods = {"mple": mple, "mcmle": mcmle}
    if method not in methods:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(methods)}")
    return methods[method](ERGMModel(terms, net), **options)


ergm = fit_ergm
