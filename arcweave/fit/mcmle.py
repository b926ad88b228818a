"""Monte-Carlo maximum likelihood: samples from one chain job a step, small linear algebra on the driver."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.diag.traces import geyer_ess
from arcweave.fit.model import ERGMModel, ERGMResult
from arcweave.fit.mple import mple
from arcweave.functions.special import chi2_quantile, f_sf
from arcweave.functions.weights import log1pexp
from arcweave.mcmc.sample import bound_chain, chains, require_observed, sample_matrix, seeds
from arcweave.network import Network
from arcweave.plans.design import compute_all, mple_design


def hotelling_p(d2: float, ess: float, p: int) -> float:
    """Whether the sample's mean can be the observed statistics, given how many draws it is worth."""
    if ess <= p:
        return 0.0
    return f_sf(ess * d2 * (ess - p) / (p * (ess - 1)), p, ess - p)


def sample_ess(sample: np.ndarray) -> float:
    return max(2.0, min(geyer_ess(sample[:, k]) for k in range(sample.shape[1])))


def mcmle(model: ERGMModel, n_samples: int = 1000, burnin: int | None = None, interval: int | None = None, max_iter: int = 20, conv_threshold: float = 0.1, hotelling_alpha: float = 0.05, gamma0: float = 0.1, max_step_norm: float = 5.0, seed: int | None = None, bridge_rungs: int | None = 16, bridge_samples: int | None = None, tol: float | None = None, missing: str = "error") -> ERGMResult:
    """Starts from the pseudolikelihood. A step goes only as far as the sample's spread supports (factor gamma); at
    gamma = 1 the fit has converged once means are near the observed statistics. bridge_rungs=None leaves out the
    log-likelihood. seed fixes every draw."""
    net, names, p = model.network, model.names, len(model.names)
    require_observed(net, "mcmle", missing)
    if tol is not None:
        warnings.warn("tol has no effect; use conv_threshold and hotelling_alpha", DeprecationWarning, stacklevel=2)
    if bridge_rungs is not None and bridge_rungs < 1:
        raise ValueError("bridge_rungs must be at least 1")
    burnin = 20 * net.n_dyads if burnin is None else burnin
    interval = max(100, net.n_dyads // 10) if interval is None else interval
    own = iter(seeds(seed, max_iter + 2))
    theta = mple(model).coefficients.copy()
    observed, chain = np.array(compute_all(net, model.terms)), bound_chain(net, model.terms)
    limit, gamma, converged = chi2_quantile(0.95, p), gamma0, False

    def sample(at: np.ndarray) -> np.ndarray:
        return sample_matrix(chains(net, chain, [{"chain": 1, "seed": next(own), "theta": at, "draws": n_samples, "burnin": burnin, "interval": interval}]), p)

    for _ in range(max_iter):
        drawn = sample(theta)
        diff, cov = observed - drawn.mean(0), np.atleast_2d(np.cov(drawn, rowvar=False))
        sd = np.sqrt(np.diag(cov))
        if (sd < 1e-8).any():
            warnings.warn(f"the sample of {', '.join(n for n, s in zip(names, sd) if s < 1e-8)} does not vary; the model may be degenerate", stacklevel=2)
        try:
            np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            warnings.warn("the covariance of the sample is singular; the fit stops here", stacklevel=2)
            break
        d2 = float(diff @ np.linalg.solve(cov, diff))
        gamma = 1.0 if d2 <= limit else float(np.clip(min(np.sqrt(limit / d2), 2 * gamma), 0.01, 1.0))
        if gamma == 1.0 and (np.abs(diff) / sd < conv_threshold).all() and hotelling_p(d2, sample_ess(drawn), p) > hotelling_alpha:
            converged = True
            break
        step = np.linalg.solve(cov, gamma * diff)
        theta = theta + step * min(1.0, max_step_norm / max(np.linalg.norm(step), 1e-300))
    drawn = sample(theta)
    cov = np.atleast_2d(np.cov(drawn, rowvar=False))
    try:
        if np.linalg.cond(cov) > 1e14:
            raise np.linalg.LinAlgError
        inverse = np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        warnings.warn("the covariance of the sample is singular; there are no standard errors", stacklevel=2)
        inverse = np.full((p, p), np.nan)
    loglik = np.nan if bridge_rungs is None else bridge_loglik(model, theta, bridge_rungs, bridge_samples or n_samples, burnin, interval, next(own), chain)
    return ERGMResult(model, theta, inverse, float(loglik), "mcmle", converged, drawn, "mcmc", "condition_on_face" if net.n_missing else "none")


def present_missing(net: Network) -> DataFrame:
    """(i, j) of the unobserved dyads that are stored as tied: their face value."""
    arcs = net.arcs.select("i", "j")
    return arcs.join(net.observed(arcs), ["i", "j"], "left_anti")


def independent_logz(model: ERGMModel, theta) -> float:
    """log of the normalizing constant for terms of single dyads, summed in Spark; masked dyads add their face value."""
    net, names = model.network, model.names
    eta = sum((float(b) * F.col(f"`{n}`") for b, n in zip(theta, names)), F.lit(0.0))
    total = float(mple_design(net, model.terms).agg(F.sum(F.col("n_tot") * log1pexp(eta))).first()[0] or 0.0)
    if net.n_missing:
        from arcweave.plans.design import change_stat_all

        face = present_missing(net).select("i", "j", F.lit(1).alias("y"), F.lit(0).alias("r"))
        total += float(change_stat_all(net, model.terms, face).agg(F.sum(eta)).first()[0] or 0.0)
    return total


def bridge_loglik(model: ERGMModel, theta, rungs: int = 16, samples: int = 1000, burnin: int | None = None, interval: int | None = None, seed: int | None = None, chain=None) -> float:
    """log-likelihood by path sampling from the dyad-independent part of theta, known exactly, to theta.

    The expected statistics at rungs + 1 points of the path come from as many chains of one job; a trapezoid sums them."""
    net = model.network
    theta = np.asarray(theta, float)
    if rungs < 1:
        raise ValueError("rungs must be at least 1")
    burnin = 20 * net.n_dyads if burnin is None else burnin
    interval = max(100, net.n_dyads // 10) if interval is None else interval
    dependent = np.array([t.dyad_dependent for t in model.terms])
    base = np.where(dependent, 0.0, theta)
    free = [k for k in range(len(theta)) if not dependent[k]]
    observed = np.array(compute_all(net, model.terms))
    if free:
        logz = independent_logz(ERGMModel([model.terms[k] for k in free], net), theta[free])
    else:
        logz = net.n_dyads * np.log(2.0)
    delta = theta - base
    if not delta.any():
        return float(theta @ observed - logz)
    chain = chain or bound_chain(net, model.terms)
    grid = np.linspace(0, 1, rungs + 1)
    rows = [{"chain": k, "seed": s, "theta": base + x * delta, "draws": samples, "burnin": burnin, "interval": interval} for k, (x, s) in enumerate(zip(grid, seeds(seed, rungs + 1)))]
    got = sample_means(chains(net, chain, rows), len(theta), rungs + 1)
    slope = got @ delta
    return float(theta @ observed - logz - ((slope[1:] + slope[:-1]) / 2 * np.diff(grid)).sum())


def sample_means(drawn, p: int, n: int) -> np.ndarray:
    """Mean statistics of each chain, averaged in Spark."""
    got = drawn.groupBy("chain").agg(*[F.avg(F.get("stats", F.lit(k))).alias(f"m{k}") for k in range(p)]).toPandas().sort_values("chain")
    return got[[f"m{k}" for k in range(p)]].to_numpy(float).reshape(n, p)
