"""Formulas, models bound to a network, and fitted results."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from arcweave.functions.special import two_sided_p
from arcweave.network import Network
from arcweave.operators.base import Term, TermSet, expanded, is_dyad_dependent


@dataclass(frozen=True)
class ERGMFormula:
    terms: TermSet
    constraints: tuple = ()

    def __init__(self, terms: Iterable[Term], constraints: Iterable = ()):
        object.__setattr__(self, "terms", terms if isinstance(terms, TermSet) else TermSet(terms))
        object.__setattr__(self, "constraints", tuple(constraints))


class ERGMModel:
    """A formula whose terms are checked against a network and expanded to one for each statistic."""

    reference = "bernoulli"

    def __init__(self, formula: ERGMFormula | Iterable[Term], network: Network):
        formula = formula if isinstance(formula, ERGMFormula) else ERGMFormula(formula)
        self.network = network
        self.formula = ERGMFormula(expanded(network, formula.terms), formula.constraints)

    @property
    def terms(self) -> TermSet:
        return self.formula.terms

    @property
    def names(self) -> list[str]:
        return self.terms.names

    @property
    def dyad_dependent(self) -> bool:
        return is_dyad_dependent(self.terms)


def _stars(p: float) -> str:
    return "" if math.isnan(p) else next((s for limit, s in ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, ".")) if p < limit), "")


@dataclass(frozen=True)
class ERGMResult:
    model: ERGMModel
    coefficients: np.ndarray
    vcov: np.ndarray
    loglik: float
    method: str
    converged: bool
    mcmc_samples: np.ndarray | None = None
    se_type: str = "hessian"
    missing_method: str = "none"
    std_errors: np.ndarray = field(init=False)

    def __post_init__(self):
        with np.errstate(invalid="ignore"):
            object.__setattr__(self, "std_errors", np.sqrt(np.diag(self.vcov)))

    @property
    def z_values(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.coefficients / self.std_errors

    @property
    def p_values(self) -> np.ndarray:
        return np.array([two_sided_p(float(z)) for z in self.z_values])

    @property
    def nobs(self) -> int:
        return self.model.network.n_dyads

    @property
    def dof(self) -> int:
        return len(self.coefficients)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.dof

    @property
    def bic(self) -> float:
        return -2 * self.loglik + self.dof * math.log(max(self.nobs, 1))

    @property
    def estimand(self) -> str:
        return "ergm"

    @property
    def objective(self) -> str:
        return "pseudolikelihood" if self.method == "mple" else "mc_likelihood"

    @property
    def is_exact(self) -> bool:
        """Whether the fit maximizes the likelihood itself."""
        return self.method == "mple" and not self.model.dyad_dependent

    @property
    def se_method(self) -> str:
        return "fisher" if self.se_type == "mcmc" else self.se_type

    @property
    def tie_method(self) -> str:
        return "not_applicable"

    @property
    def approximations(self) -> list[str]:
        out = []
        if self.method == "mple" and self.model.dyad_dependent:
            out.append("the pseudolikelihood stands in for the likelihood of a dyad-dependent model")
            if self.se_type == "hessian":
                out.append("standard errors from the pseudolikelihood's Hessian are typically anticonservative")
        if self.method == "mcmle":
            out.append("estimates and log-likelihood carry Monte-Carlo error")
        if self.missing_method == "condition_on_face":
            out.append("unobserved dyads are held at their face value")
        return out

    def fit_metadata(self) -> dict:
        return {k: getattr(self, k) for k in ("estimand", "objective", "is_exact", "se_method", "missing_method", "tie_method", "approximations")}

    def coef_table(self, spark: SparkSession) -> DataFrame:
        """(term, estimate, std_error, z_value, p_value)."""
        rows = [(n, *map(float, x)) for n, x in zip(self.model.names, np.stack([self.coefficients, self.std_errors, self.z_values, self.p_values], axis=1))]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, z_value double, p_value double")

    def __str__(self) -> str:
        out = [f"ERGM fit by {self.method}", f"Dyads: {self.nobs}"]
        if self.model.network.n_missing:
            how = {"available_case": "available-case (left out of the pseudolikelihood)", "condition_on_face": "held at their face values"}
            out.append(f"Missing dyads: {self.model.network.n_missing} masked; {how.get(self.missing_method, self.missing_method)}")
        out += [f"Log-likelihood: {self.loglik:.4f}", f"AIC: {self.aic:.2f}, BIC: {self.bic:.2f}", f"Converged: {self.converged}", "", "Coefficients:"]
        width = max(len(n) for n in self.model.names)
        out.append(f"{'':{width}}  {'Estimate':>10}  {'Std.Error':>10}  {'z value':>8}  {'Pr(>|z|)':>9}")
        for n, b, s, z, p in zip(self.model.names, self.coefficients, self.std_errors, self.z_values, self.p_values):
            out.append(f"{n:{width}}  {b:>10.4f}  {s:>10.4f}  {z:>8.3f}  {p:>9.3g} {_stars(p)}".rstrip())
        out.append("Signif. codes: 0 '***' 0.001 '**' 0.01 '*' 0.05 '.' 0.1 ' ' 1")
        if self.method == "mple" and self.model.dyad_dependent:
            errors = "come from a parametric bootstrap, but the estimates may be biased" if self.se_type == "bootstrap" else "are suspect (typically anticonservative); method='mcmle' or se='bootstrap' is safer"
            out += ["", f"Note: dyad-dependent terms were fitted by maximum pseudolikelihood; the standard errors {errors}."]
        return "\n".join(out)


def coef(r: ERGMResult) -> np.ndarray:
    return r.coefficients


def stderror(r: ERGMResult) -> np.ndarray:
    return r.std_errors


def vcov(r: ERGMResult) -> np.ndarray:
    return r.vcov


def loglikelihood(r: ERGMResult) -> float:
    return r.loglik


def aic(r: ERGMResult) -> float:
    return r.aic


def bic(r: ERGMResult) -> float:
    return r.bic


def nobs(r: ERGMResult) -> int:
    return r.nobs


def dof(r: ERGMResult) -> int:
    return r.dof


def fit_metadata(r: ERGMResult) -> dict:
    return r.fit_metadata()
