"""Statistical analysis of networks as Spark jobs: terms, fits, simulation and diagnostics."""

from arcweave.diag.gof import GOFResult, gof
from arcweave.diag.traces import mcmc_diagnostics
from arcweave.fit.mcmle import bridge_loglik, mcmle
from arcweave.fit.model import ERGMFormula, ERGMModel, ERGMResult, aic, bic, coef, dof, fit_metadata, loglikelihood, nobs, stderror, vcov
from arcweave.fit.mple import ergm, fit_ergm, mple
from arcweave.fit.newton import logistic_derivatives, newton_fit
from arcweave.mcmc.sample import mh_sample, sample_networks, simulate_ergm
from arcweave.network import Network
from arcweave.operators.base import PairTerm, Term, TermSet, is_dyad_dependent, required_edge_attributes, required_vertex_attributes, requires_directed, requires_undirected
from arcweave.operators.nodal import AbsDiff, EdgeCov, NodeCov, NodeFactor, NodeMatch, NodeMismatch, NodeMix
from arcweave.operators.structural import GWDSP, GWESP, Degree, Edges, GWDegree, GWIDegree, GWODegree, IDegree, Kstar, Mutual, ODegree, Triangle, TwoPath
from arcweave.plans.design import change_stat, change_stat_all, compute, compute_all, mple_design, summary_stats
from arcweave.sources.datasets import covariate, load_dataset, load_golden, read_network, write_network

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("diag", "fit", "functions", "mcmc", "network", "operators", "plans", "sources")]
