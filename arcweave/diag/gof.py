"""Goodness of fit: an observed network's distributions beside those of networks simulated from the fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.diag.panels import degree_counts, distance_counts, shared_partner_counts
from arcweave.fit.model import ERGMResult
from arcweave.mcmc.sample import require_observed, sample_networks

STATS = ("degree", "idegree", "odegree", "esp", "distance")


def panel(counts: DataFrame, name: str, n_sim: int, labels: DataFrame) -> DataFrame:
    """(panel, label, observed, sim_mean, sim_min, sim_max, p_value) of (sim_id, label, c), sim_id 0 being observed.

    A network without a row for a label counts 0 there. p is two-sided and never 0."""
    own, sim = F.col("sim_id") == 0, F.col("sim_id") > 0
    obs = counts.filter(own).select("label", F.col("c").alias("observed"))
    met = labels.join(obs, "label", "left").fillna(0, ["observed"]).join(counts.filter(sim).select("label", "c"), "label", "left")
    each = met.groupBy("label", "observed").agg(F.count("c").alias("k"), F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count_if(F.col("c") <= F.col("observed")).alias("le"), F.count_if(F.col("c") >= F.col("observed")).alias("ge"))
    none = F.lit(n_sim) - F.col("k")  # networks that count 0
    le = F.col("le") + F.when(F.col("observed") >= 0, none).otherwise(0)
    ge = F.col("ge") + F.when(F.col("observed") <= 0, none).otherwise(0)
    p = F.least(F.lit(1.0), 2 * F.least((1 + le) / (n_sim + 1), (1 + ge) / (n_sim + 1)))
    low = F.when(none > 0, F.lit(0)).otherwise(F.col("lo"))
    return each.select(F.lit(name).alias("panel"), "label", "observed", (F.col("total") / n_sim).alias("sim_mean"), low.cast("long").alias("sim_min"), F.coalesce("hi", F.lit(0)).cast("long").alias("sim_max"), p.alias("p_value"))


@dataclass(frozen=True)
class GOFResult:
    panels: DataFrame
    names: list[str]
    n_sim: int

    def panel(self, name: str) -> DataFrame:
        return self.panels.filter(F.col("panel") == name).orderBy("label")

    def __str__(self) -> str:
        out = ["Goodness-of-fit assessment: ERGM"]
        for name in self.names:
            out += ["", f"{name:10}  {'obs':>8}  {'min':>8}  {'mean':>10}  {'max':>8}  MC p-value"]
            out += [f"{r.label:<10}  {r.observed:>8}  {r.sim_min:>8}  {r.sim_mean:>10.2f}  {r.sim_max:>8}  {r.p_value:.3f}" for r in self.panel(name).collect()]
        return "\n".join([*out, "", f"Based on {self.n_sim} simulated networks"])


def gof(result: ERGMResult, n_sim: int = 100, stats=("degree", "esp", "distance"), burnin: int = 10_000, interval: int = 1000, seed: int | None = None, n_chains: int | None = None, esp_type: str = "OTP", missing: str = "error") -> GOFResult:
    """Panels of the statistics; `degree` of a directed network becomes idegree and odegree."""
    net = result.model.network
    if unknown := [s for s in stats if s not in STATS]:
        raise ValueError(f"unknown statistics {', '.join(unknown)}; there are {', '.join(STATS)}")
    if n_sim < 1:
        raise ValueError("n_sim must be at least 1")
    require_observed(net, "gof", missing)
    sims = sample_networks(result.model, result.coefficients, n_sim, burnin, interval, seed, n_chains=n_chains, missing=missing, warn=False)
    every = sims.unionByName(net.arcs.select(F.lit(0).alias("sim_id"), "i", "j")).cache()
    ids = net.spark.range(n_sim + 1).select(F.col("id").cast("int").alias("sim_id"))
    names = []
    for s in stats:
        names += ["idegree", "odegree"] if s == "degree" and net.directed else [s]
    if not net.directed and {"idegree", "odegree"} & set(names):
        raise ValueError("idegree and odegree need a directed network")
    made = None
    for name in names:
        if name == "esp":
            counts, first = shared_partner_counts(every, net.directed, esp_type), 0
        elif name == "distance":
            counts, first = distance_counts(every, net.vertices, net.directed), 1
        else:
            counts, first = degree_counts(every, net.vertices, net.directed, name, ids), 0
        counts = counts.cache()
        top = net.n - 1 if "degree" in name else int(counts.agg(F.max("label")).first()[0] or first)
        own = panel(counts, name, n_sim, net.spark.range(first, top + 1).withColumnRenamed("id", "label"))
        made = own if made is None else made.unionByName(own)
    return GOFResult(made, names, n_sim)
