"""Diagnostics of ordered traces: in numpy for a fit's own sample, in Spark for stored traces of any length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.fit.model import ERGMResult
from arcweave.functions.special import two_sided_p
from arcweave.plans.scratch import removed, stored, with_row_numbers


def autocovariance(x: np.ndarray) -> np.ndarray:
    """At every lag, divided by n."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x - x.mean(), size)
    return np.fft.irfft(f * np.conj(f), size)[:n] / n


def geyer_variance(x) -> float:
    """Long-run variance by the initial monotone sequence: sums of neighbouring lags while positive, never rising."""
    x = np.asarray(x, float)
    g = autocovariance(x)
    if np.ptp(x) == 0:
        return 0.0
    pairs = g[: len(g) // 2 * 2].reshape(-1, 2).sum(1)
    stop = np.flatnonzero(pairs <= 0)
    pairs = np.minimum.accumulate(pairs[: stop[0]] if len(stop) else pairs)
    return float(2 * pairs.sum() - g[0])


def geyer_ess(x) -> float:
    """Independent draws that the trace is worth; its length where it doesn't vary."""
    x = np.asarray(x, float)
    var = geyer_variance(x)
    return float(len(x) * x.var() / var) if var > 0 and np.ptp(x) > 0 else float(len(x))


def geweke_z(x, first: float = 0.1, last: float = 0.5) -> float:
    """How far the means of the beginning and the end lie apart, in standard errors."""
    x = np.asarray(x, float)
    a, b = x[: max(2, int(first * len(x)))], x[len(x) - max(2, int(last * len(x))) :]
    se = np.sqrt(max(geyer_variance(a), 0) / len(a) + max(geyer_variance(b), 0) / len(b))
    gap = a.mean() - b.mean()
    if se == 0:
        return 0.0 if gap == 0 else float("inf")
    return float(gap / se)


def autocorrelation(x) -> float:
    """At lag 1; 0 for a trace that doesn't vary."""
    x = np.asarray(x, float) - np.mean(x)
    total = float(x @ x)
    return float(x[1:] @ x[:-1] / total) if total > 0 else 0.0


def mcmc_diagnostics(result: ERGMResult) -> dict:
    if result.mcmc_samples is None:
        raise ValueError(f"this fit has no MCMC sample: it was made by {result.method}; refit with method='mcmle'")
    x = result.mcmc_samples
    rho = np.array([autocorrelation(c) for c in x.T])
    with np.errstate(divide="ignore"):
        ess = np.where(np.abs(rho) < 1, len(x) * (1 - rho) / (1 + rho), len(x))
    z = np.array([geweke_z(c) for c in x.T])
    return {
        "term_names": result.model.names, "autocorrelation": rho, "effective_sample_size": ess, "ess_geyer": np.array([geyer_ess(c) for c in x.T]),
        "geweke_z": z, "geweke_p": np.array([two_sided_p(float(v)) for v in z]), "n_samples": len(x),
    }


def numbered(rows: DataFrame, stat: str, order: list[str]) -> DataFrame:
    """Adds draw (from 1) and n, the length of the row's trace, in order. Ranges of all traces are sorted apart and
    numbered by how many rows come before each, so neither a trace nor a stretch of it meets in one task."""
    return with_row_numbers(rows, order, [stat], "draw", "n").withColumn("draw", F.col("draw") + 1)


def lagged(trace: DataFrame, stat: str, value: str, lags: list[int]) -> DataFrame:
    """(stat, lag, g): autocovariances at the lags, divided by n, of a numbered trace. Rows meet by their numbers."""
    mean = trace.groupBy(stat).agg(F.avg(value).alias("mean"))
    own = trace.join(mean, stat).select(stat, "draw", "n", (F.col(value) - F.col("mean")).alias("x"))
    far = own.select(stat, "draw", "n", "x", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    near = own.select(stat, F.col("draw").alias("at"), F.col("x").alias("z"))
    met = far.withColumn("at", F.col("draw") + F.col("lag")).join(near, [stat, "at"])
    return met.groupBy(stat, "lag").agg((F.sum(F.col("x") * F.col("z")) / F.max("n")).alias("g"))


def thinned(trace: DataFrame, burnin: int, interval: int) -> DataFrame:
    return trace.filter((F.col("draw") > burnin) & ((F.col("draw") - burnin) % interval == 0))


def segments(trace: DataFrame, stat: str, value: str, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """(stat, n_first, mean_first, n_last, mean_last): the parts that geweke_z compares."""
    size = lambda share: F.greatest(F.lit(2), F.floor(F.col("n") * share))
    head, tail = F.col("draw") <= size(first), F.col("draw") > F.col("n") - size(last)
    return trace.groupBy(stat).agg(F.count_if(head).alias("n_first"), F.avg(F.when(head, F.col(value))).alias("mean_first"), F.count_if(tail).alias("n_last"), F.avg(F.when(tail, F.col(value))).alias("mean_last"))


#: Draws of a segment in the first pass over a trace, which gives as many lags; most draws of a segment in the second;
#: lags that the driver takes at most.
SEGMENT, LARGEST, DRIVER_LAGS = 4_096, 1 << 20, 10_000_000


def _products(size: int):
    """Of segments x (lag 0 on) and z, `apart` segments later: sums of x[t] z[t + lag] by lag, added up over a task, by
    one product of Fourier transforms each; given out in stretches of lags."""
    wide = 1 << (2 * size - 1).bit_length()

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for stat, apart, x, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, z = x.values.to_numpy(zero_copy_only=False), z.values.to_numpy(zero_copy_only=False)
                got = np.fft.irfft(np.conj(np.fft.rfft(x, wide)) * np.fft.rfft(z, wide), wide)
                # lags -(size - 1) to size - 1 within the pair of segments
                own = sums.setdefault((stat, apart), np.zeros(2 * size - 1))
                own += np.concatenate([got[wide - size + 1 :], got[:size]])
        for (stat, apart), own in sums.items():
            lag = np.arange(2 * size - 1) - (size - 1) + apart * size
            first = int(np.searchsorted(lag, 0))
            for lo in range(first, len(lag), 65_536):
                at = slice(lo, lo + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array([stat] * len(lag[at])), pa.array(lag[at]), pa.array(own[at])], ["stat", "lag", "p"])

    return run


def autocovariances(trace: DataFrame, stat: str, value: str, size: int, segments: int = 1) -> DataFrame:
    """(stat, lag, g): autocovariances of numbered traces, divided by n, at all lags below size * segments.

    Traces are cut into segments of `size` draws; each is multiplied with itself and the next ones, all lags at once by
    Fourier transforms, so one pass and one shuffle of the trace give every lag."""
    kind = trace.schema[stat].dataType.simpleString()
    mean = trace.groupBy(stat).agg(F.avg(value).alias("mean"), F.max("n").alias("size_"))
    part = F.floor((F.col("draw") - 1) / size)
    cut = trace.join(mean, stat).groupBy(stat, part.alias("b")).agg(F.sort_array(F.collect_list(F.struct("draw", (F.col(value) - F.col("mean")).alias("x")))).alias("s")).select(stat, "b", F.col("s.x").alias("x"))
    cut, path = stored(cut)
    near = cut.select(stat, "b", "x", F.explode(F.sequence(F.lit(0), F.lit(segments))).alias("apart"))
    met = near.join(cut.select(F.col(stat).alias("other"), F.col("b").alias("c"), F.col("x").alias("z")), (F.col(stat) == F.col("other")) & (F.col("b") + F.col("apart") == F.col("c")))
    sums = met.select(stat, "apart", "x", "z").mapInArrow(_products(size), f"stat {kind}, lag long, p double").groupBy("stat", "lag").agg(F.sum("p").alias("p"))
    got, _ = stored(sums.join(mean.withColumnRenamed(stat, "stat"), "stat").filter((F.col("lag") < size * segments) & (F.col("lag") < F.col("size_"))).select(F.col("stat").alias(stat), "lag", (F.col("p") / F.col("size_")).alias("g")))
    removed(trace.sparkSession, path)
    return got


def _positive_pairs(g: DataFrame, stat: str, base: dict) -> dict:
    """For each trace its variance, the sums of neighbouring lags before the first that is not positive, and whether there is such a one."""
    pairs = g.groupBy(stat, F.floor(F.col("lag") / 2).alias("k")).agg(F.sum("g").alias("s"), F.max(F.when(F.col("lag") == 0, F.col("g"))).alias("g0"))
    stop = pairs.groupBy(stat).agg(F.min(F.when(F.col("s") <= 0, F.col("k"))).alias("stop"))
    rows = pairs.join(stop, stat).filter("stop is null or k < stop or k = 0").select(stat, "k", "s", "g0", "stop").limit(DRIVER_LAGS + 1).toPandas()
    if len(rows) > DRIVER_LAGS:
        raise ValueError(f"long-run variances of more than {DRIVER_LAGS} pairs of lags")
    out = {}
    for name, own in rows.sort_values("k").groupby(stat):
        ended = bool(own.stop.notna().any())
        last = own.stop.iloc[0] if ended else base[name].n // 2  # an odd trace's last lag has no neighbour
        out[name] = (float(own.g0.iloc[0]), own.s[own.k < last].to_numpy(float), ended)
    return out


def long_runs(trace: DataFrame, stat: str, value: str, size: int = SEGMENT) -> dict:
    """For each numbered trace: (n, mean, variance, long-run variance), the last as geyer_variance has it.

    One pass gives the first `size` lags of all traces, which end most; a second one, over those that it does not end,
    gives all lags. The driver gets the sums of neighbouring lags up to the first that is not positive."""
    got = trace.groupBy(stat).agg(F.max("n").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
    base = {r[stat]: r for r in got}
    moving = [k for k, r in base.items() if r.low != r.high]
    found = _positive_pairs(autocovariances(trace.filter(F.col(stat).isin(moving)), stat, value, size), stat, base) if moving else {}
    open_ = [k for k in moving if not found[k][2] and base[k].n > size]
    if open_:
        longest = max(base[k].n for k in open_)
        wide = min(LARGEST, max(size, 1 << int(np.ceil(np.log2(8 * np.sqrt(longest))))))
        found |= _positive_pairs(autocovariances(trace.filter(F.col(stat).isin(open_)), stat, value, wide, -(-longest // wide)), stat, base)
    out = {}
    for k, r in base.items():
        if k not in found:
            out[k] = (int(r.n), float(r["mean"]), 0.0, 0.0)
            continue
        g0, pairs, _ = found[k]
        out[k] = (int(r.n), float(r["mean"]), g0, float(2 * np.minimum.accumulate(pairs).sum() - g0))
    return out


def trace_ess(trace: DataFrame, stat: str, value: str) -> DataFrame:
    """(stat, n, ess) of numbered traces: geyer_ess of each."""
    rows = [(k, n, n * var / own if own > 0 and var > 0 else float(n)) for k, (n, _, var, own) in long_runs(trace, stat, value).items()]
    return trace.sparkSession.createDataFrame(rows, f"{stat} {trace.schema[stat].dataType.simpleString()}, n long, ess double")


def trace_geweke(trace: DataFrame, stat: str, value: str, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """(stat, z) of numbered traces: geweke_z of each."""
    size = lambda share: F.greatest(F.lit(2), F.floor(F.col("n") * share).cast("long"))
    head = trace.filter(F.col("draw") <= size(first)).withColumn("n", size(first))
    gap = F.col("n") - size(last)
    tail = trace.filter(F.col("draw") > gap).withColumns({"draw": F.col("draw") - gap, "n": size(last)})
    a, b = long_runs(head, stat, value), long_runs(tail, stat, value)
    rows = []
    for k in a:
        se = float(np.sqrt(max(a[k][3], 0) / a[k][0] + max(b[k][3], 0) / b[k][0]))
        diff = a[k][1] - b[k][1]
        rows.append((k, diff / se if se else 0.0 if diff == 0 else float("inf")))
    return trace.sparkSession.createDataFrame(rows, f"{stat} {trace.schema[stat].dataType.simpleString()}, z double")
