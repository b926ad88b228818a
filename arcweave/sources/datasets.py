"""Bundled data and readers."""

from __future__ import annotations

import tomllib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arcweave.network import Network

# Marriage ties and wealth of 16 Florentine families, a published data set.
FLORENTINE_TIES = [(1, 9), (2, 6), (2, 7), (2, 9), (3, 5), (3, 9), (4, 7), (4, 11), (4, 15), (5, 11), (5, 15), (7, 8), (7, 16), (9, 13), (9, 14), (9, 16), (10, 14), (11, 15), (13, 15), (13, 16)]
FLORENTINE_WEALTH = [10, 36, 55, 44, 20, 32, 8, 42, 103, 48, 49, 3, 27, 10, 146, 48]


def load_dataset(spark: SparkSession, name: str) -> Network:
    if name != "florentine_marriage":
        raise ValueError(f"no dataset {name!r}; there is florentine_marriage")
    return Network.from_edges(spark, 16, FLORENTINE_TIES, directed=False, attributes={"wealth": [float(w) for w in FLORENTINE_WEALTH]})


def load_golden(path: str) -> dict:
    """Pinned values of a TOML file, a dictionary for each of its tables; an unreadable file raises."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def read_network(spark: SparkSession, vertices: str, arcs: str, directed: bool = True, missing: str | None = None, format: str = "parquet", **options) -> Network:
    """A network from stored tables in any format Spark reads; vertices need v, arcs and missing i and j."""
    read = lambda path: spark.read.options(**options).format(format).load(path)
    return Network(read(vertices), read(arcs), directed, read(missing) if missing else None)


def write_network(net: Network, folder: str, format: str = "parquet") -> None:
    """vertices, arcs and, if any, missing, each as a table below the folder."""
    if net.rule:
        raise ValueError("a rule for unobserved dyads is no table; give it again with the network that is read")
    net.vertices.write.mode("overwrite").format(format).save(f"{folder}/vertices")
    net.arcs.write.mode("overwrite").format(format).save(f"{folder}/arcs")
    if net.missing is not None:
        net.missing.write.mode("overwrite").format(format).save(f"{folder}/missing")


def covariate(spark: SparkSession, matrix, ids=None):
    """(i, j, x) of a square matrix's non-zero entries, vertex ids from 1 unless given."""
    import numpy as np

    m = np.asarray(matrix, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValueError("a covariate matrix must be square")
    ids = list(range(1, len(m) + 1)) if ids is None else list(ids)
    rows = [(int(ids[a]), int(ids[b]), float(m[a, b])) for a, b in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "i long, j long, x double").filter(F.col("x") != 0)
