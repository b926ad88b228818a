"""Statistics of a network kept up from a log of arc changes: an extension beside the batch plans.

A batch of changes costs what its neighbourhood costs. With T the ends of the dyads that change and W = T and the
neighbours of T, every sum over ties, degrees, triples or shared partners differs between the networks after and before
by as much as it does between the subnetworks that W induces: what meets no changed dyad is the same in both and cancels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcweave.network import Network
from arcweave.operators.base import Term, expanded
from arcweave.plans.design import compute_all
from arcweave.plans.scratch import removed, stored

PAIR, CHANGE = "i long, j long", "i long, j long, on boolean, batch long"


class KeptStats:
    """The arcs of a network by version, and its statistics after each batch of changes, as tables below `path`.

    `arcs-<b>` is a whole copy after batch b, made at the start (-1) and after every `compact` batches; `changes/batch=<b>`
    holds the dyads that batch b made tied or untied, `stats/batch=<b>` (place, term, value) the statistics after it.
    stats is written last and a batch reads only what earlier ones wrote, so a batch that is run again after a failure
    gives the same tables. An object on a path that has such tables goes on with them and with their vertices.

    Levels of attributes are those of the network at the start. Statistics of edge attributes can't be kept, as a
    change brings none. Values are sums of differences: exact for counts, else with the rounding of each batch."""

    def __init__(self, net: Network, terms: Iterable[Term], path: str, compact: int = 20):
        self.spark, self.directed, self.path, self.compact = net.spark, net.directed, path.rstrip("/"), compact
        self.terms = expanded(net, terms)
        named = [t.name for t in self.terms if t.required_edge_attributes]
        if named:
            raise ValueError(f"statistics of edge attributes can't be kept: {', '.join(named)}")
        try:
            self.last()
        except AnalysisException:
            net.vertices.write.mode("overwrite").parquet(f"{self.path}/vertices")
            net.arcs.select("i", "j").write.mode("overwrite").parquet(f"{self.path}/arcs--1")
            self.vertices = self.spark.read.parquet(f"{self.path}/vertices")
            self._write_stats(compute_all(self.network(-1), self.terms), -1)
        self.vertices = self.spark.read.parquet(f"{self.path}/vertices")

    def _write_stats(self, values: list[float], batch: int) -> None:
        rows = [(k, t.name, float(x)) for k, (t, x) in enumerate(zip(self.terms, values))]
        self.spark.createDataFrame(rows, "place int, term string, value double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/batch={batch}")

    def last(self) -> int:
        """The number of the last batch that is in the statistics; -1 before the first."""
        return int(self.spark.read.parquet(f"{self.path}/stats").agg(F.max("batch")).first()[0])

    def stats(self, batch: int | None = None) -> DataFrame:
        """(term, value) after that batch, by default the last."""
        rows = self.spark.read.parquet(f"{self.path}/stats/batch={self.last() if batch is None else batch}")
        return rows.orderBy("place").select("term", "value")

    def _base(self, batch: int) -> int:
        """The last whole copy at or before that batch."""
        return (batch + 1) // self.compact * self.compact - 1

    def _arcs(self, base: int, batch: int) -> DataFrame:
        """(i, j) after that batch: a whole copy and what changed since; a dyad is as its last change left it."""
        whole = self.spark.read.schema(PAIR).parquet(f"{self.path}/arcs-{base}")
        if base == batch:
            return whole
        paths = [f"{self.path}/changes/batch={b}" for b in range(base + 1, batch + 1)]
        log = self.spark.read.schema(CHANGE).option("basePath", f"{self.path}/changes").parquet(*paths)
        latest = log.groupBy("i", "j").agg(F.max_by("on", "batch").alias("on"))
        return whole.join(latest, ["i", "j"], "left_anti").union(latest.filter("on").select("i", "j"))

    def network(self, batch: int | None = None) -> Network:
        """As it was after that batch, by default the last."""
        batch = self.last() if batch is None else batch
        return Network(self.vertices, self._arcs(self._base(batch), batch), self.directed)

    def _effective(self, changes: DataFrame, before: DataFrame) -> DataFrame:
        """(i, j, on) of the dyads that the changes leave in another state than they had."""
        rows = changes.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.struct("at", "on").alias("last")).filter("i <> j and last.on is not null")
        if not self.directed:
            rows = rows.withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})
        rows = rows.groupBy("i", "j").agg(F.max("last").getField("on").alias("on"))
        for e in ("i", "j"):
            rows = rows.join(self.vertices.select(F.col("v").alias(e)), e, "left_semi")
        tied = rows.join(before.withColumn("was", F.lit(True)), ["i", "j"], "left")
        return tied.filter(F.col("on") != F.coalesce("was", F.lit(False))).select("i", "j", "on")

    def fold(self, changes: DataFrame, batch: int) -> None:
        """Takes in `changes` (at, i, j, on): `on` says whether the dyad is tied from `at` on.

        Of changes of one dyad the one with the greatest `at` counts (null comes first, of equal ones a tie wins), whatever
        their order in the table; repeated rows change nothing. Rows with a null i, j or on, loops and ends that are no
        vertices are left out, as are other columns; a table without rows keeps all as it was."""
        before = self._arcs(self._base(batch - 1), batch - 1)
        self._effective(changes, before).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        flips = self.spark.read.schema("i long, j long, on boolean").parquet(f"{self.path}/changes/batch={batch}")
        values = [r.value for r in self.stats(batch - 1).collect()]
        if not flips.isEmpty():
            ends = flips.select(F.col("i").alias("v")).union(flips.select("j")).distinct()
            near = [before.join(ends.toDF(e), e, "left_semi").select(F.col(o).alias("v")) for e, o in (("i", "j"), ("j", "i"))]
            inside, at = stored(ends.union(near[0]).union(near[1]).distinct())
            kept, own = stored(before.join(inside.toDF("i"), "i", "left_semi").join(inside.toDF("j"), "j", "left_semi").select("i", "j"))
            vertices = self.vertices.join(inside, "v", "left_semi")
            after = kept.join(flips, ["i", "j"], "left_anti").union(flips.filter("on").select("i", "j"))
            old, new = (compute_all(Network(vertices, a, self.directed), self.terms) for a in (kept, after))
            values = [x + n - o for x, n, o in zip(values, new, old)]
            removed(self.spark, at, own)
        if self._base(batch) == batch:
            self._arcs(self._base(batch - 1), batch).write.mode("overwrite").parquet(f"{self.path}/arcs-{batch}")
        self._write_stats(values, batch)

    def stream(self, changes: DataFrame, **trigger) -> StreamingQuery:
        """Starts a query that folds each micro-batch of the streaming table `changes`; `trigger` as DataStreamWriter has
        it, by default all that is there now. Its progress is kept below `path`, so a query that is started again goes on."""
        writer = changes.writeStream.foreachBatch(self.fold).option("checkpointLocation", f"{self.path}/progress")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
