"""Tables between the steps of a long computation, in the folder that driver and executors share; and row numbers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one is set here only where it is unset and all tasks run in the driver's own
    process. On a cluster without it this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='arcweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written as Parquet in the shared folder and read back, and where it lies: for removed(), once nothing reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that stored() has made, in whatever store they lie."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared(spark: SparkSession):
    """Queries made and run in here leave no shuffle files behind, instead of some until the JVM next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def with_row_numbers(rows: DataFrame, order: list[str], within: list[str] | None = None, row: str = "row", total: str | None = None) -> DataFrame:
    """Adds the row's number from 0 in the order of the columns `order`, for each value of the columns `within` if given,
    and with `total` how many rows that value has. Rows that are equal in all of these follow each other in any order.

    The rows are dealt to ranges of (within, order), sorted there and written once with their place in the part; what
    comes before each part is a sum over one row for each part and value. So no value, however frequent, meets in one task."""
    keys = within or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed, _ = stored(dealt.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    own = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__c").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__own"), (before - F.col("__first")).alias("__ahead"), F.sum("__c").over(own).alias("__n"))
    same = F.col("__part") == F.col("__own")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return placed.join(ahead, same).select(*rows.columns, (F.col("__ahead") + F.col("__at")).alias(row), *([F.col("__n").alias(total)] if total else []))
