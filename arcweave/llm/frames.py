"""Small helpers shared by the text operators: reading tables, shared scratch tables, Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside joins and orders: such rows come last and equal each other.
NULL_ID = (1 << 63) - 1
#: Bytes of text that one numpy step holds at most (a longer text is a step of its own).
SLICE_BYTES = (1 << 20) - 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and all tasks
    run in the driver's own process; on a cluster without it this raises."""
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


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    return stored(df)[0]


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that stored() has made; all that came of them must have been written by then."""
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


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of `df` is called so."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of at most `rows` rows in this session, a fifth of Spark's default: whole texts and sets of shingles
    are a few kB each, so JVM and Python workers hold a few MB for a batch. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def lean(run: Callable) -> Callable:
    """The function, for mapInArrow, that at its end gives memory it has freed back to the system: Spark keeps Python workers
    for the stages that follow, and what an idle one holds counts against its executor."""

    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return own


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of the string column, null as empty, about `limit` bytes at a time."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def pressed(batches):
    """mapInArrow: the text column as zstd blobs, for shuffles; other columns stay."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        at = b.schema.get_field_index("text")
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            blob = pa.array([press.compress(x.encode()) for x in part.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([blob if i == at else part.column(i) for i in range(part.num_columns)], schema=part.schema.set(at, pa.field("text", pa.binary())))


def unpressed(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What slices() gives, from a column of zstd blobs."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    col = batch.column(batch.schema.get_field_index(name))
    lo, held, size = 0, [], 0
    for r, x in enumerate(col):
        held.append(press.decompress(x.as_py()))
        size += len(held[-1])
        if size >= limit or r + 1 == len(col):
            off = np.zeros(len(held) + 1, np.int64)
            np.cumsum([len(t) for t in held], out=off[1:])
            yield lo, r + 1, np.frombuffer(b"".join(held), np.uint8), off
            lo, held, size = r + 1, [], 0
