"""What the operators share: column handling, Arrow batches, tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a local session names none (as in tests), a temporary one is set; on a cluster, that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="lodestar-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and any executor can read it.

    The folder goes when the driver's process ends, or with unstaged.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstaged(*frames: DataFrame | None) -> None:
    """Delete what staged has written for these frames, which nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            _drop(df.sparkSession, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20):
    """Arrow batches of so many rows and bytes at most, for what is run (not only planned) within."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended before
        pass


def others(df: DataFrame, *names: str) -> list[str]:
    """df's columns that don't carry one of names (an operator's results replace columns of the same name)."""
    low = {n.lower() for n in names}
    return [c for c in dict.fromkeys(df.columns) if c.lower() not in low]


def add_columns(
    df: DataFrame, inputs: list[str], start: Callable[[], Callable[..., list[pa.Array]]], fields: list[T.StructField], keep: list[str] | None = None
) -> DataFrame:
    """df's columns (or those of keep) and fields, made from the Arrow columns of inputs, batch by batch.

    start runs once in each task and returns the function of a batch. No shuffle; only the needed columns are scanned.
    """
    kept = [c for c in (others(df) if keep is None else keep) if c.lower() not in {f.name.lower() for f in fields}]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names = kept + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for b in batches:
            if b.num_rows:
                at = {n: i for i, n in enumerate(b.schema.names)}
                yield pa.RecordBatch.from_arrays([b.column(at[c]) for c in kept] + f(*(b.column(at[c]) for c in inputs)), names=names)

    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, *inputs]))).mapInArrow(run, schema)


_held: dict[str, Callable] = {}


def claim(owner: str, release: Callable | None = None) -> None:
    """Called by a task as it begins: what other operators keep in this Python worker for their next task goes.

    Workers serve many stages, and their caches would add up. release frees what the owner is going to keep.
    """
    others_ = [name for name in _held if name != owner]
    for name in others_:
        _held.pop(name)()
    if others_:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if release is not None:
        _held[owner] = release


class Memo(dict):
    """make(key), remembered in two generations of at most limit entries each."""

    def __init__(self, make: Callable, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
