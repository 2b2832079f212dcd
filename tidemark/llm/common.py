"""What the operators of this subpackage share: scratch tables, batch sizes, table access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark import reachable

#: Rows in an Arrow batch. Texts may be very long, so a batch is kept to a few hundred.
BATCH_ROWS = 512

_OWN: dict[str, str] = {}


class Cache(dict):
    """A bounded cache for a Python worker: what ``make`` gives for a string, looked up at the speed of a dictionary.

    When ``limit`` strings are held, they become the old generation, from which
    those still in use come back; strings over ``longest`` are made each time.
    """

    def __init__(self, make, limit: int = 250_000, longest: int = 64):
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = self.copy()
                self.clear()
            self[key] = out
        return out


_CLAIMED: dict[str, dict] = {}


def claim(name: str, held: dict | None = None) -> None:
    """Called by an operator's Python code when a task starts: what other operators keep in this worker is given up.

    Workers serve one stage after another; without this the caches of a whole pipeline would add up.
    """
    others = [d for n, d in _CLAIMED.items() if n != name and d]
    for d in others:
        d.clear()
    if held is not None:
        _CLAIMED[name] = held
    if others:
        gc.collect()
        _give_back()


def _give_back() -> None:
    """What this process has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for ``mapInArrow``, after which a worker keeps nothing that it no longer uses: idle workers stand beside the JVM of later stages."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return tidy


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: ``spark.checkpoint.dir``.

    Only where the setting is unset in a local session, as in tests, a temporary
    folder of this machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _OWN:
        _OWN["root"] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN["root"]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _remove(spark, path)
    except Exception:  # the session may be going away; scratch tables are then left to the folder's owner
        pass


_GATHERED: list[tuple[SparkSession, str]] = []


def forget() -> None:
    """Scratch tables made so far are not for ``release`` to remove."""
    _GATHERED.clear()


def release(kept: DataFrame) -> None:
    """Remove the scratch tables made since ``forget``, except those that a frame reads."""
    files = kept.inputFiles()
    for spark, path in list(_GATHERED):
        name = path.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in f for f in files):
            _remove_quietly(spark, path)
            _GATHERED.remove((spark, path))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the driver's Python ends."""
    path = f"{scratch_root(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    _GATHERED.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again.

    This cuts lineage: later stages survive lost executors without repeating
    what came before, and Python code before the cut runs once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialized frame that nothing reads any more."""
    _remove(df.sparkSession, df.scratch_path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session has its own setting; called before any Python code is planned."""
    reachable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
