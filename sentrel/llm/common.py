"""What the operators share: table access, the shared folder, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go if the session names no shared folder (tests, local mode).
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode a folder of this machine where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="sentrel-"))


def free(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Scratch:
    """Tables written to the shared folder, to cut lineage in a way that survives a lost executor. What is left of them goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path, system = self._path(self.root)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return what reads it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them."""
        path, system = self._path(f"{self.root}/{name}" if name else self.root)
        system.delete(path, True)


#: What a Python worker keeps between tasks: one operator's model at a time, so that the operators' models don't add up.
_model: dict[str, object] = {}


def kept_model(key: str, build):
    """The model of that key, built if the worker doesn't have it."""
    if key not in _model:
        release()
        _model[key] = build()
    return _model[key]


def release() -> None:
    """Drop the kept model, and give back to the system what a reused worker no longer needs (Arrow's pool, the C library's free pages)."""
    import pyarrow as pa

    if _model:
        _model.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches(it, cap: int = 1 << 23, model: str | None = None):
    """Arrow batches of text columns, re-cut so that no batch holds much more than ``cap`` bytes (one row at least).

    A model that another operator left in the worker goes first; ``model`` is the key of the one in use.
    """
    if model not in _model:
        release()
    for b in it:
        if b.nbytes <= cap or b.num_rows <= 1:
            yield b
        else:
            rows = max(1, int(b.num_rows * cap / b.nbytes))
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
