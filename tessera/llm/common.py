"""What the operators of this subpackage share: reading tables, the shared folder, tables written between steps."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import DataType

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, and in local mode, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def settle(spark: SparkSession) -> None:
    """Batches of few rows and bytes from Parquet and to Python, where the session doesn't say: texts may be very long, and a batch
    of them lies in memory on both sides."""
    for key, few in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4194304"), ("spark.sql.parquet.columnarReaderBatchSize", "256")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, few)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives the loss of executors. Row groups are small, as a task holds one in memory."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again, and lets Spark delete the shuffle files of what is written."""
    for t in tables:
        spark = t.sparkSession
        if jvm := getattr(getattr(spark, "_sc", None), "_jvm", None):
            path = jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(spark._sc._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        unused(tables[0].sparkSession)


def unused(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: else they stay until the driver collects its garbage."""
    gc.collect()
    if jvm := getattr(getattr(spark, "_sc", None), "_jvm", None):
        jvm.System.gc()


_HELD: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one thing at a time, so that workers that Spark uses again don't pile up models."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Lets go of what the worker holds for other steps."""
    _HELD.clear()


def trim() -> None:
    """Gives memory that this worker no longer uses back to the system: Spark keeps workers for later steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, after which the worker gives its memory back; models that held() has stay for the next task."""

    @functools.wraps(run)
    def go(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return go


def lean_alone(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """As lean(), of a step without a model: the worker lets go of other steps' models first."""

    @functools.wraps(run)
    def go(batches: Iterator) -> Iterator:
        forget()
        yield from run(batches)
        trim()

    return go


def lean_udf(f: Callable, kind: str | DataType) -> Callable:
    """A Pandas UDF of f, which takes batches of columns; the worker gives its memory back after the last."""

    def run(batches):
        for x in batches:
            yield f(*x) if isinstance(x, tuple) else f(x)
        trim()

    return F.pandas_udf(run, kind, PandasUDFType.SCALAR_ITER)


def crc_mod(column: str, n: int) -> str:
    """SQL of crc32(column as text) mod n; a null column counts as the empty text."""
    return f"crc32(cast(coalesce(cast({column} as string), '') as binary)) % {n}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name a column name that df has not, without regard to case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
