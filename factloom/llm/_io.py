"""Tables between the jobs of one operator, kept where every executor can read them."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary folder in local mode, else an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where new_path makes folders while a scratch folder is open.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)
#: Spark then drops a query's shuffle files at its end; of a stored table none is read again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock = threading.Lock()
#: Writes under way in each session, and the setting before the first of them.
_writes: dict[int, tuple[int, str]] = {}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any write of this session is under way, also of several threads."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _writes.get(key) or (0, spark.conf.get(_CLEANUP, "false"))
        _writes[key] = (n + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writes.pop(key)
            if n > 1:
                _writes[key] = (n - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables that are stored meanwhile go at the end, but those stored with keep."""
    path = new_path(spark, label)
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write once and read back: later jobs reuse the rows, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}" if keep else new_path(spark, label)
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash with them."""
    return df.select(*(df[name].alias(alias) for alias, name in columns.items()))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def release() -> None:
    """Gives the process's free memory back: a worker's at the end of a task, the driver's after a fit. Idle processes keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_text(kind: str, judge: Callable[[], Callable[[pa.Array], pa.Array]]) -> Callable[[Column], Column]:
    """A column of type ``kind`` from a text column. judge() runs once a task; what it returns maps a batch of texts.

    Only the texts go to the workers and only the results come back; the rows' other columns
    stay in the JVM.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = judge()
        for texts in batches:
            yield one(texts)
        del one
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)
