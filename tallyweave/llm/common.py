"""Helpers that several operators share: tables, scratch space, splits, ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WHITE = r"\x20\x09-\x0D"
#: Rows that one window task of :func:`salted_rank` should sort.
ROWS_PER_SALT = 100_000


#: Rows of whole texts that go to a Python worker at once, unless the session says otherwise: ten
#: thousand, Spark's default, may hold a gigabyte of long texts, in the JVM and in the worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows of an Arrow batch to BATCH_ROWS where they are Spark's default."""
    if int(spark.conf.get(_BATCH)) == 10_000:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; columns beyond the known five are left out by name."""
    return table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


@functools.cache
def _own_scratch() -> str:
    path = tempfile.mkdtemp(prefix="tallyweave-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this process in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or _own_scratch()


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once into the shared scratch folder and read it back: lineage is cut there,
    a lost executor costs no recomputation, and the planner knows the real size."""
    small_batches(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/tallyweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a Python worker process keeps from task to task.
_KEPT: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """One object for each Python worker process, kept across the tasks that ask for it; a task that
    asks for another one, or a :func:`worker_pass` without any, drops it."""
    if name not in _KEPT:
        _forget()
        _KEPT[name] = make()
    return _KEPT[name]


def _forget() -> None:
    """Drops what earlier stages left in this worker, and gives the memory back to the system."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def worker_pass(run: Callable[[Iterator], Iterator], cached: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, in a worker that holds nothing of other stages before it, unless
    it has a cache of its own (``cached``), and no spare memory after it."""

    def whole(batches: Iterator) -> Iterator:
        if not cached:
            _forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def salts_for(n_rows: int) -> int:
    return max(8, -(-n_rows // ROWS_PER_SALT))


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], salts: int, name: str = "rank", salt: Column | None = None) -> DataFrame:
    """Gapless rank from 0 within ``keys``, without one task ever holding a whole key.

    Rows of a key are dealt over ``salts`` by a hash of ``order`` and numbered within each
    salt; small counts by (key, salt) give every salt its first number. ``order`` should tell
    the rows of a key apart; fully equal rows of a key share a salt and are numbered anyhow.
    A ``salt`` that rises with ``order`` (0 to ``salts`` - 1) makes the rank follow that order.
    """
    dealt = df.withColumn("_salt", (F.pmod(F.xxhash64(*order), F.lit(salts)) if salt is None else salt).cast("int"))
    counts = dealt.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_salt") == F.col("_s")]
    joined = numbered.join(first, functools.reduce(Column.__and__, on))
    return joined.withColumn(name, (F.col("_first") + F.col("_row") - 1).cast("long")).drop("_salt", "_row", "_first", "_s", *[f"_k_{k}" for k in keys])
