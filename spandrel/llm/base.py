"""What the operators of this subpackage share: reading, cutting lineage, shipping code."""

from __future__ import annotations

import functools
import inspect
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: The same characters as a plain string, for translate().
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(*modules: str) -> None:
    """Send these modules' code along with the functions that use them, so that executors need no copy of the package."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Where the session names none, a folder of our own is set on one machine only;
    on a cluster executors would not see each other's files there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_leftovers(spark: SparkSession):
    """Plans made here drop their shuffle files once they have run: what they result in is written, so nothing asks for them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder.

    Lineage ends there, so a lost executor costs a read of the file and nothing else.
    """
    shared_folder(df.sparkSession)
    with _without_leftovers(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as Parquet, which takes less room for large tables; ``discard`` removes it."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with _without_leftovers(spark):
        df.select("*").write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored_folder = folder
    return out


def remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Removes what ``stored`` has written, once no plan reads it any more."""
    for df in tables:
        remove(df.sparkSession, df._stored_folder)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, UPPER, LOWER)


def remembered(name: str) -> dict:
    """A dictionary that outlives a task in a Python worker that Spark uses again."""
    store = sys.modules.setdefault("_spandrel_worker_store", types.ModuleType("_spandrel_worker_store"))
    return store.__dict__.setdefault("kept", {}).setdefault(name, {})


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (one more than rows) of a string array; a null row is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, most_bytes: int = 2_000_000):
    """Record batches cut so that each holds at most about ``most_bytes`` of ``column``, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


#: Keys that are sent to every executor at most, some 20 bytes each, to drop their rows; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is not in ``gone``, a table of distinct keys."""
    gone = cut(gone)
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")


def replicated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says; undoes a grouping of equal rows."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop("_copy", times)


#: What a key is called inside of operators, so that it clashes with no column of theirs.
OWN_KEY = "_key_of_row"


def any_key(*results: str, also: tuple[str, ...] = ()):
    """Lets the ``key`` of an operator's first table, and of those in ``also``, have any name.

    A key that is named like one of the operator's ``results`` is called ``key`` in what it returns.
    """

    def wrap(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(*args, **settings):
            bound = signature.bind(*args, **settings)
            bound.apply_defaults()
            key = bound.arguments["key"]
            if key == OWN_KEY:
                return operator(*args, **settings)
            for table in (next(iter(bound.arguments)), *also):
                bound.arguments[table] = bound.arguments[table].withColumnRenamed(key, OWN_KEY)
            bound.arguments["key"] = OWN_KEY
            return operator(*bound.args, **bound.kwargs).withColumnRenamed(OWN_KEY, "key" if key in results else key)

        return run

    return wrap
