"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a folder of this machine
    serves a local session (tests) until the process ends; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioframe-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def tables_dir(spark: SparkSession) -> str:
    """Where this application's tables between steps lie."""
    return f"{shared_dir(spark)}/folioframe/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends, and no executor's loss loses it."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_tables(spark: SparkSession) -> None:
    """Deletes all tables between steps of this application; results that aren't written yet can't be read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with as many underscores as make it new to ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_or_empty(column: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(column if isinstance(column, Column) else F.col(f"`{column}`"), F.lit(""))


def scan_partitions(spark: SparkSession) -> int:
    """Partitions for work that costs much per row: what the session deals shuffles to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Rows that are Python values at a time.
ROWS_AT_ONCE = 512


def give_back_memory() -> None:
    """Returns what is free to the system: idle Python workers live on, and would keep it from the next step."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def append_columns(
    df: DataFrame,
    source: Column,
    fields: StructType,
    maker: Callable[[], Callable[[list], Iterable[list]]],
) -> DataFrame:
    """All columns of ``df`` (those named like a field are replaced) and ``fields``, made by Python.

    ``maker`` is called once in each task and returns a function from the values of
    ``source`` (some rows) to a list of values for each field.  Rows pass through in
    Arrow batches, of which ``ROWS_AT_ONCE`` become Python values at a time; nothing is shuffled.
    At its end a task gives the memory back that it needed.
    """
    kept = df.drop(*fields.names)
    value = free_name(kept, "__value")
    shaped = StructType([*kept.schema.fields, *fields.fields])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            work = work or maker()
            place = batch.schema.get_field_index(value)
            made = work(batch.column(place).to_pylist())
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            names = [n for n in batch.schema.names if n != value]
            columns += [pa.array(v, type=f.type) for v, f in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *arrow.names])
        del work
        give_back_memory()

    return kept.withColumn(value, source).mapInArrow(run, shaped)
