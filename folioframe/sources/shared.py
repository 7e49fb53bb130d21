"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; without it, local sessions use a folder of this machine until the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    application = spark.sparkContext.applicationId
    if application not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _local[application] = tempfile.mkdtemp(prefix="folioframe-")
        atexit.register(shutil.rmtree, _local[application], True)
    return _local[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, under this application's name, that nothing lies at."""
    return f"{shared_folder(spark)}/folioframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, under this application's name: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
