"""The driver's tables in the shape of the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores: a small table lies in fewer splits than there are, and its texts are what queries work on."""
    own, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return own if own.rdd.getNumPartitions() >= cores else own.repartition(cores)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, chunk_seq, source, page, text): every document is a chunk; forty ids make a page of each source."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_seq"), "source", (F.floor(F.col("doc_id") / 40) + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, vector) of the chunks that have one."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return own.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), "chunk_id")


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, page, vector): a synthetic second vector space, half of the vector of the page's first chunk that has one."""
    own = vectors(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", "source", "page"), "chunk_id")
    return own.groupBy("source", "page").agg(F.min_by("vector", "chunk_id").alias("v")).select("source", "page", F.slice("v", 1, 32).alias("vector"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_text, query_vector): every benchmark item, with the vector of its number."""
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).join(vec, "query_id", "left")


def image_queries(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", F.slice("query_vector", 1, 32).alias("query_vector"))


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A fixture given as SQL VALUES, the same text that the oracle reads."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")
