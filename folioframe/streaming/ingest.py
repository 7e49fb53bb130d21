"""Streaming ingest: page files arrive, sources are replaced, and their chunks can be searched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.providers import Embedder, FirstSentence, HashEmbedder, Writer, embedded
from ..functions.text import retrieval_text
from ..operators.chunking import chunk_pages
from ..operators.services import contextualised
from ..operators.store import behind, remove_source
from ..sources.store import LAYERS
from ..sources.transcripts import PAGES, save_pages


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages (JSON lines) as they arrive in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk layer at ``path``; empty before anything was written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(LAYERS["chunks"]).parquet(path)
    return spark.createDataFrame([], LAYERS["chunks"])


def searchable(pages: DataFrame, contexts: Callable[[], Writer], embedder: Callable[[], Embedder]) -> DataFrame:
    """Chunks of ``pages`` with context, id and vector, ready to go behind a store."""
    pieces = contextualised(chunk_pages(pages), pages, contexts)
    vector = embedded(retrieval_text(F.col("context"), F.col("text")), embedder)
    return pieces.withColumn("vector", vector).withColumn("chunk_id", F.xxhash64("source", "page", "piece"))


def ingest(
    pages: DataFrame, transcripts: str, chunks: str, checkpoint: str,
    contexts: Callable[[], Writer] = FirstSentence, embedder: Callable[[], Embedder] = HashEmbedder,
) -> StreamingQuery:
    """Writes every source of a batch over its old pages and chunks; runs until all that is there is taken in.

    Chunks get their context, the next places behind all other sources, and unit vectors.  A batch that is run
    again writes the same partitions again, so nothing doubles.  Of a page that comes twice in a batch the
    longer text counts.
    """

    def replace(batch: DataFrame, _: int) -> None:
        order = Window.partitionBy("source", "page").orderBy(F.desc(F.length("text")), "text")
        own = batch.where("source IS NOT NULL").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
        save_pages(own, transcripts)
        rest = remove_source(stored_chunks(batch.sparkSession, chunks), own)
        pieces = behind(rest, searchable(own, contexts, embedder), ["page", "piece"])
        pieces.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(chunks)

    return pages.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
