"""The layers of a knowledge base as tables partitioned by source: transcripts, chunks with vectors, page images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import retrieval_text
from .transcripts import remove_source

LAYERS = {
    "transcripts": "page int, text string, image_path string, source string",
    "chunks": "chunk_id long, chunk_seq long, page int, text string, context string, image_path string, vector array<float>, source string",
    "images": "page int, vector array<float>, source string",
}

#: The inverted index beside the chunks: postings by source, in order of term, and what all of them add up to.
POSTINGS = "chunk_id long, dl long, term string, tf long, source string"
WEIGHTS, STATS = "term string, df long, idf double", "n long, avgdl double"

#: Fixed value: how the context of a diagram chunk goes on behind source and page.
CONTEXT_TAIL = "页图纸的机读摘要，内容为从图上识别出的介质管路、器件符号与设备位号。"


def save(layer: str, rows: DataFrame, path: str) -> None:
    """Writes rows of a layer; each source that is written replaces its old rows in one step."""
    fields = [f.strip().split(" ", 1) for f in LAYERS[layer].split(", ")]
    own = rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/{layer}")


def save_index(spark: SparkSession, path: str, sources: list[str] | None = None) -> None:
    """Writes the inverted index of the chunk layer; with ``sources`` only their postings are made again.

    What is indexed is the context and the text.  Weights and lengths are summed up from all postings.
    """
    from ..operators.index import postings, word_index

    chunks = load(spark, "chunks", path)
    changed = chunks if sources is None else chunks.where(F.col("source").isin(sources))
    texts = changed.select("chunk_id", "source", retrieval_text(F.col("context"), F.col("text")).alias("text"))
    own = postings(texts).join(changed.select("chunk_id", "source"), "chunk_id")
    ordered = own.select(*[f.strip().split(" ")[0] for f in POSTINGS.split(",")]).repartition("source").sortWithinPartitions("source", "term")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/postings")
    index = word_index(chunks, spark.read.schema(POSTINGS).parquet(f"{path}/postings"))
    index.weights.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/weights")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str):
    """The stored ``operators.index.WordIndex``, or None if none was saved."""
    from ..operators.index import WordIndex

    if not exists(spark, "stats", path):
        return None
    parts = (("postings", POSTINGS), ("weights", WEIGHTS), ("stats", STATS))
    return WordIndex(*(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in parts))


def exists(spark: SparkSession, layer: str, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{layer}")
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder))


def load(spark: SparkSession, layer: str, path: str) -> DataFrame | None:
    """A layer, or None if nothing was ever saved."""
    return spark.read.schema(LAYERS[layer]).parquet(f"{path}/{layer}") if exists(spark, layer, path) else None


def delete_source(spark: SparkSession, source: str, path: str, images: str | None = None) -> dict[str, bool]:
    """Takes a source out of every layer; tells where it was.

    Its postings go too and the index is summed up again; with ``images``, the folder of page images, so do the
    image files that its transcripts and chunks name.
    """
    if images is not None:
        layers = [load(spark, layer, path) for layer in ("transcripts", "chunks")]
        for layer in layers:
            names = layer.where(F.col("source") == source).select("image_path").where("image_path IS NOT NULL").distinct() if layer is not None else None
            for row in names.toLocalIterator() if names is not None else ():  # pages of one source
                file = spark._jvm.org.apache.hadoop.fs.Path(f"{images}/{row['image_path']}")
                file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)
    found = {layer: remove_source(spark, f"{path}/{layer}", source) for layer in LAYERS}
    if exists(spark, "stats", path) and remove_source(spark, f"{path}/postings", source):
        save_index(spark, path, [])
    return found


def clear(spark: SparkSession, path: str) -> None:
    """Deletes all layers and the index."""
    for layer in (*LAYERS, "postings", "weights", "stats"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{layer}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def page_image_uris(results: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, place, uri): images of the results' pages (query_id, place, source, page, image_path), each page once, as data URIs.

    ``files`` (image_path, content) is a binaryFile scan; results without a file are left out.
    """
    first = results.where("image_path IS NOT NULL").groupBy("query_id", "source", "page").agg(F.min(F.struct("place", "image_path")).alias("f"))
    return first.select("query_id", "f.place", "f.image_path").join(files, "image_path").select(
        "query_id", "place", F.concat(F.lit("data:image/png;base64,"), F.base64("content")).alias("uri")
    )


def diagram_chunks(pages: DataFrame, images: DataFrame, text) -> DataFrame:
    """(source, page, text, context, image_path) of diagram pages that name tags or media; symbols are not indexed.

    ``text`` makes the chunk's text from the columns of ``pages``; ``images`` gives (source, page, image_path).
    """
    context = F.concat(F.lit("这是《"), F.col("source"), F.lit("》第"), F.col("page").cast("string"), F.lit(CONTEXT_TAIL))
    able = pages.where((F.size("tags") > 0) | (F.size("media") > 0)).drop("image_path")
    return able.join(images.select("source", "page", "image_path"), ["source", "page"], "left").select("source", "page", text.alias("text"), context.alias("context"), "image_path")
