"""Mutation and maintenance of the chunk store, as relations in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalised
from .ordering import in_order


def ordered_text(seq: str, text: str = "text"):
    """Aggregate: texts in order of ``seq`` joined by blank lines."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "\n\n")


def remove_source(store: DataFrame, sources: DataFrame) -> DataFrame:
    """The store without the rows of ``sources`` (source)."""
    return store.join(sources.select("source").distinct(), "source", "left_anti").select(*store.columns)


def removed_counts(store: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, removed): how many rows each asked-for source loses."""
    return sources.select("source").distinct().join(store.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("removed"))


def append(store: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The store and ``behind(store, new, order)``."""
    return store.unionByName(behind(store, new, order))


def behind(store: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` as rows of the store behind all it holds: with the next chunk_seq in ``order``, and unit vectors if there are any.

    Numbers come from sums over (source) runs, so only the rows of one source are ordered together.
    """
    if "vector" in new.columns:
        new = new.withColumn("vector", l2_normalised(F.col("vector")).cast(store.schema["vector"].dataType))
    last = store.agg(F.coalesce(F.max("chunk_seq"), F.lit(-1).cast("long")).alias("last"))
    first = new.groupBy("source").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("first", "source").rowsBetween(Window.unboundedPreceding, -1)
    ahead = first.select("source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    numbered = new.withColumn("own", own).join(ahead, "source").crossJoin(F.broadcast(last))
    numbered = numbered.withColumn("chunk_seq", F.col("last") + F.col("ahead") + F.col("own"))
    return numbered.select(*store.columns)


def replace_sources(store: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The store with every source of ``new`` taken out and ``new`` behind the rest."""
    return append(remove_source(store, new), new, order)


def sources_in_order(store: DataFrame) -> DataFrame:
    """(source, first_seq, n_chunks), first seen first."""
    return store.groupBy("source").agg(F.min("chunk_seq").alias("first_seq"), F.count(F.lit(1)).alias("n_chunks"))


def page_texts(chunks: DataFrame) -> DataFrame:
    """(source, page, text, image_path): pages rebuilt from their chunks in order, with the first image."""
    return chunks.groupBy("source", "page").agg(
        ordered_text("chunk_seq").alias("text"),
        F.min_by(F.col("image_path"), F.when(F.col("image_path").isNotNull(), F.col("chunk_seq"))).alias("image_path"),
    )


def backfill(chunks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Pages rebuilt for the sources that have no transcript yet."""
    return page_texts(chunks.join(transcripts.select("source").distinct(), "source", "left_anti"))


def reuse_contexts(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` with the context that ``old`` had for the same source, page and text; of several the last that isn't empty."""
    known = old.where(F.length("context") > 0).groupBy("source", "page", "text").agg(F.max_by("context", "chunk_seq").alias("context"))
    return new.drop("context").join(known, ["source", "page", "text"], "left")


def page_of_chunk(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunks`` with ``page_text``: the text of their page, or their own where the page is missing."""
    own = pages.select("source", "page", F.col("text").alias("page_text"))
    return chunks.join(own, ["source", "page"], "left").withColumn("page_text", F.coalesce("page_text", "text"))


def merge_pages(existing: DataFrame, parsed: DataFrame, diagrams: DataFrame) -> DataFrame:
    """(source, page, text): parsed pages over existing ones; diagram pages keep what exists."""
    able = parsed.join(diagrams.select("source", "page"), ["source", "page"], "left_anti")
    a, b = existing.select("source", "page", F.col("text").alias("was")), able.select("source", "page", F.col("text").alias("now"))
    return a.join(b, ["source", "page"], "full").select("source", "page", F.coalesce("now", "was").alias("text"))


def replace_pages(store: DataFrame, fixed: DataFrame) -> DataFrame:
    """The store with the chunks of each page of ``fixed`` (source, page, piece, text, ...) in the place of the page's first old one.

    All columns of the store stay, those that ``fixed`` lacks null in its rows; chunk_seq is numbered anew over the whole
    store, from 0, in the order there was.  Pages that the store doesn't hold are left out.
    """
    pages = fixed.select("source", "page").distinct()
    first = store.groupBy("source", "page").agg(F.min("chunk_seq").alias("__place"))
    kept = store.join(pages, ["source", "page"], "left_anti").withColumn("__place", F.col("chunk_seq")).withColumn("__piece", F.lit(0))
    new = fixed.withColumnRenamed("piece", "__piece").join(first, ["source", "page"])
    rows = kept.unionByName(new.drop("chunk_seq"), allowMissingColumns=True).drop("chunk_seq")
    return in_order(rows, ["__place", "__piece"], "chunk_seq").select(*store.columns)


def stale(targets: DataFrame, done: DataFrame, method: str) -> DataFrame:
    """Targets (source, page) that are not done, or were done by another method."""
    fresh = done.where(F.col("tag_method") == method).select("source", "page")
    return targets.join(fresh, ["source", "page"], "left_anti")
