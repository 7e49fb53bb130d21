"""Fusion of the channels, assembly of the final hits, and their context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import held_patterns
from ..functions.text import IDENTIFIER, query_tokens
from .index import PLACES, contribution

FUSED, TOP = 15, 5


def fuse(vector: DataFrame, bm25: DataFrame, image: DataFrame, chunks: DataFrame, most: int = FUSED) -> DataFrame:
    """(query_id, chunk_id, score, rank) by the sum of reciprocal ranks over three channels.

    A page's image rank counts for each of its chunks.  Ties keep the order in which the
    channels first name a chunk: vectors, then words, then images.
    """
    page_hits = image.select("query_id", "source", "page", F.col("rank")).join(chunks.select("chunk_id", "source", "page"), ["source", "page"])
    channels = [
        frame.select("query_id", "chunk_id", "rank", F.lit(i).alias("channel")) for i, frame in enumerate((vector, bm25, page_hits))
    ]
    every = channels[0].unionAll(channels[1]).unionAll(channels[2])
    fused = every.groupBy("query_id", "chunk_id").agg(
        F.sum(contribution(F.col("rank"))).alias("score"), F.min(F.struct("channel", "rank", "chunk_id")).alias("first")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "first")
    return fused.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most).drop("first")


def identifier_hits(chunks: DataFrame, queries: DataFrame, scores: DataFrame | None = None, most: int = 1) -> DataFrame:
    """(query_id, chunk_id, rank): chunks whose text holds an identifier of the query as a substring.

    Best score first (``scores``: query_id, chunk_id, score; missing counts as 0), then the
    larger chunk_id.  Identifiers of all queries are looked for in one pass over the chunks.
    """
    wanted = queries.select("query_id", F.explode(query_tokens(F.col("query_text"))).alias("identifier")).where(F.col("identifier").rlike(IDENTIFIER))
    lowered = chunks.select("chunk_id", F.lower("text").alias("lowered"))
    found = held_patterns(lowered, ["chunk_id"], "lowered", wanted.select("identifier")).withColumnRenamed("pattern", "identifier")
    hits = wanted.join(found, "identifier").select("query_id", "chunk_id").distinct()
    hits = hits.join(scores.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left") if scores is not None else hits.withColumn("score", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.coalesce("score", F.lit(0.0)), PLACES)), F.desc("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most).select("query_id", "chunk_id", "rank")


def assemble(fused: DataFrame, exact: DataFrame, image: DataFrame, chunks: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, chunk_id, slot, score): the hits that are shown.

    The fused order fills ``top`` slots; an exact identifier hit is pinned to the front with score
    1; then, if no slot shows the best image page, the best fused chunk of that page takes the last slot.
    """
    pinned = exact.where("rank = 0").select("query_id", "chunk_id", F.lit(-1).alias("place"), F.lit(1.0).alias("score"))
    rest = fused.join(pinned.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    line = pinned.unionByName(rest.select("query_id", "chunk_id", F.col("rank").alias("place"), "score"))
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    placed = line.withColumn("slot", slot).where(F.col("slot") <= top)
    best_page = image.where("rank = 0").select("query_id", "source", "page")
    on_page = best_page.join(chunks.select("chunk_id", "source", "page"), ["source", "page"]).select("query_id", "chunk_id")
    shown = placed.join(on_page, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct()
    pool = fused.join(on_page, ["query_id", "chunk_id"], "left_semi").join(shown, "query_id", "left_anti")
    rescue = pool.groupBy("query_id").agg(F.min(F.struct("rank", "chunk_id", "score")).alias("r"))
    taken = placed.groupBy("query_id").agg(F.least(F.max("slot") + 1, F.lit(top)).alias("last"))
    rescued = rescue.join(taken, "query_id").select("query_id", F.col("r.chunk_id").alias("chunk_id"), F.col("last").alias("slot"), F.col("r.score").alias("score"))
    kept = placed.join(rescued.select("query_id", "slot"), ["query_id", "slot"], "left_anti").select("query_id", "chunk_id", "slot", "score")
    return kept.unionByName(rescued)


def expand_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(query_id, chunk_seq, chunk_id, source, page, text): hits and what lies up to ``window`` places from them in the same source.

    Each hit names the places around it and an equi-join fetches them; nothing is compared in ranges.
    """
    own = hits.join(chunks.select("chunk_id", "chunk_seq", "source"), "chunk_id")
    near = own.select("query_id", "source", F.explode(F.sequence(F.col("chunk_seq") - window, F.col("chunk_seq") + window)).alias("chunk_seq")).distinct()
    return near.join(chunks, ["source", "chunk_seq"]).select("query_id", "chunk_seq", "chunk_id", "source", "page", "text")


def context_blocks(expanded: DataFrame) -> DataFrame:
    """(query_id, block, source, page, text): runs of chunks of one page, in order of chunk_seq, joined by blank lines."""
    order = Window.partitionBy("query_id").orderBy("chunk_seq")
    new = (F.lag("source").over(order).isNull() | (F.lag("source").over(order) != F.col("source")) | (F.lag("page").over(order) != F.col("page"))).cast("int")
    numbered = expanded.withColumn("new", new).withColumn("block", F.sum("new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "text"))), lambda c: c["text"]), "\n\n")
    return numbered.groupBy("query_id", "block", "source", "page").agg(text.alias("text"))


def context_text(blocks: DataFrame) -> DataFrame:
    """(query_id, context): all blocks under headers that name source and page."""
    part = F.struct("block", F.concat(F.lit("[来源: "), F.col("source"), F.lit(" 第"), F.col("page").cast("string"), F.lit("页]\n"), F.col("text")).alias("text"))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda b: b["text"]), "\n\n").alias("context"))
