"""Pages from the blocks of a layout parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import heading, html_table_to_markdown, latex_to_plain, strip

SKIPPED = ("header", "footer", "page_number")
BATCH_PAGES = 180


def block_texts(blocks: DataFrame) -> DataFrame:
    """(source, page, place, piece) of blocks (source, place, type, page_idx, text, text_level, table_body, table_caption, image_caption).

    Pages count from 1.  Headers, footers and page numbers, blocks whose page is no number, and
    blocks that come out blank are left out.
    """
    caption = F.array_join(F.coalesce("table_caption", F.array().cast("array<string>")), " ")
    table = html_table_to_markdown(F.col("table_body"))
    text = latex_to_plain(F.coalesce("text", F.lit("")))
    level = F.col("text_level").try_cast("int")
    piece = (
        F.when(F.col("type") == "table", F.when(F.length(caption) > 0, F.concat(caption, F.lit("\n"), table)).otherwise(table))
        .when(F.col("type") == "image", F.array_join(F.coalesce("image_caption", F.array().cast("array<string>")), " "))
        .otherwise(F.when((level != 0) & (F.length(text) > 0), heading(level, text)).otherwise(text))
    )
    able = blocks.where(~F.coalesce(F.col("type").isin(*SKIPPED), F.lit(False))).withColumn("page", F.col("page_idx").try_cast("int") + 1)
    return able.where("page IS NOT NULL").select("source", "page", "place", strip(piece).alias("piece")).where(F.length("piece") > 0)


def blocks_to_pages(blocks: DataFrame) -> DataFrame:
    """(source, page, text): the blocks of a page in order, joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return block_texts(blocks).groupBy("source", "page").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "\n\n").alias("text"))


def page_batches(documents: DataFrame) -> DataFrame:
    """(source, start, stop): documents (source, n_pages) in batches of at most 180 pages, for a service with that limit."""
    last = F.ceil(F.col("n_pages") / BATCH_PAGES) - 1
    starts = documents.where("n_pages > 0").select("source", "n_pages", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("i"))
    return starts.select("source", (F.col("i") * BATCH_PAGES).alias("start"), F.least((F.col("i") + 1) * BATCH_PAGES, "n_pages").alias("stop"))
