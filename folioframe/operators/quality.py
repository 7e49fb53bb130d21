"""Detection of degenerate transcriptions and damaged contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMBERED, SUBSTANCE, strip

#: Lines needed, share of repeated lines, repeats of a pattern, characters of substance, shortest line.
LEAST_LINES, RATIO, LEAST_REPEAT, LEAST_SUBSTANCE, SHORT_LINE = 20, 0.35, 3, 15, 12


def degenerate_pages(pages: DataFrame, key: list[str]) -> DataFrame:
    """(*key, n_lines, mass, top_pattern, top_count): pages that repeat one pattern of line again and again.

    Lines of at most 12 characters and table rows don't count.  Numbers and identifiers are
    replaced by a sign, so lines that differ only there are one pattern.  Pages of fewer lines than
    count are left out before any line is looked at.  Both aggregations combine
    on the map side; a page with very many lines is spread over the tasks by pattern.
    """
    line = strip(F.col("line"))
    lines = pages.where(F.size(F.split("text", "\n")) >= LEAST_LINES).select(*key, F.explode(F.split("text", "\n")).alias("line")).select(*key, line.alias("line"))
    lines = lines.where((F.length("line") > SHORT_LINE) & ~F.col("line").startswith("|"))
    counts = lines.select(*key, F.regexp_replace("line", NUMBERED, "#").alias("pattern")).groupBy(*key, "pattern").agg(F.count(F.lit(1)).alias("n"))
    repeated = (F.col("n") >= LEAST_REPEAT) & (F.regexp_count("pattern", F.lit(SUBSTANCE)) >= LEAST_SUBSTANCE)
    found = counts.groupBy(*key).agg(
        F.sum("n").alias("n_lines"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("mass"),
        F.max(F.when(repeated, F.struct("n", "pattern"))).alias("top"),
    )
    bad = (F.col("n_lines") >= LEAST_LINES) & (F.col("mass") >= LEAST_LINES) & (F.col("mass") / F.col("n_lines") > RATIO)
    return found.where(bad).select(*key, "n_lines", "mass", F.col("top.pattern").alias("top_pattern"), F.col("top.n").alias("top_count"))


def truncated(finish_reason):
    """Whether the transcription hit its length limit."""
    return F.coalesce(finish_reason == "length", F.lit(False))


def failure_reasons(attempts: DataFrame, key: list[str]) -> DataFrame:
    """(*key, reason) of transcriptions (text, finish_reason) that failed: cut at the length limit, or degenerate.

    The limit goes first; a degenerate page tells its repeated lines, all lines, and the pattern that repeats most.
    """
    cut = attempts.where(truncated(F.col("finish_reason"))).select(*key).distinct().withColumn("reason", F.lit("length limit"))
    bad = degenerate_pages(attempts.select(*key, "text"), key).join(cut.select(*key), key, "left_anti")
    told = F.concat(
        F.col("mass").cast("string"), F.lit("/"), F.col("n_lines").cast("string"), F.lit(" repeated lines: "), F.substring("top_pattern", 1, 40),
        F.lit(" x "), F.col("top_count").cast("string"),
    )
    return cut.unionByName(bad.select(*key, told.alias("reason")))


def longest_attempt(attempts: DataFrame, key: list[str]) -> DataFrame:
    """(*key, text): of a page's attempts (attempt, text) the longest, of equals the first."""
    return attempts.groupBy(*key).agg(F.max_by("text", F.struct(F.length("text"), -F.col("attempt"))).alias("text"))


def is_diagram(pages: DataFrame, images: DataFrame, key: list[str], most_text: int = 1500, least_area: int = 4_000_000) -> DataFrame:
    """(*key): pages with little text and a large image, from (text) and image sizes (width, height)."""
    largest = images.groupBy(*key).agg(F.max(F.col("width") * F.col("height")).alias("area")).where(F.col("area") >= least_area)
    return pages.where(F.length(strip(F.col("text"))) < most_text).join(largest, key, "left_semi").select(*key)


def numbered(frame: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a running number from 1 within ``key``."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
