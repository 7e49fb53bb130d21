"""Diagram mining: tags and their votes, pipe runs, legends, tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
NOT_A_TAG = r"(?i)^(NOTE|DN|SUS|CLASS|PAGE|FIG|NO|REV|SCALE|TYPE|MAX|MIN)[0-9]"
WATERMARK = "(?i)DRAFT MANUAL FOR REVIEW"
TOLERANCE = 3.0
SWATCH_WIDTH, SWATCH_HEIGHT, LABEL_DX, LABEL_DY = 50, 1.5, 60, 6
LEAST_VECTOR_ITEMS = 15


def tag_votes(readings: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """(*key, tag, votes, stable) of tile readings (*key, run, tile, tag): in how many runs some tile showed the tag.

    Stable tags have min(``least``, runs of the page) votes or more.
    """
    runs = readings.groupBy(*key).agg(F.countDistinct("run").alias("runs"))
    votes = readings.where("tag IS NOT NULL").groupBy(*key, "tag").agg(F.countDistinct("run").alias("votes"))
    return votes.join(runs, key).select(*key, "tag", "votes", (F.col("votes") >= F.least(F.lit(least), F.col("runs"))).alias("stable"))


def vote_totals(votes: DataFrame, key: list[str]) -> DataFrame:
    """(*key, n_stable, n_unstable, rejected): counts of tags, and the share that didn't get the votes."""
    return votes.groupBy(*key).agg(
        F.count_if("stable").alias("n_stable"), F.count_if(~F.col("stable")).alias("n_unstable"),
        (F.count_if(~F.col("stable")) / F.count(F.lit(1))).alias("rejected"),
    )


def normalised_tags(tags: DataFrame, key: list[str]) -> DataFrame:
    """(*key, tag): without what only looks like a tag, a diameter sign where it was read as 0, and without tags that begin a longer one.

    Every tag names its own beginnings and an equi-join finds them, so a page's tags are not compared in pairs.
    """
    fixed = tags.where(~F.col("tag").rlike(NOT_A_TAG)).select(*key, F.regexp_replace("tag", r"-0(?=[0-9])", "-Ø").alias("tag")).distinct()
    lengths = F.when(F.length("tag") > 1, F.sequence(F.lit(1), F.length("tag") - 1)).otherwise(F.array().cast("array<int>"))
    starts = fixed.select(*key, F.explode(F.transform(lengths, lambda n: F.substring(F.col("tag"), F.lit(1), n))).alias("tag")).distinct()
    return fixed.join(starts, [*key, "tag"], "left_anti")


def cleaned_runs(readings: DataFrame, key: list[str]) -> DataFrame:
    """(*key, run, tag): what each run read on a page, over all its tiles, normalised before it votes; a run without tags keeps a row of null.

    ``readings`` (*key, run, tag); a null tag says that the run was made and its tile showed none.
    """
    runs = readings.select(*key, "run").distinct()
    return runs.join(normalised_tags(readings.select(*key, "run", "tag"), [*key, "run"]), [*key, "run"], "left")


def snapped(labels: DataFrame, vocabulary: DataFrame, key: list[str], most: int = 1) -> DataFrame:
    """(*key, label, snapped): the one vocabulary entry of the page that is nearest within ``most`` (0 or 1) edits, else the label itself.

    Two strings within one edit share a variant that lacks one character at most, so variants meet in
    an equi-join and only those pairs are measured.
    """

    def variants(c: str) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(c), cut)) if most else F.array(c)

    own = labels.select(*key, "label").distinct()
    words = vocabulary.select(*key, F.col("tag").alias("known")).distinct()
    near = (
        own.withColumn("v", F.explode(variants("label"))).join(words.withColumn("v", F.explode(variants("known"))), [*key, "v"])
        .select(*key, "label", "known").distinct()
        .withColumn("d", F.levenshtein("label", "known")).where((F.col("d") <= most) & (F.length("label") > 0))
    )
    best = near.groupBy(*key, "label").agg(F.min(F.struct("d", "known")).alias("best"), F.min("d").alias("least"), F.collect_list("d").alias("all"))
    one = F.size(F.filter("all", lambda d: d == F.col("least"))) == 1
    best = best.select(*key, "label", F.when(one, F.col("best.known")).alias("known"))
    return own.join(best, [*key, "label"], "left").select(*key, "label", F.coalesce("known", "label").alias("snapped"))


def tile_boxes(pages: DataFrame, grid: int = 3, overlap: float = 0.08) -> DataFrame:
    """(source, page, row, col, x0, y0, x1, y1): a page's tiles, wider by a share of the whole page, within its bounds."""
    at = pages.select("source", "page", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("row"))
    at = at.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))

    def low(i: str, size: str) -> Column:
        return F.greatest(F.lit(0), (F.col(i) * F.col(size) / grid - F.lit(overlap) * F.col(size)).cast("int"))

    def high(i: str, size: str) -> Column:
        return F.least(F.col(size).cast("int"), ((F.col(i) + 1) * F.col(size) / grid + F.lit(overlap) * F.col(size)).cast("int"))

    return at.select("source", "page", "row", "col", low("col", "width").alias("x0"), low("row", "height").alias("y0"), high("col", "width").alias("x1"), high("row", "height").alias("y1"))


def render_zoom(image_width: Column, page_width: Column) -> Column:
    """Zoom that shows a page's image at its own size, from 2.5 to 6."""
    return F.greatest(F.lit(2.5), F.least(F.lit(6.0), image_width / page_width))


def colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat_ws(",", *[F.round(c, 3).cast("string") for c in (r, g, b)])


def segments(drawings: DataFrame) -> DataFrame:
    """(source, page, colour, item, x0, y0, x1, y1) of coloured items (source, page, item, kind, colour, x0, y0, x1, y1); a rectangle has four."""
    able = drawings.where("colour IS NOT NULL AND kind IN ('l', 're')")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))

    def line(*p: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(p, ("x0", "y0", "x1", "y1"), strict=True)])

    edges = F.array(line(x0, y0, x1, y0), line(x1, y0, x1, y1), line(x1, y1, x0, y1), line(x0, y1, x0, y0))
    return able.select("source", "page", "colour", "item", F.inline(F.when(F.col("kind") == "l", F.array(line(x0, y0, x1, y1))).otherwise(edges)))


def has_vector_pipes(drawings: DataFrame) -> DataFrame:
    """(source, page) of pages with 15 coloured lines and rectangles or more."""
    return drawings.where("colour IS NOT NULL AND kind IN ('l', 're')").groupBy("source", "page").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_VECTOR_ITEMS).select("source", "page")


def joined_ends(lines: DataFrame, key: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b): segments (seg, *key, x0, y0, x1, y1) of which two ends lie within ``tolerance`` in both directions.

    Ends fall into cells as wide as the tolerance; each is looked up in the nine cells around it.
    """
    ends = lines.select("seg", *key, F.inline(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))))
    cells = ends.withColumn("cx", F.floor(F.col("x") / tolerance)).withColumn("cy", F.floor(F.col("y") / tolerance))
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    wide = cells.select("seg", *key, "x", "y", "cx", "cy", F.inline(around)).select(
        F.col("seg").alias("b"), *key, F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")
    )
    near = (F.abs(F.col("x") - F.col("bx")) < tolerance) & (F.abs(F.col("y") - F.col("by")) < tolerance)
    return cells.join(wide, [*key, "cx", "cy"]).where((F.col("seg") < F.col("b")) & near).select(F.col("seg").alias("a"), "b").distinct()


def page_runs(lines: pd.DataFrame, tolerance: float) -> np.ndarray:
    """For each segment of a page the least ``seg`` of its run."""
    seg = lines["seg"].to_numpy()
    ends = np.concatenate([lines[["x0", "y0"]].to_numpy(float), lines[["x1", "y1"]].to_numpy(float)])
    owner = np.tile(np.arange(len(seg)), 2)
    above = np.argsort(np.argsort(seg, kind="stable"), kind="stable")  # parents by order of seg
    parent = np.arange(len(seg))
    by_order = np.argsort(above)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    cells: dict[tuple[int, int], list[int]] = {}
    for k, (cx, cy) in enumerate(np.floor(ends / tolerance).astype(np.int64)):
        around = (n for dx in (-1, 0, 1) for dy in (-1, 0, 1) for n in cells.get((cx + dx, cy + dy), ()))
        for n in around:
            if (np.abs(ends[k] - ends[n]) < tolerance).all():
                a, b = sorted((root(above[owner[k]]), root(above[owner[n]])))
                parent[b] = a
        cells.setdefault((cx, cy), []).append(k)
    return seg[by_order[[root(i) for i in above]]]


def pipe_runs(lines: DataFrame, key: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(*key, run, segments, x0, y0, x1, y1): segments that hang together at their ends, with their bounds; ``run`` is the least segment.

    A page's segments are one group (a page holds so many strokes and no more), so one exchange is all it takes.
    """
    kinds = {c: lines.schema[c].dataType.simpleString() for c in [*key, "seg"]}
    named = ", ".join(f"{c} {kinds[c]}" for c in key)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        return page[key].assign(run=page_runs(page, tolerance), x0=page[["x0", "x1"]].min(axis=1), y0=page[["y0", "y1"]].min(axis=1), x1=page[["x0", "x1"]].max(axis=1), y1=page[["y0", "y1"]].max(axis=1))

    placed = lines.select(*key, "seg", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).groupBy(*key).applyInPandas(
        run, f"{named}, run {kinds['seg']}, x0 double, y0 double, x1 double, y1 double"
    )
    return placed.groupBy(*key, "run").agg(
        F.count(F.lit(1)).alias("segments"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def runs_in_order(runs: DataFrame, key: list[str]) -> DataFrame:
    """``runs`` with ``place``: from 1 within a page, most segments first; of equals the least run goes first."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("segments"), "run")))


def legend(swatches: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, page, colour, medium): the nearest text line right of each short coloured stroke; the last of a colour counts.

    ``swatches`` (source, page, item, colour, x0, y0, x1, y1), ``texts`` (source, page, text, x0, y0, x1, y1).
    Both are cut into strips of the label's height, so only texts at the stroke's height are compared.
    """
    able = swatches.where((F.col("colour").isNotNull()) & (F.col("x1") - F.col("x0") <= SWATCH_WIDTH) & (F.abs(F.col("y1") - F.col("y0")) <= SWATCH_HEIGHT))
    marks = able.select("source", "page", "item", "colour", F.col("x1").alias("right"), ((F.col("y0") + F.col("y1")) / 2).alias("mid"))
    marks = marks.withColumn("strip", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("mid") / LABEL_DY) + d)))
    lines = texts.where((F.length(F.trim("text")) > 0) & ~F.col("text").rlike(WATERMARK)).select(
        "source", "page", F.trim("text").alias("text"), F.col("x0").alias("left"), ((F.col("y0") + F.col("y1")) / 2).alias("line_mid")
    ).withColumn("strip", F.floor(F.col("line_mid") / LABEL_DY))
    dx = F.col("left") - F.col("right")
    near = marks.join(lines, ["source", "page", "strip"]).where((dx >= 0) & (dx < LABEL_DX) & (F.abs(F.col("line_mid") - F.col("mid")) < LABEL_DY))
    own = near.groupBy("source", "page", "item", "colour").agg(F.min(F.struct(dx.alias("dx"), "text"))["text"].alias("medium"))
    return own.groupBy("source", "page", "colour").agg(F.max_by("medium", "item").alias("medium"))


def media_summary(runs: DataFrame, colours: DataFrame) -> DataFrame:
    """(source, page, medium, runs, segments) of runs whose colour is in the legend."""
    named = runs.join(colours, ["source", "page", "colour"], "left").withColumn("medium", F.coalesce("medium", F.lit(""))).where("medium <> ''")
    return named.groupBy("source", "page", "medium").agg(F.count(F.lit(1)).alias("runs"), F.sum("segments").alias("segments"))
