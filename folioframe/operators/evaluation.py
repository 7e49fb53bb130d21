"""Retrieval evaluation: ranks of the right pages, recall, coverage, and checks of the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import held_patterns
from ..functions.text import squash


def hit_ranks(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """(case_id, rank): the first place (from 1) at which a case's results (case_id, place, source, page) show a wanted page; null if none."""
    found = results.join(wanted.select("case_id", "source", "page"), ["case_id", "source", "page"], "left_semi").groupBy("case_id").agg(F.min("place").alias("rank"))
    return wanted.select("case_id").distinct().join(found, "case_id", "left")


def recall(ranks: DataFrame) -> DataFrame:
    """One row (cases, recall_1, recall_3, recall_5, mrr); without cases all are 0."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))

    def at(k: int):
        return (F.count_if(F.col("rank") <= k) / n).alias(f"recall_{k}")

    return ranks.agg(F.count(F.lit(1)).alias("cases"), at(1), at(3), at(5), (F.coalesce(F.sum(1.0 / F.col("rank")), F.lit(0.0)) / n).alias("mrr"))


def coverage(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """(case_id, wanted, found, coverage): how many of a case's pages its results show."""
    shown = results.select("case_id", "source", "page").distinct().withColumn("hit", F.lit(1))
    joined = wanted.select("case_id", "source", "page").distinct().join(shown, ["case_id", "source", "page"], "left")
    return joined.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("coverage")
    )


def coverage_summary(covered: DataFrame) -> DataFrame:
    """One row (cases, full, average)."""
    return covered.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("found") == F.col("wanted")).alias("full"), F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("average"))


def evidence_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """(case_id, source, page): pages (source, page, text) whose text holds a case's evidence, white space aside.

    All evidence is looked for in one pass over the pages.
    """
    asked = evidence.select("case_id", squash(F.col("evidence")).alias("wanted"))
    own = pages.select("source", "page", squash(F.col("text")).alias("squashed"))
    found = held_patterns(own, ["source", "page"], "squashed", asked.select("wanted"))
    return asked.join(found, F.col("wanted") == F.col("pattern")).select("case_id", "source", "page")


def kind_hits(ranks: DataFrame, cases: DataFrame) -> DataFrame:
    """(kind, cases, hits): of each kind of case (case_id, kind) how many there are, and how many have a rank at all.

    Cases without a kind are single ones.
    """
    kinds = cases.select("case_id", F.coalesce("kind", F.lit("single")).alias("kind"))
    joined = kinds.join(ranks.select("case_id", "rank"), "case_id", "left")
    return joined.groupBy("kind").agg(F.count(F.lit(1)).alias("cases"), F.count("rank").alias("hits"))


def normalised_cases(cases: DataFrame) -> DataFrame:
    """(q, source, kind, pages): cases of one page (page) or several (pages) in one form; kind is single by default."""
    pages = F.coalesce("pages", F.array("page"))
    return cases.select("q", "source", F.coalesce("kind", F.lit("single")).alias("kind"), pages.alias("pages"))
