"""Inverted and vector indexes as plain tables, and the channels that search them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_tokens, tokens
from ..functions.vectors import norm
from ..sources.shared import written

#: Fixed values of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
POOL = 20
#: Scores are compared at this precision, so that sums in another order rank alike.
PLACES = 9
#: Queries sent to all tasks at once by the exact vector scan; more go in rounds.
QUERY_BLOCK = 4096


@dataclass(frozen=True)
class WordIndex:
    """An inverted index as tables: postings (chunk_id, dl, term, tf), weights (term, df, idf), stats (one row: n, avgdl)."""

    postings: DataFrame
    weights: DataFrame
    stats: DataFrame


def postings(chunks: DataFrame, text_col: str = "text", id_col: str = "chunk_id", segmenter=None) -> DataFrame:
    """(chunk_id, dl, term, tf): how often each term stands in each chunk of ``dl`` tokens.

    Texts are dealt by chunk, then tokenised and counted there: what is shuffled is the text, once, and all
    postings of a chunk stay together, so a search adds up a chunk's score before it moves anything.
    """
    session = chunks.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    dealt = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).repartition(tasks, "chunk_id")
    words = dealt.select("chunk_id", tokens(F.col("text"), segmenter).alias("words"))
    each = words.select("chunk_id", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    return each.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def word_index(chunks: DataFrame, posts: DataFrame) -> WordIndex:
    """The index over ``posts``, the postings of ``chunks`` (best a stored table; see ``sources.store``)."""
    total = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    stats = chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(total)
    stats = stats.select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avgdl"))
    return WordIndex(posts, term_weights(posts, stats), stats)


def document_lengths(chunks: DataFrame, text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, dl); chunks without tokens have length 0."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.size(tokens(F.col(text_col))).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_weights(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): ln(N - df + 0.5) - ln(df + 0.5); where that is negative, a quarter of the mean over all terms."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Most query terms that are sent to all tasks; with more, postings and terms are shuffled.
BROADCAST_TERMS = 1_000_000


def search_words(index: WordIndex, queries: DataFrame, segmenter=None) -> DataFrame:
    """(query_id, chunk_id, score) of chunks that share a term with the query (query_id, query_text).

    The queries' terms and their weights are small and go to the postings, so only postings of these terms are read
    on, and none is shuffled before it is worth something to a query.
    """
    terms = queries.select("query_id", F.explode(query_tokens(F.col("query_text"), segmenter)).alias("term"))
    asked = terms.join(index.weights.select("term", "idf"), "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    if terms.count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return index.postings.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """``search_words`` over an index made for this call: the corpus is tokenised once, its postings are written and searched."""
    posts = written(postings(chunks, text_col), "postings")
    return search_words(word_index(chunks, posts), queries)


def ranked(scores: DataFrame, most: int, *ties: str) -> DataFrame:
    """The ``most`` best rows of each query with rank from 0: by score, then ``ties``."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), *ties)
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most)


def bm25_topk(chunks: DataFrame, queries: DataFrame, most: int = POOL) -> DataFrame:
    """(query_id, chunk_id, score, rank): scores over 0 only."""
    return ranked(bm25_scores(chunks, queries).where("score > 0"), most, "chunk_id")


def vector_scores(vectors: DataFrame, queries: DataFrame, key: list[str], most: int) -> DataFrame:
    """(query_id, *key, score) of every query (query_id, query_vector) against all rows (key, vector).

    Queries go to the tasks in blocks of a fixed number, as one matrix; a batch of rows is scored by
    one product.  A task holds what may be among the ``most`` best of the rows it has seen, and returns
    that at its end.
    """
    spark = vectors.sparkSession
    rows = vectors.where(norm(F.col("vector")) > 0).select(*key, "vector")
    asked = queries.where(norm(F.col("query_vector")) > 0).select("query_id", "query_vector")
    query_type = asked.schema["query_id"].dataType.simpleString()
    schema = ", ".join([f"query_id {query_type}", *[f"{k} {rows.schema[k].dataType.simpleString()}" for k in key], "score double"])

    def unit(values) -> np.ndarray:
        found = np.stack([np.asarray(v, np.float64) for v in values])
        return found / np.sqrt((found**2).sum(axis=1, keepdims=True))

    def scored(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in block]), unit([r["query_vector"] for r in block])))

        def best(held: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
            """The rows that may be among the best, and each query's floor; ties are settled later."""
            held = held.sort_values(["query", "score"], ascending=[True, False], kind="stable")
            place = held.groupby("query").cumcount()
            floor = held.loc[place == most - 1].set_index("query")["score"] - 2 * 10.0**-PLACES
            return held[held["score"] >= held["query"].map(floor).fillna(-np.inf)], floor

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            least, held, size = np.full(len(ids), -np.inf), [], 0
            for batch in batches:
                if not len(batch):
                    continue
                scores = matrix @ unit(batch["vector"]).T
                rank = max(0, scores.shape[1] - most)
                own = np.partition(scores, rank, axis=1)[:, rank] - 2 * 10.0**-PLACES if scores.shape[1] >= most else least
                query, row = np.nonzero(scores >= np.maximum(least, own)[:, None])
                held.append(pd.DataFrame({"query": query, **{k: batch[k].to_numpy()[row] for k in key}, "score": scores[query, row]}))
                size += len(query)
                if size > 4 * most * len(ids):
                    kept, floor = best(pd.concat(held, ignore_index=True))
                    least[floor.index.to_numpy()] = floor.to_numpy()
                    held, size = [kept], 0
            if held:
                kept, _ = best(pd.concat(held, ignore_index=True))
                yield kept.assign(query_id=ids[kept["query"].to_numpy()])[["query_id", *key, "score"]]

        return rows.mapInPandas(run, schema)

    parts, source = [], asked.toLocalIterator()
    while block := list(islice(source, QUERY_BLOCK)):
        parts.append(scored(block))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def vector_topk(vectors: DataFrame, queries: DataFrame, most: int = POOL) -> DataFrame:
    """(query_id, chunk_id, score, rank) by inner product of unit vectors; null and zero vectors take no part."""
    return ranked(vector_scores(vectors, queries, ["chunk_id"], most), most, "chunk_id")


def image_topk(pages: DataFrame, queries: DataFrame, most: int = 10, least: float = 0.35) -> DataFrame:
    """(query_id, source, page, score, rank): pages (source, page, vector) of at least the confidence ``least``."""
    top = ranked(vector_scores(pages, queries, ["source", "page"], most), most, "source", "page")
    return top.where(F.round("score", PLACES) >= least)


def contribution(rank: Column) -> Column:
    """Reciprocal rank of a rank counted from 0."""
    return F.lit(1.0) / (F.lit(60) + rank + 1)
