"""Exact top-k search by inner product, over vectors sorted by length.

Candidates are dealt by descending length and packed into blocks.  All vectors are turned
by the right singular vectors of the candidates (from their d x d Gram matrix), so the
first places carry most of every product.  A block is scored for the first places only;
by Cauchy-Schwarz the rest adds at most the product of the residual lengths, and what can't
reach a query's k-th best score so far is dropped, in several steps of more and more places.
What is left is scored exactly in integers.  The k-th best scores start from the longest
block (scored by the tasks, a part of the queries each), and grow as a task goes on to shorter
vectors; a block whose longest vector is too short for every query isn't multiplied at all.

Queries go in rounds of a fixed number, each round sent to all tasks, which take them in parts:
no more than PART queries are held against a block at once.  A round keeps no more than k
results per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scan_partitions, written

BLOCK = 2048
#: Queries sent to the tasks at once, and those of them that meet a block at once.
ROUND, PART = 1 << 15, 512
#: Places scored before each pruning step, as parts of the dimension.
STEPS = (0.25, 0.5)
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
BLOCK_SCHEMA = "place long, n long, ids binary, values binary"


def quantized(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(embedding: Column) -> Column:
    """Not null, and without null or non-finite components."""
    wrong = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(wrong, F.lit(False))


def packed(vectors: DataFrame, size: int, dimension: int) -> DataFrame:
    """(place, n, ids, values): rows (id, v) in their order, ``size`` at a time; short vectors are filled with zeros."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        ids, rows = [], []

        def block():
            values = np.zeros((len(ids), dimension), np.int64)
            for i, row in enumerate(rows):
                values[i, : len(row)] = row
            return pa.RecordBatch.from_arrays(
                [pa.array([place]), pa.array([len(ids)]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([values.tobytes()])],
                ["place", "n", "ids", "values"],
            )

        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(row)
                if len(ids) == size:
                    yield block()
                    ids, rows = [], []
                    place += 1
        if ids:
            yield block()

    return vectors.mapInArrow(pack, BLOCK_SCHEMA)


def unpacked(ids: bytes, values: bytes, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(values, np.int64).reshape(len(own), dimension)


def rotation(blocks: DataFrame, dimension: int) -> np.ndarray:
    """Right singular vectors of all candidates, strongest first."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            for ids, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unpacked(ids, values, dimension)[1].astype(np.float64)
                total += x.T @ x
        at = np.arange(dimension * dimension)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    cells = blocks.select("ids", "values").mapInArrow(gram, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros(dimension * dimension)
    for row in cells.collect():  # as many as the dimension squared
        total[row["at"]] = row["value"]
    scale = np.abs(total).max() or 1.0
    return np.linalg.eigh(total.reshape(dimension, dimension) / scale)[1][:, ::-1]


def top_places(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; the least one where a row is shorter."""
    at = max(0, scores.shape[1] - k)
    return np.partition(scores, at, axis=1)[:, at]


class Search:
    """Some queries and their best candidates so far."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.values, self.turn, self.k = ids, values, turn, k
        self.real = values.astype(np.float64)
        self.turned = self.real @ turn
        self.length = np.linalg.norm(self.real, axis=1)
        self.rests = [np.linalg.norm(self.turned[:, h:], axis=1) for h in self.heads()]
        self.most = float(np.abs(self.real).max(initial=0))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, id, score

    def heads(self) -> list[int]:
        return [h for part in STEPS if (h := int(self.values.shape[1] * part))]

    def slack(self, x: np.ndarray) -> float:
        return 1 + 1e-9 * x.shape[1] * self.most * float(np.abs(x).max(initial=0))

    def survivors(self, x: np.ndarray) -> np.ndarray:
        """Candidates that may reach the k-th best score of some query."""
        slack = self.slack(x)
        if not (self.length * np.linalg.norm(x, axis=1).max() >= self.floor - slack).any():
            return np.zeros(0, np.int64)
        turned = x @ self.turn
        left = np.arange(len(x))
        for h, rest in zip(self.heads(), self.rests, strict=True):
            own = turned[left]
            bound = self.turned[:, :h] @ own[:, :h].T
            bound += rest[:, None] * np.linalg.norm(own[:, h:], axis=1)[None, :]
            left = left[(bound >= self.floor[:, None] - slack).any(0)]
            if not len(left):
                break
        return left

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(x.astype(np.float64)).max(initial=0)) * x.shape[1] < EXACT:
            return (self.real @ x.T.astype(np.float64)).astype(np.int64)
        exact = self.values.astype(object) @ x.T.astype(object)  # beyond a long, scores stop at its limits
        return np.minimum(np.maximum(exact, LONG_MIN), LONG_MAX).astype(np.int64)

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Takes a block of candidates in."""
        if not len(ids) or not len(self.ids):
            return
        left = self.survivors(values.astype(np.float64))
        if not len(left):
            return
        scores = self.scores(values[left])
        own = self.ids[:, None] == ids[left][None, :]
        if np.isneginf(self.floor).any() and len(left) > self.k:  # own rows count as least, which only lowers the floor
            self.floor = np.maximum(self.floor, top_places(np.where(own, LONG_MIN, scores), self.k))
        query, at = np.nonzero((scores >= self.floor[:, None]) & ~own)
        if not len(query):
            return
        query, found, score = (np.concatenate(x) for x in zip(self.best, (query, ids[left][at], scores[query, at]), strict=True))
        order = np.lexsort((found, ~score, query))  # of longs, ~ turns the order around without a limit
        query, found, score = query[order], found[order], score[order]
        start = np.searchsorted(query, query)
        keep = np.arange(len(query)) - start < self.k
        self.best = query[keep], found[keep], score[keep]
        full = np.arange(len(query)) - start == self.k - 1
        self.floor[query[full]] = score[full]

    def seed(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """A floor for each query: the k-th best score in a block, less if its own row is among it."""
        if len(ids) <= self.k:
            return self.floor
        scores = np.where(self.ids[:, None] == ids[None, :], LONG_MIN, self.scores(values))
        found = top_places(scores, self.k)
        return np.where(found > LONG_MIN, found, -np.inf)


def parts_of(n: int) -> list[tuple[int, int]]:
    return [(at, min(at + PART, n)) for at in range(0, n, PART)]


def seeded_floors(blocks: DataFrame, sent: Broadcast, n: int, k: int) -> np.ndarray:
    """The floors that the longest block gives to ``n`` queries; each task takes parts of the queries."""
    spark = blocks.sparkSession
    parts = spark.createDataFrame(parts_of(n), "a long, b long").repartition(min(len(parts_of(n)), scan_partitions(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, turn, longest = sent.value
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                floor = Search(ids[a:b], values[a:b], turn, k).seed(*longest)
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([np.asarray(floor, np.float64).tobytes()])], ["a", "floor"])

    floors = np.full(n, -np.inf)
    for row in parts.mapInArrow(run, "a long, floor binary").toLocalIterator():  # eight bytes for each query of the round
        found = np.frombuffer(row["floor"], np.float64)
        floors[row["a"] : row["a"] + len(found)] = found
    return floors


def search_round(blocks: DataFrame, longest: tuple[np.ndarray, np.ndarray], ids: np.ndarray, values: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """(round's query number, query_id, vec_id, score) from all blocks, at most k per query and task."""
    context = blocks.sparkSession.sparkContext
    sent = context.broadcast((ids, values, turn, longest))
    floors = context.broadcast(seeded_floors(blocks, sent, len(ids), k))
    dimension, parts = values.shape[1], parts_of(len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_values, own_turn, _ = sent.value
        states = [Search(own_ids[a:b], own_values[a:b], own_turn, k, floors.value[a:b]) for a, b in parts]
        for batch in batches:
            for i in range(batch.num_rows):
                block = unpacked(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), dimension)
                for state in states:
                    state.add(*block)
        for (at, _), state in zip(parts, states, strict=True):
            query, found, score = state.best
            if len(query):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query + at), pa.array(state.ids[query]), pa.array(found), pa.array(score)], ["number", "query_id", "vec_id", "score"]
                )

    return blocks.select("ids", "values").mapInArrow(run, "number long, query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of highest integer inner product, ties to the smaller id.

    Components count as floor(scale * x).  A query's own row (rows of its id) is no candidate;
    a query with fewer candidates gets them all.  Vectors that are null or hold a null or
    non-finite component, and null ids, take no part.  Shorter vectors are filled with zeros.
    Rows that repeat an id are candidates each, and queries each.  No vectors give no rows.
    """
    spark = vectors.sparkSession
    columns = [F.col(f"`{id_col}`").cast("long").alias("id"), quantized(F.col(f"`{vector_col}`"), scale).alias("v")]
    fit = usable(F.col(f"`{vector_col}`")) & F.col(f"`{id_col}`").isNotNull()
    every = vectors.where(fit).select(*columns)
    dimension = max(1, every.agg(F.max(F.size("v"))).first()[0] or 1)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ranged = every.withColumn("length", length).repartitionByRange(scan_partitions(spark), F.desc("length"), "id")
    blocks = written(packed(ranged.sortWithinPartitions(F.desc("length"), "id").select("id", "v"), BLOCK, dimension), "vector-blocks")
    asked = written(queries.where(fit).select(*columns).sort("id"), "queries")
    first = blocks.orderBy("place").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not first:
        return empty
    longest = unpacked(first[0]["ids"], first[0]["values"], dimension)
    turn = rotation(blocks, dimension)
    rounds, rows = [], asked.toLocalIterator()
    while part := list(islice(rows, ROUND)):
        values = np.zeros((len(part), dimension), np.int64)
        for i, row in enumerate(part):
            own = row["v"][:dimension]
            values[i, : len(own)] = own
        found = search_round(blocks, longest, np.array([r["id"] for r in part], np.int64), values, turn, k)
        rounds.append(written(found.withColumn("round", F.lit(len(rounds))), "round"))
    if not rounds:
        return empty
    order = Window.partitionBy("round", "number").orderBy(F.desc("score"), "vec_id")
    return (
        reduce(DataFrame.unionAll, rounds)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
