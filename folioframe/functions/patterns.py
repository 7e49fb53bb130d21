"""Many patterns looked for in many texts, in one pass over the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    import ahocorasick
except ImportError:  # each pattern by itself then
    ahocorasick = None

#: Patterns sent to all tasks at once; more go in rounds.
PATTERN_BLOCK = 20_000


def finder(patterns: list[str]) -> Callable[[str], set[str]]:
    """Which of the patterns a text holds."""
    if ahocorasick is None:
        return lambda text: {p for p in patterns if p in text}
    machine = ahocorasick.Automaton()
    for p in patterns:
        machine.add_word(p, p)
    machine.make_automaton()
    return lambda text: {p for _, p in machine.iter(text)}


def held_patterns(texts: DataFrame, key: list[str], text_col: str, patterns: DataFrame) -> DataFrame:
    """(*key, pattern): which of ``patterns`` (one string column; null and empty ones are left out) each text holds as a substring.

    Texts stream past an automaton of all patterns of a round, so no text is compared with a pattern by itself.
    """
    spark = texts.sparkSession
    own = texts.select(*key, text_col)
    schema = ", ".join([*[f"{k} {own.schema[k].dataType.simpleString()}" for k in key], "pattern string"])
    name = patterns.columns[0]
    source = patterns.where(f"length({name}) > 0").select(name).distinct().toLocalIterator()

    def searched(block: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = finder(sent.value)
            for batch in batches:
                found = [sorted(find(t)) if t else [] for t in batch.column(len(key)).to_pylist()]
                row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                columns = [batch.column(i).take(row) for i in range(len(key))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([p for f in found for p in f], pa.string())], [*key, "pattern"])

        return own.mapInArrow(run, schema)

    parts = []
    while block := [r[0] for r in islice(source, PATTERN_BLOCK)]:
        parts.append(searched(block))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
