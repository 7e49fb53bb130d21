"""Structure-aware chunking of Markdown pages.

Blocks, parts of tables and chunks all depend on what stands before, so a page is one pass over its lines, in
Arrow batches: linear in its length, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Fixed values.
TARGET, MOST, OVERLAP = 800, 1600, 100
HEADER, TABLE_ROW = re.compile(r"#{1,6}\s"), re.compile(r"\s*\|")


def block_list(text: str) -> list[str]:
    """Runs of lines of one kind: table rows, or other lines; a heading begins a new run, blank lines part runs."""

    def runs() -> Iterator[tuple[tuple[int, int], str]]:
        headings = 0
        for line in text.split("\n"):
            kind = 0 if not line.strip() else 2 if TABLE_ROW.match(line) else 1
            headings += bool(HEADER.match(line))
            yield (kind, headings if kind else -1), line

    return ["\n".join(line for _, line in run) for (kind, _), run in groupby(runs(), key=lambda x: x[0]) if kind]


def filled(parts: Iterable[str], room: Callable[[int], bool], joint: int) -> Iterator[list[str]]:
    """Neighbours put together while the length of what is joined (``joint`` characters between two) finds room."""
    held: list[str] = []
    size = 0
    for part in parts:
        grown = size + joint + len(part) if held else len(part)
        if held and not room(grown):
            yield held
            held, grown = [], len(part)
        held.append(part)
        size = grown
    if held:
        yield held


def table_list(block: str, most: int = MOST) -> list[str]:
    """Parts of a table, each beginning with its first two lines and as many rows as fit."""
    lines = block.split("\n")
    header = "\n".join(lines[:2])
    groups = filled(lines[2:], lambda n: len(header) + 1 + n <= most, 1)
    return ["\n".join([header, *own]) for own in groups] or [header]


def char_list(text: str, size: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters that share ``overlap``, stripped; blank ones are left out."""
    starts = range(0, max(1, len(text) - overlap), size - overlap)
    return [piece for at in starts if (piece := text[at : at + size].strip())]


def chunk_list(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """Blocks, the ones over ``most`` characters split, and neighbours joined by a blank line within ``target`` characters."""

    def sized() -> Iterator[str]:
        for block in block_list(text):
            if len(block) <= most:
                yield block
            else:
                yield from table_list(block, most) if TABLE_ROW.match(block) else char_list(block, most)

    return ["\n\n".join(own) for own in filled(sized(), lambda n: n <= target, 2)]


def listed(column: Column, make: Callable[[str], list[str]]) -> Column:
    """``make`` of every text, as arrays; null gives none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: make(t) if t else [])

    return run(column)


def blocks(text: Column) -> Column:
    """Array of blocks: cut at blank lines, before headings, and where table rows begin or end."""
    return listed(text, block_list)


def table_parts(block: Column, most: int = MOST) -> Column:
    """Array of parts of a table, each beginning with its first two lines and as many rows as fit."""
    return listed(block, lambda t: table_list(t, most))


def chunk_pages(pages: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Rows of ``pages`` (source, page, text, ...) as chunks in ``text``, with their number in the page (from 0) in ``piece``.

    Null and blank pages have no chunks.
    """
    pieces = F.filter(listed(F.col("text"), lambda t: chunk_list(t, target, most)), lambda p: F.length(strip(p)) > 0)
    kept = [c for c in pages.columns if c not in ("text", "piece")]
    return pages.select(*kept, F.posexplode(pieces).alias("piece", "text"))
