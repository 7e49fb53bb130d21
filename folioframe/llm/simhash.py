"""SimHash near-dedup by anchor-point covering.

Two fingerprints that differ in at most T bits differ in at most T // 2 bits of one of
their halves.  The anchors of a half are the words of the Hamming code of length 31, a
perfect code of covering radius 1 (the half's last bit plays no part).  Every
fingerprint has its home at the nearest anchor of each half and is replicated to every
anchor within radius 1 + T // 2.  If two halves differ in at most T // 2 bits, the one
reaches the other's home, so comparing per anchor finds every link.

Equal fingerprints are one row from the start.  An anchor doesn't return its pairs but a
tree for each group that hangs together in it: at most one edge for each fingerprint.

An anchor with very many fingerprints is split before they are compared: of T + 1 segments that a
half is cut into, two fingerprints that link agree in one at least, so each goes to a part for every
segment of the other half, and if a part is still too full, of the anchor's own half.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import append_columns, scan_partitions, text_or_empty, written
from .components import connected_components

CODE_BITS = 31
SEED = 42
#: Fingerprints of a cell that are compared in one task; larger cells are split.  Of these, all are compared with all, in
#: blocks; where a cell can't be split further, the neighbours of each member are looked up.
DENSE_CELL = 20_000
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle_words: int) -> int:
    """Bit b is set if over half the shingles' hashes have it; 0 for a text without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle_words:
        return hashed(join(words), SEED)
    shingles = zip(*(words[i:] for i in range(shingle_words)), strict=False)
    values = np.fromiter((hashed(join(s), SEED) for s in shingles), np.uint64, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), BLOCK):
        ones += np.unpackbits(values[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, text_col: str, shingle_words: int, name: str = "fingerprint") -> DataFrame:
    """Rows of ``docs`` with the fingerprint as a (signed) long."""

    def maker():
        return lambda texts: [[signed(fingerprint(t, shingle_words)) for t in texts]]

    return append_columns(docs, text_or_empty(text_col).cast("binary"), StructType([StructField(name, LongType())]), maker)


def syndromes(halves: np.ndarray) -> np.ndarray:
    """Which place to flip (1 to 31) to reach the nearest anchor; 0: is an anchor."""
    found = np.zeros(len(halves), np.int64)
    for i in range(CODE_BITS):
        found ^= np.where(halves >> i & 1, i + 1, 0)
    return found


def flips_by_syndrome(radius: int) -> list[np.ndarray]:
    """For each syndrome the flips of at most ``radius`` bits that lead to an anchor, fewest bits first."""
    found: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for n in range(radius + 1):
        for places in combinations(range(1, CODE_BITS + 1), n):
            s = flip = 0
            for p in places:
                s ^= p
                flip |= 1 << (p - 1)
            found[s].append(flip)
    return [np.array(x, np.int64) for x in found]


def replicas(values: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, fingerprints, and whether the cell is the fingerprint's home."""
    flips = flips_by_syndrome(1 + threshold // 2)
    bits = values.view(np.uint64)
    cells, members, homes = [], [], []
    for half in (0, 1):
        own = ((bits >> np.uint64(32 * half)) & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)
        which = syndromes(own)
        for s in np.unique(which):
            at = np.flatnonzero(which == s)
            reach = own[at][:, None] ^ flips[s][None, :] | half << CODE_BITS
            cells.append(reach.ravel())
            members.append(np.repeat(values[at], len(flips[s])))
            homes.append(np.tile(np.arange(len(flips[s])) == 0, len(at)))
    return np.concatenate(cells), np.concatenate(members), np.concatenate(homes)


def trees(members: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that join what hangs together among distinct fingerprints, from one member to those reached."""
    members = np.sort(members)
    dense = len(members) <= DENSE_CELL
    masks = np.concatenate(flips_of_64(threshold)) if not dense else None
    left = np.ones(len(members), bool)
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        frontier = np.array([root])
        while len(frontier):
            reached = []
            for at in range(0, len(frontier), 64):
                values = members[frontier[at : at + 64]]
                if dense:
                    rest = np.flatnonzero(left)
                    near = (np.bitwise_count(values[:, None] ^ members[rest][None, :]) <= threshold).any(0)
                    new = rest[near]
                else:
                    probes = np.unique(values[:, None] ^ masks[None, :])
                    place = np.minimum(np.searchsorted(members, probes), len(members) - 1)
                    new = np.unique(place[(members[place] == probes) & left[place]])
                left[new] = False
                reached.append(new)
            frontier = np.concatenate(reached)
            if len(frontier):
                yield members[frontier], np.full(len(frontier), members[root])


def flips_of_64(threshold: int) -> list[np.ndarray]:
    return [
        np.array([sum(1 << p for p in places) for places in combinations(range(64), n)], np.uint64) for n in range(1, threshold + 1)
    ]


def cell_edges(cells: np.ndarray, members: np.ndarray, homes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of whole cells, given in order of the cell."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, len(cells)])
    lived = np.add.reduceat(homes.astype(np.int64), starts) > 0
    bits = members.view(np.uint64)
    pairs = starts[lived & (sizes == 2)]
    close = pairs[np.bitwise_count(bits[pairs] ^ bits[pairs + 1]) <= threshold]
    yield bits[close], bits[close + 1]
    for start, size in zip(starts[lived & (sizes > 2)], sizes[lived & (sizes > 2)], strict=True):
        yield from trees(bits[start : start + size], threshold)


def split_cells(cells: DataFrame, threshold: int, other: bool) -> DataFrame:
    """Cells (cell, fp, home) by the bits of each segment of a half: the one that isn't the cell's, or its own.

    Where a fingerprint is home doesn't matter any more: all links of a cell lie in its parts.
    """
    n = threshold + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, fp, half = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            bits = fp.view(np.uint64) >> (32 * ((half + other) % 2)).astype(np.uint64) & np.uint64(0xFFFFFFFF)
            for i in range(n):
                low, high = 32 * i // n, 32 * (i + 1) // n
                part = bits >> np.uint64(low) & np.uint64((1 << (high - low)) - 1) | np.uint64(i << 40 | other << 44)
                key = mixed(cell.view(np.uint64) ^ mixed(part)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(np.ones(len(fp), np.int64)), pa.array(half)], CELL_NAMES)

    return cells.select(*CELL_NAMES).mapInArrow(run, CELLS)


CELLS, CELL_NAMES = "cell long, fp long, home long, half long", ["cell", "fp", "home", "half"]


def mixed(h: np.ndarray) -> np.ndarray:
    """One to one, spread over all bits."""
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def cell_links(cells: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) of whole cells; each cell lies in one task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            if held and len(columns[0]) and columns[0][0] == columns[0][-1] == held[0][0][-1]:
                held.append(columns)  # one cell goes on through the whole batch
                continue
            whole = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns], strict=True)]
            held = [[c[cut:] for c in columns]] if len(columns[0]) else held
            yield from edges_of(whole)
        if held:
            yield from edges_of([np.concatenate(x) for x in zip(*held, strict=True)])

    def edges_of(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]) > 1:
            found = list(cell_edges(*columns, threshold))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = cells.select("cell", "fp", "home").repartition(scan_partitions(cells.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(compare, "a long, b long")


def fingerprint_links(prints: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (long column fp) linked at ``threshold`` or fewer bits."""

    def replicate(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), BLOCK):
                cells, members, homes = replicas(np.ascontiguousarray(values[at : at + BLOCK]), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells, members, homes.astype(np.int64), cells >> CODE_BITS)], CELL_NAMES)

    cells = prints.select("fp").mapInArrow(replicate, CELLS)
    links = []
    for other in (True, False, None):
        counts = cells.groupBy("cell").count()
        large = written(counts.where(F.col("count") > DENSE_CELL).select("cell"), "large-cells") if other is not None else None
        if large is None or large.isEmpty():
            links.append(cell_links(cells, threshold))
            break
        links.append(cell_links(cells.join(large, "cell", "left_anti"), threshold))
        cells = written(split_cells(cells.join(large, "cell", "left_semi"), threshold, other), "split-cells")
    return reduce(DataFrame.unionAll, links).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, threshold: int = 2
) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``: 16 hex digits, and the least id reachable over links.

    Null is the empty text, and a text without words has fingerprint zero, which links like any
    other.  A text of fewer words than a shingle is one shingle.  ``threshold`` may be 0 to 3.
    Null ids have their group's component_id.  Other columns of ``docs`` don't matter.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("threshold must be 0 to 3")
    narrow = written(
        with_fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", shingle_words, "fp").drop("text"),
        "fingerprints",
    )
    prints = written(narrow.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    roots = written(connected_components(fingerprint_links(prints, threshold)), "roots")
    placed = written(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    least = written(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "least-ids")
    groups = written(placed.join(least, "root").select("fp", "component_id"), "groups")
    return narrow.join(groups, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
