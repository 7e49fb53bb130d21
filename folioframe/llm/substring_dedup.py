"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes covers it that also starts somewhere else.  Strings
are judged on the input, in UTF-8, and never cross documents.

Sorting every suffix of a corpus would move all of it, so only suffixes at anchors are sorted.
The anchor of a string is the place of its smallest gram (GRAM bytes, by hash; the first of
equals); equal strings have their anchors at the same offset.  Neighbouring strings share an
anchor, and all strings of one anchor together are its context.

  1. Grams of all anchors are counted; those that occur once settle their strings.
  2. Contexts of the others are counted by SHA-256 (its first 128 bits); equal contexts settle all
     strings in them.
  3. Where a gram still has several contexts, each different one is cut from one of its documents,
     and the suffixes that start at its anchors are sorted by merging.  Two suffixes are compared by
     prefix polynomial hashes: binary search finds their common extension, and the byte behind it
     decides.  Common extensions of neighbours split the order into runs; within a run, equal hashes
     of what stands left of the anchor give equal strings, and these are verified byte by byte.

A gram with very many contexts is split before it is sorted: strings that begin ``lo`` to ``hi`` bytes
before the anchor agree, if they are equal, in the bytes that all of these places share, so contexts are
parted by those bytes, for narrower and narrower ranges.  A range of one place leaves strings that are
equal or not, and these are grouped by their bytes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, give_back_memory, scan_partitions, text_or_empty, written
from .exact_dedup import BUCKET_BITS, bitmap_bits, collision_bitmap, mark_collisions

GRAM = 200
#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once: short documents together, long ones in stretches that overlap.
STRETCH = 1 << 18
#: Contexts that are sorted together; what has more is split, into this many ranges of places at once.
MOST_CONTEXTS, SPLIT = 4096, 4
#: Bytes of contexts whose parts are sorted in one go; a part stays whole.
BYTES_AT_ONCE = 1 << 22
#: How much larger the bitmaps are than those for keys of all rows; the keys here are few of many.
KEY_SHARE = 8
WORD = np.uint64


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, WORD)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of a base up to TABLE, and of base ** TABLE: products of two are all that a buffer of 2 GB needs.
TABLE = 2 * STRETCH
_powers = {base: powers(base, TABLE) for base in (BASE, INVERSE)}
_steps = {base: powers(pow(base, TABLE, 1 << 64), (1 << 31) // TABLE) for base in (BASE, INVERSE)}


def power_at(base: int, n: np.ndarray) -> np.ndarray:
    return _powers[base][n % TABLE] * _steps[base][n // TABLE]


def power(base: int, n: int) -> np.ndarray:
    return _powers[base][:n] if n <= TABLE else power_at(base, np.arange(n))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i]: the sum of (byte + 1) * BASE ** place over the first i bytes, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, WORD)
    for at in range(0, len(data), TABLE):
        part = data[at : at + TABLE].astype(WORD)
        part += WORD(1)
        part *= _powers[BASE][: len(part)]
        part *= _steps[BASE][at // TABLE]
        own = out[at + 1 : at + 1 + len(part)]
        np.cumsum(part, out=own)
        own += out[at]
    return out


def piece_hashes(prefix: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of pieces, the same wherever a piece stands."""
    return (prefix[start + size] - prefix[start]) * power_at(INVERSE, start)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> WORD(32))) * WORD(0xD6E8FEB86659FD93)
    return h ^ (h >> WORD(32))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, place, gram) of every anchor of documents that lie one behind the other, ending at ``ends``.

    Strings starting at first to last have their smallest gram at place.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    prefix = prefix_hashes(data)
    grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * power(INVERSE, len(prefix) - GRAM))
    least = (grams & ~WORD(0xFFFFFFFF)) | np.arange(len(grams), dtype=WORD)
    span, have = length - GRAM + 1, 1  # grams of a string
    while have * 2 <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    place = (least & WORD(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    inside = start + length <= ends[np.searchsorted(ends, start, side="right")]
    new = np.r_[True, place[1:] != place[:-1]] | np.r_[True, inside[1:] != inside[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1
    valid = inside[first]
    first, last = first[valid], last[valid]
    return first, last, place[first], grams[place[first]].view(np.int64)


def stretches(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, which text, its offset) of parts to hash at once; long texts in parts that share length - 1 bytes."""
    parts, which, offsets, total = [], [], [], 0

    def out():
        return b"".join(parts), np.cumsum([len(p) for p in parts]), np.array(which), np.array(offsets)

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), STRETCH):
            part = text[at : at + STRETCH + length - 1]
            if len(part) < length:
                continue
            parts.append(part)
            which.append(i)
            offsets.append(at)
            total += len(part)
            if total >= STRETCH:
                yield out()
                parts, which, offsets, total = [], [], [], 0
    if parts:
        yield out()


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS_AT_ONCE`` rows, as their texts become Python values."""
    return (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE))


def sent_bitmap(keys: DataFrame, key: str, filter_bits: int) -> Broadcast:
    """A bitmap of ``filter_bits`` of the values of ``key``, for numpy on the tasks."""
    bits = np.zeros(-(-filter_bits // BUCKET_BITS) * BUCKET_BITS // 8, np.uint8)
    for row in collision_bitmap(keys, key, filter_bits).toLocalIterator():
        at = row["bucket"] * BUCKET_BITS // 8
        bits[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def digests(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first 128 bits of each piece's SHA-256, as two longs."""
    found = np.frombuffer(b"".join(hashlib.sha256(p).digest()[:16] for p in pieces), ">i8").astype(np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def anchor_grams(docs: DataFrame, length: int) -> DataFrame:
    """(gram) of every anchor of ``docs`` (id, digest, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            for data, ends, _, _ in stretches(batch.column(0).to_pylist(), length):
                gram = anchors(np.frombuffer(data, np.uint8), ends, length)[3]
                yield pa.RecordBatch.from_arrays([pa.array(gram)], ["gram"])
        give_back_memory()

    return docs.select("text").mapInArrow(run, "gram long")


def anchor_contexts(docs: DataFrame, length: int, wanted: Broadcast, filter_bits: int) -> DataFrame:
    """(id, digest, gram, first, at, strings, c1, c2) of the anchors whose gram's bit is on.

    The context begins at byte ``first`` and holds ``strings`` strings, its anchor stands ``at`` bytes in, and
    c1, c2 tell its bytes.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, digest long, gram long, first long, at long, strings long, c1 long, c2 long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            for data, ends, which, offsets in stretches(batch.column(2).to_pylist(), length):
                first, last, place, gram = anchors(np.frombuffer(data, np.uint8), ends, length)
                keep = np.flatnonzero(wanted.value[(slot := gram % filter_bits) >> 3] >> (slot & 7) & 1)
                first, last, place, gram = first[keep], last[keep], place[keep], gram[keep]
                part = np.searchsorted(ends, first, side="right")
                begin = first - np.r_[0, ends[:-1]][part] + offsets[part]
                c1, c2 = digests([data[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                doc = pa.array(which[part])
                ids, rows = (pa.array(batch.column(k)).take(doc) for k in (0, 1))
                columns = [ids, rows, *map(pa.array, (gram, begin, place - first, last - first + 1, c1, c2))]
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back_memory()

    return docs.select("id", "digest", "text").mapInArrow(run, schema)


def context_bytes(docs: DataFrame, chosen: DataFrame, length: int, filter_bits: int) -> DataFrame:
    """(part, lo, hi, c1, c2, at, strings, context) of the contexts ``chosen`` (gram, c1, c2, id, digest, first, at, strings).

    Each is cut from its document; only texts of documents that hold a chosen one are shuffled.  A document whose row
    repeats gives its contexts as often.
    """
    held = F.collect_list(F.struct("gram", "c1", "c2", "first", "at", "strings"))
    by_row = written(chosen.groupBy(F.struct("id", "digest").alias("of")).agg(held.alias("held")), "chosen-contexts")
    key = F.xxhash64("id", "digest")
    touched = collision_bitmap(by_row.select(F.xxhash64("of.id", "of.digest").alias("key")), "key", filter_bits)
    able = mark_collisions(docs.withColumn("key", key), "key", touched, filter_bits, "hit").where("hit").drop("key", "hit")
    schema = "part long, lo long, hi long, c1 long, c2 long, at long, strings long, context binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, own = batch.column(0)[row].as_py(), pa.array(batch.column(1)[row].values)
                gram, c1, c2, first, at, strings = own.flatten()
                pieces = [text[a : a + n - 1 + length] for a, n in zip(first.to_pylist(), strings.to_pylist(), strict=True)]
                ranges = [pa.array(np.full(len(pieces), x, np.int64)) for x in (0, length - GRAM)]
                yield pa.RecordBatch.from_arrays([gram, *ranges, c1, c2, at, strings, pa.array(pieces, pa.binary())], names)
        give_back_memory()

    joined = able.join(by_row, F.struct("id", "digest").eqNullSafe(F.col("of"))).select("text", "held")
    return written(joined.mapInArrow(run, schema), "contexts")


class Suffixes:
    """Suffixes of one buffer, each with an end, compared by hashes."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data + b"\0", np.uint8)
        self.prefix = prefix_hashes(self.data)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common extensions from a and b on, at most ``most``: binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = piece_hashes(self.prefix, a, middle) == piece_hashes(self.prefix, b, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def before(self, a, a_end, b, b_end) -> np.ndarray:
        """Whether suffix a sorts strictly before suffix b."""
        most = np.minimum(a_end - a, b_end - b)
        n = self.common(a, b, most)
        ended = n == most
        return np.where(ended, a_end - a < b_end - b, self.data[a + np.where(ended, 0, n)] < self.data[b + np.where(ended, 0, n)])

    def merge_sorted(self, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (which lie together): runs of 1, 2, 4, ... are merged.

        All merges of a round happen at once: an element's place is its place in its own run and
        the number of elements of the other run before it, which binary search finds.
        """
        n = len(start)
        order = np.arange(n)
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[heads, n])
        head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        run = 1
        while run < sizes.max(initial=0):
            slot = np.arange(n) - head
            mine = slot // run
            other = head + (mine ^ 1) * run
            stop = np.minimum(other + run, head + size)
            at = np.flatnonzero(other < head + size)
            low, high = other[at].copy(), stop[at].copy()
            x = order[at]
            left = (mine[at] & 1) == 0
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                middle = (low[k] + high[k]) // 2
                y = order[middle]
                # Equals keep the order of the runs: a left element goes before equal right ones.
                goes = np.where(
                    left[k],
                    self.before(start[y], end[y], start[x[k]], end[x[k]]),
                    ~self.before(start[x[k]], end[x[k]], start[y], end[y]),
                )
                low[k] = np.where(goes, middle + 1, low[k])
                high[k] = np.where(goes, high[k], middle)
            place = np.arange(n)
            place[at] = head[at] + (mine[at] & ~1) * run + (slot[at] % run) + (low - other[at])
            merged = np.empty(n, np.int64)
            merged[place] = order
            order = merged
            run *= 2
        return order


def repeated_strings(
    part: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, strings: np.ndarray, contexts: list[bytes], length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of every string of ``length`` bytes that stands in two of the contexts, which lie in order of part.

    Of a context only the strings count that begin ``lo`` to ``hi`` bytes before its anchor.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    suffixes = Suffixes(b"".join(contexts))
    order = suffixes.merge_sorted(begin + at, begin + sizes, part)
    g, place, first, end, count = part[order], (begin + at)[order], begin[order], (begin + sizes)[order], strings[order]
    low, high = lo[order], hi[order]
    most = np.minimum(end[1:] - place[1:], end[:-1] - place[:-1])
    extension = np.where(g[1:] == g[:-1], suffixes.common(place[:-1], place[1:], most), -1)
    found, starts = [], []
    for left in range(length - GRAM + 1):  # bytes of the string before its anchor
        able = np.flatnonzero((place - left >= first) & (place - left < first + count) & (low <= left) & (left <= high))
        if len(able) < 2:
            continue
        run = np.cumsum(np.r_[True, extension < length - left])[able]
        hashes = mixed(piece_hashes(suffixes.prefix, place[able] - left, left)) if left else np.zeros(len(able), WORD)
        by = np.lexsort((hashes, run))
        same = (run[by][1:] == run[by][:-1]) & (hashes[by][1:] == hashes[by][:-1])
        pairs = np.flatnonzero(same)
        true = np.ones(len(pairs), bool)
        span = np.arange(length)
        for at_once in np.array_split(np.arange(len(pairs)), max(1, len(pairs) // 4096)):
            a, b = (place[able[by[pairs[at_once] + d]]] - left for d in (0, 1))
            true[at_once] = (suffixes.data[a[:, None] + span] == suffixes.data[b[:, None] + span]).all(1)
        if true.all():
            both = np.unique(np.concatenate([able[by[pairs]], able[by[pairs + 1]]]))
        else:  # a collision may stand between two equals: the strings themselves decide
            whole = suffixes.data.tobytes()
            alike = defaultdict(list)
            for i in able:
                alike[g[i], whole[place[i] - left : place[i] - left + length]].append(i)
            both = np.array([i for same_string in alike.values() if len(same_string) > 1 for i in same_string], np.int64)
        found.append(order[both])
        starts.append((place - left - first)[both])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(starts)


def sorted_strings(contexts: DataFrame, length: int) -> DataFrame:
    """(c1, c2, start): repeated strings of the contexts, by sorting the suffixes of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            part = table.column("part").to_numpy()
            cut = int(np.searchsorted(part, part[-1])) if len(part) else 0
            held = table.slice(cut).to_batches()  # the last part may go on
            yield from in_pieces(table.slice(0, cut))
        if held:
            yield from in_pieces(pa.Table.from_batches(held).combine_chunks())
        give_back_memory()

    def in_pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole parts, as many at once as have ``BYTES_AT_ONCE``; a larger one alone."""
        part = table.column("part").to_numpy()
        ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1 if len(part) else np.zeros(0, np.int64)
        total = np.cumsum(pc.binary_length(table.column("context")).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(part):
            most = np.searchsorted(total, (total[at - 1] if at else 0) + BYTES_AT_ONCE, side="right")
            end = int(ends[max(np.searchsorted(ends, most, side="right") - 1, np.searchsorted(ends, at, side="right"))])
            yield from found(table.slice(at, end - at))
            at = end

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        same = [table.column(c).to_numpy() for c in ("part", "c1", "c2")]
        new = np.r_[True, np.any([x[1:] != x[:-1] for x in same], axis=0)]  # a context counts once
        table = table.filter(pa.array(new))
        part, lo, hi, at, strings, c1, c2 = (table.column(c).to_numpy() for c in ("part", "lo", "hi", "at", "strings", "c1", "c2"))
        which, start = repeated_strings(part, lo, hi, at, strings, table.column("context").to_pylist(), length)
        yield pa.RecordBatch.from_arrays([pa.array(c1[which]), pa.array(c2[which]), pa.array(start)], ["c1", "c2", "start"])

    dealt = contexts.repartition(scan_partitions(contexts.sparkSession), "part").sortWithinPartitions("part", "c1", "c2")
    return dealt.mapInArrow(run, "c1 long, c2 long, start long")


def split_parts(contexts: DataFrame, length: int) -> DataFrame:
    """The contexts in parts for narrower ranges of places, each told by the bytes that strings from these places share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows, parts, lows, highs = [], [], [], []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lo", "hi", "at", "strings", "context"))
            for row, (lo, hi, at, strings, context) in enumerate(zip(*columns, strict=True)):
                bounds = [lo + (hi - lo + 1) * j // SPLIT for j in range(SPLIT + 1)]
                for low, above in zip(bounds, bounds[1:]):
                    high = above - 1
                    if low > high or low > at or high < at - strings + 1:
                        continue
                    shared = xxhash.xxh3_64_intdigest(context[at - low : at - high + length], seed=low * length + high)
                    rows.append(row)
                    parts.append(shared - (1 << 64) if shared >> 63 else shared)
                    lows.append(low)
                    highs.append(high)
            others = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows, pa.int64())) for c in ("c1", "c2", "at", "strings", "context")]
            ranges = [pa.array(x, pa.int64()) for x in (parts, lows, highs)]
            yield pa.RecordBatch.from_arrays([*ranges, *others], ["part", "lo", "hi", "c1", "c2", "at", "strings", "context"])
        give_back_memory()

    return contexts.select("part", "lo", "hi", "c1", "c2", "at", "strings", "context").mapInArrow(run, contexts.schema)


def grouped_strings(contexts: DataFrame, length: int) -> DataFrame:
    """(c1, c2, start): the same for ranges of one place, whose strings are grouped by their bytes."""
    start = F.col("at") - F.col("lo")
    rows = contexts.select("c1", "c2", start.alias("start"), F.expr(f"substring(context, CAST(at - lo AS INT) + 1, {length})").alias("string"))
    one = F.struct("c1", "c2")
    several = rows.groupBy("string").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("string")
    return rows.join(written(several, "repeated-strings"), "string").select("c1", "c2", "start")


def strings_of_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """(c1, c2, start): all strings that stand in several of the contexts; parts with too many are split and split again."""
    found = []
    while True:
        single = contexts.where("lo = hi")
        sizes = contexts.where("lo < hi").groupBy("part").count()
        large = written(sizes.where(F.col("count") > MOST_CONTEXTS).select("part"), "large-parts")
        found.append(sorted_strings(contexts.where("lo < hi").join(large, "part", "left_anti"), length))
        if found[1:]:  # the first ranges are wide
            found.append(grouped_strings(single, length))
        if large.isEmpty():
            return reduce(DataFrame.unionAll, found)
        contexts = written(split_parts(contexts.join(large, "part", "left_semi").where("lo < hi"), length), "split-contexts")


def repeated_spans(docs: DataFrame, length: int, filter_bits: int | None) -> DataFrame:
    """(id, digest, spans): for rows with repeats, spans (start, end) of bytes to remove, overlapping and in no order."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    grams = written(anchor_grams(docs, length).groupBy("gram").count().where("count > 1").select("gram"), "repeated-grams")
    bits = filter_bits or bitmap_bits(KEY_SHARE * grams.count())
    rows = written(anchor_contexts(docs, length, sent_bitmap(grams, "gram", bits), bits), "anchors")
    kinds = written(rows.groupBy("gram", "c1", "c2").count(), "context-kinds")
    # Grams with several contexts, one of which at least occurs once.
    mixed_grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("count").alias("least")).where("kinds > 1 AND least = 1")
    mixed_grams = written(mixed_grams.select("gram"), "mixed-grams")
    where = F.min(F.struct("id", "digest", "first", "at", "strings"))
    chosen = rows.join(mixed_grams, "gram", "left_semi").groupBy("gram", "c1", "c2").agg(where.alias("w")).select("gram", "c1", "c2", "w.*")
    found = strings_of_contexts(context_bytes(docs, chosen, length, bits), length)
    starts = written(found.groupBy("c1", "c2").agg(F.collect_set("start").alias("starts")), "string-starts")
    whole = kinds.where("count > 1").select("c1", "c2", F.lit(True).alias("whole"))
    settled = written(whole.join(starts, ["c1", "c2"], "full"), "settled-contexts")
    span = F.when(
        F.col("whole"), F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("strings") - 1 + length).alias("end")))
    ).otherwise(F.transform("starts", lambda s: F.struct((F.col("first") + s).alias("start"), (F.col("first") + s + length).alias("end"))))
    spans = rows.join(settled, ["c1", "c2"]).select("id", "digest", F.explode(span).alias("span"))
    return spans.groupBy("id", "digest").agg(F.collect_set("span").alias("spans"))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, filter_bits: int | None = None
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs``.

    ``spans`` are the maximal removed runs (start, end) in bytes of the text in UTF-8.  Null counts
    as empty; texts shorter than ``length`` lose nothing.  Rows that repeat a text repeat all its
    strings.  Ids may repeat or be null.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    spans = written(repeated_spans(rows, length, filter_bits), "repeated-spans")
    bits = filter_bits or bitmap_bits(KEY_SHARE * spans.count())
    touched = written(collision_bitmap(spans.select(F.xxhash64("id", "digest").alias("key")), "key", bits), "touched")
    marked = mark_collisions(rows.withColumn("key", F.xxhash64("id", "digest")), "key", touched, bits, "hit").drop("key")
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    none = F.array().cast("array<struct<start:long,end:long>>")
    untouched = marked.where("NOT hit").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("spans"),
    )
    of = spans.select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), "spans")
    cut = marked.where("hit").join(of, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            made: list[list] = [[], [], [], [], []]
            for data, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = merged_spans([(s["start"], s["end"]) for s in own or []])
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                values = (len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "end": b} for a, b in runs])
                for column, value in zip(made, values, strict=True):
                    column.append(value)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), kind]
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(made, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        give_back_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    removed = cut.select("id", "text", "spans").mapInArrow(run, f"id {kind}, {result}")
    return untouched.unionByName(removed).withColumnRenamed("id", id_col)
