"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level only looks at rows whose group at the level before had several
members.  Which groups those are is sent to the tasks as a bitmap (sized by the
number of rows, at most 32 MB): a row whose bit is off is unique for certain, so
its text is neither compared nor shuffled.  A bit set by another group costs
needless work, never a wrong result, since the last level groups by the SHA-256 of
the whole text.

Groups are only ever pre-aggregated (largest id, count).  The rows of a group meet
again in an equi-join of which Spark splits hot partitions, so a group with a
third of all rows never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_or_empty, written

#: Bits in one row of a bitmap, as Spark's bitmap functions lay them out.
BUCKET_BITS = 32768


def collision_bitmap(keys: DataFrame, key: str, filter_bits: int) -> DataFrame:
    """Bitmap rows (bucket, bits) with the bit of every value of ``key``; at most filter_bits / 8 bytes in all."""
    slot = F.pmod(F.col(key), F.lit(filter_bits))
    return (
        keys.select(F.floor(slot / BUCKET_BITS).alias("bucket"), (slot % BUCKET_BITS).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def mark_collisions(df: DataFrame, key: str, bitmap: DataFrame, filter_bits: int, flag: str) -> DataFrame:
    """Adds boolean ``flag``: the bit of ``key`` is on.  The bitmap's size is fixed, so it is broadcast."""
    slot = F.pmod(F.col(key), F.lit(filter_bits))
    place, bits = free_name(df, "__bucket"), free_name(df, "__bits")
    joined = df.withColumn(place, F.floor(slot / BUCKET_BITS)).join(
        F.broadcast(bitmap.select(F.col("bucket").alias(place), F.col("bits").alias(bits))), place, "left"
    )
    inside = (slot % BUCKET_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, (inside % 8).cast("int")) == 1
    return joined.withColumn(flag, F.coalesce(on, F.lit(False))).drop(place, bits)


def bitmap_bits(rows: int, least: int = 1 << 20, most: int = 1 << 28) -> int:
    """Bits of a bitmap for keys of ``rows`` rows: eight for each, at most 32 MB in all.

    A bitmap too small for its keys lets more rows through than need be; results don't change.
    """
    return min(most, max(least, 1 << (8 * max(1, rows) - 1).bit_length()))


def refine(docs: DataFrame, text: Column, prefix_chars: int, filter_bits: int | None) -> tuple[DataFrame, int]:
    """The level-two bitmap (which length and prefix hash groups have several members), and its bits."""
    head = F.substring(text, 1, prefix_chars)
    narrow = written(
        docs.select(F.octet_length(text).cast("long").alias("n"), F.xxhash64(F.octet_length(text), head).alias("prefix")),
        "exact-signatures",
    )
    bits = filter_bits or bitmap_bits(narrow.count())
    lengths = narrow.groupBy("n").count().where("count > 1").select(F.xxhash64("n").alias("key"))
    by_length = collision_bitmap(lengths, "key", bits)
    survivors = mark_collisions(narrow.withColumn("key", F.xxhash64("n")), "key", by_length, bits, "hit").where("hit")
    prefixes = survivors.groupBy("prefix").count().where("count > 1")
    return written(collision_bitmap(prefixes, "prefix", bits), "exact-bitmap"), bits


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    filter_bits: int | None = None,
    digest_col: str | None = None,
) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size and kept.

    Texts are equal if identical as given; null counts as empty.  Of equal texts the
    row with the largest id stays (null ids come last).  Rows that repeat id and text
    are one group: exactly one of them stays.  Columns of ``docs`` that are named like a
    result are replaced; all others pass through.  An empty table gives an empty result.

    With ``digest_col`` every row has the SHA-256 of its text (lowercase hex) in that column
    and no text: it is hashed once, where it is read, and never shuffled.
    """
    docs = docs.drop("keep_id", "group_size", "kept", *([digest_col] if digest_col else []))
    text, narrow_id = text_or_empty(text_col), F.col(f"`{id_col}`")
    key, hit, tie, first = (free_name(docs, c) for c in ("__prefix", "__hit", "__tie", "__first"))
    full = digest_col or free_name(docs, "__full")
    bitmap, bits = refine(docs, text, prefix_chars, filter_bits)
    marked = mark_collisions(
        docs.withColumn(key, F.xxhash64(F.octet_length(text), F.substring(text, 1, prefix_chars))), key, bitmap, bits, hit
    ).drop(key)
    if digest_col:
        marked = marked.withColumn(full, F.sha2(text, 256)).drop(text_col)
    passed = [c for c in marked.columns if c != hit]
    unique = marked.where(~F.col(hit)).select(
        *(F.col(f"`{c}`") for c in passed), narrow_id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    hashed = marked.where(F.col(hit)).drop(hit)
    if not digest_col:
        hashed = hashed.withColumn(full, F.sha2(text, 256))
    groups = written(
        hashed.groupBy(full).agg(F.max(narrow_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups"
    )
    members = hashed.join(groups, full)
    largest = narrow_id.eqNullSafe(F.col("keep_id"))
    result = [*(F.col(f"`{c}`") for c in passed), F.col("keep_id"), F.col("group_size")]
    repeats = written(
        members.where(largest & (F.col("group_size") > 1)).groupBy(full).count().where("count > 1"), "exact-repeats"
    )
    if repeats.isEmpty():
        return unique.unionByName(members.select(*result, largest.alias("kept")))
    flagged = members.join(repeats.select(full, F.lit(True).alias(tie)), full, "left")
    several = F.coalesce(F.col(tie), F.lit(False)) & largest
    plain = flagged.where(~several).select(*result, largest.alias("kept"))
    # Rows that repeat the kept id: one copy of one kind stays, all else goes.
    names = [*passed, "keep_id", "group_size"]
    kinds = flagged.where(several).groupBy(*dict.fromkeys([full, *names])).agg(F.count(F.lit(1)).cast("int").alias(tie))
    order = F.xxhash64(*[F.col(f"`{c}`") for c in passed])
    others = F.array_repeat(F.lit(False), F.col(tie) - 1)
    numbered = kinds.join(kinds.groupBy(full).agg(F.min(order).alias(first)), full).select(
        *result, F.explode(F.concat(F.array(order == F.col(first)), others)).alias("kept")
    )
    return unique.unionByName(plain).unionByName(numbered)
