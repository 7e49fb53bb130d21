"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one sequence (documents in a pseudorandom order) that is
cut into blocks of fixed length.  A source's target decides how many words the mix takes
of it, and so how many slots of the output hold its blocks.

The slots of all sources are dealt to the output shards by a pseudorandom permutation, and what
each shard gets of each source is counted.  These counts are a multinomial draw given the
totals (draws without replacement): independent draws would miss the targets and could take a
document more than twice.  The counts then number the slots: the j-th slot that a shard holds of a
source is slot k of that source, k running over the shards in order, and holds block P(k) of
its sequence.  P is a pseudorandom permutation of the source's full blocks, a new one in each
pass; the short last block ends each pass, and the last slot takes only as many words of its
block as are still due.  So the draw decides which block lies where; how many words of a document
are taken in all follows from the targets alone.

Permutations compute every index by itself, for a range of any size, so nothing is sorted.
Running sums come in levels, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name, scan_partitions, text_or_empty, written

#: Rounds of a permutation, and primes to multiply by: a size up to 2 ** 42 is no multiple of all three.
ROUNDS = 3
PRIMES = (1_048_583, 1_048_589, 1_048_601)
#: Slots that one row expands to at once.
SLOT_CHUNK = 4096
#: Documents of one source in a bucket, on average.
BUCKET_ROWS = 500
#: Places whose running sums one task adds up.
SUM_FAN = 4096
#: Most sources whose figures are sent to all tasks; with more, they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def with_permuted(df: DataFrame, name: str, index: Column, size: Column, *key: Column) -> DataFrame:
    """Adds ``name``: the image of ``index`` under a pseudorandom permutation of range(size) named by ``key``.

    Index and size are longs, the size from 1 to 2 ** 42.  Each round multiplies by a prime that
    doesn't divide the size and adds, modulo the size, then turns a first part of the range around;
    both are permutations, and the turn isn't linear.  Every round is a projection of its own, so
    that code is generated for it once.
    """
    first, second, third = (F.lit(p).cast("long") for p in PRIMES)
    factor = F.when(size % first != 0, first).when(size % second != 0, second).otherwise(third)
    df = df.withColumn(name, index.cast("long"))
    at = F.col(name)
    for turn in range(ROUNDS):
        df = df.withColumn(name, F.pmod(at * factor + F.pmod(F.xxhash64(*key, F.lit(turn), F.lit("add")), size), size))
        part = F.pmod(F.xxhash64(*key, F.lit(turn), F.lit("turn")), size) + 1
        df = df.withColumn(name, F.when(at < part, part - 1 - at).otherwise(at))
    return df


def word_count(text: Column) -> Column:
    """Number of words; a word is a run of anything but the six ASCII spaces."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows).

    Sources in order of code points, null last, weigh as ``cycle`` says, again and again.  They
    share ``share`` times all words by weight; no target exceeds ``limit`` times its source's
    size, and the excess is shared by weight among the rest until none is above.  A source of
    size 0 has target 0.

    With r = limit * size / weight, the sources that stop at their limit are the first ones in
    order of r, up to the first r that the level (what is left, by the weight left) doesn't
    exceed; so sums in that order give what sharing again and again would.
    """
    # Sources are one row each here; both windows run over these rows alone.
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, cycle))), (order % len(cycle) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * share
    weighed = sizes.select("source", "source_size", "rows", weight.alias("weight"), total.alias("total"))
    by_limit = Window.orderBy("ratio", "weight", F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        weighed.withColumn("most", F.col("source_size") * F.lit(float(limit)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("place", F.row_number().over(by_limit))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
            / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
    )
    # The first source that the level doesn't lift above its limit fixes the level for all behind it.
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return ranked.select(
        "source", "source_size", "rows",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least(F.col("most"), F.coalesce(open_level * F.col("weight"), F.col("most"))))
        .alias("target"),
    )


def with_source_figures(docs: DataFrame, figures: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``figures`` (a written table of one row per source)."""
    figures = figures.withColumnRenamed("source", "of")
    if figures.count() <= BROADCAST_SOURCES:
        figures = F.broadcast(figures)
    return docs.join(figures, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def running_sums(df: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over rows of the same source with a smaller ``at`` (one row for each source and ``at``).

    Sums run over stretches of ``SUM_FAN`` places first, then inside of a stretch.
    """
    grouped = df.withColumn("stretch", F.floor(F.col(at) / SUM_FAN))
    sums = grouped.groupBy("source", "stretch").agg(F.sum(value).alias("all"))
    ahead = F.sum("all").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.struct("source", "stretch").alias("of"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum(value).over(Window.partitionBy("source", "stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    placed = grouped.withColumn("here", F.coalesce(inside, F.lit(0)))
    joined = placed.join(starts, F.struct("source", "stretch").eqNullSafe(F.col("of")))
    return joined.withColumn(name, F.col("ahead") + F.col("here")).drop("of", "stretch", "ahead", "here")


def document_offsets(docs: DataFrame) -> DataFrame:
    """Adds ``start``: words of the same source that come before the row in a pseudorandom order.

    ``docs`` has id, digest, source, size, and ``rows`` (those of the source).  Sums run over buckets first, then inside a bucket.
    """
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS).cast("long")
    keyed = docs.withColumn("bucket", F.pmod(F.xxhash64("id", "digest"), buckets)).drop("rows")
    sums = running_sums(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket", "words", "first")
    starts = sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.col("first").alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("id", "digest", F.lit(7)), "id", "digest", "size")
    here = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        keyed.withColumn("here", here)
        .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
        .withColumn("start", F.col("ahead") + F.col("here"))
        .drop("of", "at", "ahead", "here", "bucket")
    )


def source_slots(targets: DataFrame, block_words: int) -> DataFrame:
    """(source, source_size, due, full, in_pass, slots, ahead, all_slots): how many slots hold blocks of each source."""
    full = F.floor(F.col("source_size") / block_words)
    in_pass = full + (F.col("source_size") % block_words > 0).cast("long")
    due = F.round("target").cast("long")
    passes = F.floor(due / F.col("source_size"))
    sources = targets.where("source_size > 0 AND target > 0").select(
        "source", "source_size", due.alias("due"), full.alias("full"), in_pass.alias("in_pass"),
        (passes * in_pass + F.ceil((due - passes * F.col("source_size")) / block_words)).cast("long").alias("slots"),
    )
    # One row for each source.
    ahead = F.coalesce(F.sum("slots").over(Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sources.select("*", ahead.alias("ahead"), F.sum("slots").over(Window.partitionBy()).alias("all_slots")).where("slots > 0")


def shard_draws(sources: DataFrame, shard_slots: int) -> DataFrame:
    """(shard, source, n): how many slots each output shard draws of each source; every shard but the last draws ``shard_slots``."""
    chunks = sources.select("source", "slots", "ahead", "all_slots")
    chunks = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_CHUNK))))
    # A large source's slots are dealt by many tasks; their number is given, as the rows before this are few.
    chunks = chunks.repartition(scan_partitions(sources.sparkSession), "source", "chunk")
    last = F.least(F.col("slots"), (F.col("chunk") + 1) * SLOT_CHUNK) - 1
    each = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * SLOT_CHUNK, last)))
    each = with_permuted(each, "at", F.col("ahead") + F.col("k"), F.col("all_slots"), F.lit("places"))
    return each.groupBy(F.floor(F.col("at") / shard_slots).alias("shard"), "source").agg(F.count(F.lit(1)).alias("n"))


def mix_slots(targets: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """The output's layout: (shard, slot, source, pass, block, take): words ``take`` of the block go to that place."""
    sources = written(source_slots(targets, block_words), "mix-sources")
    draws = running_sums(written(shard_draws(sources, shard_slots), "mix-draws"), "shard", "n", "first")
    in_shard = Window.partitionBy("shard")
    lower = F.sum("n").over(in_shard.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1))
    draws = draws.select("*", F.coalesce(lower, F.lit(0)).alias("lower"), F.sum("n").over(in_shard).alias("held"))
    draws = with_source_figures(draws, sources)
    each = draws.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("k", F.col("first") + F.col("j"))
    each = each.withColumn("turn", F.floor(F.col("k") / F.col("in_pass"))).withColumn("place", F.col("k") % F.col("in_pass"))
    each = with_permuted(each, "slot", F.col("lower") + F.col("j"), F.col("held"), F.lit("slots"), F.col("shard"))
    whole = F.col("place") < F.col("full")
    each = with_permuted(each, "drawn", F.when(whole, F.col("place")).otherwise(0), F.greatest("full", F.lit(1)), F.col("source"), F.col("turn"))
    words = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("place") * block_words)
    begin = F.col("turn") * F.col("source_size") + F.col("place") * block_words
    return each.select(
        "shard", "slot", "source", F.col("turn").alias("pass"),
        F.when(whole, F.col("drawn")).otherwise(F.col("place")).alias("block"), F.least(words, F.col("due") - begin).alias("take"),
    )


def mixed_pieces(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, cycle: tuple[float, ...], share: float, limit: float,
    block_words: int, shard_slots: int,
) -> tuple[DataFrame, DataFrame]:
    """Documents (id, digest, source, size, source_size, target, start) and the pieces of them that the mix takes.

    A piece is (id, digest, source, start, shard, slot, pass, block, first, words): words of the document from ``first`` on.
    ``digest`` tells rows of one id apart.
    """
    text = text_or_empty(text_col)
    sized = written(
        docs.select(
            F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), F.col(f"`{source_col}`").alias("source"),
            word_count(text).alias("size"),
        ),
        "mix-sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = written(source_targets(sums, cycle, share, limit), "mix-targets")
    placed = written(document_offsets(with_source_figures(sized, targets)), "mix-offsets")
    slots = mix_slots(targets, block_words, shard_slots)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = placed.where("size > 0").select(
        "id", "digest", "source", "start", "size", F.explode(F.sequence(first, last)).alias("block")
    )
    key = F.xxhash64("source", "block")  # null is a source of its own; the columns themselves are compared too
    # Slots grow with the corpus, whatever Spark makes of the few rows that they come from: never broadcast.
    joined = parts.withColumn("key", key).join(
        slots.hint("merge").withColumn("key", key).withColumnsRenamed({"source": "of", "block": "at"}), "key"
    ).where(F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("take"))
    pieces = joined.select(
        "id", "digest", F.col("of").alias("source"), "start", "shard", "slot", "pass", "block", (begin - F.col("start")).alias("first"), (end - begin).alias("words")
    ).where("words > 0")
    return placed, pieces


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block_words: int = 128, shard_slots: int = 1024,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words of it that the mix takes, repeats
    counted), first_shard and last_shard (the output shards that hold some of them; null where nothing is taken).

    Null texts have no words; null is a source of its own, the last.  Rows that repeat id and
    text lie side by side in their source's sequence and are taken as the blocks fall.  The
    result depends on the rows alone, not on their partitions.  An empty table gives an empty result.
    """
    placed, pieces = mixed_pieces(docs, id_col, text_col, source_col, cycle, share, limit, block_words, shard_slots)
    row = F.struct("id", "digest", "source", "start")
    shards = (F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    taken = pieces.groupBy(row.alias("key")).agg(F.sum("words").alias("words"), *shards)
    able = F.col("size") > 0
    return (
        placed.withColumn("key", row)
        .join(taken, "key", "left")
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target",
            F.when(able, F.coalesce("words", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
            *[F.when(able, F.col(c)).alias(c) for c in ("first_shard", "last_shard")],
        )
    )


#: What ``mix`` is given where nothing else is said.
DEFAULTS = {"cycle": (5, 2, 1), "share": 1.5, "limit": 2.0, "block_words": 128, "shard_slots": 1024}


def taken_parts(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, options: dict
) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """``docs`` with digest and number of the copy, the names of these two columns, and the pieces with the same row keys.

    Rows that repeat id, text and source are numbered; there is nothing to tell them apart but their
    other columns.  Only such rows are sorted for it.
    """
    names = {c: free_name(docs, f"__{c}") for c in ("digest", "copy")}
    docs = docs.withColumn(names["digest"], F.xxhash64(text_or_empty(text_col)))
    key = [F.col(f"`{id_col}`"), F.col(names["digest"]), F.col(f"`{source_col}`")]
    placed, pieces = mixed_pieces(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, **(DEFAULTS | options))
    same = ["id", "digest", "source"]
    repeated = written(placed.where("size > 0").groupBy(*same).count().where("count > 1").select(F.struct(*same).alias("of")), "mix-copies")
    if repeated.isEmpty():
        return docs.withColumn(names["copy"], F.lit(1)), names, pieces.join(
            placed.select(F.struct(*same, "start").alias("row"), "size"), F.struct(*same, "start").eqNullSafe(F.col("row"))
        ).drop("row").withColumn("copy", F.lit(1))

    def numbered(df: DataFrame, row: list, order: list, name: str) -> DataFrame:
        marked = df.join(repeated.withColumnRenamed("of", "__several"), F.struct(*row).eqNullSafe(F.col("__several")), "left")
        by_key = Window.partitionBy(*row).orderBy(*order)
        several = marked.where("__several IS NOT NULL").withColumn(name, F.row_number().over(by_key))
        return marked.where("__several IS NULL").withColumn(name, F.lit(1)).unionByName(several).drop("__several")

    own = [F.col(f"`{id_col}`").alias("id"), F.col(names["digest"]).alias("digest"), F.col(f"`{source_col}`").alias("source")]
    others = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    copies = numbered(placed.where("size > 0"), [F.col(c) for c in same], [F.col("start")], "copy")
    copies = copies.select(F.struct(*same, "start").alias("row"), "size", "copy")
    return numbered(docs, own, [others], names["copy"]), names, pieces.join(copies, F.struct(*same, "start").eqNullSafe(F.col("row"))).drop("row")


def piece_words(text: Column) -> Column:
    """Array of the words of a text, each with the white space behind it."""
    return F.regexp_extract_all(text, F.lit(rf"{WORD_PATTERN}[\x20\x09-\x0D]*"), F.lit(0))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: a row of ``docs`` for each pass that takes words of it, with those words as its text.

    Where a pass takes all words the text is unchanged; else it is the taken words with the
    white space behind each, in their order.  Rows that repeat id, text and source are rows of their own.
    Options are those of ``mix``.
    """
    rows, names, pieces = taken_parts(docs, id_col, text_col, source_col, options)
    key = ["id", "digest", "source", "copy"]
    part = F.struct("first", "words")
    found = pieces.groupBy(F.struct(*key).alias("row"), "pass", "size").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum("words").alias("taken"))
    inner = {c: free_name(rows, f"__{c}") for c in ("row", "pass", "size", "parts", "taken")}
    found = written(found, "mix-parts").withColumnsRenamed(inner)
    words = piece_words(text_or_empty(text_col))
    cut = F.array_join(
        F.flatten(F.transform(inner["parts"], lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")))), ""
    )
    row = F.struct(*[F.col(f"`{c}`").alias(k) for k, c in zip(key, (id_col, names["digest"], source_col, names["copy"]), strict=True)])
    return (
        rows.join(found.hint("merge"), row.eqNullSafe(F.col(inner["row"])))  # grows with the corpus: never broadcast
        .withColumn(text_col, F.when(F.col(inner["taken"]) == F.col(inner["size"]), F.col(f"`{text_col}`")).otherwise(cut))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as output shards: (shard, slot, source, pass, block, words), the words of each slot's block in their order.

    Slots count from 0 in each shard, and all but the last shard hold ``shard_slots``.  A slot holds ``block_words``
    words, or fewer where a source's sequence ends or no more are due.  Options are those of ``mix``.
    """
    rows, names, pieces = taken_parts(docs, id_col, text_col, source_col, options)
    key = ["id", "digest", "source", "copy"]
    held = F.struct("shard", "slot", "pass", "block", "start", "first", "words")
    found = written(pieces.groupBy(F.struct(*key).alias("row")).agg(F.collect_list(held).alias("held")), "mix-held")
    row = F.struct(*[F.col(f"`{c}`").alias(k) for k, c in zip(key, (id_col, names["digest"], source_col, names["copy"]), strict=True)])
    texts = rows.select(row.alias("of"), text_or_empty(text_col).alias("text"))
    each = texts.join(found.hint("merge"), F.col("of").eqNullSafe(F.col("row"))).select("row.source", F.explode("held").alias("p"), piece_words(F.col("text")).alias("all"))
    piece = F.transform(F.slice("all", (F.col("p.first") + 1).cast("int"), F.col("p.words").cast("int")), lambda w: F.regexp_extract(w, WORD_PATTERN, 0))
    parts = each.select("source", "p.shard", "p.slot", "p.pass", "p.block", F.struct(F.col("p.start").alias("start"), F.col("p.first").alias("first"), piece.alias("words")).alias("part"))
    together = F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["words"]))
    return parts.groupBy("shard", "slot", "source", "pass", "block").agg(together.alias("words"))
