"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are near if they have at least ``least_words`` words each and one word replaced,
inserted or deleted makes one the other; lines of fewer words must be equal.  Every line
emits a hashed key for each variant with one word deleted, and one for itself.  Keys carry
what was deleted where, so equal keys mean an edit distance of at most one:

  replaced:  a and b without word i, for the same i and length;
  inserted:  a without word i, and b as a whole.

So lines meet in aggregations (the earliest line of each key), never in pairs, however many
share a key.  The edit distance to the earliest is verified on the words; a key whose lines are not
near (hashes that agree by chance) is taken apart by the variants themselves.

Equal lines are those of one 128-bit hash.  Rows are told apart by id and digest of the text.

Variants are made only of lines that can have a near line: two near lines share their first
or their last half, so a line whose halves no other line has is settled by its half keys.
Which keys have several lines is sent as a bitmap sized by the number of lines, 32 MB at most (see
``exact_dedup``); its mistakes cost work, never results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_or_empty, written
from .exact_dedup import bitmap_bits, collision_bitmap, mark_collisions

#: Distances of the doubling steps that make prefix sums of an array.
DOUBLINGS = [1 << i for i in range(30)]
#: Bits of a variant's key.
KEY_BITS = 64
#: The two halves of a line's hash.
HASH = ["h", "g"]
#: White space within a line; with the space and the line's end, all that parts words.
OTHER_SPACE = r"[\x09\x0B-\x0D]"


def row_digest(text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text_or_empty(text_col))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, line, words, h, g): every line, counted from 0, with its words and their hash.

    Words are cut at single spaces, which takes no pattern; other white space is made a space before.
    """
    spaced = F.regexp_replace(text_or_empty(text_col), OTHER_SPACE, " ")
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), row_digest(text_col).alias("digest"), F.posexplode(F.split(spaced, "\n")).alias("line", "text"))
    worded = lines.select("id", "digest", "line", F.array_remove(F.split("text", " "), "").alias("words"))
    return worded.withColumn("h", F.xxhash64("words")).withColumn("g", F.xxhash64(F.lit("second"), "words"))


def half_keys(words: Column) -> Column:
    """Hashes of the first and last halves, for this length and for that of a line one word shorter."""
    n = F.size(words)

    def pair(h: Column) -> list[Column]:
        return [
            F.xxhash64(F.lit("first"), h, F.slice(words, F.lit(1), h)),
            F.xxhash64(F.lit("last"), h, F.slice(words, n - h + 1, h)),
        ]

    return F.array_distinct(F.array(*pair(F.floor(n / 2).cast("int")), *pair(F.floor((n - 1) / 2).cast("int"))))


def xor_all(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def prefix_xor(values: Column) -> Column:
    """Running XOR, by doubling: each step adds what stands 1, 2, 4, ... places before."""
    steps = F.filter(F.array(*map(F.lit, DOUBLINGS)), lambda d: d < F.size(values))
    return F.aggregate(
        steps,
        values,
        lambda held, d: F.transform(held, lambda x, i: x.bitwiseXOR(F.coalesce(F.get(held, i - d), F.lit(0).cast("long")))),
    )


def with_variants(lines: DataFrame, spelled: bool = False) -> DataFrame:
    """Distinct lines (place, h, g, words) with the keys of their deletion neighbourhood, an array for each role: ``replaced``, ``deleted`` and ``whole``.

    With ``spelled`` the keys of ``deleted`` are one for each word, else each once.
    """
    at = lines.withColumn("here", F.transform("words", lambda w, i: F.xxhash64(i, w)))
    at = at.withColumn("moved", F.transform("words", lambda w, i: F.xxhash64(i - 1, w)))
    at = at.withColumn("whole", xor_all(F.col("here"))).withColumn("all_moved", xor_all(F.col("moved")))
    both = F.zip_with("here", "moved", lambda a, b: a.bitwiseXOR(b))
    at = at.withColumn("running", prefix_xor(both)).withColumn("n", F.size("words"))
    replaced = F.transform("here", lambda g, i: cut(F.xxhash64(F.lit("replaced"), F.col("n"), i, F.col("whole").bitwiseXOR(g))))
    # Words before i keep their places, those behind it move up by one.
    shorter = F.zip_with("running", "here", lambda r, g: r.bitwiseXOR(g).bitwiseXOR(F.col("all_moved")))
    deleted = F.transform(shorter, lambda v: cut(F.xxhash64(F.lit("shorter"), F.col("n") - 1, v)))
    own = F.array(cut(F.xxhash64(F.lit("shorter"), F.col("n"), F.col("whole"))))
    keys = [replaced.alias("replaced"), (deleted if spelled else F.array_distinct(deleted)).alias("deleted"), own.alias("whole")]
    return at.select(*lines.columns, *keys)


def cut(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << KEY_BITS) - 1 if KEY_BITS < 64 else -1).cast("long"))


def variants(lines: DataFrame) -> DataFrame:
    """(key, role, place, h, g): a row for each key of lines ``with_variants``."""
    ends = F.size("replaced"), F.size("replaced") + F.size("deleted")
    role = F.when(F.col("i") < F.col("a"), "replaced").when(F.col("i") < F.col("b"), "deleted").otherwise("whole")
    each = lines.select("place", *HASH, ends[0].alias("a"), ends[1].alias("b"), F.posexplode(F.concat("replaced", "deleted", "whole")).alias("i", "key"))
    return each.select("key", role.alias("role"), "place", *HASH)


def spelled_variants(lines: DataFrame) -> DataFrame:
    """``variants`` of distinct lines (place, h, g, words), with ``variant``: what the key stands for."""

    def without(i: Column) -> Column:
        return F.array_join(F.filter("words", lambda _, j: j != i), " ")

    def keyed(role: str, text) -> Column:
        return F.transform(role, lambda k, i: F.struct(k.alias("key"), F.lit(role).alias("role"), text(i).alias("variant")))

    every = F.concat(
        keyed("replaced", lambda i: F.concat(F.lit("replaced "), F.size("words").cast("string"), F.lit(" "), i.cast("string"), F.lit(" "), without(i))),
        keyed("deleted", lambda i: F.concat(F.lit("shorter "), without(i))),
        keyed("whole", lambda _: F.concat(F.lit("shorter "), F.array_join("words", " "))),
    )
    return with_variants(lines, spelled=True).select(F.explode(every).alias("v"), "place", *HASH).select("v.*", "place", *HASH)


def earlier_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """(h, g, place, witness, *by): for every variant row the earliest line that it meets in ``by``, if that is before it."""
    first = [F.min(F.when(F.col("role") == r, F.col("place"))).alias(f"first_{r}") for r in ("replaced", "deleted", "whole")]
    earliest = written(rows.groupBy(*by).agg(*first), "line-earliest")
    role = F.col("role")
    witness = F.when(role == "replaced", F.col("first_replaced")).when(role == "deleted", F.col("first_whole")).otherwise(F.col("first_deleted"))
    return rows.join(earliest, by).select(*HASH, "place", witness.alias("witness"), *by).where("witness < place")


def within_one(a: Column, b: Column) -> Column:
    """Whether one word's edit makes array ``a`` array ``b``: common head and tail leave one word at most."""

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differs == 0, F.least(F.size(x), F.size(y))).otherwise(differs - 1)

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


def near_lines(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, filter_bits: int, least_words: int) -> DataFrame:
    """(h, g) of the distinct lines that have an earlier near line."""
    keys = lines.where(F.col("n") >= least_words).select(*HASH, F.explode("halves").alias("key"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in HASH for f in (F.min, F.max)]  # of plain numbers, which need no sorting
    shared = keys.groupBy("key").agg(*ends).where("min_h <> max_h OR min_g <> max_g").select("key")
    halves = written(collision_bitmap(shared, "key", filter_bits), "line-halves")
    candidates = written(
        mark_collisions(keys, "key", halves, filter_bits, "hit").where("hit").groupBy("h").agg(F.count(F.lit(1)).alias("c")), "line-candidates"
    )
    chosen = written(collision_bitmap(candidates, "h", filter_bits), "line-bitmap")
    # Shorter lines that hit by chance go after the grouping: before it, their filter would cut every line into words once more.
    again = mark_collisions(line_rows(docs, id_col, text_col), "h", chosen, filter_bits, "hit").where("hit")
    distinct = again.groupBy(*HASH).agg(F.min(F.struct("id", "digest", "line")).alias("place"), F.any_value("words").alias("words"))
    distinct = written(with_variants(distinct.select(*HASH, "place", "words").where(F.size("words") >= least_words)), "line-texts")
    keyed = distinct.select(F.explode(F.concat("replaced", "deleted", "whole")).alias("key"))
    counted = keyed.groupBy("key").count().where("count > 1").select("key")
    met = written(collision_bitmap(counted, "key", filter_bits), "line-variants")
    rows = written(mark_collisions(variants(distinct), "key", met, filter_bits, "hit").where("hit").drop("hit"), "line-keys")
    found = earlier_lines(rows, ["key"])
    words = distinct.select(*HASH, F.col("words").alias("own"))
    first = distinct.select(F.col("place").alias("witness"), "words")
    judged = found.join(words, HASH).join(first, "witness").withColumn("near", within_one(F.col("own"), F.col("words")))
    judged = written(judged.groupBy(*HASH, "key").agg(F.bool_or("near").alias("near")), "line-meetings")
    near = judged.where("near").select(*HASH)
    false_keys = judged.where("NOT near").select("key").distinct()
    if false_keys.isEmpty():
        return written(near.distinct(), "near-lines")
    # A chance meeting may hide a true one behind it: in these keys, lines meet by the variants themselves.
    involved = distinct.select(*HASH, "place", "words").join(rows.join(false_keys, "key", "left_semi").select(*HASH).distinct(), HASH)
    spelled = spelled_variants(involved).join(false_keys, "key", "left_semi")
    return written(near.unionByName(earlier_lines(spelled, ["variant"]).select(*HASH)).distinct(), "near-lines")


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 8, filter_bits: int | None = None
) -> DataFrame:
    """(id, digest, n_lines, dropped, copies): ``dedup_lines`` with one row for all rows that repeat id and text."""
    rows = line_rows(docs, id_col, text_col)
    lines = written(
        rows.select(
            "id", "digest", "line", F.size("words").alias("n"), *HASH, F.when(F.size("words") >= least_words, half_keys(F.col("words"))).alias("halves")
        ),
        "lines",
    )
    near = near_lines(docs, lines, id_col, text_col, filter_bits or bitmap_bits(lines.count()), least_words)
    worded = lines.where("n > 0")
    place = F.struct("id", "digest", "line")
    firsts = worded.groupBy(*HASH).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
    settled = written(
        firsts.join(near.withColumn("near", F.lit(True)), HASH, "left").where("c > 1 OR near").select(*HASH, "first", "near"), "line-groups"
    )
    gone = worded.join(settled, HASH).where(F.col("near").isNotNull() | (place != F.col("first")))
    gone = gone.groupBy(F.struct("id", "digest").alias("of")).agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    counts = lines.groupBy("id", "digest").agg((F.max("line") + 1).alias("n_lines"), F.count_if(F.col("line") == 0).cast("int").alias("copies"))
    return counts.join(gone, F.struct("id", "digest").eqNullSafe(F.col("of")), "left").select(
        "id", "digest", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), "copies"
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 8, filter_bits: int | None = None
) -> DataFrame:
    """(id, n_lines, dropped): for each row of ``docs`` the numbers of the lines that go, ascending, from 0.

    A line goes if an earlier one (by id, then by digest of the row's text, then by place; null ids first) is
    equal in words, or near.  Lines without words stay.  Null and the empty text are one line without
    words.  Rows that repeat both id and text are one place and are treated alike; rows that share only
    the id are rows of their own.  An empty table gives an empty result.
    """
    found = dropped_lines(docs, id_col, text_col, least_words, filter_bits)
    each = found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return each.select(F.col("id").alias(id_col), "n_lines", "dropped")


def without_dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` with the dropped lines taken out of the text; a text that loses nothing is unchanged."""
    of, gone = free_name(docs, "__of"), free_name(docs, "__dropped")
    found = dropped_lines(docs, id_col, text_col, **options).select(F.struct("id", "digest").alias(of), F.col("dropped").alias(gone))
    lines = F.split(text_or_empty(text_col), "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i)), "\n")
    row = F.struct(F.col(f"`{id_col}`").alias("id"), row_digest(text_col).alias("digest"))
    return (
        docs.join(found, row.eqNullSafe(F.col(of)))
        .withColumn(text_col, F.when(F.size(gone) > 0, kept).otherwise(F.col(f"`{text_col}`")))
        .drop(of, gone)
    )
