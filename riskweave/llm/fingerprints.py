"""Document fingerprints as threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the document's, the
sketch of a union is the union of the sketches, and shares of very unequal documents can be estimated. Short documents
would keep too little, so a sketch goes on up to a least number of its smallest hashes; two sketches are compared below
the lower of the hashes that each is known to be whole up to. Sketches of long documents aren't changed by that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, table

WORDS = 5
#: A sixteenth of the hashes is kept, and at least so many where a document has them.
SCALE, LEAST = 16, 32
#: Rows of a range of ids that one window puts in order, about, and ranges at most (their bounds are a constant of the plan).
RANGE_ROWS, MOST_RANGES = 512, 1 << 16

_LOW = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ceiling(scale: int) -> int:
    """Hashes below it, as signed numbers, are one in `scale`."""
    return _LOW + (1 << 64) // scale


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Distinct 64-bit hashes of a text's runs of `words` words; fewer words make one shingle, none make none.

    Words are what lies between blanks and \\t to \\r; a null text has none.
    """
    split = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")

    def runs(h: Column) -> Column:
        whole = F.transform(F.slice(h, F.lit(1), F.size(h) - F.lit(words - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))
        short = F.array(F.xxhash64(h))
        return F.when(F.size(h) >= words, whole).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(let(F.transform(split, lambda w: F.xxhash64(w)), runs))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE, least: int = LEAST) -> Column:
    """array<long>: in order, all shingle hashes below the ceiling, and as many of the next as make `least`."""
    return F.filter(F.sort_array(shingle_hashes(text, words)), lambda h, i: (h < ceiling(scale)) | (i < least))


def as_text(hashes: Column) -> Column:
    """A sketch as hexadecimal digits, 16 a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def from_text(fingerprint: Column) -> Column:
    """The sketch that as_text() wrote."""
    number = lambda s: F.shiftleft(F.conv(F.substring(s, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(s, 9, 8), 16, 10).cast("long"))
    return F.transform(F.filter(F.split(F.regexp_replace(fingerprint, "(.{16})", "$1 "), " "), lambda s: s != ""), number)


def whole_below(hashes: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The last hash up to which a sketch lacks none."""
    return F.when(F.size(hashes) < least, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.lit(ceiling(scale) - 1), F.element_at(hashes, -1)))


def merged(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of both documents together, from their sketches."""
    end = F.least(whole_below(a, scale, least), whole_below(b, scale, least))
    return let(F.struct(F.sort_array(F.array_union(a, b)).alias("all"), end.alias("end")), lambda x: F.filter(x["all"], lambda h, i: (h <= x["end"]) & ((h < ceiling(scale)) | (i < least))))


def group_sketches(sketches: DataFrame, key: str, column: str, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """key, hash: each group's sketch as rows, one hash a row, so that no group is ever gathered. Below `least` hashes of the ceiling a group has what lies under its members' ends."""
    own = sketches.select(F.col(key).alias("key"), F.col(column).alias("s"))
    ends = own.groupBy("key").agg(F.min(whole_below(F.col("s"), scale, least)).alias("end"))
    hashes = own.select("key", F.explode("s").alias("hash")).distinct()
    return hashes.join(ends.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).filter(F.col("hash") <= F.col("end")).select(F.col("key").alias(key), "hash")


def compared(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """struct<likeness, share_of_first, share_of_second>: estimates of |A and B| / |A or B|, / |A| and / |B|; equal sketches have 1, two sketches without a common range 0."""
    end = F.least(whole_below(a, scale, least), whole_below(b, scale, least))

    def counted(x: Column) -> Column:
        share = lambda of: F.coalesce(F.try_divide(x["both"].cast("double"), of), F.lit(0.0))
        same = x["same"]
        return F.struct(
            F.when(same, 1.0).otherwise(share(x["a"] + x["b"] - x["both"])).alias("likeness"), F.when(same, 1.0).otherwise(share(x["a"])).alias("share_of_first"), F.when(same, 1.0).otherwise(share(x["b"])).alias("share_of_second")
        )

    def cut(x: Column) -> Column:
        below = lambda s: F.filter(s, lambda h: h <= x["end"])
        return let(F.struct(below(x["a"]).alias("a"), below(x["b"]).alias("b"), x["same"].alias("same")), lambda y: let(F.struct(F.size(y["a"]).alias("a"), F.size(y["b"]).alias("b"), F.size(F.array_intersect(y["a"], y["b"])).alias("both"), y["same"].alias("same")), counted))

    return let(F.struct(a.alias("a"), b.alias("b"), end.alias("end"), (a == b).alias("same")), cut)


def numbers(values: list, kind: str = "bigint") -> Column:
    """A constant array, folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",", -1).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def range_bounds(ids: DataFrame, column: str, rows: int = RANGE_ROWS) -> list[int]:
    """Values that cut a column into ranges of about so many rows, at most MOST_RANGES of them."""
    n = ids.count()
    ranges = min(MOST_RANGES, -(-n // rows))
    if ranges < 2:
        return []
    row = ids.agg(F.min(column), F.percentile_approx(column, numbers([i / ranges for i in range(1, ranges)], "double"), max(10_000, 20 * ranges))).first()
    return sorted({x for x in row[1] or [] if x > row[0]})


def range_of(value: Column, bounds: Column, n: int) -> Column:
    """How many of n ascending bounds are at or below a value, by binary search; 0 for null."""
    strides = [1 << k for k in reversed(range(n.bit_length()))]
    if not strides:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, strides)), F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= value, at + s).otherwise(at))


def with_next(rows: DataFrame, key: str, carried: list[str], ties: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows, with next_ and its name for each of `carried`: the values of the row that follows by descending key; the first row follows the last.

    Keys are longs; rows of one key are ordered by `ties`, null keys come last. Rows are shuffled once, into ranges of
    keys; each range's first row is also sent to the range before it, so that nothing is put in order in one task.
    """
    found = range_bounds(rows.select(key), key, range_rows)
    bounds, ranges = numbers(found), len(found) + 1
    place = lambda: range_of(F.col(key), bounds, len(found))
    # One number a range, its highest key; it is null only where every key is.
    top = {r["r"]: r["top"] for r in rows.groupBy(place().alias("r")).agg(F.max(key).alias("top")).collect()}
    leads = F.coalesce(F.col(key) == F.get(numbers([top[r] for r in range(ranges)]), F.col("__r")), F.lit(False)) if top.get(0) is not None else F.lit(True)
    at = lambda r, guest: F.struct(r.alias("r"), F.lit(guest).alias("guest"))
    own, guest = at(F.col("__r"), False), at(F.pmod(F.col("__r") + 1, F.lit(ranges)), True)
    dealt = rows.withColumn("__r", place()).withColumn("__at", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("__at.r").orderBy("__at.guest", F.desc_nulls_last(key), *ties)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).filter("not __at.guest").drop("__r", "__at")


def fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """doc_id, n_chars, sketch array<long>: one row for each row of docs.

    docs: doc_id, text; other columns are ignored. A null text counts as empty; a text without words has an empty
    sketch; equal texts have equal sketches; repeated rows have a row each; an empty table gives no rows.
    """
    own = picked(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.select("doc_id", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text"), words, scale, least).alias("sketch"))


def edited_fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE, least: int = LEAST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_edited, held_next.

    A document's edited text is its own, with the last floor(n_chars / 2) code points replaced by as many of the next
    document's first (by descending doc_id; all of them, if fewer). held_*: the share of the document's shingles that
    the other text is estimated to hold. Odd rows are treated as fingerprints() says; rows of one id follow each other in the order of
    their texts, a null id comes last; a document alone in its table follows itself; two texts without words have a likeness of 1.
    """
    own = picked(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("doc_id", "text", sketch(F.col("text"), words, scale, least).alias("sketch"))
    both = with_next(own, "doc_id", ["text", "sketch"], ["text"], range_rows)
    half = F.floor(F.length("text") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), words, scale, least).alias("edited_sketch"), "next_sketch")
    # The sketches are used more than once each: computed in the projection below.
    to_edited, to_next = compared(F.col("sketch"), F.col("edited_sketch"), scale, least), compared(F.col("sketch"), F.col("next_sketch"), scale, least)
    return both.select("*", to_edited.alias("e"), to_next.alias("x")).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("e.likeness").alias("near_edited"), F.col("x.likeness").alias("near_next"), F.col("e.share_of_first").alias("held_edited"), F.col("x.share_of_first").alias("held_next"),
    )


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
