"""How filters interact: what each order of filters keeps and removes at each step, from one CUBE over failure flags.

A document's failures are flags. A CUBE over the flags and the part of the table gives, for each set of filters, how
many documents fail none of them: the row in which just these flags are grouped and all false. A step of an order is
then the difference between two sets, so orders are joins of small tables, whatever the number of documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, staged, table

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
_FLAGS = [f"fails_{f}" for f in FILTERS]
_COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failures that a text alone decides; a null text counts as empty, a comparison of case is of A-Z only."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _SPACE, -1), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "fails_A": F.size(words) < 100,
        "fails_B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "fails_C": 100 * capitals > 10 * F.length(text),
        "fails_D": text.rlike(r"[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails_A to fails_E, n, good, toxic: how many documents have just these failures.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are ignored. A null lang is the part of the
    empty string. E is a text that a smaller doc_id has too: of rows that share the smallest id of a text none fails
    it, and a null id is neither smaller nor larger than another. A document is good (toxic) if any of its label rows
    says so, and neither without a label. Repeated rows count each; an empty table gives no rows.

    Texts leave the scan as digests, and copies are counted before they are dealt by text, so that a text which a
    third of the rows share is a few rows for each task.
    """
    own = picked(docs, doc_id="doc_id", text="text", part="lang")
    own = own.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()])
    said = picked(labels, l_id="doc_id", quality="quality", toxic="toxic").groupBy("l_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic")
    )
    no = F.lit(False)
    own = own.join(said, F.col("doc_id") == F.col("l_id"), "left").withColumns({"is_good": F.coalesce("is_good", no), "is_toxic": F.coalesce("is_toxic", no)})
    alike = ["digest", "part", "is_good", "is_toxic", *_FLAGS[:4]]
    by_id = own.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))  # of one id: those of one text, part and label
    groups = by_id.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    )
    first = F.min("first.doc_id").over(Window.partitionBy("digest"))
    free = F.col("n_null") + F.when(F.col("first.doc_id") == first, F.col("first.n")).otherwise(0)
    both = groups.withColumn("free", free).select("*", F.explode(F.array(F.struct(F.lit(False).alias("fails_E"), F.col("free").alias("c")), F.struct(F.lit(True).alias("fails_E"), (F.col("n") - F.col("free")).alias("c")))).alias("e"))
    return (
        both.filter("e.c > 0").groupBy("part", *_FLAGS[:4], F.col("e.fails_E").alias("fails_E"))
        .agg(F.sum("e.c").alias("n"), F.sum(F.when(F.col("is_good"), F.col("e.c")).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), F.col("e.c")).otherwise(0)).alias("toxic"))
    )


def survivors(counts: DataFrame) -> DataFrame:
    """part, filters, n, good, toxic: for each part and set of filters (a mask, A being 1), what fails none of them; no row where that is nothing."""
    cube = counts.cube(*_FLAGS, "part").agg(*[F.sum(c).alias(c) for c in _COUNTS], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"any_{f}") for f in _FLAGS])
    chosen = [F.col(f"any_{f}") == 0 for f in _FLAGS]
    passed = cube.filter(F.col("all_parts") == 0)
    for f, on in zip(_FLAGS, chosen, strict=True):
        passed = passed.filter(~on | ~F.col(f))
    mask = sum((F.when(on, 1 << i).otherwise(0) for i, on in enumerate(chosen)), F.lit(0))
    return passed.select("part", mask.alias("filters"), *_COUNTS)


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, bit, filters_before, filters_after: 600 rows, whatever the input."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), k, 1 << f, before, before | 1 << f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, filters_before int, filters_after int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part, order and step.

    Odd rows are treated as failure_counts() says; zeros are given; an empty table gives no rows.
    """
    everything = (1 << len(FILTERS)) - 1
    left = survivors(failure_counts(docs, labels))
    # Each part's survivors of every set, zeros included: 32 structs in the order of the mask.
    grid = left.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filters", F.struct(*_COUNTS)))).alias("of"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    sets = grid.select("part", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(everything)), lambda m: F.coalesce(F.try_element_at("of", m), zero))).alias("filters", "s"))
    sets = staged(sets.select("part", "filters", *[F.col(f"s.{c}").alias(c) for c in _COUNTS]), "survivors")  # 32 rows a part: the texts are read once
    # What a set and one filter of it say apart from any order.
    single = sets.select(F.col("part").alias("f_part"), F.col("filters").alias("f_set"), F.col("n").alias("f_n"))
    at = F.broadcast(steps(docs.sparkSession))  # 600 rows
    named = lambda name: sets.select(F.col("part").alias(f"{name}_part"), F.col("filters").alias(f"{name}_set"), *[F.col(c).alias(f"{name}_{c}") for c in _COUNTS])
    before, after = named("b"), named("a")
    pairs = before.join(at, F.col("b_set") == F.col("filters_before")).join(after, (F.col("b_part") == F.col("a_part")) & (F.col("a_set") == F.col("filters_after")))
    per = single.groupBy("f_part").agg(F.max(F.when(F.col("f_set") == 0, F.col("f_n"))).alias("all_n"), F.max(F.when(F.col("f_set") == everything, F.col("f_n"))).alias("none_n"), F.map_from_entries(F.collect_list(F.struct("f_set", "f_n"))).alias("f_of"))
    pairs = pairs.join(per, F.col("b_part") == F.col("f_part"))
    removed = F.col("b_n") - F.col("a_n")
    rows = pairs.select(
        F.col("b_part").alias("part"), "filter_order", "step", F.col("a_n").alias("kept"), removed.alias("removed"), (F.col("all_n") - F.col("f_of")[F.col("bit")] - removed).alias("redundant"),
        (F.col("f_of")[F.lit(everything) - F.col("bit")] - F.col("none_n")).alias("unique_fails"), (F.col("b_good") - F.col("a_good")).alias("good_lost"), (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"), "bit",
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), f AS (
  SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM w
), c AS (
  SELECT part, fails, len(list_filter(fails, lambda x: x)) AS n_fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o
), r AS (
  SELECT filter_order, part, fails, n_fails, n, good, toxic,
    coalesce(list_position(list_transform([1, 2, 3, 4, 5], lambda i: fails[ascii(filter_order[i]) - 64]), true), 6) AS gone_at FROM o, c
), t AS (
  SELECT part, s.filter_order, step, filter_order[step] AS letter,
    coalesce(sum(n) FILTER (gone_at > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone_at = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone_at < step AND fails[ascii(filter_order[step]) - 64]), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (n_fails = 1 AND fails[ascii(filter_order[step]) - 64]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (gone_at = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone_at = step), 0)::BIGINT AS toxic_lost
  FROM s JOIN r USING (filter_order) GROUP BY part, s.filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t
"""
