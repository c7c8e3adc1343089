"""Hard negatives by exact search in inverted lists of a k-means clustering.

Rows are dealt by id into slices of some ten thousand. A slice's rows lie in lists, one for each centroid, and a list
knows its radius, the largest distance of a member from the centroid. By the Cauchy-Schwarz inequality a query's product
with a member lies within |query| * radius of its product with the centroid. Lists are visited from the highest bound on;
a list whose bounds lie outside the wanted window of scores is skipped, and a query stops once the next bound falls
strictly below its k-th score. A task holds one group of queries and one slice, whatever the table's size or the size
of a cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, picked, staged, table
from .topk import exact_matrices, longs, lowest_of, quantized
from .vectors import best, matrix, usable

#: Rows of a slice and queries of a group: what a task holds.
SLICE_ROWS, GROUP_QUERIES = 32768, 2048
#: Centroids of a vector length, and the rows, chosen by a hash of their ids, that they are fitted on at most.
CENTROIDS, SAMPLE_ROWS, ROUNDS = 128, 16384, 6

NONE = np.iinfo(np.int64).max


def centroids_of(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids at most (Lloyd's rounds, from rows that lie far from each other in order)."""
    rows = np.unique(rows, axis=0)
    k = max(1, min(k, len(rows) // 8))
    found = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
    for _ in range(rounds):
        near = nearest_centroid(rows, found)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, near, rows)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def nearest_centroid(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * (rows @ centroids.T), axis=1)


class Lists:
    """A slice's inverted lists, with each list's centroid and radius."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, lists: np.ndarray, centroids: np.ndarray):
        present, at = np.unique(lists, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.members = np.split(order, np.searchsorted(at[order], np.arange(1, len(present))))
        self.ids, self.labels, self.rows, self.centroids = ids, labels, rows, centroids[present]
        apart = rows.astype(float) - self.centroids[at]
        far = np.sqrt((apart**2).sum(1))
        self.radii = np.array([far[m].max() for m in self.members])

    def search(self, query_ids, query_labels, queries, k: int, same: bool, low, high) -> tuple[np.ndarray, np.ndarray, int]:
        """Each query's k best scores and ids within [low, high] among rows of its label (same) or of others; how many products were taken."""
        lowest = lowest_of(queries.dtype)
        n, length = len(query_ids), np.sqrt((queries.astype(float) ** 2).sum(1))
        middle, reach = queries.astype(float) @ self.centroids.T, length[:, None] * self.radii
        slack = 1e-9 * (length[:, None] * (np.sqrt((self.centroids**2).sum(1)) + self.radii)) + 1e-9  # for the rounding of bounds
        upper, lower = middle + reach + slack, middle - reach - slack
        least, most = low.astype(float), high.astype(float)
        upper[(lower > most[:, None]) | (upper < least[:, None])] = -np.inf  # outside the window
        order = np.argsort(-upper, axis=1, kind="stable")
        scores, ids = np.full((n, k), lowest, dtype=queries.dtype), np.full((n, k), NONE)
        active, done = np.flatnonzero(low <= high), 0
        for step in range(len(self.members)):
            nth = order[active, step]
            bound = upper[active, nth]
            active = active[(bound > -np.inf) & (bound >= scores[active, k - 1].astype(float))]
            if not len(active):
                break
            nth = order[active, step]
            for c in np.unique(nth):
                own, them = active[nth == c], self.members[c]
                got = queries[own] @ self.rows[them].T
                done += got.size
                wanted = (query_labels[own][:, None] == self.labels[them]) == same
                wanted &= (query_ids[own][:, None] != self.ids[them]) & (got >= low[own][:, None]) & (got <= high[own][:, None])
                hit = wanted.any(1)
                own, got, wanted = own[hit], got[hit], wanted[hit]
                if len(own):
                    got = np.where(wanted, got, lowest)
                    near = np.where(wanted, np.broadcast_to(self.ids[them], got.shape), NONE)
                    scores[own], ids[own] = best(np.concatenate([scores[own], got], 1), np.concatenate([ids[own], near], 1), k)
        return scores, ids, done


def fitted(rows: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Centroids for each length of vector, fitted on at most `sample` rows of all lengths; a length that isn't among them has one centroid, at zero."""
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("d", "v").toArrow()  # a top-k of each task, then of those
    d = seen.column("d").to_numpy()
    return {int(n): centroids_of(matrix(seen.column("v").filter(pa.array(d == n)), np.float64), centroids) for n in np.unique(d)}


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, vec_id: str = "vec_id", label: str = "label", vector: str = "vector", slice_rows: int = SLICE_ROWS, group_queries: int = GROUP_QUERIES,
    centroids: int = CENTROIDS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the other rows of its label with the highest integer inner products; for each, its
    negatives are the best rows of other labels whose product is at least low and at most high percent of the
    positive's. Ties go to the smaller vec_id; fewer than asked for are given where there are fewer.

    vectors: integer components; is_anchor: a Column over them. Rows without an id or a label, and vectors that are
    null, empty, or hold a null take no part. Only vectors of equal length are compared. Of rows that share an id the
    one of the smallest label, then vector, counts. Scores are exact; beyond the range of a long they stop at its ends.
    An empty table gives no rows.
    """
    own = picked(vectors.withColumn("__anchor", is_anchor), vec_id=vec_id, label=label, v=vector, anchor="__anchor")
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v"), F.coalesce("anchor", F.lit(False)).alias("anchor")).alias("x"))
    own = own.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x.*").withColumn("d", F.size("v"))
    own = staged(own, "vectors")
    n, q = own.agg(F.count("*"), F.count_if("anchor")).first()
    slices, groups = max(1, -(-n // slice_rows)), max(1, -(-q // group_queries))
    index = staged(_listed(own, fitted(own, centroids), slices), "lists")
    asked = own.filter("anchor").select("d", F.pmod(F.xxhash64(F.lit("group"), "vec_id"), F.lit(groups)).alias("group"), F.col("vec_id").alias("anchor_id"), "label", "v")
    found = _searched(asked.withColumns({"positive_id": F.lit(None).cast("long"), "low": F.lit(None).cast("long"), "high": F.lit(None).cast("long")}), index, slices, groups, positives, True)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    pairs = staged(found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives).select(F.col("anchor_id").alias("a"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda percent: (percent * F.col("positive_score").cast("decimal(38,0)"))
    window = pairs.select("*", F.ceil(share(low) / 100).cast("long").alias("low"), F.floor(share(high) / 100).cast("long").alias("high")).filter("low <= high")
    wide = asked.join(window, F.col("a") == F.col("anchor_id")).select(*asked.columns, "positive_id", "low", "high")
    found = _searched(wide, index, slices, groups, negatives, False).join(pairs.withColumnRenamed("positive_id", "p"), (F.col("anchor_id") == F.col("a")) & (F.col("positive_id") == F.col("p")))
    each = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _listed(rows: DataFrame, centroids: dict[int, np.ndarray], slices: int) -> DataFrame:
    """rows with slice, list and, of the list, centroid: the centroids (CENTROIDS of a length at most) go to the tasks with the function."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())), ("d", pa.int32()), ("list", pa.int32()), ("centroid", pa.list_(pa.float64()))])

    def assign(batches):
        for b in batches:
            t = pa.table(b)
            for n in np.unique(t.column("d").to_numpy()):
                part = t.filter(pa.array(t.column("d").to_numpy() == n))
                known = centroids.get(int(n), np.zeros((1, int(n))))
                near = nearest_centroid(matrix(part.column("v"), np.float64), known)
                yield from pa.table([*part.columns, pa.array(near.astype(np.int32)), pa.array(list(known[near]))], schema=schema).to_batches()

    found = mapped(rows.select("vec_id", "label", "v", "d"), assign, "vec_id long, label long, v array<bigint>, d int, list int, centroid array<double>")
    return found.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))


_FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _searched(asked: DataFrame, index: DataFrame, slices: int, groups: int, k: int, same: bool) -> DataFrame:
    """anchor_id, positive_id, id, score: the k best of each slice for each row of asked, within its low and high (null: no limit)."""
    mine = asked.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    theirs = index.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(ours, others):
        if not len(ours) or not len(others):
            return _FOUND.empty_table()
        queries, rows = exact_matrices(matrix(ours.column("v"), np.int64), matrix(others.column("v"), np.int64))
        lists = others.column("list").to_numpy()
        present, at = np.unique(lists, return_index=True)
        centroids = np.zeros((present[-1] + 1, rows.shape[1]))
        centroids[present] = matrix(others.column("centroid").take(pa.array(at)), np.float64)
        anchors = ours.column("anchor_id").to_numpy()
        found = Lists(others.column("vec_id").to_numpy(), others.column("label").to_numpy(), rows, lists, centroids)
        ends = [np.array([end if x is None else x for x in ours.column(c).to_pylist()], dtype=queries.dtype) for c, end in (("low", -(1 << 199)), ("high", 1 << 199))]
        scores, ids, _ = found.search(anchors, ours.column("label").to_numpy(), queries, k, same, *ends)
        hit = ids != NONE
        which = np.broadcast_to(np.arange(len(anchors))[:, None], ids.shape)[hit]
        return pa.table([pa.array(anchors[which]), ours.column("positive_id").combine_chunks().take(pa.array(which)), pa.array(ids[hit]), pa.array(longs(scores[hit]))], schema=_FOUND)

    return mine.groupBy("d", "group", "slice").cogroup(theirs.groupBy("d", "group", "slice")).applyInArrow(search, "anchor_id long, positive_id long, id long, score long")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")) & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), quantized(F.col("embedding"), 256).alias("vector")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
