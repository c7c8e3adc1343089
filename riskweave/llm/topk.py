"""Exact top-k by inner product, a block of the id range at a time.

Vectors are numbered in the order of their ids and cut into shards, ranges of some thousand rows, and those into
blocks with a forward index (a matrix) and each term's maximum and minimum. A query's bound for a range is the sum over
its terms of the larger product. Each query is first searched in the shard of its highest bound, which gives a k-th score
to beat, and then only in the shards whose bounds reach it; in a shard, blocks are taken in the order of their bounds
until the next bound is below the k-th score. Groups of queries meet shards, and shares of the shards' bounds, in tasks
of their own, so a task holds one group and one shard or share, whatever the table's size; only bounds that reach the
score to beat leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, staged, table
from .vectors import best, matrix, once_each, top_rows, usable

SHARD_ROWS = 8192
GROUP_QUERIES = 2048
BLOCK_ROWS = 256
#: Shards that a task bounds for a group of queries.
SHARDS_A_TASK = 1024
#: Integers below this are exact in double precision.
EXACT = 1 << 53


def lowest_of(kind: np.dtype) -> int | float:
    """Below any score."""
    return -np.inf if kind != object else -(1 << 200)  # whole numbers have no end


def quantized(vector, scale: int = 1024):
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


class Blocks:
    """A shard's blocks: forward indexes, ids, and each term's maximum and minimum."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int):
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        self.blocks = [(ids[i : i + size], rows[i : i + size]) for i in range(0, len(ids), size)]
        self.repeated = len(np.unique(ids)) < len(ids)
        self.most = np.stack([r.max(0) for _, r in self.blocks])
        self.least = np.stack([r.min(0) for _, r in self.blocks])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beat: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Each query's k best scores and ids in this shard; how many block scorings were done. beat: scores below which nothing is wanted."""
        n = len(query_ids)
        lowest = lowest_of(queries.dtype)
        beat = np.full(n, lowest, dtype=queries.dtype) if beat is None else beat
        bounds = np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        scores, ids = np.full((n, k), lowest, dtype=queries.dtype), np.full((n, k), np.iinfo(np.int64).max)
        active, done = np.arange(n), 0
        for step in range(len(self.blocks)):
            nth = order[active, step]
            active = active[bounds[active, nth] >= np.maximum(scores[active, k - 1], beat[active])]
            if not len(active):
                break
            nth = order[active, step]
            for b in np.unique(nth):
                own = active[nth == b]
                block_ids, rows = self.blocks[b]
                got = queries[own] @ rows.T
                got[query_ids[own][:, None] == block_ids] = lowest
                done += len(own)
                both = np.concatenate([scores[own], got], 1), np.concatenate([ids[own], np.broadcast_to(block_ids, got.shape)], 1)
                if self.repeated:
                    both = once_each(*both, lowest)
                scores[own], ids[own] = best(*both, k)
        return scores, ids, done


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "vector", shard_rows: int = SHARD_ROWS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS, shards_a_task: int = SHARDS_A_TASK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with every other row.

    vectors: integer components; is_query: a Column over them. Vectors that are null, empty, or hold a null take no part;
    only vectors of equal length are compared; rows with a query's own id are not its candidates; ties go to the smaller
    vec_id; a query with fewer than k candidates gets them all; an empty table gives no rows. Rows that share an id are
    one query and one candidate: a pair's score is the highest of its rows'. Scores are exact; beyond the range of a
    long they stop at its ends.
    """
    rows = picked(vectors.withColumn("__query", is_query), vec_id=vec_id, v=vector, is_query="__query").filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    rows = staged(rows.withColumn("d", F.size("v")), "vectors")
    n, q = rows.agg(F.count("*"), F.count_if("is_query")).first()
    groups = max(1, -(-q // group_queries))
    asked = rows.filter("is_query").select("d", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(groups)).cast("int").alias("part"), "vec_id", "v", F.monotonically_increasing_id().alias("row"))
    if n <= shard_rows:  # one shard: nothing to choose from
        asked = staged(asked, "queries")
        rows = rows.withColumn("shard", F.lit(0).cast("long"))
        return top_rows(_searched(asked.select("row", F.lit(0).cast("long").alias("shard")), asked, rows, k, block_rows, None).select("query_id", "vec_id", "score"), k)
    rows, asked = _sharded(rows, shard_rows), staged(asked, "queries")
    ends = staged(_ends(rows, shards_a_task), "ends")
    # The best shard of each query gives a score to beat; a query with fewer rows there than it asks for beats everything.
    best = _bounded(asked.withColumns({"done": F.lit(None).cast("long"), "beat": F.lit(None).cast("long")}), ends, True)
    best = staged(best.groupBy("row").agg(F.max(F.struct("bound", (-F.col("shard")).alias("s"))).alias("b")).select("row", (-F.col("b.s")).alias("shard")), "best")
    first = staged(_searched(best, asked, rows, k, block_rows, None), "first")
    beat = first.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("beat")).filter(F.col("n") >= k).select(F.col("row").alias("b_row"), "beat")
    told = asked.join(best.select(F.col("row").alias("d_row"), F.col("shard").alias("done")), F.col("row") == F.col("d_row")).join(beat, F.col("row") == F.col("b_row"), "left").drop("d_row", "b_row")
    rest = _bounded(told, ends, False)
    found = first.unionByName(_searched(rest.select("row", "shard", "beat"), asked, rows, k, block_rows, "beat"))
    return top_rows(found.select("query_id", "vec_id", "score"), k)


def _sharded(rows: DataFrame, shard_rows: int) -> DataFrame:
    """rows with shard: ranges of vec_id of so many rows, within one length each."""
    ranged = staged(rows.repartitionByRange("d", "vec_id", F.xxhash64("v")).withColumn("place", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("place").agg(F.count("*").alias("n"))  # one row a task
    bases = sizes.select(F.col("place").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = ranged.withColumn("within", F.row_number().over(Window.partitionBy("place").orderBy("d", "vec_id"))).join(F.broadcast(bases), F.col("place") == F.col("p"))
    return staged(numbered.select("d", "vec_id", "v", "is_query", F.floor((F.col("base") + F.col("within") - 1) / shard_rows).alias("shard")), "shards")


_BOUNDS = pa.schema([("row", pa.int64()), ("shard", pa.int64()), ("bound", pa.int64()), ("beat", pa.int64())])


def _ends(rows: DataFrame, shards_a_task: int) -> DataFrame:
    """d, shard, most, least, share: each term's maximum and minimum, a row for each shard and length; a share has so many shards at most."""
    terms = rows.select("d", "shard", F.posexplode("v").alias("i", "x")).groupBy("d", "shard", "i").agg(F.max("x").alias("most"), F.min("x").alias("least"))
    ends = terms.groupBy("d", "shard").agg(F.array_sort(F.collect_list(F.struct("i", "most", "least"))).alias("t"))  # one struct a component
    return ends.select("d", "shard", F.col("t.most").alias("most"), F.col("t.least").alias("least"), F.floor(F.col("shard") / shards_a_task).alias("share"))


def _bounded(asked: DataFrame, ends: DataFrame, best: bool) -> DataFrame:
    """row, shard, bound, beat: the most that a query's score can be in a shard.

    best: only the query's best shard of each share, ties to the smaller; else those besides `done` that reach `beat`
    (null: all). A task meets one group of queries with one share of shards.
    """
    shares = ends.select(F.col("d").alias("s_d"), F.col("share").alias("s_share")).distinct()
    mine = asked.join(shares, F.col("d") == F.col("s_d")).withColumnRenamed("s_share", "share")
    parts = asked.select(F.col("d").alias("p_d"), F.col("part").alias("p_part")).distinct()
    theirs = ends.join(parts, F.col("d") == F.col("p_d")).select("p_d", "p_part", F.col("share").alias("p_share"), "shard", "most", "least")

    def bound(ours, others):
        if not len(ours) or not len(others):
            return _BOUNDS.empty_table()
        others = others.sort_by("shard")
        qs, most, least = exact_matrices(*(matrix(t.column(c), np.int64) for t, c in ((ours, "v"), (others, "most"), (others, "least"))))
        top = np.maximum(qs, 0) @ most.T + np.minimum(qs, 0) @ least.T
        shards, lowest = others.column("shard").to_numpy(), lowest_of(qs.dtype)
        if best:
            at = np.arange(len(qs)), top.argmax(1)
        else:
            beat = np.array([lowest if x is None else x for x in ours.column("beat").to_pylist()], dtype=qs.dtype)
            done = np.array([-1 if x is None else x for x in ours.column("done").to_pylist()])
            at = np.nonzero((top >= beat[:, None]) & (shards != done[:, None]))
        return pa.table([ours.column("row").combine_chunks().take(pa.array(at[0])), pa.array(shards[at[1]]), pa.array(longs(top[at])), ours.column("beat").combine_chunks().take(pa.array(at[0]))], schema=_BOUNDS)

    return mine.groupBy("d", "part", "share").cogroup(theirs.groupBy("p_d", "p_part", "p_share")).applyInArrow(bound, "row long, shard long, bound long, beat long")


def exact_matrices(*matrices: np.ndarray) -> list[np.ndarray]:
    """Matrices whose rows' products sum up exactly: in doubles, or as Python's whole numbers where sums could pass 2**53."""
    first, *rest = (int(np.abs(m.astype(float)).max(initial=0)) + 1 for m in matrices)
    kind = np.float64 if first * max(rest) * matrices[0].shape[1] < EXACT else object
    return [m.astype(kind) for m in matrices]


def longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        ends = np.iinfo(np.int64)
        scores = np.clip(scores, ends.min, ends.max)
    return scores.astype(np.int64)


_FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(pairs: DataFrame, asked: DataFrame, rows: DataFrame, k: int, block_rows: int, beat: str | None) -> DataFrame:
    """row, query_id, vec_id, score: the k best of each pair's shard for its query row; with beat, scores below it may be left out."""
    least = F.col(beat) if beat else F.lit(None).cast("long")
    mine = pairs.select(F.col("row").alias("p_row"), "shard", least.alias("beat")).join(asked, F.col("p_row") == F.col("row")).select("d", "shard", "part", "row", "vec_id", "v", "beat")
    # Candidates go only to the groups that ask their shard.
    wanted = mine.select(F.col("d").alias("w_d"), F.col("shard").alias("w_shard"), F.col("part").alias("w_part")).distinct()
    theirs = rows.join(wanted, (F.col("shard") == F.col("w_shard")) & (F.col("d") == F.col("w_d"))).select("w_d", "w_shard", "w_part", "vec_id", "v")

    def search(ours, others):
        if not len(ours) or not len(others):
            return _FOUND.empty_table()
        qid, cid = ours.column("vec_id").to_numpy(), others.column("vec_id").to_numpy()
        qs, cs = exact_matrices(matrix(ours.column("v"), np.int64), matrix(others.column("v"), np.int64))
        lowest = lowest_of(qs.dtype)
        below = np.array([lowest if x is None else x for x in ours.column("beat").to_pylist()], dtype=qs.dtype)
        scores, ids, _ = Blocks(cid, cs, block_rows).search(qid, qs, k, below)
        found = (ids != np.iinfo(np.int64).max) & (scores != lowest)
        spread = lambda x: np.broadcast_to(x[:, None], ids.shape)[found]
        return pa.table([pa.array(spread(ours.column("row").to_numpy())), pa.array(spread(qid)), pa.array(ids[found]), pa.array(longs(scores[found]))], schema=_FOUND)

    return mine.groupBy("d", "shard", "part").cogroup(theirs.groupBy("w_d", "w_shard", "w_part")).applyInArrow(search, "row long, query_id long, vec_id long, score long")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"))).select("vec_id", quantized(F.col("embedding")).alias("vector"))
    return exact_top_k(rows, F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  GROUP BY 1, 2
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""
