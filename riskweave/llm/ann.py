"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors to a few dimensions, shifts them within a cell, and orders them along a Hilbert curve;
Spark range-partitions that order and numbers it. A query looks at the rows whose numbers lie near its own on each
curve, ranks them by inner product, and the curves' results are merged. How near is measured: for a bounded sample of
queries the true neighbours are found by a scan of all rows, and the window is made wide enough for a chosen share
of them. On data without structure that is a large part of the table; on clustered data it is narrow.
Equal vectors are searched once: one row stands for them with its smallest ids, so that a vector that fills a third of
the table costs no more than another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, picked, staged, table
from .vectors import best, matrix, top_rows, usable

CURVES = 16
DIMENSIONS, BITS = 8, 7
#: Queries whose true neighbours set the window, and the share of those neighbours that must lie within it.
SAMPLE_QUERIES = 128
WITHIN = 0.96
#: Rows of a curve that are searched at once: as many as the window's, but no fewer than BUCKET_ROWS, and no more than have
#: BUCKET_CELLS components (32 MB as doubles), so that a task's memory doesn't grow with the table.
BUCKET_ROWS, BUCKET_CELLS = 1024, 1 << 22

_LOWEST = -np.inf


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of cell coordinates (0 to 2**bits - 1): Gray-code un-rotation, bit by bit."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            high = (x[:, i] >> bit & 1).astype(bool)
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, n - 1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> bit & 1)
    return key


def curve_key(vectors: np.ndarray, curve: int, scale: float, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Keys on one curve: its own random projection and shift, the same for all tasks. scale: root mean square of a component."""
    d = vectors.shape[1]
    n = min(dimensions, d)
    rng = np.random.default_rng([curve, d])
    axes = np.linalg.qr(rng.standard_normal((d, n)))[0]
    spread = 0.5 + 0.5 * np.tanh(0.8 * (vectors @ axes) / scale)
    cells = (spread * (1 - 2.0**-bits) + rng.random(n) * 2.0**-bits) * 2**bits
    return hilbert_keys(cells.astype(np.int64).clip(0, 2**bits - 1), bits)


_KEYS = pa.schema([("rep", pa.int64()), ("d", pa.int32()), ("curve", pa.int32()), ("key", pa.int64())])
_FOUND = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def _ordered(reps: DataFrame, curves: int, scale: float) -> DataFrame:
    """rep, d, curve, at: each vector's number on each curve (numbers run on over the curves and lengths)."""

    def keys(batches):
        for b in batches:
            ids, sizes = b.column("rep").to_numpy(), b.column("v").value_lengths().to_numpy()
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                rows = matrix(b.column("v").take(pa.array(own)), np.float64)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.full(len(own), d, np.int32)), pa.array(np.full(len(own), c, np.int32)), pa.array(curve_key(rows, c, scale))], schema=_KEYS)

    keyed = mapped(reps.select("rep", "v"), keys, "rep long, d int, curve int, key long")
    # Ranges are cut by (curve, key, rep), so equal keys are dealt over several tasks.
    ranged = keyed.repartitionByRange("curve", "d", "key", "rep").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "curves")
    inside = Window.partitionBy("part").orderBy("curve", "d", "key", "rep")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a task
    bases = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # At most spark.sql.shuffle.partitions rows: small enough to broadcast.
    return ranged.withColumn("within", F.row_number().over(inside)).join(F.broadcast(bases), F.col("part") == F.col("p")).select("rep", "d", "curve", (F.col("base") + F.col("within") - 1).alias("at"))


def _window(reps: DataFrame, ordered: DataFrame, sample: list, k: int, within: float) -> int:
    """The least distance in numbers that, on some curve, takes in the wanted share of the sample's true neighbours."""
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in sample:
        ids, rows = asked.setdefault(len(r["v"]), ([], []))
        ids.append(r["rep"])
        rows.append(r["v"])
    asked = {d: (np.array(ids), np.array(rows)) for d, (ids, rows) in asked.items()}

    def scan(batches):
        for b in batches:
            sizes = b.column("v").value_lengths().to_numpy()
            for d, (qid, q) in asked.items():
                own = np.flatnonzero(sizes == d)
                if len(own):
                    ids = b.column("rep").to_numpy()[own]
                    scores = q @ matrix(b.column("v").take(pa.array(own)), np.float64).T
                    scores[qid[:, None] == ids] = _LOWEST
                    s, i = best(scores, np.broadcast_to(ids, scores.shape), k)
                    ok = s > _LOWEST
                    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], i.shape)[ok]), pa.array(i[ok]), pa.array(s[ok])], schema=_FOUND)

    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    pairs = mapped(reps.select("rep", "v"), scan, "query long, rep long, score double").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    pairs = pairs.select("query", F.col("rep").alias("near"))  # SAMPLE_QUERIES * k rows
    a = ordered.select(F.col("rep").alias("query"), "curve", F.col("at").alias("here"))
    b = ordered.select(F.col("rep").alias("near"), F.col("curve").alias("c"), F.col("at").alias("there"))
    far = F.broadcast(pairs).join(a, "query").join(b, ["near"]).filter(F.col("curve") == F.col("c")).groupBy("query", "near").agg(F.min(F.abs(F.col("here") - F.col("there"))).alias("far"))
    return int(far.agg(F.percentile("far", F.lit(within))).first()[0] or 0) + 1


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "vector", curves: int = CURVES, sample_queries: int = SAMPLE_QUERIES, within: float = WITHIN, window: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row about the k other rows of largest inner product, nearest first.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part; only vectors of equal
    length are compared; a query's own id is no candidate; ties go to the smaller vec_id; a query with fewer than k
    candidates of any nearness gets those that its windows reach; an empty table gives no rows. Every row is indexed.
    Rows that share an id are one query and one candidate: a pair's score is the highest of its rows' that are found.
    window: numbers to look at on either side; None measures it.
    """
    rows = picked(vectors.withColumn("__query", is_query), vec_id=vec_id, v=vector, is_query="__query")
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float") if dict(vectors.dtypes)[vector] == "array<float>" else x + F.lit(0)))  # no -0.0
    # The k + 1 smallest ids of each distinct vector (a query leaves its own out). Row-number limits are applied before the shuffle too.
    first = rows.select("vec_id", "v", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")).alias("n")).filter(F.col("n") <= k + 1)
    groups = first.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    asking = rows.filter("is_query").select("v").distinct().withColumn("asks", F.lit(True))
    reps = groups.join(asking, "v", "left").select(F.col("ids")[0].alias("rep"), "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    reps = staged(reps, "vectors")
    longest, asks, scale = reps.agg(F.max(F.size("v")), F.count_if("asks"), F.sqrt(F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double")) / F.size("v")))).first()
    ordered = staged(_ordered(reps, curves, scale or 1.0), "numbered")
    if window is None:
        part = min(1.0, 4 * sample_queries / max(1, asks))
        drawn = reps.filter("asks").filter(F.pmod(F.xxhash64(F.lit("sample"), "rep"), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)))).select("rep", "v").orderBy(F.xxhash64("rep")).limit(sample_queries).collect()
        window = _window(reps, ordered, drawn, k, within)
    window = max(k + 1, window)
    bucket_rows = max(BUCKET_ROWS, min(window, BUCKET_CELLS // max(1, longest or 1)))

    # Each vector goes to its bucket on each curve; each query to all buckets that its window touches.
    placed = ordered.join(reps.select("rep", "v", "asks"), "rep").withColumn("bucket", F.floor(F.col("at") / bucket_rows))
    candidates = placed.select("curve", "d", "bucket", "rep", "v", "at")
    beside = F.explode(F.sequence(F.floor((F.col("at") - window) / bucket_rows), F.floor((F.col("at") + window) / bucket_rows))).alias("q_bucket")
    queries = placed.filter("asks").select(F.col("curve").alias("q_curve"), F.col("d").alias("q_d"), beside, F.col("rep").alias("query"), F.col("v").alias("q"), F.col("at").alias("q_at"))
    reach = window

    def search(mine, theirs):
        if not len(mine) or not len(theirs):
            return _FOUND.empty_table()
        qid, cid = mine.column("query").to_numpy(), theirs.column("rep").to_numpy()
        qat, cat = mine.column("q_at").to_numpy(), theirs.column("at").to_numpy()
        rows = matrix(theirs.column("v"), np.float64)
        asked = matrix(mine.column("q"), np.float64)
        out = []
        step = max(1, (8 << 20) // max(1, len(cid)))
        for i in range(0, len(qid), step):
            scores = asked[i : i + step] @ rows.T
            scores[np.abs(qat[i : i + step, None] - cat) > reach] = _LOWEST
            s, ids = best(scores, np.broadcast_to(cid, scores.shape), k + 1)  # a vector's equals are near it too
            ok = s > _LOWEST
            out.append(pa.table([pa.array(np.broadcast_to(qid[i : i + step, None], ids.shape)[ok]), pa.array(ids[ok]), pa.array(s[ok])], schema=_FOUND))
        return pa.concat_tables(out)

    found = queries.groupBy("q_curve", "q_d", "q_bucket").cogroup(candidates.groupBy("curve", "d", "bucket")).applyInArrow(search, "query long, rep long, score double")
    once = found.repartition("query").groupBy("query", "rep").agg(F.max("score").alias("score"))
    top = once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("n") <= k + 1).drop("n")
    # Every id of the best vectors, at most (k + 1) ** 2 for a distinct query vector, and of those the first k + 1.
    ids = top.join(reps.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.repartition("query").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    lists = ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    lists = lists.join(reps.filter("asks").select(F.col("rep").alias("query"), "v"), "query")
    answers = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), "v").join(lists, "v")
    kept = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return top_rows(answers.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.vec_id", "x.score"), k)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, F.col("vec_id") % 20 == 0)
