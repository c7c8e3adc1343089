"""Vector columns as Arrow lists and matrices, shared by the two searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and no component null or not finite."""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def matrix(lists: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Rows of equal length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), dtype)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k highest scores, ties to smaller ids, best first. Both are rows by candidates."""
    if scores.shape[1] > 4 * k:  # rows' k-th scores first, then only what reaches them
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        width = int((scores >= kth[:, None]).sum(1).max())
        if width < scores.shape[1] // 2:
            at = np.argsort(~(scores >= kth[:, None]), axis=1, kind="stable")[:, :width]
            scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def once_each(scores: np.ndarray, ids: np.ndarray, lowest) -> tuple[np.ndarray, np.ndarray]:
    """Rows of scores and ids, in which an id stands only with its highest score and elsewhere as nothing."""
    order = np.lexsort((-scores, ids), axis=1)
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, dtype=bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    return np.where(again, lowest, scores), np.where(again, np.iinfo(np.int64).max, ids)


def top_rows(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of query_id, vec_id, score, ties to smaller vec_id; repeated pairs count once, with the highest score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
