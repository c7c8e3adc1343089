import numpy as np
import pytest

from riskweave.llm import ann, topk
from riskweave.llm.ann import hilbert_keys, nearest, op6_nearest_neighbours
from riskweave.llm.topk import Blocks, exact_top_k, op4_exact_topk, quantized
from riskweave.llm.vectors import best, usable
from pyspark.sql import functions as F

SCHEMA = "vec_id long, vector array<double>, label int, v string"


def brute(rows, query, k, lowest=None):
    out = {}
    for qi, q in rows:
        if query(qi):
            scored = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in rows if ci != qi and len(c) == len(q))
            out[qi] = [(ci, -s) for s, ci in scored[:k]]
    return {q: x for q, x in out.items() if x}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_exact_query_equals_brute_force(spark, sf):
    rows = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert answers(op4_exact_topk(spark, sf)) == brute(rows, lambda i: i % 100 == 0, 10)


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [0.0, 0.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [-1.0, 0.5]), (10, [1.0, 2.0, 3.0]), (20, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)


def test_exact_odd_rows(spark):
    df = odd_vectors(spark).filter(usable(F.col("vector"))).withColumn("vector", quantized(F.col("vector")))
    rows = [(i, v) for i, v in df.select("vec_id", "vector").collect() if i is not None]
    for size in (1, 100):
        assert answers(exact_top_k(df, F.col("vec_id") % 10 == 0, 3, shard_rows=size, group_queries=size, block_rows=2, shards_a_task=2)) == brute(rows, lambda i: i % 10 == 0, 3)
    assert exact_top_k(df.filter("false"), F.lit(True)).collect() == []
    huge = spark.createDataFrame([(0, [1 << 62]), (1, [1 << 40]), (2, [-3])], "vec_id long, vector array<long>")
    assert answers(exact_top_k(huge, F.col("vec_id") == 0)) == {0: [(1, (1 << 63) - 1), (2, -(1 << 63))]}


def test_pruning_skips_blocks_and_loses_nothing():
    rng = np.random.default_rng(0)
    centres = rng.integers(-1000, 1000, (40, 16))
    rows = np.concatenate([c + rng.integers(-20, 20, (50, 16)) for c in centres]).astype(float)
    ids = np.arange(len(rows))
    q = rows[::100]
    scores, found, done = Blocks(ids, rows, 50).search(ids[::100], q, 10)
    all_scores = q @ rows.T
    all_scores[np.arange(len(q)), ids[::100]] = -1e18
    want_s, want_i = best(all_scores, np.broadcast_to(ids, all_scores.shape), 10)
    assert (scores == want_s).all() and (found == want_i).all()
    assert done < 0.3 * len(q) * 40


def test_shards_below_the_score_to_beat_are_left_out(spark, monkeypatch):
    """Clusters in the order of their ids: most queries look at few shards, and answers are those of all rows."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(-200, 200, (20, 8)), 50, 0) + rng.integers(-5, 5, (1000, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    asked, searched = [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda pairs, *a: asked.append(pairs) or searched(pairs, *a))
    got = answers(exact_top_k(df, F.col("vec_id") % 10 == 0, 10, shard_rows=50, group_queries=30, block_rows=16))
    assert got == brute(rows, lambda i: i % 10 == 0, 10)
    assert asked[0].count() == 100 and asked[1].count() < 100 * 19 / 2


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 3), (3, 3), (4, 2)])
def test_hilbert_steps_are_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest_query_recall(spark, sf):
    rows = [(i, [float(x) for x in v]) for i, v in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows, lambda i: i % 20 == 0, 20), answers(op6_nearest_neighbours(spark, sf))
    assert want.keys() == got.keys()
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    assert all(abs(vectors[q] @ vectors[i] - s) < 1e-12 for q, x in got.items() for i, s in x)


def test_nearest_recall_with_narrow_windows(spark, monkeypatch):
    """Clustered vectors, several buckets a curve: windows are a small share of the table, and what they reach is enough."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 16))
    x = np.repeat(centres, 40, 0) + 0.15 * rng.standard_normal((6000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    widths, measured = [], ann._window
    monkeypatch.setattr(ann, "_window", lambda *a: widths.append(measured(*a)) or widths[-1])
    monkeypatch.setattr(ann, "BUCKET_ROWS", 256)
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -9
    want = np.argsort(-s, 1)[:, :20]
    got = answers(nearest(df, F.col("vec_id") % 20 == 0))
    assert np.mean([len(set(w) & {i for i, _ in got[20 * k]}) / 20 for k, w in enumerate(want)]) >= 0.9
    assert 0 < widths[0] < 300


def test_rows_that_share_an_id(spark):
    """Repeated query rows, repeated candidates, and one id with two vectors: each pair counts once, with its highest score."""
    rows = [(0, [1, 0]), (0, [1, 0]), *[(i, [i, 0]) for i in range(1, 8)], (7, [7, 0]), (7, [2, 5]), (3, [9, 1]), (10, [0, 1]), (10, [1, 1])]

    def want(k):
        scores = {}
        for q, x in rows:
            for c, y in rows:
                if q % 10 == 0 and c != q:
                    scores.setdefault(q, {}).setdefault(c, []).append(x[0] * y[0] + x[1] * y[1])
        return {q: sorted(((c, max(s)) for c, s in found.items()), key=lambda p: (-p[1], p[0]))[:k] for q, found in scores.items()}

    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    for size in (1, 100):
        assert answers(exact_top_k(df, F.col("vec_id") % 10 == 0, 4, shard_rows=size, group_queries=size, block_rows=2, shards_a_task=2)) == want(4)
    floats = df.withColumn("vector", F.col("vector").cast("array<double>"))
    assert answers(nearest(floats, F.col("vec_id") % 10 == 0, 4)) == want(4)


def test_nearest_odd_rows_and_hot_vector(spark, monkeypatch):
    df = odd_vectors(spark)
    kept = df.filter(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull())
    assert answers(nearest(df, F.col("vec_id") % 10 == 0, 3)) == brute([tuple(r) for r in kept.select("vec_id", "vector").collect()], lambda i: i % 10 == 0, 3)
    assert nearest(df.filter("false"), F.lit(True)).collect() == []
    rows = [(i, [1.0, 0.0] if i % 3 else [float(i), 1.0]) for i in range(300)]
    hot = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert answers(nearest(hot, F.col("vec_id") % 20 == 0, window=300)) == want
    monkeypatch.setattr(ann, "BUCKET_ROWS", 16)
    monkeypatch.setattr(ann, "BUCKET_CELLS", 64)  # 32 rows a bucket, and a window of several
    assert answers(nearest(hot, F.col("vec_id") % 20 == 0, window=300)) == want
    got = answers(nearest(hot, F.col("vec_id") % 20 == 0))
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * 20 * len(want)


def test_a_task_bounds_few_shards(spark, monkeypatch):
    """No task sees more shards than its share, and what is found stays the same."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-9, 10, 6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    real = topk._bounded
    ends = []
    monkeypatch.setattr(topk, "_bounded", lambda asked, e, best: (ends.append(e), real(asked, e, best))[1])
    got = answers(exact_top_k(df, F.col("vec_id") % 10 == 0, 4, shard_rows=8, group_queries=7, block_rows=3, shards_a_task=5))
    assert got == brute(rows, lambda i: i % 10 == 0, 4)
    assert ends[0].groupBy("d", "share").count().agg(F.max("count")).first()[0] <= 5 and ends[0].count() >= 38
