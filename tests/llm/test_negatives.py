import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import negatives
from riskweave.llm.negatives import Lists, centroids_of, hard_negatives, nearest_centroid, op11_hard_negatives

SCHEMA = "vec_id long, label int, vector array<long>, v string, anchor int"


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, vector). The rows that the mining must return."""
    out = set()
    for a, label, q in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in rows if i != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out |= {(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(near, 1)}
    return out


def rows_of(df):
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_equals_brute_force(spark, sf):
    rows = []
    for i, label, v in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect():
        rows.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    assert rows_of(op11_hard_negatives(spark, sf)) == brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("slice_rows,group_queries", [(1, 1), (7, 3), (1000, 1000)])
def test_any_cut_gives_the_same(spark, slice_rows, group_queries):
    """Ties, copies of a hot vector, negative and zero scores, two lengths."""
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-4, 5, 4).tolist()) for i in range(60)]
    rows += [(100 + i, i % 3, [2, 2, 2, 2]) for i in range(30)] + [(200 + i, i % 2, [1, i, 0]) for i in range(8)] + [(300, 1, [0, 0, 0, 0])]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    want = brute(rows, lambda i: i % 5 == 0, 3, 2, 60, 90)
    assert want and rows_of(hard_negatives(df, F.col("vec_id") % 5 == 0, 3, 2, 60, 90, slice_rows=slice_rows, group_queries=group_queries, centroids=4)) == want


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(0, 1, [3, 4]), (1, 1, [2, 4]), (2, 2, [2, 3]), (2, 2, [2, 3]), (3, None, [9, 9]), (4, 1, None), (5, 2, []), (6, 2, [None, 1]), (None, 2, [2, 3]), (7, 2, [2, 2]), (7, 3, [0, 0])], "vec_id long, label int, vector array<long>"
    )
    rows = [(0, 1, [3, 4]), (1, 1, [2, 4]), (2, 2, [2, 3]), (7, 2, [2, 2])]
    assert rows_of(hard_negatives(df, F.col("vec_id") == 0, low=10)) == brute(rows, lambda i: i == 0, low=10)
    assert hard_negatives(df.filter("false"), F.lit(True)).collect() == []
    assert hard_negatives(df, F.lit(None).cast("boolean")).collect() == []
    huge = [(0, 1, [1 << 40, 1]), (1, 1, [1 << 20, 3]), (2, 2, [1 << 20, 2]), (3, 2, [1 << 20, 4])]
    assert rows_of(hard_negatives(spark.createDataFrame(huge, "vec_id long, label int, vector array<long>"), F.col("vec_id") == 0)) == brute(huge, lambda i: i == 0)


def test_lists_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(0)
    centres = rng.integers(-1000, 1000, (40, 16))
    rows = np.concatenate([c + rng.integers(-20, 20, (50, 16)) for c in centres]).astype(float)
    ids, labels = np.arange(len(rows)), np.arange(len(rows)) % 3
    cents = centroids_of(rows, 40)
    lists = Lists(ids, labels, rows, nearest_centroid(rows, cents), cents)
    q = rows[::100]
    high = np.full(len(q), 4e6)
    low = np.full(len(q), 1e6)
    scores, found, done = lists.search(ids[::100], labels[::100], q, 5, False, low, high)
    for n, i in enumerate(ids[::100]):
        s = rows @ rows[i]
        ok = [j for j in np.lexsort((ids, -s)) if j != i and labels[j] != labels[i] and 1e6 <= s[j] <= 4e6][:5]
        assert found[n][found[n] != negatives.NONE].tolist() == ok and scores[n][: len(ok)].tolist() == s[ok].tolist()
    assert done < len(q) * len(rows) / 4
