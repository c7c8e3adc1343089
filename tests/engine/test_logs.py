import json
import random

import pytest

from pyspark.sql import functions as F

from riskweave.streaming import logs


def event(ts, ip="1", path="/", query=None, status=200, ua="Mozilla", svc="shop", body=None):
    return json.dumps({"ts": ts, "svc": svc, "ip": ip, "method": "GET", "path": path, "query": query, "status": status, "ua": ua, "ref": None, "body": body})


def parsed(spark, lines, arrival=None):
    return logs.parsed_log(spark.createDataFrame([(x,) for x in lines], "value string"), arrival=arrival)


def test_rules(spark):
    lines = [event("2024-01-01T00:00:00Z", path="/s", query="q=<ScRipt>"), event("2024-01-01T00:00:01Z", query="id=1' or '1"), event("x", query="next=https%3A%2F%2Fevil.example%2Fa"), event(None, query="next=/home"), event("2024-01-01T00:00:02Z", ua="sqlmap", status=500), "{broken", event("2024-01-01T00:00:03Z", svc="c2")]
    e = parsed(spark, lines, F.timestamp_seconds(F.lit(1_800_000_000)))
    assert e.filter("malformed").count() == 1 and e.filter("at = timestamp_seconds(1800000000)").count() == 3
    assert parsed(spark, lines).filter("at IS NULL").count() == 0
    got = sorted((r.rule, r.evidence) for r in logs.stateless_alerts(e.filter("NOT malformed")).collect())
    assert got == [("exfiltration-to-c2", "c2"), ("open-redirect", "next=https%3A%2F%2Fevil.example%2Fa"), ("reflected-xss", "<script"), ("scanner-tooling-ua", "sqlmap"), ("sql-injection", "' or '1"), ("verbose-error", "status 500")]


def model(rows, seconds, most):
    """ip, bucket -> alerts by a queue and a cooldown."""
    out, times, until = [], {}, {}
    for us, key, n in sorted(rows):
        q = times.setdefault(key, [])
        q.append(us)
        q[:] = [t for t in q if t >= us - seconds * 1_000_000]
        if len(q) > most and until.get(key, -(1 << 62)) <= us:
            until[key] = us + seconds * 1_000_000
            out.append((key, us, len(q)))
    return sorted(out)


def test_burst_in_batch(spark):
    rng = random.Random(0)
    rows = [(rng.randint(0, 120) * 500_000, rng.choice("ab"), i) for i in range(200)]
    rows = [(us, k, i) for i, (us, k, _) in enumerate(sorted(rows))]
    df = spark.createDataFrame([(k, us, i) for us, k, i in rows], "k string, us long, id long").withColumn("at", F.timestamp_micros("us"))
    got = logs.burst_alerts(df, ["k"], "at", 10, F.lit(5), "id").select("k", F.unix_micros("at").alias("us"), "hits").collect()
    assert sorted((r.k, r.us, r.hits) for r in got) == model([(us, k, i) for us, k, i in rows], 10, 5)


@pytest.mark.parametrize("windows", [1, 2, 5, 1000])
def test_any_slices_give_the_same(spark, windows):
    """A hot key over many slices, gaps, rows at the same time, a null key, times before the epoch."""
    rng = random.Random(windows)
    rows = [(us, "hot") for us in (rng.randint(-40, 1600) * 250_000 for _ in range(3000))] + [(rng.randint(0, 4000) * 500_000, rng.choice(["a", None])) for _ in range(400)]
    rows = [(us, k, i) for i, (us, k) in enumerate(sorted(rows, key=lambda r: r[0]))]
    df = spark.createDataFrame([(k, us, i) for us, k, i in rows] + [("hot", None, 9999)], "k string, us long, id long").withColumn("at", F.timestamp_micros("us"))
    got = logs.burst_alerts(df, ["k"], "at", 10, F.lit(5), "id", slice_windows=windows).select("k", F.unix_micros("at").alias("us"), "hits").collect()
    order = lambda x: (x[0] or "", *x[1:])
    want = sorted(model([(us, k or "", i) for us, k, i in rows], 10, 5))
    assert sorted(((r.k or "", r.us, r.hits) for r in got), key=order) == want and len(want) > 20


def test_exactly_the_limit_and_the_edge(spark):
    df = spark.createDataFrame([("a", s * 1_000_000, s) for s in (0, 1, 2, 3, 4)] + [("a", 10_000_000, 9)], "k string, us long, id long").withColumn("at", F.timestamp_micros("us"))
    got = logs.burst_alerts(df, ["k"], "at", 10, F.lit(5), "id").collect()
    assert [(r.id, r.hits) for r in got] == [(9, 6)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    lines = [event(f"2024-01-01T00:00:{s:02d}Z", ip=rng.choice("12"), path=rng.choice(["/api/chat", "/x"]), ua=rng.choice(["curl", "Mozilla"]), query=rng.choice(["q=<script>", None])) for s in sorted(rng.choices(range(40), k=80))]
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.log").write_text("\n".join(lines[:40]) + "\n")
    (source / "1.log").write_text("\n".join(lines[40:]) + "\n")
    batch = sorted((r.rule, r.ip, str(r.at)) for r in logs.stateless_alerts(parsed(spark, lines)).collect())
    q = logs.stateless_alerts(logs.log_stream(spark, str(source))).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.rule, r.ip, str(r.at)) for r in spark.sql("SELECT * FROM alerts").collect()) == batch


def test_new_alerts_sink(spark, tmp_path):
    write = logs.new_alerts_sink(str(tmp_path / "known"))
    df = logs.stateless_alerts(parsed(spark, [event("2024-01-01T00:00:00Z", status=500), event("2024-01-01T00:00:01Z", status=500)]))
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "known")).count() == 1
    write(df, 0)  # a batch that is run again
    assert spark.read.parquet(str(tmp_path / "known")).count() == 1


def test_stateful_burst_stream(spark, tmp_path):
    """The keyed processor gives what the fold gives in batch."""
    lines = [event(f"2024-01-01T00:00:{s:02d}Z", ip=ip, path="/api/chat") for ip in "12" for s in (0, 1, 2, 3, 4, 5, 6, 7, 30, 31)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = logs.burst_stream(logs.log_stream(spark, str(source))).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted((r.ip, r.us, r.hits) for r in spark.sql("SELECT * FROM bursts").collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = logs.bucketed(parsed(spark, lines)).withColumn("id", F.unix_micros("at"))
    want = sorted((r.ip, r.id, r.hits) for r in logs.burst_alerts(batch, ["ip", "bucket"], "at", 10, F.lit(5), "id").collect())
    assert got == want and len(got) == 2
