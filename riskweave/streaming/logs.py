"""Access-log rules: the same columns in batch and in Structured Streaming, and the keyed burst rule with cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import staged

LOG_SCHEMA = "ts string, svc string, ip string, method string, path string, query string, status int, ua string, ref string, body string"

# Rule, severity, technique.
LOG_RULES = (
    ("reflected-xss", "HIGH", "T1059.007"), ("sql-injection", "HIGH", "T1190"), ("os-command-injection", "CRITICAL", "T1059.004"), ("path-traversal", "HIGH", "T1083"), ("open-redirect", "MEDIUM", "T1190"), ("scanner-tooling-ua", "MEDIUM", "T1595.002"),
    ("automated-client-ua", "INFO", "T1595.002"), ("verbose-error", "LOW", "T1592"), ("internal-tier-access", "CRITICAL", "T1210"), ("exfiltration-to-c2", "CRITICAL", "T1041"), ("denial-of-wallet-burst", "HIGH", "T1499.003"),
)
# What alerts must match, by rule, tried in this order, whatever the case.
LOG_PATTERNS = {
    "reflected-xss": (r"<\s*script", r"%3c\s*script", r"</\s*script", r"\bon(error|load|mouseover|click|focus|toggle)\s*=", r"javascript:", r"<\s*img[^>]+src", r"<\s*svg", r"<\s*iframe", r"document\.cookie", r"alert\s*\("),
    "sql-injection": (
        r"union\s+select", r"\bor\s+1\s*=\s*1\b", r"'\s*or\s+'?\d", r"'\s*or\s+'[^']*'\s*=\s*'", r";\s*drop\s+table", r"\bsleep\s*\(\s*\d", r"\bwaitfor\s+delay\b", r"\bbenchmark\s*\(", r"\bdrop\s+(table|database)\b", r"\bxp_cmdshell\b", r"information_schema",
        r"--\s+", r"%27\s*or",
    ),
    "os-command-injection": (
        r";\s*(id|whoami|uname|cat|ls|pwd|nc|bash|sh|wget|curl)\b", r"\|\s*(id|whoami|uname|cat|ls|nc|bash|sh)\b", r"&&\s*(id|whoami|uname|cat|ls|nc|bash|sh)\b", r"\$\(", r"`[^`]+`", r"%3b\s*(id|whoami|cat|ls|uname)", r"%7c\s*(id|whoami|cat|ls|uname)", r";\s*sleep\s+\d",
    ),
    "path-traversal": (r"\.\./", r"\.\.\\", r"%2e%2e", r"\.\.%2f", r"%2e%2e%2f", r"/etc/passwd", r"\.\.%5c", r"(?:\.\.[\\/]){2,}"),
    "scanner-tooling-ua": (r"\bnmap\b", r"\bnikto\b", r"\bsqlmap\b", r"\bdirb\b", r"\bdirbuster\b", r"\bgobuster\b", r"\bwpscan\b", r"\bmasscan\b", r"\bzgrab\b", r"\bnuclei\b", r"\bhydra\b", r"\bwfuzz\b", r"\bffuf\b", r"\bzaproxy\b|\bOWASP ZAP\b"),
    "automated-client-ua": (r"\bcurl/", r"\bwget/", r"python-requests", r"\bgo-http-client\b", r"\bokhttp\b", r"\blibwww-perl\b", r"\bhttpie\b", r"\b(node-fetch|axios|java)/"),
}
# Parameters that redirect, hosts that are our own, and the services of the inner tier and of the attacker.
REDIRECT_PARAMS = "url|next|return|returnto|return_to|dest|destination|redirect|redirect_uri|continue|to|goto|target"
INTERNAL_HOST = r"^(localhost|127\.0\.0\.1|0\.0\.0\.0|web|api|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+)(:\d+)?$"
INTERNAL_SERVICE, INTERNAL_PATH, KNOWN_BAD_SERVICE = "internal", "/admin", "c2"


def parsed_log(lines: DataFrame, column: str = "value", arrival: Column | None = None) -> DataFrame:
    """The log's fields, at (event time) and malformed, from one JSON text a row.

    A row whose ts can't be read has the time of its arrival: a column of lines, or the time of the run.
    """
    schema = T._parse_datatype_string(LOG_SCHEMA)
    schema.add("_corrupt_record", T.StringType())
    j = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = lines.select(j.alias("j"), F.col(column).alias("raw"), (F.current_timestamp() if arrival is None else arrival).alias("arrival"))
    bad = F.col("_corrupt_record").isNotNull() | F.col("path").isNull() & F.col("ip").isNull()
    return out.select("j.*", "raw", "arrival").withColumn("malformed", bad).withColumn("at", F.coalesce(F.try_to_timestamp("ts"), "arrival")).drop("_corrupt_record", "arrival")


def _evidence(text: Column, rule: str) -> Column:
    """The text that the first of a rule's patterns finds; one look at all of them comes first, since most texts have none."""
    first = F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in LOG_PATTERNS[rule]])
    return F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in LOG_PATTERNS[rule])), first)


def external_redirect(query: Column) -> Column:
    """The first redirect parameter of a query, with its value, that leads to a host which isn't our own; null if none."""
    pairs = F.regexp_extract_all(query, F.lit(rf"(?i)(?:^|&)((?:{REDIRECT_PARAMS})=[^&]+)"), 1)
    host = lambda v: F.regexp_extract(F.trim(F.coalesce(F.try_url_decode(v), v)), r"(?i)^(?:https?:)?//([^/?#]+)", 1)
    value = lambda p: F.substr(p, F.instr(p, "=") + 1)
    away = F.filter(pairs, lambda p: (host(value(p)) != "") & ~host(value(p)).rlike("(?i)" + INTERNAL_HOST))
    return F.get(away, F.lit(0))


def stateless_alerts(events: DataFrame) -> DataFrame:
    """rule, severity, technique, evidence and the event's fields: one event may raise several alerts. Works on streams too."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("path", "query", "body")]))
    finds = {r: _evidence(text, r) for r in ("reflected-xss", "sql-injection", "os-command-injection", "path-traversal")}
    finds |= {r: _evidence(F.coalesce("ua", F.lit("")), r) for r in ("scanner-tooling-ua", "automated-client-ua")}
    finds["open-redirect"] = external_redirect(F.col("query"))
    finds["verbose-error"] = F.when(F.col("status") == 500, F.lit("status 500"))
    finds["internal-tier-access"] = F.when((F.col("svc") == INTERNAL_SERVICE) & F.col("path").startswith(INTERNAL_PATH), F.col("path"))
    finds["exfiltration-to-c2"] = F.when(F.col("svc") == KNOWN_BAD_SERVICE, F.coalesce(F.nullif(F.trim(F.coalesce(F.nullif("query", F.lit("")), "body", F.lit(""))), F.lit("")), "svc"))
    rules = {r: (s, t) for r, s, t in LOG_RULES}
    hits = [F.when(e.isNotNull(), F.struct(F.lit(r).alias("rule"), F.lit(rules[r][0]).alias("severity"), F.lit(rules[r][1]).alias("technique"), e.alias("evidence"))) for r, e in finds.items()]
    return events.withColumn("a", F.explode(F.array_compact(F.array(*hits)))).select("a.*", *[c for c in events.columns])


def once_per_source(alerts: DataFrame, rule: str = "automated-client-ua") -> DataFrame:
    """Alerts, those of one rule only the first of each service and address. On a stream, within the watermark, so that state stays bounded."""
    other, own = alerts.filter(F.col("rule") != rule), alerts.filter(F.col("rule") == rule)
    if alerts.isStreaming:
        return other.unionByName(own.dropDuplicatesWithinWatermark(["svc", "ip"]))
    w = Window.partitionBy("svc", "ip").orderBy("at", "path")
    return other.unionByName(own.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n"))


# Buckets of the burst rule and how many requests in a window they allow.
WINDOW_S, CHAT_MOST, LOGIN_MOST, PATH_MOST = 10, 5, 5, 30
LOGIN_PATHS = ("/login", "/api/login", "/auth/login")


def bucketed(events: DataFrame) -> DataFrame:
    """Adds bucket and most: chat, login, or the path by itself."""
    p = F.regexp_replace("path", "/+$", "")
    p = F.when(p == "", "/").otherwise(p)
    return events.withColumn("bucket", F.when(p == "/api/chat", "chat").when(p.isin(*LOGIN_PATHS), "login").otherwise(F.concat(F.lit("path:"), p))).withColumn("most", F.when(p == "/api/chat", CHAT_MOST).when(p.isin(*LOGIN_PATHS), LOGIN_MOST).otherwise(PATH_MOST))


def sliding_counts(events: DataFrame, keys: list[str], at: str, seconds: int, order: list[str] = ()) -> DataFrame:
    """Adds hits: rows of the same keys in the `seconds` before and at each row's time, both ends included."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn("hits", F.count("*").over(w))


#: A slice of time has so many windows' lengths.
SLICE_WINDOWS = 360


def burst_alerts(events: DataFrame, keys: list[str], at: str, seconds: int, most: Column, order: str, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """keys, at, order, hits: rows of a burst that aren't within the cooldown (`seconds` after the last alert of their keys).

    A key's time is cut into slices, so that one address under attack is many tasks. A slice's rows tell, for any time
    up to which alerts are held back when it begins, until when they are when it ends: a step function of few steps,
    since runs of alerts soon meet. These are put together for each key, and then each slice gives its own alerts.
    Null keys are a key; rows without a time go.
    """
    span, length = seconds * 1_000_000, seconds * slice_windows * 1_000_000
    over = sliding_in_order(events, keys, at, seconds, order, slice_windows).filter(F.col("hits") > most)
    over = staged(over.select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(order).cast("long").alias("id"), "hits").withColumn("slice", F.floor(F.col("us") / length)), "bursts")
    key_schema = T.StructType([f for f in over.schema.fields if f.name in keys])
    named = lambda *extra: T.StructType([*key_schema.fields, *[T.StructField(n, T.LongType()) for n in extra]])
    keyed = lambda t, n, **columns: pa.table([*[t.column(k).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for k in keys], *[pa.array(c) for c in columns.values()]], names=[*keys, *columns])

    def steps(t: pa.Table) -> pa.Table:
        us = np.unique(t.column("us").to_numpy())
        after = np.searchsorted(us, us + span)
        until = us + span
        for i in range(len(us) - 1, -1, -1):
            if after[i] < len(us):
                until[i] = until[after[i]]
        # Alerts before the slice hold back less than a window of it.
        n = min(len(us), int(np.searchsorted(us, t.column("slice")[0].as_py() * length + span)) + 1)
        last = np.flatnonzero(np.append(until[1:n] != until[: n - 1], True))
        return keyed(t, len(last), slice=np.full(len(last), t.column("slice")[0].as_py()), upto=us[last], until=until[last])

    def begun(t: pa.Table) -> pa.Table:
        t = t.sort_by([("slice", "ascending"), ("upto", "ascending")])
        slices, upto, until = (t.column(c).to_numpy() for c in ("slice", "upto", "until"))
        first = np.flatnonzero(np.append(True, slices[1:] != slices[:-1]))
        held, out = -(1 << 62), []
        for i, j in zip(first, [*first[1:], len(slices)], strict=True):
            out.append(held)
            k = i + int(np.searchsorted(upto[i:j], held))
            held = int(until[k]) if k < j else held
        return keyed(t, len(first), slice=slices[first], held=np.array(out))

    def told(t: pa.Table, entry: pa.Table) -> pa.Table:
        t = t.sort_by([("us", "ascending"), ("id", "ascending")])
        us, held, out = t.column("us").to_numpy(), entry.column("held")[0].as_py(), []
        while (i := int(np.searchsorted(us, held))) < len(us):
            out.append(i)
            held = int(us[i]) + span
        return t.select([*keys, "us", "id", "hits"]).take(pa.array(out, pa.int64()))

    entries = over.groupBy(*keys, "slice").applyInArrow(steps, named("slice", "upto", "until")).groupBy(*keys).applyInArrow(begun, named("slice", "held"))
    entries = entries.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("slice").alias("e_slice"), "held")
    found = over.groupBy(*keys, "slice").cogroup(entries.groupBy(*[f"e_{k}" for k in keys], "e_slice")).applyInArrow(told, named("us", "id", "hits"))
    return found.select(*keys, F.timestamp_micros("us").alias(at), F.col("id").alias(order), "hits")


def sliding_in_order(events: DataFrame, keys: list[str], at: str, seconds: int, order: str, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """sliding_counts as an arrival sees it: of rows at the same time, only those that come before it in order. Rows are counted in slices of time, those of a window before a slice in it too."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    span, length = seconds * 1_000_000, seconds * slice_windows * 1_000_000
    own = events.withColumn("__us", micros).filter("__us IS NOT NULL").withColumn("__own", F.floor(F.col("__us") / length))
    dealt = own.withColumn("__slice", F.explode(F.when(F.col("__us") >= (F.col("__own") + 1) * length - span, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))))
    all_ = Window.partitionBy(*keys, "__slice").orderBy("__us").rangeBetween(-span, Window.currentRow)
    later = Window.partitionBy(*keys, "__slice", "__us").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("hits", F.count("*").over(all_) - F.count("*").over(later)).filter("__slice = __own").drop("__us", "__own", "__slice")


class BurstProcessor(StatefulProcessor):
    """Per key: times within the window, and until when alerts are held back."""

    def __init__(self, seconds: int = WINDOW_S):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", T.StructType([T.StructField("us", T.LongType())]))
        self.until = handle.getValueState("until", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [t[0] for t in self.times.get()] if self.times.exists() else []
        until = self.until.get()[0] if self.until.exists() else -(1 << 62)
        span, out = self.seconds * 1_000_000, []
        for us, most in sorted((int(u), int(m)) for df in rows for u, m in zip(df["us"], df["most"], strict=True)):
            times = [t for t in times if t >= us - span] + [us]
            if len(times) > most and until <= us:
                until = us + span
                out.append((key[0], key[1], us, len(times)))
        self.times.put([(t,) for t in times])
        self.until.update((until,))
        yield pd.DataFrame(out, columns=["ip", "bucket", "us", "hits"]).astype({"us": "int64", "hits": "int64"})

    def close(self) -> None:
        pass


def burst_stream(events: DataFrame, seconds: int = WINDOW_S, late: str = "20 seconds") -> DataFrame:
    """Streaming burst alerts: ip, bucket, us (event time in microseconds), hits. Needs the RocksDB state store."""
    e = bucketed(events.filter("at IS NOT NULL")).withWatermark("at", late).select("ip", "bucket", "most", F.unix_micros("at").alias("us"))
    return e.groupBy("ip", "bucket").transformWithStateInPandas(BurstProcessor(seconds), "ip string, bucket string, us long, hits long", "append", "none")


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parsed events of JSON-lines files as they arrive."""
    return parsed_log(spark.readStream.text(path))


def new_alerts_sink(known_path: str):
    """A foreachBatch function that writes alerts not yet under known_path, by (rule, svc, ip, path).

    A batch has a folder of its own, named by its epoch and written anew if the batch is: a batch that is run again
    after a failure adds nothing twice, and only what other batches wrote counts as known.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        keys = ["rule", "svc", "ip", "path"]
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        place = spark._jvm.org.apache.hadoop.fs.Path(known_path)
        others = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{known_path}/epoch=*")) or []
        names = [f.getPath().getName() for f in others]
        if any(n != f"epoch={epoch}" for n in names):
            known = spark.read.schema(batch.schema.add("epoch", "long")).option("basePath", known_path).parquet(known_path).filter(F.col("epoch") != epoch)
            same = lambda c: fresh[c].eqNullSafe(known[c])
            fresh = fresh.join(known.select(*keys).distinct().alias("k"), same("rule") & same("svc") & same("ip") & same("path"), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{known_path}/epoch={epoch}")

    return write
