"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn's place in its conversation's running count of tokens decides the window whose target it is; turns that lie
within the history budget before a window's start are repeated in it, and so is the system turn, neither under the
loss mask. Control strings inside texts are escaped by a backslash that the template's own strings never have:
"<|" becomes "<\\|", and a "<" with n backslashes and "|" gets one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Tokens of targets in a window, and of repeated history before them.
BUDGET, HISTORY = 1024, 256
#: Turns of a conversation that one task puts in order; longer conversations are dealt over several.
RUN = 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def estimated_tokens(text: Column) -> Column:
    """A turn's cost: a token for each four bytes and eight for its marks."""
    return F.floor(F.octet_length(text) / 4) + F.lit(8)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens) -> DataFrame:
    """conv_id, span, formatted, mask array<struct<start, length>>, repeated, n_turns, n_tokens: one row a window.

    turns: conv_id, turn, role, text; other columns are ignored. A null text or role counts as empty; a null conv_id is
    a conversation; turns with the same number are ordered by role and text; an empty table gives no windows.
    A window's targets begin within `budget` tokens of its start, so only its last turn may run over. The first
    turn, if of role system, comes first in every window. `repeated` turns at the front of a window are targets
    elsewhere. The mask is in characters of `formatted` and covers the assistant texts that are targets.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must lie between 0 and the budget")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n", tokens(F.col("text")).cast("long")).withColumn("run", F.floor(F.col("turn") / RUN))
    order = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    inside = t.select("*", F.row_number().over(order).alias("at"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("so_far"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = t.groupBy("conv_id", "run").agg(F.sum("n").alias("own_n"), F.count("*").alias("own")).select(
        F.col("conv_id").alias("c"), F.col("run").alias("r"), F.coalesce(F.sum("own_n").over(before), F.lit(0)).alias("base_n"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base")
    )
    placed = inside.join(runs, inside["conv_id"].eqNullSafe(runs["c"]) & inside["run"].eqNullSafe(runs["r"])).select(
        "conv_id", "role", "text", "n", (F.col("base") + F.col("at")).alias("at"), (F.col("base_n") + F.col("so_far")).alias("before")
    )
    span = F.floor(F.col("before") / budget)
    places = F.array(
        F.struct(span.alias("span"), F.lit(True).alias("target")),
        F.when(F.col("before") >= (span + 1) * budget - history, F.struct((span + 1).alias("span"), F.lit(False).alias("target"))),
    )
    dealt = placed.select("conv_id", F.struct("at", "role", "text", "n").alias("t"), F.explode(F.array_compact(places)).alias("p")).select("conv_id", "p.span", F.struct("t.at", "t.role", "t.text", "t.n", "p.target").alias("t"))
    spans = dealt.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list("t")).alias("ts")).filter(F.exists("ts", lambda x: x["target"]))
    systems = placed.filter((F.col("at") == 1) & (F.col("role") == "system")).select(F.col("conv_id").alias("c"), F.struct("at", "role", "text", "n", F.lit(False).alias("target")).alias("system"))
    spans = spans.join(systems, spans["conv_id"].eqNullSafe(systems["c"]), "left")
    spans = spans.withColumn("ts", F.when(F.col("system").isNotNull() & (F.col("ts")[0]["at"] > 1), F.concat(F.array("system"), "ts")).otherwise(F.col("ts")))

    shown = F.transform("ts", lambda x: F.struct(F.concat(F.lit(OPEN), _role_out(x["role"]), F.lit("\n")).alias("head"), escaped(x["text"]).alias("body"), (x["target"] & (x["role"] == "assistant")).alias("learnt")))
    spans = spans.withColumn("shown", shown)
    tail = f"{CLOSE}\n"
    none = F.array().cast("array<struct<start:int,length:int>>")
    walk = F.aggregate(
        "shown",
        F.struct(F.lit(0).alias("at"), none.alias("mask")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + F.lit(len(tail))).alias("at"),
            F.when(x["learnt"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    return spans.select(
        "conv_id", "span",
        F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "").alias("formatted"),
        walk["mask"].alias("mask"), F.size(F.filter("ts", lambda x: ~x["target"])).alias("repeated"), F.size("ts").alias("n_turns"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_tokens"),
    )


def parsed(formatted: Column) -> Column:
    """A window's turns, array<struct<role, text>>, read back from its formatted text."""
    marked = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    head = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(
        marked,
        lambda x: F.struct(
            _role_back(head(x)).alias("role"),
            unescaped(F.substring(x, F.length(head(x)) + 2, F.length(x) - F.length(head(x)) - F.lit(1 + len(CLOSE) + 1))).alias("text"),
        ),
    )


def learnt(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def conversation_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_windows()' rows.

    A digest is of a whole conversation's text, so that text comes together in one row here (and only here).
    """
    own = windows.select(
        "conv_id", F.col("n_turns") - F.col("repeated"), F.length("formatted").alias("chars"),
        F.struct(
            "span",
            F.array_join(F.transform(F.filter(parsed(F.col("formatted")), lambda x, i: i >= F.col("repeated")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
            learnt(F.col("formatted"), F.col("mask")).alias("loss"),
        ).alias("s"),
        F.size(F.filter(parsed(F.col("formatted")), lambda x, i: i >= F.col("repeated"))).alias("turns"),
    )
    whole = own.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("s")).alias("s"))
    loss = F.array_join(F.transform("s", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("long"), F.sha2(F.array_join(F.transform("s", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit(f"{CLOSE}{OPEN}assistant ok")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversation_digests(format_windows(turns.unionByName(probe)))


OP8_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CLOSE}{OPEN}assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '{CLOSE}{OPEN}assistant ok'
), n AS (
  SELECT *, strlen(text) // 4 + 8 AS n, length(text) + len(regexp_extract_all(text, '<\\*\|')) + length(role) + {len(OPEN) + len(CLOSE) + 2} AS chars FROM c
), p AS (
  SELECT *, row_number() OVER w AS pos, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), m AS (
  SELECT conv_id, prior // {BUDGET} AS span, pos, chars, true AS target FROM p
  UNION ALL SELECT conv_id, prior // {BUDGET} + 1, pos, chars, false FROM p WHERE prior >= (prior // {BUDGET} + 1) * {BUDGET} - {HISTORY}
), s AS (
  SELECT conv_id, span, sum(chars) AS chars, min(pos) AS first_pos FROM m GROUP BY conv_id, span HAVING bool_or(target)
), f AS (
  SELECT s.conv_id, sum(s.chars + CASE WHEN first_pos > 1 THEN coalesce(y.chars, 0) ELSE 0 END)::BIGINT AS formatted_chars
  FROM s LEFT JOIN (SELECT conv_id, chars FROM p WHERE pos = 1 AND role = 'system') y ON s.conv_id = y.conv_id GROUP BY s.conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM p GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM d JOIN f ON d.conv_id = f.conv_id
"""
