"""Versions and ranges as columns: versions are structs that compare by parts; a range is a list of bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version(text: Column) -> Column:
    """struct<major, minor, patch, final, pre> of a declared version; null if there is none to be found.

    Leading marks (^ ~ v = < >) go, missing parts count as 0, and a pre-release sorts below its release.
    """
    core = F.regexp_extract(text, r"^[\^~<>=v\s]*([0-9]{1,9})(?:\.([0-9]{1,9}))?(?:\.([0-9]{1,9}))?", 0)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, r"^[\^~<>=v\s]*([0-9]{1,9})(?:\.([0-9]{1,9}))?(?:\.([0-9]{1,9}))?", i), F.lit("")).cast("int"), F.lit(0))
    pre = F.regexp_extract(text, r"^[\^~<>=v\s]*[0-9]+(?:\.[0-9]+)*-([0-9A-Za-z.-]+)", 1)
    return F.when(core != "", F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("final"), pre.alias("pre")))


def bounds(text: Column) -> Column:
    """array<struct<op, version>> of a range such as ">=1.2.0, <2.0.0"; parts that aren't bounds go."""
    parts = F.filter(F.split(text, r"\s*,\s*|\s+(?=[<>=!])"), lambda p: p.rlike(r"^\s*(<=|>=|<|>|=|==|!=)\s*[0-9]"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*(<=|>=|==|!=|<|>|=)", 1).alias("op"), version(F.regexp_replace(p, r"^\s*(<=|>=|==|!=|<|>|=)\s*", "")).alias("version")))


def within(v: Column, ranges: Column) -> Column:
    """Whether a version meets every bound; false for a null version or a range without bounds."""
    meets = F.forall(
        ranges,
        lambda b: F.when(b["op"] == "<", v < b["version"]).when(b["op"] == "<=", v <= b["version"]).when(b["op"] == ">", v > b["version"]).when(b["op"] == ">=", v >= b["version"]).when(b["op"] == "!=", v != b["version"]).otherwise(v == b["version"]),
    )
    return F.coalesce((F.size(ranges) > 0) & v.isNotNull() & meets, F.lit(False))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def alternatives(text: Column) -> Column:
    """The bounds of each of a range's alternatives, which || sets apart."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\s*\|\|\s*"), bounds)


def within_any(v: Column, text: Column) -> Column:
    """Whether a version lies in one of a range's alternatives."""
    return F.exists(alternatives(text), lambda ranges: within(v, ranges))


EVENTS = "array<struct<introduced:string,fixed:string,last_affected:string>>"


def _folded(events: Column, depth_counts: bool) -> Column:
    """array<struct<lo, hi, through>> of events (struct<v, kind, text>; kind 0 opens, 1 closes before, 2 closes after), in order.

    depth_counts: whether what was opened twice must be closed twice, as where ranges lie over each other.
    """
    interval = "struct<lo:string,hi:string,through:boolean>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("lo"), F.array().cast(f"array<{interval}>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        opens, deep = e["kind"] == 0, s["depth"]
        after = F.when(opens, deep + 1 if depth_counts else F.lit(1)).otherwise(F.greatest(deep - 1, F.lit(0)))
        closed = F.array(F.struct(s["lo"].alias("lo"), e["text"].alias("hi"), (e["kind"] == 2).alias("through")))
        return F.struct(after.cast("int").alias("depth"), F.when(opens & (deep == 0), e["text"]).otherwise(s["lo"]).alias("lo"), F.when(~opens & (deep > 0) & (after == 0), F.concat(s["out"], closed)).otherwise(s["out"]).alias("out"))

    def end(s: Column) -> Column:
        still = F.array(F.struct(s["lo"].alias("lo"), F.lit(None).cast("string").alias("hi"), F.lit(False).alias("through")))
        return F.when(s["depth"] > 0, F.concat(s["out"], still)).otherwise(s["out"])

    return F.aggregate(F.array_sort(events), start, step, end)


def _event(text: Column, kind: int) -> Column:
    return F.when(version(text).isNotNull(), F.struct(version(text).alias("v"), F.lit(kind).alias("kind"), text.alias("text")))


def affected_ranges(ranges: Column) -> Column:
    """array<struct<lo, hi, through>>: the disjoint ranges, by version, of an array of event lists (EVENTS).

    A list's events open (introduced) and close a range, before a version (fixed) or after it (last_affected); without
    a close it has no end. Lists may overlap, ranges that touch become one, and events without a version go.
    """
    each = F.transform(ranges, lambda events: _folded(F.array_compact(F.flatten(F.transform(events, lambda e: F.array(_event(e["introduced"], 0), _event(e["fixed"], 1), _event(e["last_affected"], 2))))), False))
    ends = F.flatten(F.transform(F.flatten(each), lambda r: F.array(_event(r["lo"], 0), F.when(r["through"], _event(r["hi"], 2)).otherwise(_event(r["hi"], 1)))))
    return F.coalesce(_folded(F.array_compact(ends), True), F.array().cast("array<struct<lo:string,hi:string,through:boolean>>"))


def range_text(ranges: Column) -> Column:
    """Disjoint ranges as within_any() reads them."""
    start = lambda r: F.when(F.coalesce(r["lo"].rlike(r"^0+(\.0+)*$"), F.lit(False)) & r["hi"].isNotNull(), F.lit(None).cast("string")).otherwise(F.concat(F.lit(">="), r["lo"]))
    stop = lambda r: F.concat(F.when(r["through"], "<=").otherwise("<"), r["hi"])
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws(",", start(r), stop(r))), " || ")


# The weights of the third version of the scoring standard, of privileges also where the scope changes.
WEIGHTS = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}, "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0}}
PRIVILEGES, PRIVILEGES_CHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}, {"N": 0.85, "L": 0.68, "H": 0.5}


def base_score(vector: Column) -> Column:
    """The base score, 0 to 10, of a vector such as CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H; null if a part is missing."""
    of = lambda name: F.regexp_extract(vector, f"/{name}:([A-Z])", 1)
    weight = lambda name, table: F.try_element_at(F.create_map(*[F.lit(x) for k, w in table.items() for x in (k, w)]), of(name))
    parts = F.struct(*[weight(name, table).alias(name) for name, table in WEIGHTS.items()], weight("PR", PRIVILEGES).alias("PR"), weight("PR", PRIVILEGES_CHANGED).alias("PRC"), of("S").alias("S"))

    def summed(w: Column) -> Column:
        loss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
        impact = F.when(w["S"] == "C", 7.52 * (loss - 0.029) - 3.25 * F.pow(loss - 0.02, F.lit(15.0))).otherwise(6.42 * loss)
        return F.struct(impact.alias("impact"), (8.22 * w["AV"] * w["AC"] * F.when(w["S"] == "C", w["PRC"]).otherwise(w["PR"]) * w["UI"]).alias("ease"), w["S"].alias("S"))

    def rounded(t: Column) -> Column:
        total = (t["impact"] + t["ease"]) * F.when(t["S"] == "C", 1.08).otherwise(1.0)
        up = _let(F.round(F.least(total, F.lit(10.0)) * 100_000), lambda whole: F.when(whole % 10_000 == 0, whole / 100_000).otherwise((F.floor(whole / 10_000) + 1) / 10))
        return F.when((t["S"] != "") & total.isNotNull(), F.when(t["impact"] <= 0, 0.0).otherwise(up))

    return F.when(vector.rlike("^CVSS:3"), _let(_let(parts, summed), rounded))


def severity_of_score(score: Column) -> Column:
    """The name of a base score's band; null for 0 and null."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low")
