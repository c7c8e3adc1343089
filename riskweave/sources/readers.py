"""Sources: source files, manifests, lockfiles, advisories, diffs, logs, rule packs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex

# Extensions that count as source, and the largest file read.
SOURCE_EXTENSIONS = ("js", "jsx", "ts", "tsx", "mjs", "cjs")
LARGEST_FILE = 2_000_000


def source_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = ("*node_modules/*", "*.min.js", "*dist/*"), extensions: tuple[str, ...] = SOURCE_EXTENSIONS, largest: int = LARGEST_FILE) -> DataFrame:
    """file (from the root), ext, text, size: decoded with replacement; the size and name are filtered before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    base = root.rstrip("/").removeprefix("file://")
    files = raw.filter(F.col("length") <= largest).withColumn("file", F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), "^" + _quoted(base) + "/*", ""))
    for g in ignore:
        files = files.filter(~F.col("file").rlike(glob_regex(g)))
    return files.select("file", F.regexp_extract("file", r"\.([^.]+)$", 1).alias("ext"), _text().alias("text"), F.col("length").alias("size"))


def _text() -> Column:
    """A file's bytes as text; what isn't UTF-8 is replaced."""
    return F.make_valid_utf8(F.col("content").cast("string"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """file, section, section_ord, name, declared of every package manifest; unreadable ones give no rows."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").load(root)
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    schema = ", ".join(f"{s} map<string,string>" for s in sections)
    j = raw.select(F.col("path").alias("file"), F.from_json(_text(), schema).alias("j"))
    each = F.array(*[F.struct(F.lit(n).alias("section_ord"), F.lit(s).alias("section"), F.col(f"j.{s}").alias("deps")) for n, s in enumerate(sections)])
    return j.select("file", F.explode(each).alias("s")).select("file", "s.section", "s.section_ord", F.explode("s.deps").alias("name", "declared"))


def lock_packages(spark: SparkSession, root: str) -> DataFrame:
    """file, path, version, resolved, integrity, dev of every lockfile's packages, or of its dependencies in the old form."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "package-lock.json").load(root)
    entry = "struct<version:string,resolved:string,integrity:string,dev:boolean>"
    j = raw.select(F.col("path").alias("file"), F.from_json(_text(), f"packages map<string,{entry}>, dependencies map<string,{entry}>").alias("j"))
    return j.select("file", F.explode(F.coalesce("j.packages", "j.dependencies")).alias("path", "p")).filter("path <> ''").select("file", "path", "p.*")


def advisories(spark: SparkSession, *paths: str) -> DataFrame:
    """package, id, cve, vulnerable_range, patched, severity, symbols: by package and id, the first path wins."""
    rows = None
    for n, p in enumerate(paths):
        df = spark.read.schema("package string, id string, cve string, vulnerable_range string, patched string, severity string, symbols array<string>").json(p).withColumn("source", F.lit(n))
        rows = df if rows is None else rows.unionByName(df)
    return rows.groupBy("package", "id").agg(F.min_by(F.struct("cve", "vulnerable_range", "patched", "severity", "symbols"), "source").alias("a")).select("package", "id", "a.*")


def advisory_records(spark: SparkSession, path: str) -> DataFrame:
    """Advisory records with lists of events, one JSON text a line, as deps.advisories_from_records() asks for them."""
    shape = "id string, aliases array<string>, summary string, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
    return spark.read.schema(shape).json(path)


def changed_lines(spark: SparkSession, diff_text: str) -> DataFrame:
    """file, line of a unified diff's new side; a hunk that only deletes marks one line."""
    lines = spark.createDataFrame([(n, t) for n, t in enumerate(diff_text.split("\n"))], "n long, t string")  # a diff under review, on the driver already
    from pyspark.sql import Window

    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("file", F.last(F.when(F.col("t").startswith("+++ "), F.regexp_extract("t", r"^\+\+\+ (?:b/)?(\S+)", 1)), ignorenulls=True).over(w))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    hunks = named.filter(F.col("t").rlike(hunk)).select("file", F.regexp_extract("t", hunk, 1).cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract("t", hunk, 2), F.lit("")).cast("int"), F.lit(1)).alias("n"))
    return hunks.filter("file <> '/dev/null'").select("file", F.explode(F.sequence("a", F.col("a") + F.greatest("n", F.lit(1)) - 1)).alias("line")).distinct()


def access_log(spark: SparkSession, path: str) -> DataFrame:
    from ..streaming.logs import parsed_log

    return parsed_log(spark.read.text(path))


def installed_packages(spark: SparkSession, root: str, largest: int = 1_000_000) -> DataFrame:
    """project (the folder above the outermost node_modules), name, version, scripts of every installed package's manifest; unreadable ones give no rows.

    All are read: there is no cap on their number. A manifest without a name has that of its folder.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").load(root)
    inside = raw.filter((F.col("length") <= largest) & F.col("path").contains("/node_modules/"))
    j = inside.select("path", F.from_json(_text(), "name string, version string, scripts map<string,string>, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j")).filter("j IS NOT NULL AND j._corrupt_record IS NULL")
    own = F.regexp_extract("path", r"([^/]+)/package\.json$", 1)
    return j.select(F.substring_index("path", "/node_modules/", 1).alias("project"), F.coalesce("j.name", own).alias("name"), F.coalesce("j.version", F.lit("")).alias("version"), "j.scripts")


def env_files(spark: SparkSession, root: str) -> DataFrame:
    """project (the root), file: the environment files right under the root. Spark's readers pass over names that start with a dot, so their folder is listed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.env*")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    return spark.createDataFrame([(root.rstrip("/"), f.getPath().getName()) for f in found if f.isFile()], "project string, file string")  # a handful of names


def listed(spark: SparkSession, path: str, project: str, column: str) -> DataFrame:
    """project and one column of a text file's lines that aren't blank: a repository's list of files, or its ignore patterns."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.lit(project).alias("project"), F.col("value").alias(column))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded HTTP responses, one JSON text a line, as checks.response_findings() asks for them."""
    return spark.read.schema("url string, status int, headers map<string,string>, cookies array<string>, body string, probe_kind string, probe string").json(path)


def exploited(spark: SparkSession, path: str) -> DataFrame:
    """cve: the catalogue of exploited vulnerabilities, a JSON document with a list of entries."""
    doc = spark.read.option("multiLine", "true").schema("vulnerabilities array<struct<cveID:string>>").json(path)
    return doc.select(F.explode("vulnerabilities").alias("v")).select(F.upper("v.cveID").alias("cve")).filter("cve IS NOT NULL").distinct()


def exploit_scores(spark: SparkSession, path: str) -> DataFrame:
    """cve, p: exploit probabilities, a CSV with columns cve and epss after comment lines."""
    rows = spark.read.option("header", "true").option("comment", "#").csv(path)
    return rows.select(F.upper("cve").alias("cve"), F.expr("try_cast(epss AS double)").alias("p")).filter("p IS NOT NULL")


def config_file(path: str) -> dict:
    """Settings of a scan from a JSON or TOML file: only names that a scan knows; null where nothing is said."""
    from ..plans.scan import Config

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    else:
        import tomllib

        with open(path, "rb") as f:
            found = tomllib.load(f)
    known = Config.__dataclass_fields__.keys() - {"rules"}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known}


def rule_pack(path: str) -> list[dict]:
    """Entries of a YAML or JSON rule file."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or []
