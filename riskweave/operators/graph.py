"""Import graphs: edges from text, file resolution, and which entry points reach a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_place, staged

#: Extensions that an import may leave out, in the order in which they are tried, also as an index file.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: What a name may lack, in the order in which it is tried.
ENDS = ("", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS])

_FROM = r"(?:import|export)\s[^;'\"]*?from\s*['\"]([^'\"]+)['\"]"
_CALL = r"(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]"
_BARE = r"import\s*['\"]([^'\"]+)['\"]"


def import_specs(text: Column) -> Column:
    """Distinct module names that a source imports, exports from, requires or loads."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in (_FROM, _CALL, _BARE)]))


def normal_path(path: Column) -> Column:
    """A path without . and .. parts; .. at the root stays there."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def bases(spec: Column, importer: Column, roots: tuple[str, ...] = ("", "src")) -> Column:
    """The paths that a module name may mean, in the order in which they are tried, each with any of ENDS; empty for a package.

    A name that starts with a dot is relative to the importer, one that starts with @/ or ~/ to each of the roots.
    """
    here = normal_path(F.concat(F.regexp_replace(importer, "[^/]*$", ""), spec))
    aliased = F.array(*[normal_path(F.concat(F.lit(f"{r}/"), F.substr(spec, F.lit(3)))) for r in roots])
    return F.when(spec.rlike(r"^[@~]/"), aliased).when(spec.startswith("."), F.array(here)).otherwise(F.array().cast("array<string>"))


def resolved(imports: DataFrame, files: DataFrame, by: list[str], roots: tuple[str, ...] = ("", "src")) -> DataFrame:
    """by, dst: the first file that exists of those which the imports of a group may mean. imports: file, spec and by; files: file.

    A file is known by what is left of its path without each of the ENDS that it has, so that it meets a name once, instead
    of every name being tried with every end. The join is a left one: files can be sent out where they are few, imports
    (of which Spark can't tell how many a text has) never.
    """
    tried = imports.select(*by, F.posexplode_outer(bases(F.col("spec"), F.col("file"), roots)).alias("root", "base")).filter("base IS NOT NULL")
    known = files.select(F.col("file").cast("string").alias("dst")).distinct().select("dst", F.posexplode(F.array(*[F.lit(e) for e in ENDS])).alias("n", "end")).filter(F.endswith("dst", F.col("end")))
    known = known.select("dst", "n", F.left("dst", F.length("dst") - F.length("end")).alias("base"))
    order = F.when(F.col("dst").isNotNull(), F.struct("root", "n"))
    return tried.join(known, "base", "left").groupBy(*by).agg(F.min_by("dst", order).alias("dst")).filter("dst IS NOT NULL")


def edges(files: DataFrame, roots: tuple[str, ...] = ("", "src")) -> DataFrame:
    """src, dst: each import of a file of the corpus by another, by the first name that exists. files: file, text."""
    return links(files.select("file", import_specs(F.col("text")).alias("specs")), roots)


def links(files: DataFrame, roots: tuple[str, ...] = ("", "src")) -> DataFrame:
    """edges() of files whose module names are known. files: file, specs."""
    specs = files.select("file", F.explode("specs").alias("spec"))
    return resolved(specs, files, ["file", "spec"], roots).select(F.col("file").alias("src"), "dst").distinct()


#: Names of files that the router of an app directory renders.
RENDERED = ("page", "layout", "template", "default", "loading", "error", "not-found", "global-error", "head", "opengraph-image", "icon")


def entry_kind(file: Column, text: Column, framework: str | None = None) -> Column:
    """server, client or null: what makes a file an entry point. framework: of the project, if known."""
    parts = F.split(file, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    has = lambda d: F.array_contains(parts, d)
    head = F.array_join(F.slice(F.split(text, r"\r?\n"), 1, 3), "\n")
    single_page = stem.isin("main", "index") & (has("src") | (F.size(parts) == 1)) & (name.startswith("main.") if framework not in ("vite", "react") else F.lit(True))
    return (
        F.when(file.rlike(r"^(src/)?middleware\.(ts|tsx|js|jsx|mjs|cjs)$"), "server")
        .when(has("app") & (stem == "route"), "server").when(has("app") & stem.isin(*RENDERED), "client")
        .when(has("pages"), F.when(F.concat(F.lit("/"), file).contains("/api/"), "server").otherwise("client"))
        .when(head.rlike(r"(?m)^\s*['\"]use server['\"]"), "server").when(single_page, "client")
    )


def reach(entrypoints: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """rel, kind, entrypoint, path, hops: what is reachable; server entries win over client ones; paths are shortest, ties to the smallest.

    entrypoints: rel, kind. Each round is one job that writes the files which it reaches first to the shared folder, where
    the next one finds all of them, so plans don't grow and a lost executor costs one round. More than `rounds` hops
    are an error, no cut.
    """
    spark = entrypoints.sparkSession
    links = staged(edges.select("src", "dst").distinct(), "edges")
    place = new_place(spark, "reached")
    schema = "rel string, kind string, path array<string>"
    entrypoints.select("rel", "kind", F.array("rel").alias("path")).distinct().write.parquet(f"{place}/hops=0")
    for hop in range(1, rounds + 3):
        front = spark.read.schema(schema).parquet(f"{place}/hops={hop - 1}")
        if front.isEmpty():
            break
        if hop > rounds + 1:
            raise ValueError(f"some file is over {rounds} imports away")
        seen = spark.read.schema(schema + ", hops int").parquet(place).select("rel", "kind")
        step = front.join(links, F.col("rel") == F.col("src")).select(F.col("dst").alias("rel"), "kind", F.concat("path", F.array("dst")).alias("path"))
        step.groupBy("rel", "kind").agg(F.min("path").alias("path")).join(seen, ["rel", "kind"], "left_anti").select("rel", "kind", "path").write.parquet(f"{place}/hops={hop}")
    all_ = spark.read.schema(schema + ", hops int").parquet(place)
    best = all_.groupBy("rel").agg(F.max_by(F.struct("kind", "path", "hops"), "kind").alias("b"))  # "server" comes after "client"
    return best.select("rel", "b.kind", F.col("b.path")[0].alias("entrypoint"), "b.path", "b.hops")


def annotated(findings: DataFrame, reached: DataFrame, has_entrypoints: bool, source: str = r"\.(ts|tsx|js|jsx|mjs|cjs)$") -> DataFrame:
    """Adds reachable (null: not analysed), reach_kind, reach_entrypoint, reach_path; files that aren't source are reachable, of kind project."""
    if not has_entrypoints:
        return findings.select("*", F.lit(None).cast("boolean").alias("reachable"), F.lit(None).cast("string").alias("reach_kind"), F.lit(None).cast("string").alias("reach_entrypoint"), F.lit(None).cast("array<string>").alias("reach_path"))
    r = reached.select(F.col("rel").alias("r_rel"), F.col("kind").alias("r_kind"), F.col("entrypoint").alias("reach_entrypoint"), F.col("path").alias("reach_path"))
    out = findings.join(r, F.col("file") == F.col("r_rel"), "left")
    is_source = F.col("file").rlike(source)
    return out.withColumn("reachable", F.when(is_source, F.col("r_rel").isNotNull()).otherwise(F.lit(True))).withColumn("reach_kind", F.when(is_source, F.col("r_kind")).otherwise("project")).drop("r_rel", "r_kind")
