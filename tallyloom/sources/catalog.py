"""File trees, manifests and coverage artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.paths import LOCK_FILES, eligible, language_of
from tallyloom.sources.tree import list_tree, read_files

#: Bytes of a file that is captured, at most.
MAX_FILE = 4 << 20


def capture_files(spark: SparkSession, root: str, own_only: bool = True) -> DataFrame:
    """path (below the root), text, digest, bytes, lines, newline kind and language of every file.

    Own files only: vendored folders are not listed, lock files and files too large or empty are not opened.
    """
    if own_only:
        listed = list_tree(spark, root).filter(~F.col("path").rlike(LOCK_FILES) & F.col("bytes").between(1, MAX_FILE))
        df = read_files(listed, root).filter(eligible(F.col("path"), F.col("content"), MAX_FILE))
    else:
        df = read_files(list_tree(spark, root, ()), root)
    text = F.col("content").cast("string")
    nl = F.when(F.instr(text, "\r\n") > 0, F.when(F.regexp_count(text, F.lit("(?<!\r)\n")) > 0, "mixed").otherwise("crlf")).when(F.instr(text, "\n") > 0, "lf").otherwise("none")
    lines = F.size(F.split(text, "\n"))
    return df.select("path", text.alias("text"), F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("byte_count"), lines.alias("lines"), (F.length(F.substring_index(text, "\n", -1)) + 1).alias("last_column"), nl.alias("newline"), language_of(F.col("path")).alias("language"))


_COVERAGE = "artifact string, run string, commit_id string, records array<struct<subject:string,metric:string,hits:long,total:long>>"


def import_coverage(df: DataFrame, column: str = "body") -> DataFrame:
    """A row a metric of each artifact; records with more hits than total, or negative ones, are left out."""
    a = df.select(F.from_json(column, _COVERAGE).alias("a")).filter(F.col("a.records").isNotNull())
    r = a.select("a.artifact", "a.run", "a.commit_id", F.explode("a.records").alias("r")).select("artifact", "run", "commit_id", "r.*")
    return r.filter((F.col("hits") >= 0) & (F.col("hits") <= F.col("total"))).orderBy("artifact", "run", "subject", "metric")


_SECTIONS = {"dependencies": "runtime", "devDependencies": "development", "peerDependencies": "peer", "optionalDependencies": "optional"}


def manifest_facts(files: DataFrame) -> dict[str, DataFrame]:
    """Projects, dependencies (scope by section), scripts and entry points of JSON manifests (path, text)."""
    sections = ", ".join(f"{s} map<string,string>" for s in _SECTIONS)
    m = files.select("path", F.from_json("text", f"name string, version string, main string, bin map<string,string>, scripts map<string,string>, {sections}").alias("m"))
    root = F.regexp_replace("path", r"/?[^/]*$", "")
    project = m.select(F.coalesce("m.name", root).alias("project_id"), root.alias("root"), F.col("m.version").alias("version"), "m")
    deps = None
    for s, scope in _SECTIONS.items():
        one = project.select("project_id", F.explode(f"m.{s}").alias("package_name", "specifier"), F.lit(scope).alias("scope"))
        deps = one if deps is None else deps.unionByName(one)
    scripts = project.select("project_id", F.explode("m.scripts").alias("name", "command"))
    entry = project.filter("m.main is not null").select("project_id", F.lit("package").alias("kind"), F.col("m.main").alias("target"))
    entry = entry.unionByName(scripts.select("project_id", F.when(F.col("name").startswith("test"), "test").otherwise("script").alias("kind"), F.col("name").alias("target")))
    entry = entry.unionByName(project.select("project_id", F.explode("m.bin").alias("n", "target")).select("project_id", F.lit("executable").alias("kind"), "target"))
    return {"projects": project.select("project_id", "root", "version"), "dependencies": deps, "scripts": scripts, "entrypoints": entry}


def requirement_names(lines: DataFrame, column: str = "line") -> DataFrame:
    """Package names of requirement lines, folded, without extras, versions and comments."""
    name = F.regexp_extract(column, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return lines.withColumn("package_name", F.lower(name)).filter("package_name <> ''")


def search_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(fact_key, kind, path, title, body) of the tables chunk (chunk_id, path, text), symbol (symbol_id, path, name, signature), dependency and script."""
    out = None
    rows = {
        "chunk": lambda d: (F.col("chunk_id"), F.col("path"), F.element_at(F.split("path", "/"), -1), F.col("text")),
        "symbol": lambda d: (F.concat_ws(":", "project_id", "symbol_id"), F.col("path"), F.col("name"), F.coalesce("signature", F.lit(""))),
        "dependency": lambda d: (F.concat_ws(":", "project_id", "package_name"), F.col("project_id"), F.col("package_name"), F.concat_ws(" ", "scope", "specifier")),
        "script": lambda d: (F.concat_ws(":", "project_id", "name"), F.col("project_id"), F.col("name"), F.col("command")),
    }
    for kind, df in tables.items():
        key, path, title, body = rows[kind](df)
        one = df.select(F.concat(F.lit(kind + ":"), key).alias("fact_key"), F.lit(kind).alias("kind"), path.alias("path"), title.alias("title"), body.alias("body"))
        out = one if out is None else out.unionByName(one)
    return out
