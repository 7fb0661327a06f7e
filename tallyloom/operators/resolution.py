"""Imports, declarations and dependencies resolved to files, packages and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import normalize_package
from tallyloom.functions.paths import ancestors, normalize_path
from tallyloom.functions.scratch import materialize

# Endings that a module's path may lack.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".json", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """The first existing candidate of each (directory, specifier): relative, alias prefix, workspace package, then dotted module, each with the known endings.

    Distinct (directory, specifier) pairs are resolved once; the file table is joined on the candidate path.
    """
    one = imports.select("directory", "specifier").distinct()
    spec, here = F.col("specifier"), F.col("directory")
    relative = F.when(spec.startswith("."), normalize_path(F.concat_ws("/", here, spec)))
    dotted = F.when(~spec.startswith(".") & ~spec.contains("/"), F.translate(spec, ".", "/"))
    bases = one.select("directory", "specifier", F.posexplode(F.array(relative, F.lit(None).cast("string"), F.lit(None).cast("string"), dotted)).alias("way", "base"))
    if aliases is not None:
        a = F.broadcast(aliases)
        bases = bases.unionByName(one.join(a, F.startswith(spec, F.col("prefix"))).select("directory", "specifier", F.lit(1).alias("way"), F.concat(F.col("target"), F.expr("substring(specifier, length(prefix) + 1)")).alias("base")))
    if packages is not None:
        named = one.withColumn("name", F.when(spec.startswith("@"), F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(spec, r"^([^/]+)", 1)))
        bases = bases.unionByName(named.join(packages.select("name", "root"), "name").select("directory", "specifier", F.lit(2).alias("way"), F.concat(F.col("root"), F.expr("substring(specifier, length(name) + 1)")).alias("base")))
    tried = bases.filter(F.col("base").isNotNull()).select("directory", "specifier", "way", F.posexplode(F.array(*[F.concat(F.col("base"), F.lit(e)) for e in ENDINGS])).alias("pos", "path"))
    best = tried.join(files.select("path").distinct(), "path").groupBy("directory", "specifier").agg(F.min_by("path", F.struct("way", "pos")).alias("resolved_path"))
    out = imports.join(best, ["directory", "specifier"], "left")
    return out.withColumn("outcome", F.when(F.col("resolved_path").isNotNull(), "resolved").when(spec.startswith("."), "candidate").otherwise("external"))


def merge_declarations(declarations: DataFrame, semantic: DataFrame, exports: DataFrame) -> DataFrame:
    """Structural declarations without those a semantic span of the same path and name overlaps; exported by name or by an enclosing export span."""
    s = semantic.select("path", "name", F.col("start").alias("s2"), F.col("end").alias("e2"))
    d = declarations.alias("d")
    kept = d.join(s.alias("s"), (F.col("d.path") == F.col("s.path")) & (F.col("d.name") == F.col("s.name")) & (F.col("d.start") < F.col("s.e2")) & (F.col("s.s2") < F.col("d.end")), "left_anti")
    names = exports.filter(F.col("name").isNotNull()).select("path", "name").distinct().withColumn("by_name", F.lit(True))
    spans = exports.filter(F.col("start").isNotNull()).select(F.col("path").alias("p2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    inside = kept.join(spans, (F.col("path") == F.col("p2")) & (F.col("s2") <= F.col("start")) & (F.col("end") <= F.col("e2")), "left_semi").select("path", "name", "start", "end").distinct().withColumn("inside", F.lit(True))
    out = kept.join(names, ["path", "name"], "left").join(inside, ["path", "name", "start", "end"], "left")
    return out.withColumn("exported", F.coalesce("by_name", F.lit(False)) | F.coalesce("inside", F.lit(False))).drop("by_name", "inside")


def direct_dependencies(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """One row a (path, package): the import's first segment against the project's declared names, both normalised."""
    seg = F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/.]+)", 1)
    i = imports.withColumn("key", normalize_package(seg)).select("project_id", "path", "key")
    d = declared.select("project_id", normalize_package(F.col("package_name")).alias("key"), "package_name")
    return i.join(d, ["project_id", "key"]).groupBy("path", "package_name").agg(F.min("project_id").alias("project_id"))


def resolve_specifiers(dependencies: DataFrame, catalog: DataFrame) -> DataFrame:
    """`catalog:` and `catalog:name` take the version of the table; other specifiers stay."""
    ref = F.col("specifier").startswith("catalog:")
    name = F.when(ref, F.when(F.col("specifier") == "catalog:", "default").otherwise(F.substring("specifier", 9, 200)))
    c = catalog.select(F.col("catalog").alias("c2"), F.col("package_name").alias("p2"), "version")
    j = dependencies.withColumn("__c", name)
    out = j.join(c, (F.col("__c") == F.col("c2")) & (F.col("package_name") == F.col("p2")), "left")
    return out.select(*dependencies.columns, F.when(ref, F.col("version")).otherwise(F.col("specifier")).alias("resolved"))


def resolve_as_of(references: DataFrame, declarations: DataFrame, few: int = 256) -> DataFrame:
    """Identities a reference at a statement sees: declared before it and neither dropped nor renamed since.

    Declarations (name, identity, statement, operation add or remove) become intervals of validity by `lead`. A name with `few`
    intervals at most is joined by the name. Intervals of other names are cut into the blocks of a binary segment tree over
    statements, two a level at most, and references meet them by (name, level, block): a point lies in one block of an interval
    that holds it and in none of another, so only pairs that are seen are made, however often a name is declared.
    No match is unresolved, one resolved, several ambiguous.
    """
    nxt = F.lead("statement").over(W.partitionBy("name", "identity").orderBy("statement"))
    spans = declarations.withColumn("until", nxt).filter(F.col("operation") == "add").select(F.col("name").alias("n2"), "identity", F.col("statement").cast("long").alias("since"), F.col("until").cast("long").alias("until"))
    refs = references.select("ref_id", "name", "statement")
    end = F.lit(refs.agg(F.max("statement")).first()[0]).cast("long")
    # the interval's first statement, and the one after its last
    spans = spans.withColumns({"lo": F.col("since") + 1, "hi": F.coalesce(F.least("until", end), end) + 1}).filter("lo < hi")
    often = materialize(spans.groupBy("n2").agg(F.count("*").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("long")).filter(F.col("n") > few).select("n2", "long"))
    longest = often.agg(F.max("long")).first()[0]
    if longest is None:
        cut, asked = spans.withColumns({"level": F.lit(-1), "block": F.lit(0).cast("long")}), refs.withColumns({"level": F.lit(-1), "block": F.lit(0).cast("long")})
    else:
        hot, top = often.select("n2", F.lit(True).alias("hot")), longest.bit_length()
        first, past = "shiftright(lo + shiftleft(1L, k) - 1, k)", "shiftright(hi, k)"
        blocks = f"flatten(transform(sequence(0, {top}), k -> filter(array(IF({first} < {past} AND {first} % 2 != 0, struct(k AS level, {first} AS block), NULL), IF({first} < {past} AND {past} % 2 != 0, struct(k AS level, {past} - 1 AS block), NULL)), x -> x IS NOT NULL)))"
        cut = spans.join(hot, "n2", "left").withColumn("x", F.explode(F.expr(f"IF(hot, {blocks}, array(struct(-1 AS level, 0L AS block)))"))).select("n2", "identity", "lo", "hi", "x.level", "x.block")
        asked = refs.join(hot.withColumnRenamed("n2", "name"), "name", "left").withColumn("x", F.explode(F.expr(f"IF(hot, transform(sequence(0, {top}), k -> struct(k AS level, shiftright(cast(statement AS long), k) AS block)), array(struct(-1 AS level, 0L AS block)))"))).select("ref_id", "name", "statement", "x.level", "x.block")
    met = (F.col("name") == F.col("n2")) & (asked["level"] == cut["level"]) & (asked["block"] == cut["block"]) & (F.col("lo") <= F.col("statement")) & (F.col("statement") < F.col("hi"))
    seen = asked.join(cut, met).select("ref_id", "name", "statement", "identity")
    every = seen.unionByName(refs.withColumn("identity", F.lit(None).cast(seen.schema["identity"].dataType)))
    out = every.groupBy("ref_id", "name", "statement").agg(F.array_sort(F.collect_set("identity")).alias("identities"))
    n = F.size("identities")
    return out.withColumn("state", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous"))


def location_rows(symbols: DataFrame) -> DataFrame:
    """One row for each definition, reference and implementation of a symbol."""
    kinds = ("definitions", "references", "implementations")
    every = F.concat(*[F.transform(F.col(k), _tag(k[:-1])) for k in kinds])
    return symbols.select("symbol_id", F.explode(every).alias("x")).select("symbol_id", "x.*")


def _tag(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["path"].alias("path"), x["line"].alias("line"))


def call_rows(symbols: DataFrame) -> DataFrame:
    """Calls as edges (caller, callee, line)."""
    return symbols.select(F.col("symbol_id").alias("caller"), F.explode("calls").alias("c")).select("caller", F.col("c.target").alias("callee"), F.col("c.line").alias("line"))


def fragment_rows(fragments: DataFrame) -> DataFrame:
    """Fragments with 1-based positions; candidate projections have status candidate and confidence 0.6."""
    cand = F.col("projection") == "candidate"
    return fragments.select("path", "projection", (F.col("row") + 1).alias("line"), (F.col("col") + 1).alias("column"), F.when(cand, "candidate").otherwise("resolved").alias("status"), F.when(cand, 0.6).otherwise(1.0).alias("confidence"))


__all__ = ["ancestors", "call_rows", "direct_dependencies", "fragment_rows", "location_rows", "merge_declarations", "resolve_as_of", "resolve_imports", "resolve_specifiers"]
