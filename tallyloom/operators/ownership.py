"""Owners, rules, bindings and policies over paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.paths import ancestors, glob_regex, glob_root, plain_glob_regex

#: Rules without a folder of their own that meet all paths by one broadcast.
LOOSE = 10_000


def owner_by_prefix(paths: DataFrame, owners: DataFrame, kind: str | None = None) -> DataFrame:
    """The owner with the longest root at a `/`; the empty root owns what nothing else does. An equi-join on each folder above a path."""
    o = owners if kind is None else owners.filter(F.col("kind") == kind)
    own = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(o.select("root", "owner"), "root")
    best = own.groupBy("path").agg(F.max_by("owner", F.struct(F.length("root"), "owner")).alias("owner"))
    return paths.join(best, "path", "left")


def packages_for_path(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """Every package that contains a path."""
    return paths.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(packages.select("root", "name"), "root").select("path", "name").distinct()


def apply_tags(packages: DataFrame, rules: DataFrame) -> DataFrame:
    """All tags of the rules that match a package's name, sorted."""
    tagged = packages.join(F.broadcast(rules), F.regexp_like("name", F.col("regex")))
    return tagged.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def rule_table(spark, rules: list[tuple[int, str, list[str]]], plain: bool = False) -> DataFrame:
    """(line, pattern, owners, regex) of a rule file; rule files are short."""
    to = plain_glob_regex if plain else glob_regex
    return spark.createDataFrame([(n, p, o, to(p)) for n, p, o in rules], "line int, pattern string, owners array<string>, regex string")


def meet_rules(paths: DataFrame, rules: DataFrame, pattern: str, loose: int = LOOSE) -> DataFrame:
    """`path` with the columns of each rule whose `regex` it matches.

    A rule with a folder (`glob_root` of its pattern) meets the paths below it by an equi-join on the folders above each
    path. Rules without one must be tried on every path: they are counted and broadcast, `loose` or so at a time.
    """
    p, rooted = paths.select("path").distinct(), rules.withColumn("__root", glob_root(F.col(pattern)))
    below = p.select("path", F.explode(ancestors(F.col("path"))).alias("__root")).join(rooted.filter("__root <> ''"), "__root")
    out = below.filter(F.regexp_like("path", F.col("regex"))).select("path", *rules.columns)
    rest = rooted.filter("__root = '' OR __root IS NULL").drop("__root")
    parts = -(-rest.count() // loose)
    for k in range(parts):
        own = rest if parts == 1 else rest.filter(F.pmod(F.xxhash64("regex"), F.lit(parts)) == k)
        out = out.unionByName(p.join(F.broadcast(own), F.regexp_like("path", F.col("regex"))).select("path", *rules.columns))
    return out


def codeowners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The last rule that matches wins; conflict when matching rules name different owners."""
    return meet_rules(paths, rules, "pattern").groupBy("path").agg(F.max_by("owners", "line").alias("owners"), F.max("line").alias("line"), (F.size(F.collect_set(F.array_sort("owners"))) > 1).alias("conflict"))


def files_for_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, rule_id): equal language, any include pattern (or none given), no ignore pattern. Patterns are regex arrays."""
    j = files.select("path", "language").join(F.broadcast(rules), "language")
    inc = (F.size("include") == 0) | F.exists("include", lambda r: F.regexp_like("path", r))
    return j.filter(inc & ~F.exists("ignore", lambda r: F.regexp_like("path", r))).select("path", "rule_id")


def resolve_targets(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """(target, path, state): a literal resolves to itself, a wildcard (with regex) to all matches; else missing."""
    p = paths.select("path").distinct()
    literal = targets.filter(F.col("regex").isNull()).select("target").join(p, F.col("target") == F.col("path"))
    wild = meet_rules(p, targets.filter(F.col("regex").isNotNull()).select("target", "regex"), "target").select("target", "path")
    found = literal.unionByName(wild)
    return targets.select("target").join(found, "target", "left").withColumn("state", F.when(F.col("path").isNull(), "missing").otherwise("resolved"))


def consolidate_policies(claims: DataFrame) -> DataFrame:
    """A row a policy: winner by score, then path, then line; titles, scopes and roles merged."""
    first = F.min_by(F.struct("title", "path", "line"), F.struct((-F.col("score")).alias("s"), "path", "line"))
    merged = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("title", "scope", "role")]
    return claims.groupBy("policy_id").agg(first.alias("w"), F.max("score").alias("score"), *merged).select("policy_id", F.col("w.title").alias("title"), F.col("w.path").alias("path"), F.col("w.line").alias("line"), "score", "titles", "scopes", "roles")


def resolve_owners(claims: DataFrame) -> DataFrame:
    """Each claim's state: the lowest tier wins; in it, different owner sets are conflicting and nobody wins; lower tiers that disagree are shadowed, others redundant."""
    c = claims.withColumn("set", F.array_sort("owners"))
    top = c.groupBy("target").agg(F.min("tier").alias("best"))
    sets = c.join(top, "target").filter(F.col("tier") == F.col("best")).groupBy("target").agg(F.collect_set("set").alias("sets"))
    j = c.join(top, "target").join(sets, "target")
    clash = F.size("sets") > 1
    state = F.when((F.col("tier") == F.col("best")) & clash, "conflicting").when(F.col("tier") == F.col("best"), "winner").when(~clash & (F.col("set") == F.col("sets")[0]), "redundant").otherwise("shadowed")
    return j.select(*claims.columns, state.alias("state"))


def resolve_bindings(bindings: DataFrame) -> DataFrame:
    """Per (policy, role) with two declaration sites or more: equal target sets are redundant (the first site stays), else all conflict."""
    key = ["policy_id", "role_label"]
    sites = bindings.groupBy(*key, "source_path", "source_line").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    groups = sites.groupBy(*key).agg(F.count("*").alias("sites"), F.size(F.collect_set("targets")).alias("sets"), F.min(F.struct("source_path", "source_line")).alias("first"))
    j = bindings.alias("b").join(groups.alias("g"), [F.col(f"b.{k}").eqNullSafe(F.col(f"g.{k}")) for k in key])
    here = F.struct("source_path", "source_line") == F.col("first")
    state = F.when(F.col("sites") < 2, "single").when(F.col("sets") > 1, "conflicting").when(here, "winner").otherwise("redundant")
    return j.select("b.*", state.alias("state"))


def tiered(matches: DataFrame, query: str = "query") -> DataFrame:
    """Of the matches of each query only those of its lowest tier."""
    best = matches.groupBy(F.col(query).alias("__q")).agg(F.min("tier").alias("__t"))
    return matches.join(best, (F.col(query) == F.col("__q")) & (F.col("tier") == F.col("__t"))).drop("__q", "__t")


def select_policies(policies: DataFrame, queries: DataFrame, alias: Column) -> DataFrame:
    """Exact id; else path; else the normalised alias. Three equi-joins and the lowest tier that hit."""
    q = queries.select("query")
    by = [policies.select("policy_id", F.col("policy_id").alias("query"), F.lit(1).alias("tier")), policies.select("policy_id", F.col("path").alias("query"), F.lit(2).alias("tier")), policies.select("policy_id", alias.alias("query"), F.lit(3).alias("tier"))]
    every = by[0].unionByName(by[1]).unionByName(by[2])
    return tiered(q.join(every, "query"))
