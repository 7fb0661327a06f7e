"""Operators on literal rows: the properties that matter, with shuffled input where order must not."""

import hashlib
import random

from pyspark.sql import functions as F

from tallyloom.operators import changes as X
from tallyloom.operators import graph as G
from tallyloom.operators import ownership as O
from tallyloom.operators import records as R
from tallyloom.operators import resolution as N
from tallyloom.operators import search as S
from tallyloom.operators import telemetry as T

CALLS = [
    (1, "alpha", "tools/call", "t1", 10.0, True, None, "2026-01-01T00:00:03Z"), (2, "alpha", "tools/call", "t1", 30.0, False, "AuthFailed", "2026-01-01T00:00:05Z"), (3, "alpha", "tools/call", "t2", 20.0, True, None, "2026-01-01T00:00:04Z"),
    (4, "beta", "tools/call", "t3", 5.0, False, "Timeout", "2026-01-01T00:00:01Z"), (5, "beta", "tools/call", "t3", 7.0, True, None, "2026-01-01T00:00:02Z"), (6, "alpha", "tools/list", "l", 999.0, False, "x", "2026-01-01T00:00:09Z"),
]
CALL = "seq long, backend string, operation string, tool_name string, duration_ms double, ok boolean, error_type string, at string"


def test_backend_summary_by_event_time_with_silent_backends(spark):
    df = spark.createDataFrame(CALLS, CALL)
    reg = spark.createDataFrame([("alpha",), ("quiet",)], "backend string")
    for d in (df, df.orderBy(F.rand(3)).repartition(8), df.coalesce(1)):
        a, b, q = T.backend_summary(d, reg).collect()
        assert (a.calls, a.errors, a.p50_ms, a.p95_ms, a.last_error, a.auth_state) == (3, 1, 20.0, 30.0, "AuthFailed", "auth_error")
        assert (b.calls, b.errors, b.last_error, b.auth_state) == (2, 1, None, "ok")
        assert (q.backend, q.calls, q.p50_ms, q.auth_state) == ("quiet", 0, None, None)


def test_totals_do_not_count_cached_and_reasoning_tokens(spark):
    df = spark.sql("""SELECT 'f' AS source, parse_json('{"usage":{"input_tokens":1000,"output_tokens":100,"cached_input_tokens":900,"reasoning_output_tokens":50},"tool_name":"rg"}') AS record
      UNION ALL SELECT 'f', parse_json('{"usage":{"prompt_tokens":"x"},"error":"e"}')""")
    a, b = T.normalize_usage(df).orderBy(F.desc("input_tokens")).collect()
    assert (a.total_tokens, a.cached_input_tokens, a.reasoning_tokens, a.category, a.status) == (1100, 900, 50, "rg", "completed")
    assert (b.total_tokens, b.status, b.category) == (0, "failed", "model")


def test_exact_repeats_pair_with_the_first(spark):
    e = spark.createDataFrame([(1, "a", "s", "c", 5), (2, "b", "s", "c", 6), (3, "c", "s", "c", 7), (4, "d", "t", "c", 8)], "seq int, id string, signature string, category string, total_tokens int")
    assert sorted((r.first_id, r.later_id) for r in T.exact_repeats(e).collect()) == [("a", "b"), ("a", "c")]


def test_health_history_carries_the_last_good_digest(spark):
    p = spark.createDataFrame([("m", 1, False, "d1", "v"), ("m", 2, True, "d2", "v2"), ("m", 3, False, "d3", "v")], "target string, seq int, ok boolean, digest string, version string")
    assert [(r.state, r.digest) for r in T.health_history(p).orderBy("seq").collect()] == [("down", None), ("ok", "d2"), ("degraded", "d2")]


def test_dedupe_first_and_last(spark):
    d = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "c")], "seq int, id string, v string").repartition(5)
    assert {(r.id, r.v) for r in T.dedupe(d, "id").collect()} == {("x", "a"), ("y", "c")}
    assert {(r.id, r.v) for r in T.dedupe(d, "id", keep="last").collect()} == {("x", "b"), ("y", "c")}


def chain(n):
    rows, prev = [], None
    for i in range(1, n + 1):
        h = hashlib.sha256(f"p{i}".encode()).hexdigest()
        e = hashlib.sha256(f"{prev or ''}|{h}|{i}".encode()).hexdigest()
        rows.append((i, f"p{i}", h, prev, e))
        prev = e
    return rows


def test_one_changed_byte_breaks_the_chain(spark):
    schema = "sequence long, payload string, payload_hash string, previous_event_hash string, event_hash string"
    good = chain(20)
    assert X.verify_chain(spark.createDataFrame(good, schema)).collect() == []
    bad = [r if r[0] != 7 else (7, "p7x", *r[2:]) for r in good]
    assert [(r.sequence, r.payload_ok) for r in X.verify_chain(spark.createDataFrame(bad, schema)).collect()] == [(7, False)]
    gap = [r for r in good if r[0] != 9]
    assert [(r.sequence, r.link_ok) for r in X.verify_chain(spark.createDataFrame(gap, schema)).collect()] == [(10, False)]


def test_fingerprint_is_free_of_order(spark):
    f = spark.createDataFrame([(f"p{i}", f"d{i}") for i in range(50)], "path string, digest string")
    a, b = X.fingerprint(f).first(), X.fingerprint(f.orderBy(F.rand(1)).repartition(8)).first()
    assert a == b != X.fingerprint(f.limit(49)).first()


def test_budget_keeps_a_prefix_and_one_source(spark):
    i = spark.createDataFrame([("p", 0, 1, 100), ("p", 0, 2, 100), ("p", 1, 1, 100), ("q", 0, 1, 9999)], "packet string, section_rank int, rank int, bytes int")
    assert sorted((r.packet, r.section_rank, r["rank"]) for r in X.fit_budget(i, 250, 1000).collect()) == [("p", 0, 1), ("p", 0, 2), ("q", 0, 1)]


def test_star_edges_are_linear(spark):
    r = spark.createDataFrame([(f"k{i:03}", ["t", f"u{i}"]) for i in range(257)], "row_key string, tokens array<string>")
    e = X.token_star_edges(r).collect()
    assert len(e) == 256 and {x.anchor for x in e} == {"k000"}


def test_offsets_have_one_based_lines_and_columns(spark):
    c = spark.createDataFrame([("f", "c1", 0, 6, 1, "ab\ncdé"[:6]), ("f", "c2", 7, 10, 3, "xyz")], "path string, chunk_id string, byte_start long, byte_end long, start_line int, text string")
    o = spark.createDataFrame([("f", 0), ("f", 3), ("f", 4), ("f", 8)], "path string, byte_offset long")
    assert [(r.byte_offset, r.chunk_id, r.line, r.column) for r in X.locate_offsets(o, c).orderBy("byte_offset").collect()] == [(0, "c1", 1, 1), (3, "c1", 2, 1), (4, "c1", 2, 2), (8, "c2", 3, 2)]


REC = "id string, kind string, origin_platform string, native_id string, workspace_key string, parent_id string, state string, sensitivity string, payload_hash string, expires_at_ms long, revision long, tombstoned_at_ms long"


def test_upsert_is_idempotent(spark):
    store = spark.createDataFrame([("1", "k", "p", "n1", "w", None, "open", "low", "h1", None, 1, None), ("2", "k", "p", "n2", "w", None, "open", "low", "h2", None, 1, 5)], REC)
    rows = [("9", "k", "p", "n1", "w", None, "open", "low", "h9", None, 1, None, 1), ("9", "k", "p", "n1", "w", None, "done", "low", "h1b", None, 1, None, 2), ("8", "k", "p", "n2", "w", None, "open", "low", "h2", None, 1, None, 1), ("7", "k", None, "n3", "w", None, "open", "low", "h3", None, 1, None, 1)]
    batch = spark.createDataFrame(rows, REC + ", seq long")
    out = {r.native_id: r for r in R.upsert_records(store, batch).collect()}
    assert (out["n1"].outcome, out["n1"].state, out["n1"].revision, out["n1"].id) == ("update", "done", 2, "1")
    assert (out["n2"].outcome, out["n2"].tombstoned_at_ms) == ("reject", 5) and out["n3"].outcome == "insert"
    again = {r.native_id: r for r in R.upsert_records(R.upsert_records(store, batch).drop("outcome"), batch).collect()}
    assert (again["n1"].outcome, again["n1"].revision, again["n3"].outcome) == ("replay", 2, "replay")
    assert {r.native_id: r.outcome for r in R.upsert_records(store, batch, revive=True).collect()}["n2"] == "update"


def test_claims_refuse_illegal_steps(spark):
    e = spark.createDataFrame([("c", 1, "active"), ("c", 2, "validated"), ("c", 3, "active"), ("c", 4, "superseded"), ("d", 1, "rejected"), ("d", 2, "validated")], "claim_id string, seq int, to_state string")
    assert {(r.claim_id, r.state, r.refused) for r in R.fold_claims(e).collect()} == {("c", "superseded", 1), ("d", "rejected", 1)}


def test_retention_takes_children_first(spark):
    r = spark.createDataFrame([("a", "k", "w", None, None, 10, None, 1), ("b", "k", "w", "a", None, 999, None, 1), ("c", "k", "v", None, None, 10, None, 1)], "id string, kind string, workspace_key string, parent_id string, expires_at_ms long, updated_at_ms long, tombstoned_at_ms long, revision long")
    p = spark.createDataFrame([("w", None, 100, True)], "workspace_key string, kind string, retain_for_ms long, enabled boolean")
    assert [x.id for x in R.apply_retention(r, p, 1000, limit=1).collect()] == ["b"]
    assert {x.id for x in R.apply_retention(r, p, 1000).collect()} == {"a", "b"}


EDGE = "source string, target string"


def test_impact_paths_and_limits(spark):
    e = spark.createDataFrame([("entry", "left"), ("entry", "right"), ("left", "core"), ("right", "core"), ("core", "entry")], EDGE)
    seeds = spark.createDataFrame([("core",)], "node string")
    got = [(r.node, r.depth, r.path) for r in G.impact(e, seeds).orderBy("depth", "path").collect()]
    assert got == [("left", 1, ["core", "left"]), ("right", 1, ["core", "right"]), ("entry", 2, ["core", "left", "entry"])]
    assert G.impact(e, seeds, max_rows=2).count() == 2 and G.impact(e, seeds, max_depth=1).count() == 2


def test_impact_keeps_first_paths_of_a_random_graph(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(130)})
    level, seen = [(("23",), 23), (("7",), 7)], {7, 23}
    depth, listed = 0, []
    while level:
        depth += 1
        best = {}
        for path, node in level:
            for a, b in edges:
                if b == node and a not in seen:
                    best[a] = min(best.get(a, (*path, str(a))), (*path, str(a)))
        level = sorted((p, n) for n, p in best.items())
        seen |= set(best)
        listed += [(n, depth, list(p)) for p, n in level]
    e, seeds = spark.createDataFrame(edges, "source int, target int"), spark.createDataFrame([(7,), (23,), (7,)], "node int")
    got = [(r.node, r.depth, r.path) for r in G.impact(e, seeds, max_rows=10_000).collect()]
    assert got == listed and len(listed) > 20
    assert [(r.node, r.depth, r.path) for r in G.impact(e, seeds, max_rows=11).collect()] == listed[:11]
    sizes, most = [len("/".join(p)) for _, _, p in listed], 100
    n = sum(sum(sizes[: i + 1]) <= most for i in range(len(sizes)))
    assert {r.node for r in G.impact(e, seeds, max_bytes=most).collect()} == {x[0] for x in listed[:n]}
    assert G.impact(e, seeds.limit(0)).count() == 0 and G.impact(e.limit(0), seeds).count() == 0


def test_cycles_are_the_same_for_reversed_input(spark):
    rows = [("a", "b"), ("b", "a"), ("b", "c"), ("x", "y"), ("z", "z"), ("p", "q"), ("q", "r"), ("r", "p"), ("r", "a"), ("y", "x2")]
    one = {(r.cycle_id, tuple(r.members)) for r in G.cycles(spark.createDataFrame(rows, EDGE)).collect()}
    two = {(r.cycle_id, tuple(r.members)) for r in G.cycles(spark.createDataFrame([(b, a) for a, b in rows[::-1]], EDGE)).collect()}
    assert one == two and {m for _, m in one} == {("a", "b"), ("z",), ("p", "q", "r")}


def test_attribution_to_the_nearest_root(spark):
    p = spark.createDataFrame([(1, 0, 1.0), (2, 1, 90.0), (3, 2, 95.0), (4, 3, 1.0), (5, 9, 99.0), (6, 6, 1.0)], "pid long, parent_pid long, cpu_percent double")
    s = spark.createDataFrame([(1, "s1"), (3, "s3")], "root_pid long, session_id string")
    got = {r.pid: (r.session_id, r.method, r.cpu_alert) for r in G.attribute_processes(p, s).collect()}
    assert got == {1: ("s1", "registered", False), 2: ("s1", "ancestor", True), 3: ("s3", "registered", True), 4: ("s3", "ancestor", False), 5: (None, "none", False), 6: (None, "none", False)}


def test_beam_reaches_neighbours_before_leftover_hits(spark):
    hits = spark.createDataFrame([(f"h{i}", float(10 - i)) for i in range(10)], "row_key string, score double")
    e = spark.createDataFrame([("h0", "owner"), ("owner", "far")], EDGE)
    got = [(r.row_key, r.distance) for r in G.expand_relations(hits, e, 2, 9).collect()]
    assert got == [("h0", 0), ("h1", 0), ("h2", 0), ("owner", 1), ("far", 2), ("h3", None), ("h4", None), ("h5", None), ("h6", None)]


def test_owner_tiers(spark):
    c = spark.createDataFrame([("t", ["a"], 1), ("t", ["b"], 2), ("t", ["a"], 3), ("u", ["a"], 1), ("u", ["b"], 1), ("u", ["a"], 2)], "target string, owners array<string>, tier int")
    got = sorted((r.target, r.tier, r.owners[0], r.state) for r in O.resolve_owners(c).collect())
    assert got == [("t", 1, "a", "winner"), ("t", 2, "b", "shadowed"), ("t", 3, "a", "redundant"), ("u", 1, "a", "conflicting"), ("u", 1, "b", "conflicting"), ("u", 2, "a", "shadowed")]


def test_longest_root_and_last_rule_win(spark):
    p = spark.createDataFrame([("apps/web/x.ts",), ("apps/website/x.ts",), ("README",)], "path string")
    o = spark.createDataFrame([("", "root"), ("apps", "apps"), ("apps/web", "web")], "root string, owner string")
    assert {r.path: r.owner for r in O.owner_by_prefix(p, o).collect()} == {"apps/web/x.ts": "web", "apps/website/x.ts": "apps", "README": "root"}
    rules = O.rule_table(spark, [(1, "*", ["all"]), (2, "apps/", ["apps"]), (3, "*.ts", ["ts"])])
    assert {r.path: (r.owners, r.conflict) for r in O.codeowners(p, rules).collect()}["apps/web/x.ts"] == (["ts"], True)


def test_as_of_resolution(spark):
    d = spark.createDataFrame([("t", "t1", 1, "add"), ("t", "t1", 5, "remove"), ("t", "t2", 7, "add"), ("t", "t3", 8, "add")], "name string, identity string, statement int, operation string")
    r = spark.createDataFrame([(1, "t", 1), (2, "t", 3), (3, "t", 6), (4, "t", 8), (5, "t", 9)], "ref_id int, name string, statement int")
    assert [(x.ref_id, x.state) for x in N.resolve_as_of(r, d).orderBy("ref_id").collect()] == [(1, "unresolved"), (2, "resolved"), (3, "unresolved"), (4, "resolved"), (5, "ambiguous")]


def test_consumers_by_one_automaton(spark):
    """Symbols inside one another, overlaps, parts of the symbol table, and the plan of many symbols."""
    texts = [("a", "xx foobar\nbar foo\nfoob"), ("b", "no\n\nobarfoo é😀bar"), ("c", None), ("d", "foobar"), ("e", "")]
    files = spark.createDataFrame(texts, "path string, text string")
    symbols = spark.createDataFrame([("foo",), ("foobar",), ("bar",), ("oba",), ("o",), (None,), ("foo",), ("😀ba",)], "symbol string")
    want = {(p, s, t[: t.index(s)].count("\n") + 1) for p, t in texts if t and p != "d" for s in ("foo", "foobar", "bar", "oba", "😀ba") if s in t}
    sources = files.filter("path = 'd'")
    for part in (2, 100):
        assert {tuple(r) for r in X.text_consumers(files, symbols, sources, part=part).collect()} == want
    many = spark.range(10_000).select(F.concat(F.lit("word"), F.col("id")).alias("symbol"))
    out = X.text_consumers(files.unionByName(spark.createDataFrame([("w", "a word77 b")], files.schema)), many, sources)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert {(r.path, r.symbol) for r in out.collect()} == {("w", "word7"), ("w", "word77")}


def test_rules_with_a_folder_meet_paths_by_equi_join(spark):
    import random
    import re

    from tallyloom.functions.paths import glob_regex

    rng = random.Random(4)
    patterns = ["apps/web/**", "/apps/*", "apps/web/x.ts", "*.ts", "docs/", "./lib/a?/b", "**/web/*", "lib/**/b", "apps/web", "x", "a[bc]/d/e", ""]
    paths = ["/".join(rng.choice(["apps", "web", "x.ts", "docs", "lib", "ab", "b", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(200)] + ["apps/web/a", "apps/web", "apps/web/x.ts", "lib/ab/b", "lib/b"]
    rules = O.rule_table(spark, [(i, p, ["o"]) for i, p in enumerate(patterns)])
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    want = {(p, i) for p in paths for i, g in enumerate(patterns) if re.search(glob_regex(g), p)}
    for loose in (1, 100):
        assert {(r.path, r.line) for r in O.meet_rules(df, rules, "pattern", loose).collect()} == want
    rooted = O.meet_rules(df, rules.filter("pattern LIKE 'apps/%'"), "pattern")
    assert rooted.count() > 0 and "NestedLoop" not in rooted._jdf.queryExecution().executedPlan().toString()


def test_contradictions_without_a_cap(spark):
    rows = [(i, "w", "s", "t", "u", f"c{i % 3}", "active" if i % 2 else "proposed") for i in range(60)]
    claims = spark.createDataFrame(rows, "id long, workspace_id string, scope string, claim_type string, subject string, content string, state string")
    want = {(a[0], b[0]) for a in rows for b in rows if b[6] == "active" and a[5] != b[5]}
    got = R.contradictions(claims, most=None).collect()
    assert {(r.id, r.other_id) for r in got} == want and len(got) == len(want)


def test_as_of_by_blocks_equals_all_pairs(spark):
    """Hot and rare names, statements below zero, open and empty intervals."""
    import random

    rng = random.Random(8)
    d = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 30), s, rng.choice(["add", "add", "remove"])) for s in rng.sample(range(-300, 900), 500)]
    r = [(i, rng.choice(["a", "b", "z", None]), rng.randint(-400, 1000)) for i in range(300)]
    want = {}
    for i, name, at in r:
        own = {}
        for n, who, s, op in sorted(d, key=lambda x: x[2]):
            if n is not None and n == name and s < at:
                own[who] = op
        want[i] = sorted(k for k, op in own.items() if op == "add")
    dd, rr = spark.createDataFrame(d, "name string, identity int, statement int, operation string"), spark.createDataFrame(r, "ref_id int, name string, statement int")
    for few in (0, 60, 10000):
        assert {x.ref_id: x.identities for x in N.resolve_as_of(rr, dd, few).collect()} == want
    assert N.resolve_as_of(rr.limit(0), dd).collect() == [] and N.resolve_as_of(rr, dd.limit(0)).filter("state <> 'unresolved'").count() == 0


def test_as_of_of_one_hot_name_makes_no_pairs(spark):
    """10^5 references to a name with 10^5 declarations, each of which ends when the next begins."""
    n = 100_000
    d = spark.range(2 * n).select(F.lit("hot").alias("name"), F.floor(F.col("id") / 2).alias("identity"), (F.col("id") + F.col("id") % 2).alias("statement"), F.when(F.col("id") % 2 == 0, "add").otherwise("remove").alias("operation"))
    r = spark.range(n).select(F.col("id").alias("ref_id"), F.lit("hot").alias("name"), (2 * F.col("id") + 1).alias("statement"))
    assert N.resolve_as_of(r, d).filter((F.col("state") == "resolved") & (F.col("identities")[0] == F.col("ref_id"))).count() == n


def test_module_resolution_takes_the_first_that_exists(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/a/index.ts",), ("lib/pkg/mod.py",), ("packages/ui/button.tsx",)], "path string")
    i = spark.createDataFrame([("src/x", "../a"), ("src", "./none"), ("any", "@ui/kit/button"), ("any", "lib.pkg.mod"), ("any", "react")], "directory string, specifier string")
    pk = spark.createDataFrame([("@ui/kit", "packages/ui")], "name string, root string")
    got = {r.specifier: (r.resolved_path, r.outcome) for r in N.resolve_imports(i, files, packages=pk).collect()}
    assert got == {"../a": ("src/a.ts", "resolved"), "./none": (None, "candidate"), "@ui/kit/button": ("packages/ui/button.tsx", "resolved"), "lib.pkg.mod": ("lib/pkg/mod.py", "resolved"), "react": (None, "external")}


def test_search_modes_and_boost(spark):
    d = spark.createDataFrame([("a", "chunk", "src/a", "alpha", "beta gamma"), ("b", "file", "src/b", "beta", "alphabet"), ("c", "chunk", "docs/c", "x", "gamma")], "fact_key string, kind string, path string, title string, body string")
    keys = lambda df: [r.fact_key for r in df.collect()]
    assert set(keys(S.search(d, "beta alph"))) == {"a", "b"} and set(keys(S.search(d, "beta alpha ", mode="any"))) == {"a", "b"}
    assert keys(S.search(d, "gamma", prefixes=["docs"])) == ["c"] and keys(S.search(d, "...")) == []
    assert keys(S.linear_search(d, "gamma")) == ["a", "c"] and S.linear_search(d, "beta").first().fact_key == "b"


def test_drift_gives_a_row_an_id_and_the_new_watermark(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 7), ("b", 4, 3), ("c", 5, 8)], "scope string, id long, updated_at_ms long")
    got = R.drifted(rows, spark.createDataFrame([("a", 6), ("b", 6), ("d", 6)], "scope string, watermark long")).collect()
    assert sorted(((r.scope, r.id, r.watermark) for r in got), key=str) == [("a", 2, 9), ("a", 3, 9), ("b", None, 6)]


def test_contradictions_collect_few_ids_of_a_common_content(spark):
    rows = [(i, "w", "s", "t", "u", "x", "active") for i in range(100)] + [(200, "w", "s", "t", "u", "y", "active")]
    claims = spark.createDataFrame(rows, "id long, workspace_id string, scope string, claim_type string, subject string, content string, state string")
    got = R._active_contents(claims, ["workspace_id", "scope", "claim_type", "subject"], 8).collect()
    assert sorted((r.content, r.low, r.ids) for r in got) == [("x", 0, list(range(8))), ("y", 200, [200])]
    pairs = {(r.id, r.other_id) for r in R.contradictions(claims).collect()}
    assert pairs == {(i, 200) for i in range(100)} | {(200, i) for i in range(8)}
