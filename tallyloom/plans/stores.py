"""Queries over snapshots, pages, records and search, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions.identity import identity_tokens
from tallyloom.functions.scratch import scratch_dir
from tallyloom.operators import changes as X
from tallyloom.operators import records as R
from tallyloom.operators import search as S
from tallyloom.operators.hashtree import HashTree
from tallyloom.operators.textindex import TextIndex
from tallyloom.plans.bindings import CLAIMS, FILES, OLD_NEW, PAGES, claims, files, pages, table, turns

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {OLD_NEW}, j AS (SELECT coalesce(o.path, n.path) AS path, sha256(o.text) AS previous, sha256(n.text) AS current FROM old o FULL JOIN new n ON o.path = n.path),
k AS (SELECT *, CASE WHEN previous IS NULL THEN 'added' WHEN current IS NULL THEN 'deleted' ELSE 'changed' END AS operation FROM j WHERE previous IS DISTINCT FROM current)
SELECT path, operation, previous, current, substr(sha256('g2:' || path || ':' || operation || ':' || coalesce(previous, '') || ':' || coalesce(current, '')), 1, 24) AS change_id FROM k""")
def x1_diff_snapshots(spark, sf_dir):
    return X.diff_snapshots(files(spark, sf_dir, "old"), files(spark, sf_dir, "new"), "g2")


@query(f"""WITH {OLD_NEW} SELECT path, sha256(text) AS digest FROM new""")
def x2_apply_changes(spark, sf_dir):
    old, new = files(spark, sf_dir, "old").select("path", "digest"), files(spark, sf_dir, "new").select("path", "digest")
    return X.apply_changes(old, new, X.diff_snapshots(old, new, "g2"))


@query(f"""WITH {FILES}, i AS (SELECT lang, substr(md5(path), 1, 2) AS k, sha256(string_agg(path || chr(0) || digest, chr(10) ORDER BY path || chr(0) || digest)) AS x FROM files GROUP BY ALL)
SELECT lang, sha256(string_agg(x, chr(10) ORDER BY x)) AS fingerprint FROM i GROUP BY lang""")
def a15_fingerprint(spark, sf_dir):
    return X.fingerprint(files(spark, sf_dir), ["lang"])


def _level(source: str, digits: int) -> str:
    """SQL: nodes of longer prefixes folded to so many digits; those that have no more stay."""
    return f"SELECT v, substr(k, 1, {digits}) AS k, CASE WHEN max(length(k)) > {digits} THEN sha256(string_agg(x, chr(10) ORDER BY x)) ELSE max(x) END AS x FROM {source} GROUP BY ALL"


def _two_generations(spark, sf_dir) -> HashTree:
    """A stored tree of the old files, and of the new ones by their change set."""
    tree = HashTree(spark, f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}", rows=16)
    old, new = (files(spark, sf_dir, v).select("path", "digest") for v in ("old", "new"))
    tree.update(old, 1)
    tree.update(X.diff_snapshots(old, new, "g2").select("path", F.col("current").alias("digest")), 2)
    return tree


@query(f"""WITH {OLD_NEW}, f AS (SELECT 1 AS v, path, sha256(text) AS digest FROM old UNION ALL SELECT 2, path, sha256(text) FROM new),
c AS (SELECT v, count(*) AS files, CASE WHEN count(*) <= 4096 THEN 2 WHEN count(*) <= 1048576 THEN 4 ELSE 6 END AS digits FROM f GROUP BY v),
l AS (SELECT v, substr(md5(path), 1, digits) AS k, sha256(string_agg(path || chr(0) || digest, chr(10) ORDER BY path || chr(0) || digest)) AS x FROM f JOIN c USING (v) GROUP BY ALL),
l4 AS ({_level("l", 4)}), l2 AS ({_level("l4", 2)}), l0 AS ({_level("l2", 0)})
SELECT v AS version, x AS fingerprint, files FROM l0 JOIN c USING (v)""")
def a15_stored_tree(spark, sf_dir):
    tree = _two_generations(spark, sf_dir)
    one, two = (tree.root(v).select(F.lit(v).alias("version"), "fingerprint", "files") for v in (1, 2))
    return one.unionByName(two)


@query(ORACLES["x1_diff_snapshots"])
def x1_diff_stored_tree(spark, sf_dir):
    return _two_generations(spark, sf_dir).diff(1, 2, "g2")


@query("""WITH a AS (SELECT o_custkey, count(*) AS candidates, count(*) FILTER (o_orderstatus <> 'P') AS resolved, bool_or(o_orderpriority = '1-URGENT') AS c, bool_or(o_orderkey % 7 = 0) AS t, bool_or(o_orderkey % 5 = 0) AS u, list_sort(list_distinct(list(o_orderpriority))) AS r FROM orders GROUP BY 1)
SELECT o_custkey, candidates, resolved, CASE WHEN c THEN 'changed' WHEN t THEN 'truncated' WHEN u THEN 'unsupported' WHEN resolved < candidates THEN 'partial' ELSE 'complete' END AS status, array_to_string(CASE WHEN len(r) > 3 THEN list_concat(r[1:3], ['and ' || (len(r) - 3) || ' more']) ELSE r END, ';') AS reasons FROM a""")
def a11_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") != "P").alias("resolved"), (F.col("o_orderpriority") == "1-URGENT").alias("changed"), (F.col("o_orderkey") % 7 == 0).alias("truncated"), (F.col("o_orderkey") % 5 == 0).alias("unsupported"), F.col("o_orderpriority").alias("reason"))
    return X.coverage(o, ["o_custkey"], 3).withColumn("reasons", F.array_join("reasons", ";"))


@query("""SELECT o_custkey, o_orderkey, n > 4 AS truncated FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 4""")
def t7_cap_rows(spark, sf_dir):
    return X.cap_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 4)


@query("""SELECT o_orderkey, o_custkey, true AS has_more FROM orders WHERE o_orderkey > 700 AND o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 100""")
def t6_keyset_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", 1).alias("tombstoned_at_ms"))
    return X.keyset_page(o, "o_orderkey", 700, 100).drop("tombstoned_at_ms")


@query(f"""WITH {FILES} SELECT path, true AS has_more FROM files WHERE (path = 'src1' OR starts_with(path, 'src1/') OR starts_with(path, 'src3/en/')) AND lang IN ('en', 'de') ORDER BY path LIMIT 20 OFFSET 5""")
def p7_query_facts(spark, sf_dir):
    f = files(spark, sf_dir).select(F.col("path").alias("row_key"), F.col("lang").alias("kind"), "path")
    return X.query_facts(f, kinds=["en", "de"], prefixes=["src1", "src3/en"], limit=20, offset=5).select("path", "has_more")


@query("""SELECT d.domain, count(p.p_partkey) AS n FROM (VALUES ('ECONOMY'), ('STANDARD'), ('NOSUCH')) d(domain) LEFT JOIN part p ON p.p_type = d.domain GROUP BY 1""")
def a9_domain_counts(spark, sf_dir):
    d = spark.createDataFrame([("ECONOMY",), ("STANDARD",), ("NOSUCH",)], "domain string")
    return X.domain_counts(table(spark, sf_dir, "part").select(F.col("p_type").alias("domain")), d)


@query("""SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def a10_store_stats(spark, sf_dir):
    return X.store_stats({n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")})


@query("SELECT DISTINCT lang AS language FROM documents WHERE lang IS NOT NULL")
def a10_languages(spark, sf_dir):
    return X.languages(table(spark, sf_dir, "documents").withColumnRenamed("lang", "language"))


@query("""SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)) AS dangling, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)) = 0 AS sound""")
def a10_integrity(spark, sf_dir):
    return X.integrity(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0"), "l_orderkey", "o_orderkey")


@query("""WITH l AS (SELECT event_id AS sequence, props AS payload, CASE WHEN event_id % 997 = 5 THEN sha256(props || 'x') ELSE sha256(props) END AS payload_hash, sha256(sha256(props) || '|' || event_id) AS event_hash FROM events),
p AS (SELECT *, CASE WHEN sequence % 991 = 7 THEN 'x' ELSE lag(event_hash) OVER (ORDER BY sequence) END AS prev, lag(event_hash) OVER (ORDER BY sequence) AS before, min(sequence) OVER () AS first FROM l),
c AS (SELECT sequence, CASE WHEN sequence = first THEN prev IS NULL ELSE coalesce(prev = before, false) END AS link_ok, payload_hash = sha256(payload) AS payload_ok, event_hash = sha256(payload_hash || '|' || sequence) AS event_ok FROM p)
SELECT * FROM c WHERE NOT (link_ok AND payload_ok AND event_ok)""")
def w5_verify_chain(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("sequence"), F.col("props").alias("payload"), F.when(F.col("event_id") % 997 == 5, F.sha2(F.concat("props", F.lit("x")), 256)).otherwise(F.sha2("props", 256)).alias("payload_hash"), F.sha2(F.concat_ws("|", F.sha2("props", 256), "event_id"), 256).alias("event_hash"))
    before = log.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("previous_event_hash"))
    log = log.join(before, "sequence", "left").withColumn("previous_event_hash", F.when(F.col("sequence") % 991 == 7, "x").otherwise(F.col("previous_event_hash")))
    return X.verify_chain(log, F.sha2(F.concat_ws("|", "payload_hash", "sequence"), 256))


@query("""SELECT c_custkey AS session_id, coalesce((SELECT max(turn) FROM conversations v WHERE v.conv_id = c.c_custkey) + 1, 0)::BIGINT AS next_ordinal FROM customer c""")
def w7_next_ordinal(spark, sf_dir):
    return X.next_ordinal(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id")), turns(spark, sf_dir))


@query("""WITH i AS (SELECT l_orderkey AS packet, l_linenumber % 3 AS section_rank, l_extendedprice AS rank, l_quantity::BIGINT * 100 AS bytes FROM lineitem),
s AS (SELECT *, sum(bytes) OVER w + 50 AS b, row_number() OVER w AS n FROM i WINDOW w AS (PARTITION BY packet ORDER BY section_rank, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT packet, count(*) AS items, sum(bytes)::BIGINT AS bytes FROM s WHERE n = 1 OR (b <= 9000 AND ceil(b / 4.0) <= 2000) GROUP BY packet""")
def w8_fit_budget(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    i = i.select(F.col("l_orderkey").alias("packet"), (F.col("l_linenumber") % 3).alias("section_rank"), F.col("l_extendedprice").alias("rank"), (F.col("l_quantity").cast("long") * 100).alias("bytes"))
    return X.fit_budget(i, 9000, 2000, 50).groupBy("packet").agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"))


@query("""WITH r AS (SELECT l_orderkey AS query, l_linenumber % 3 AS section_rank, l_extendedprice AS rank FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY query, section_rank ORDER BY rank) = 1 AS first FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN first THEN 0 ELSE 1 END, CASE WHEN first THEN section_rank END, rank) AS position FROM f)
SELECT query, section_rank, rank, first, position FROM o WHERE position <= 3""")
def w9_select_facts(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_linenumber") % 3).alias("section"), (F.col("l_linenumber") % 3).alias("section_rank"), F.col("l_extendedprice").alias("rank"))
    return X.select_facts(r, 3).select("query", "section_rank", "rank", "first", F.col("position").cast("long").alias("position"))


@query("""WITH r AS (SELECT p_partkey AS row_key, p_brand AS project_id, p_name AS seed FROM part),
hit AS (SELECT row_key, project_id, CASE WHEN seed = 'red widget' THEN 'dependency' ELSE 'path' END AS kind FROM r WHERE seed IN ('red widget', 'small ring'))
SELECT row_key FROM r WHERE row_key IN (SELECT row_key FROM hit) OR project_id IN (SELECT project_id FROM hit WHERE kind = 'dependency')""")
def j13_select_by_seed(spark, sf_dir):
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_key"), F.col("p_brand").alias("project_id"), F.array("p_name", "p_type").alias("seed_keys"))
    seeds = spark.createDataFrame([("red widget", "dependency"), ("small ring", "path")], "seed string, kind string")
    return X.select_by_seed(r, seeds).select("row_key")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN o_orderpriority = '1-URGENT' ELSE o_orderpriority = '1-URGENT' END AS matches FROM orders""")
def j20_snapshot_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("commit_id"), F.when(F.col("o_orderstatus") == "F", "tree").alias("tree_id"))
    return X.snapshot_match(o, {"commit_id": "1-URGENT", "tree_id": "tree"}).select("o_orderkey", "matches")


@query("""SELECT 1 AS rule_no, 'red' AS suggestion WHERE EXISTS (SELECT 1 FROM part WHERE p_name = 'red widget') UNION ALL SELECT 2, 'seg' WHERE EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'MACHINERY') UNION ALL SELECT 3, 'none' WHERE EXISTS (SELECT 1 FROM part WHERE p_name = 'nosuch')""")
def j21_detect(spark, sf_dir):
    rules = spark.createDataFrame([(1, "red", ["red widget"], []), (2, "seg", [], ["MACHINERY"]), (3, "none", ["nosuch"], [])], "rule_no int, suggestion string, files array<string>, dependencies array<string>")
    return X.detect(table(spark, sf_dir, "part").select(F.col("p_name").alias("path")), table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")), rules)


@query(f"""WITH {FILES}, s AS (SELECT unnest(['thingesa', 'erbl', 'lich', 'zu']) AS symbol)
SELECT path, symbol, len(substr(text, 1, instr(text, symbol) - 1)) - len(replace(substr(text, 1, instr(text, symbol) - 1), chr(10), '')) + 1 AS line FROM files, s WHERE len(symbol) >= 3 AND strlen(text) <= 262144 AND contains(text, symbol) AND source <> 'src0'""")
def j22_text_consumers(spark, sf_dir):
    f = files(spark, sf_dir)
    return X.text_consumers(f.select("path", "text"), spark.createDataFrame([("thingesa",), ("erbl",), ("lich",), ("zu",)], "symbol string"), f.filter(F.col("source") == "src0"), max_bytes=256 << 10, symbols_most=16)


@query("""WITH t AS (SELECT p_partkey AS row_key, lower(p_name) AS token FROM part UNION SELECT p_partkey, lower(p_brand) || '/' || p_size FROM part),
a AS (SELECT row_key, min(row_key) OVER (PARTITION BY token) AS anchor FROM t) SELECT DISTINCT anchor, row_key FROM a WHERE row_key <> anchor""")
def a16_token_star_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_key"), X.relation_tokens(F.col("p_name"), F.concat_ws("/", "p_brand", "p_size")).alias("tokens"))
    return X.token_star_edges(p)


@query("""WITH e AS (SELECT 'o' || o_custkey AS id, 'owns' AS kind FROM orders UNION ALL SELECT 'c' || c_custkey, 'constrains' FROM customer), d AS (SELECT id, min(kind) AS kind FROM e GROUP BY id)
SELECT id, kind, (SELECT greatest(count(*) - 500, 0) FROM d) AS omitted FROM d ORDER BY id LIMIT 500""")
def x4_governance_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("id"), F.lit("owns").alias("kind"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("constrains").alias("kind"))
    return X.governance_edges(o, c, limit=500)


# ---- records ----


@query(f"""WITH {CLAIMS}, j AS (SELECT a.id, b.id AS other_id, a.workspace_id, a.scope, a.claim_type, a.subject, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS r FROM claims a JOIN claims b ON a.scope = b.scope AND a.subject = b.subject AND a.content <> b.content AND a.id <> b.id AND b.state = 'active')
SELECT id, other_id, workspace_id, scope, claim_type, subject FROM j WHERE r <= 8""")
def j18_contradictions(spark, sf_dir):
    return R.contradictions(claims(spark, sf_dir))


@query("""SELECT o_orderpriority AS scope, count(*) FILTER (o_orderkey > 5000) AS n, greatest(max(o_orderkey), 5000) AS watermark FROM orders GROUP BY 1""")
def j19_drifted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("updated_at_ms"))
    cur = o.select("scope").distinct().withColumn("watermark", F.lit(5000).cast("long"))
    return R.drifted(o, cur).groupBy("scope").agg(F.count("id").alias("n"), F.max("watermark").alias("watermark"))


@query("""WITH n AS (SELECT l_orderkey AS source, l_returnflag AS relationship, l_partkey AS target, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL) SELECT relationship, p_partkey AS id, p_name FROM n JOIN part ON target = p_partkey WHERE source = 7""")
def j23_links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_returnflag").alias("relationship"), F.col("l_partkey").alias("target"), F.col("l_extendedprice").alias("v"))
    return R.links_from(R.put_links(li.limit(0), li), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), 7)


_REC = """rec AS (SELECT event_id AS id, event_type AS kind, 'w' || (user_id % 4) AS workspace_key, CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN event_id // 2 END AS parent_id, CASE WHEN event_id % 50 = 1 THEN 5000 END AS expires_at_ms, event_id * 10 AS updated_at_ms, CASE WHEN event_id % 40 = 0 THEN event_id END AS tombstoned_at_ms FROM events)"""


def _records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(i.alias("id"), F.col("event_type").alias("kind"), F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("workspace_key"), F.when((i % 3 == 0) & (i > 0), F.floor(i / 2)).cast("long").alias("parent_id"), F.when(i % 50 == 1, F.lit(5000)).cast("long").alias("expires_at_ms"), (i * 10).alias("updated_at_ms"), F.when(i % 40 == 0, i).alias("tombstoned_at_ms"), F.lit(1).cast("long").alias("revision"))


@query(f"""WITH {_REC}, live AS (SELECT * FROM rec WHERE tombstoned_at_ms IS NULL),
o AS (SELECT id FROM live WHERE expires_at_ms <= 60000 UNION SELECT id FROM live WHERE workspace_key = 'w1' AND updated_at_ms < 30000 UNION SELECT id FROM live WHERE workspace_key = 'w2' AND kind = 'click' AND updated_at_ms < 50000),
a AS (SELECT id FROM o UNION SELECT id FROM live WHERE parent_id IN (SELECT id FROM o)) SELECT id FROM a""")
def r8_apply_retention(spark, sf_dir):
    p = spark.createDataFrame([("w1", None, 30000, True), ("w2", "click", 10000, True), ("w3", None, 0, False)], "workspace_key string, kind string, retain_for_ms long, enabled boolean")
    return R.apply_retention(_records(spark, sf_dir), p, 60000).select("id")


@query(f"""WITH {_REC} SELECT id, CASE WHEN id % 6 = 0 AND tombstoned_at_ms IS NULL THEN 2 ELSE 1 END AS revision, CASE WHEN tombstoned_at_ms IS NULL AND id % 6 = 0 THEN 99999 ELSE tombstoned_at_ms END AS tombstoned_at_ms FROM rec WHERE NOT coalesce(CASE WHEN tombstoned_at_ms IS NULL AND id % 6 = 0 THEN 99999 ELSE tombstoned_at_ms END < 4000, false)""")
def r9_tombstone_purge(spark, sf_dir):
    r = _records(spark, sf_dir)
    return R.purge(R.tombstone(r, r.filter("id % 6 = 0").select("id"), 99999), 4000).select("id", "revision", "tombstoned_at_ms")


@query("""WITH s AS (SELECT o_orderkey AS native_id, o_orderstatus AS state, o_custkey AS w FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS native_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 10 = 1 THEN -1 ELSE o_custkey END AS w FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(s.native_id, b.native_id)::VARCHAR AS native_id, CASE WHEN b.native_id IS NULL THEN NULL WHEN s.native_id IS NULL THEN 'insert' WHEN s.w <> b.w THEN 'reject' WHEN s.state = b.state THEN 'replay' ELSE 'update' END AS outcome,
  CASE WHEN s.native_id IS NULL THEN b.state WHEN b.native_id IS NULL OR s.w <> b.w THEN s.state ELSE b.state END AS state, CASE WHEN b.native_id IS NOT NULL AND s.native_id IS NOT NULL AND s.w = b.w AND s.state <> b.state THEN 2 ELSE 1 END AS revision FROM s FULL JOIN b ON s.native_id = b.native_id""")
def r7_upsert_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")

    def rows(df, state, workspace):
        return df.select(n.cast("string").alias("id"), F.lit("order").alias("kind"), F.lit("p").alias("origin_platform"), n.cast("string").alias("native_id"), workspace.cast("string").alias("workspace_key"), F.lit(None).cast("string").alias("parent_id"), state.alias("state"), F.lit("low").alias("sensitivity"), F.lit("h").alias("payload_hash"), F.lit(None).cast("long").alias("expires_at_ms"), F.lit(1).cast("long").alias("revision"), F.lit(None).cast("long").alias("tombstoned_at_ms"))

    store = rows(o.filter(n % 3 != 0), F.col("o_orderstatus"), F.col("o_custkey"))
    batch = rows(o.filter(n % 2 == 0), F.when(n % 4 == 0, "Z").otherwise(F.col("o_orderstatus")), F.when(n % 10 == 1, F.lit(-1)).otherwise(F.col("o_custkey"))).withColumn("seq", F.lit(1))
    return R.upsert_records(store, batch).select("native_id", "outcome", "state", "revision")


@query("""SELECT role AS scope, conv_id * 100 + turn AS path, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS summary FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), 'the') ORDER BY role, conv_id * 100 + turn LIMIT 50 OFFSET 10""")
def t8_search_records(spark, sf_dir):
    t = turns(spark, sf_dir).select(F.col("role").alias("scope"), F.lit("conv").alias("origin"), F.col("seq").alias("path"), "text")
    return R.search_records(t, "THE", ["user", "assistant"], 50, 10, max_bytes=1 << 20).select("scope", "path", "summary")


@query("""SELECT lang AS scope, doc_id AS path, sha256(CASE WHEN strlen(text) <= 16384 THEN text ELSE text[1:list_max(list_filter(range(4096, 16385), lambda k: strlen(text[1:k]) <= 16384))] END) AS content_sha256 FROM documents WHERE lang IN ('de', 'en', 'es') AND contains(lower(text), 'en')""")
def t8_record_prefixes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("source").alias("origin"), F.col("doc_id").alias("path"), "text")
    return R.search_records(d, "EN", ["de", "en", "es"], prefix_bytes=16 << 10).select("scope", "path", F.sha2("content", 256).alias("content_sha256"))


@query("""SELECT o_orderkey::VARCHAR AS original_id, substr(sha256(o_orderkey || '|' || o_orderpriority), 1, 24) AS id, o_orderstatus AS state FROM orders WHERE o_orderkey % 4 <> 0""")
def s10_import_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("payload_hash"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 4 == 0).alias("known"))
    store = o.filter("known").select(F.col("id").alias("original_id"), "payload_hash")
    return R.import_records(store, o).select("original_id", "id", "state")


@query("""SELECT role AS scope, conv_id * 100 + turn AS id, text AS content FROM conversations WHERE role = 'user'""")
def s10_export_records(spark, sf_dir):
    path = f"{scratch_dir(spark)}/exports/{uuid.uuid4().hex}"
    rows = turns(spark, sf_dir).select(F.col("role").alias("scope"), F.col("seq").alias("id"), F.col("text").alias("content"))
    R.export_records(rows, "user", path)
    return spark.read.schema(rows.schema).json(path)


@query("""WITH RECURSIVE e AS (SELECT user_id AS claim_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  CASE event_type WHEN 'click' THEN 'validated' WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'superseded' WHEN 'error' THEN 'rejected' ELSE 'tombstoned' END AS s FROM events),
f(claim_id, n, state, refused) AS (SELECT DISTINCT claim_id, 0::BIGINT, 'proposed', 0::BIGINT FROM e UNION ALL
  SELECT claim_id, n, CASE WHEN ok THEN s ELSE state END, refused + CASE WHEN ok THEN 0 ELSE 1 END FROM (
    SELECT f.claim_id, e.n, e.s, f.state, f.refused, (state = 'proposed' AND s IN ('validated', 'rejected', 'tombstoned')) OR (state = 'validated' AND s IN ('active', 'rejected', 'tombstoned')) OR (state = 'active' AND s IN ('superseded', 'tombstoned')) AS ok
    FROM f JOIN e ON e.claim_id = f.claim_id AND e.n = f.n + 1))
SELECT claim_id, arg_max(state, n) AS state, max(refused) AS refused FROM f GROUP BY claim_id""")
def r10_fold_claims(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    step = F.when(F.col("event_type") == "click", "validated").when(F.col("event_type") == "purchase", "active").when(F.col("event_type") == "view", "superseded").when(F.col("event_type") == "error", "rejected").otherwise("tombstoned")
    return R.fold_claims(e.select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("seq"), step.alias("to_state")))


# ---- search and text ----

_SEARCH = """docs AS (SELECT doc_id AS fact_key, CASE WHEN doc_id % 2 = 0 THEN 'chunk' ELSE 'file' END AS kind, source || '/' || lang AS path, source AS title, text AS body FROM documents),
toks AS (SELECT fact_key, 'path' AS field, lower(unnest(regexp_extract_all(path, '[\\p{L}\\p{N}_$@]+'))) AS term FROM docs UNION ALL SELECT fact_key, 'title', lower(unnest(regexp_extract_all(title, '[\\p{L}\\p{N}_$@]+'))) FROM docs UNION ALL SELECT fact_key, 'body', lower(unnest(regexp_extract_all(body, '[\\p{L}\\p{N}_$@]+'))) FROM docs)"""


def search_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("fact_key"), F.when(F.col("doc_id") % 2 == 0, "chunk").otherwise("file").alias("kind"), F.concat_ws("/", "source", "lang").alias("path"), F.col("source").alias("title"), F.col("text").alias("body"))


@query(f"WITH {_SEARCH} SELECT fact_key, field, count(*) AS terms, count(DISTINCT term) AS distinct_terms FROM toks GROUP BY ALL")
def t2_build_postings(spark, sf_dir):
    return S.build_postings(search_docs(spark, sf_dir)).groupBy("fact_key", "field").agg(F.sum("tf").alias("terms"), F.count("*").alias("distinct_terms"))


@query(f"""WITH {_SEARCH}, dl AS (SELECT fact_key, count(*) AS dl FROM toks GROUP BY 1), st AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT count(*) FROM toks)::DOUBLE / (SELECT count(*) FROM docs) AS mean),
h AS (SELECT CASE WHEN term = 'the' THEN 0 ELSE 1 END AS q, fact_key, sum(CASE field WHEN 'path' THEN 2 WHEN 'title' THEN 4 ELSE 1 END)::DOUBLE AS wtf FROM toks WHERE term = 'the' OR starts_with(term, 'ering') GROUP BY ALL),
df AS (SELECT q, count(*) AS df FROM h GROUP BY q),
s AS (SELECT fact_key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) AS raw, count(*) AS terms FROM h JOIN df USING (q) JOIN dl USING (fact_key), st GROUP BY fact_key)
SELECT fact_key, kind, path, round(raw * CASE kind WHEN 'chunk' THEN 1.0 ELSE 1.6 END, 6) AS score FROM docs JOIN s USING (fact_key) WHERE terms = 2""")
def t1_search(spark, sf_dir):
    return S.search(search_docs(spark, sf_dir), "the ering").withColumn("score", F.round("score", 6))


@query(ORACLES["t1_search"].replace("SELECT fact_key, kind, path, round", "SELECT fact_key, path, count(*) OVER () > 30 AS has_more FROM (SELECT fact_key, path, round") + ") ORDER BY score DESC, fact_key LIMIT 20 OFFSET 10")
def t1_search_page(spark, sf_dir):
    return S.search(search_docs(spark, sf_dir), "the ering", limit=20, offset=10).select("fact_key", "path", "has_more")


@query(ORACLES["t1_search_page"])
def t1_search_stored(spark, sf_dir):
    """A page from a stored index: a first version with other bodies and further documents, then the change set that leads to today's."""
    d = search_docs(spark, sf_dir)
    index = TextIndex(spark, f"{scratch_dir(spark)}/indexes/{uuid.uuid4().hex}", d.schema["fact_key"].dataType)
    changed, gone = F.col("fact_key") % 13 == 0, F.col("fact_key") % 17 == 0
    more = d.filter(gone).withColumn("fact_key", -F.col("fact_key") - 1)
    index.update(d.withColumn("body", F.when(changed, F.col("path")).otherwise(F.col("body"))).unionByName(more), 0)
    index.update(d.filter(changed), 1, more)
    return index.search("the ering", limit=20, offset=10).select("fact_key", "path", "has_more")


@query(f"""WITH {_SEARCH}, c AS (SELECT *, (len(lower(body)) - len(replace(lower(body), 'ering', ''))) / 5 + (len(path) - len(replace(path, 'ering', ''))) / 5 + (len(title) - len(replace(title, 'ering', ''))) / 5 AS a, (len(lower(body)) - len(replace(lower(body), 'src1', ''))) / 4 + (len(path) - len(replace(path, 'src1', ''))) / 4 + (len(title) - len(replace(title, 'src1', ''))) / 4 AS b FROM docs)
SELECT fact_key, kind, path, least(a + b, 8) * CASE kind WHEN 'chunk' THEN 1.0 ELSE 1.6 END AS score FROM c WHERE a > 0 AND b > 0""")
def t3_linear_search(spark, sf_dir):
    return S.linear_search(search_docs(spark, sf_dir), "ering src1")


@query("""WITH s AS (SELECT p_partkey AS byte_offset, p_name AS name, p_brand AS path, p_type AS kind, list_concat(list_concat(regexp_extract_all(lower(p_name), '[a-z0-9_$@]+'), regexp_extract_all(lower(p_brand), '[a-z0-9_$@]+')), regexp_extract_all(lower(p_type), '[a-z0-9_$@]+')) AS t FROM part)
SELECT byte_offset, name, len(list_filter(t, lambda x: starts_with(x, 'red'))) + len(list_filter(t, lambda x: starts_with(x, 'econ'))) AS hits FROM s WHERE len(list_filter(t, lambda x: starts_with(x, 'red') OR starts_with(x, 'econ'))) > 0""")
def t4_search_symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("byte_offset"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_type").alias("kind"))
    return S.search_symbols(p, "red econ").select("byte_offset", "name", "hits")


@query(r"""WITH t AS (SELECT page_id, unnest(list_distinct(['path:' || lower(url), 'value:' || lower(split_part(url, '/', 3)), 'value:' || lower(url), CASE WHEN page_id % 2 = 0 THEN 'value:page ' || page_id END])) AS token FROM pages)
SELECT page_id, string_agg(token, ' ' ORDER BY token) AS tokens FROM t WHERE token IS NOT NULL GROUP BY page_id""")
def f14_identity_tokens(spark, sf_dir):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    name = F.format_string(" Page %d ", "page_id")
    # a list of objects below a field that names nothing, a list of strings below one that does
    nested = F.array(F.struct(host.alias("Owner"), F.length("html").alias("size")), F.struct(F.upper(host).alias("Owner"), F.col("page_id").cast("int").alias("size")))
    body = F.to_json(F.struct(nested.alias("parts"), F.array("url", F.lit(" ")).alias("page_uri"), F.col("url").alias("note"), F.when(F.col("page_id") % 2 == 0, name).alias("record")))
    p = table(spark, sf_dir, "pages").select("page_id", identity_tokens(F.col("url"), body).alias("t"))
    return p.select("page_id", F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query(f"""WITH {PAGES} SELECT page_id, greatest(ceil(strlen(path) / 4.0), 1)::BIGINT AS tokens, substr(path, 1, 10) AS short, path = 'th' OR starts_with(path, 'blog.') AS blog, lower(trim(regexp_replace(translate(path, '_-', '  '), '\\s+', ' ', 'g'))) AS identity FROM paths""")
def f12_f15_page_functions(spark, sf_dir):
    p = F.col("path")
    return pages(spark, sf_dir).select("page_id", C.estimate_tokens(p).alias("tokens"), C.clamp(p, 10).alias("short"), p.startswith("blog.").alias("blog"), C.normalize_identity(p).alias("identity"))


@query("""WITH t AS (SELECT doc_id, lower(unnest(a)) AS t, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS a FROM documents)),
f AS (SELECT doc_id, t, min(i) AS i FROM t WHERE len(t) >= 3 AND t NOT IN ('and','are','but','for','from','has','have','how','into','its','not','our','that','the','their','them','then','there','this','use','was','what','when','where','which','who','why','will','with','you','your') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f), g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS terms FROM r WHERE r <= 24 GROUP BY 1)
SELECT d.doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_$@]+')) AS n_tokens, coalesce(terms, '') AS terms FROM documents d LEFT JOIN g USING (doc_id)""")
def f6_f7_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(C.match_terms(F.col("text"))["terms"]).cast("long").alias("n_tokens"), F.array_join(C.context_terms(F.col("text")), " ").alias("terms"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: contains(x, 'ering')), true) AS at_ FROM l)
SELECT doc_id, CASE WHEN at_ > 0 THEN substr(array_to_string(ls[greatest(at_ - 1, 1):at_ + 1], chr(10)), 1, 400) END AS excerpt FROM p""")
def f16_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.excerpt(F.col("text"), F.lit("ering"), 1).alias("excerpt"))


@query("""SELECT o_orderkey, sha256('{"a":' || o_custkey || ',"b":"' || o_orderpriority || '"}') AS evidence_id, least(0.9::DOUBLE, o_totalprice / 500000) AS confidence, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'partial' ELSE 'candidate' END AS status, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.75 ELSE 0.5 END AS score FROM orders""")
def f11_f17_evidence(spark, sf_dir):
    s = C.relation_state(F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "partial").otherwise("open"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.evidence_id(F.struct(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"))).alias("evidence_id"), C.derive_confidence(F.lit(0.9), F.col("o_totalprice") / 500000).alias("confidence"), s["status"].alias("status"), s["confidence"].alias("score"))
