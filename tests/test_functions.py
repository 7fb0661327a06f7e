"""Column functions, helpers and globs on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions import paths as P
from tallyloom.functions.chunker import MAX_BYTES, MAX_LINES, chunk_files, split_file
from tallyloom.functions.redaction import redact, redact_json, redact_text, sensitive_key


def matches(parts, names):
    """The glob rules by hand, segment by segment: ** is any number of segments, * and ? stay in theirs."""
    if not parts:
        return not names
    if parts[0] == "**":
        return any(matches(parts[1:], names[i:]) for i in range(len(names) + 1)) if len(parts) > 1 else bool(names)
    return bool(names) and segment(parts[0], names[0]) and matches(parts[1:], names[1:])


def segment(p, name):
    if not p:
        return not name
    if p[0] == "*":
        return any(segment(p[1:], name[i:]) for i in range(len(name) + 1))
    return bool(name) and p[0] in ("?", name[0]) and segment(p[1:], name[1:])


def test_globs_against_a_matcher_by_segments():
    rng = random.Random(4)
    one = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    seen = set()
    for _ in range(4000):
        parts = [rng.choice(["**", one("ab*?", 3), one("ab", 2)]) for _ in range(rng.randint(2, 4))]
        # a literal first segment fixes the pattern to the top
        parts[0] = one("ab", 2)
        parts = [p for i, p in enumerate(parts) if "**" not in p or p == "**" and parts[i - 1] != "**"]
        names = [one("ab", 2) for _ in range(rng.randint(1, 4))]
        if len(parts) < 2 or parts[-1] == "**":
            continue
        want = matches(parts, names)
        assert bool(re.search(P.glob_regex("/".join(parts)), "/".join(names))) == want, (parts, names)
        seen.add(want)
    assert seen == {True, False}


def test_globs_of_one_name_match_at_any_depth_unless_anchored():
    bare, top = re.compile(P.glob_regex("LICENCE")), re.compile(P.glob_regex("/LICENCE"))
    for depth in range(4):
        path = "x/" * depth + "LICENCE"
        assert bare.search(path) and bool(top.search(path)) == (depth == 0)
    assert not bare.search("LICENCE.old") and not re.search(P.glob_regex(""), "x") and not bare.search("")


def test_glob_folders_and_classes():
    assert all(re.search(P.glob_regex("docs/"), "docs/" + x) for x in ("a", "b/c")) and not re.search(P.glob_regex("docs/"), "mydocs/a")
    for name in "pqrst":
        path = f"lib/{name}.c"
        assert bool(re.search(P.glob_regex("lib/[q-s].c"), path)) == (name in "qrs") != bool(re.search(P.glob_regex("lib/[!q-s].c"), path))


def test_plain_globs_cross_segments():
    assert re.search(P.plain_glob_regex("conf/*.rules"), "conf/deep/a.rules") and re.search(P.plain_glob_regex("*.md"), "a/b/c.md")


def test_chunks_join_to_the_file_and_keep_limits():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["é" * rng.randint(0, 3000), "x" * rng.randint(0, 200), "\n", "\r\n", "\x0b", "ab\n" * rng.randint(0, 300)]) for _ in range(rng.randint(0, 12)))
        parts = split_file(text)
        assert "".join(p[4] for p in parts) == text
        at = 0
        for s, e, a, b, t in parts:
            assert s == at and e - s == len(t.encode()) <= MAX_BYTES and (b - a + 1 <= MAX_LINES)
            at = e


def test_empty_file_is_one_empty_chunk_and_null_has_none(spark):
    df = spark.createDataFrame([("a", "", "d"), ("b", None, "d"), ("c", "x\ny", "d")], "path string, text string, digest string")
    assert sorted((r.path, r.start_line, r.end_line) for r in chunk_files(df).collect()) == [("a", 1, 1), ("c", 1, 2)]


@pytest.mark.parametrize(("text", "want", "n"), [
    ("use ghp_abcdefghijklmnopqrstuvwxyz now", "use [REDACTED] now", 1),
    ("ghp_short stays", "ghp_short stays", 0),
    ("api_key: hunter22,", "api_key: [REDACTED],", 1),
    ("max_tokens = 4000", "max_tokens = 4000", 0),
    ("token = null", "token = null", 0),
    ("a == b", "a == b", 0),
    ("Authorization: Bearer abcdefghij", "Authorization: [REDACTED]", 1),
    ("send bearer abcdefghij please", "send bearer [REDACTED] please", 1),
    ("see https://bob:pw@host/x", "see https://[REDACTED]@host/x", 1),
    ("jwt eyJhbGciOiJ.eyJzdWIiOiI.SflKxwRJSMe ok", "jwt [REDACTED] ok", 1),
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\nafter", "[REDACTED PRIVATE KEY]\n[REDACTED PRIVATE KEY]\n[REDACTED PRIVATE KEY]\nafter", 3),
    ("nothing here\n", "nothing here\n", 0),
    ("", "", 0),
])
def test_redaction(text, want, n):
    assert redact(text) == (want, n)


def test_redaction_columns(spark):
    df = spark.createDataFrame([("password = abc", '{"token":"x","input_tokens":5,"secret":null,"list":["bearer abcdefghij"],"in":{"apiKey":[1]}}'), (None, None)], "t string, j string")
    a, b = df.select(redact_text("t").alias("t"), redact_json("j").alias("j")).collect()
    assert a.t.value == "password = [REDACTED]" and a.j.value == '{"token":"[REDACTED]","input_tokens":5,"secret":null,"list":["bearer [REDACTED]"],"in":{"apiKey":"[REDACTED]"}}' and a.j["count"] == 3
    assert b.t.value is None and b.j.value is None


def test_sensitive_keys():
    assert sensitive_key("X-Api-Key") and sensitive_key("db_password") and sensitive_key("refreshToken")
    assert not sensitive_key("input_tokens") and not sensitive_key("tokenBudget") and not sensitive_key("name")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paths(spark):
    norm = lambda p: one(spark, P.normalize_path(F.lit(p)))
    assert [norm(p) for p in ("a/./b", "a/../b", "../a", "a//b", "a/b/../../..", "")] == ["a/b", "b", None, "a/b", None, ""]
    route = lambda p: one(spark, P.route_of(F.lit(p)))
    assert [route(p) for p in ("(shop)/cart/page.tsx", "@modal/photo/page.tsx", "page.tsx", "blog/[slug]/page.tsx", "_lib/x.ts", "404.tsx", "docs/index.tsx", "about.tsx")] == ["/cart", "/photo", "/", "/blog/[slug]", None, None, "/docs", "/about"]
    seg = one(spark, P.dynamic_segments(F.lit("/a/[id]/[...rest]/[[...opt]]")))
    assert [(s.position, s.name, s.kind) for s in seg] == [(2, "id", "required"), (3, "rest", "catch-all"), (4, "opt", "optional-catch-all")]
    inter = lambda p: one(spark, P.interception(F.lit(p)))
    assert [inter(p) for p in ("/feed/(.)photo", "/feed/(..)photo", "/a/b/(..)(..)photo", "/a/b/(...)photo", "/a")] == ["/feed/photo", "/photo", "/photo", "/photo", None]
    assert one(spark, P.language_of(F.lit("x/Y.PY"))) == "python" and one(spark, P.language_of(F.lit("Makefile"))) is None


def test_routes_of_the_pages_router(spark):
    route = lambda p: one(spark, P.page_route_of(F.lit(p)))
    assert [route(p) for p in ("index.tsx", "docs/index.tsx", "docs/", "about.tsx", "@u/(g)/page.tsx", "a//b.tsx", "api/users.ts", "9404.tsx", "")] == ["/", "/docs", "/docs", "/about", "/@u/(g)/page", "/a//b", "/api/users", "/9404", "/"]
    assert [route(p) for p in ("_app.tsx", "_document.tsx", "_error.js", "api.ts", "api/index.ts", None)] == [None] * 6


def test_routes_of_urls_are_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")

    from tallyloom.plans import catalogue

    known = {"http://a.com/en/9404#top": None, "https://a.com/en/3500.html": None, "http://a.com/404/": None, "http://a.com/40400": "/a.com/40400", "http://a.com/500/5.html": "/a.com/500/5", "http://": "/", "http://a.com//5": "/a.com//5", "http://a.com/@u/(g)/_x/page": "/a.com/@u/(g)/_x/page", "http://index.html": "/index", "http://a.com/404?x\r": None}
    odd = [None, "", "/", "//", "?x", "http://a.com", "http://a.com/404.html/", "http://a.com/404//", "http://a.com/9404.b.html", "http://x404.com", "http://a.com/index/", "http://a.com/index/index", "index/.html", "http://index//", "http://a.com/A.HTML", "http://a.com/5.html\n", "http://a.com/404\n", "http://a.com/a?x\n", "http://a.com/a?b\nc#d", "http://a.com/é404", "http://a.com/_app"]
    rows = list(enumerate([*known, *odd]))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.route for r in catalogue.QUERIES["f9_route_of"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(known))] == list(known.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert got == dict(con.execute(catalogue.ORACLES["f9_route_of"]).fetchall())


def test_eligible_files(spark):
    rows = [("src/a.py", b"x = 1\n"), ("node_modules/a.js", b"x"), ("yarn.lock", b"x"), ("b.min.js", b"x"), ("bin", b"a\x00b"), ("bad.txt", b"\xff\xfe"), ("empty.txt", b""), ("long.txt", b"y" * 70000), ("é.md", "é".encode())]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    assert {r.path for r in df.filter(P.eligible(F.col("path"), F.col("content"))).collect()} == {"src/a.py", "é.md"}


def test_columns(spark):
    size = lambda s: one(spark, C.parse_size(F.lit(s)))
    assert [size(s) for s in ("200k", "1M", "1.5m", "12", "x", "")] == [200_000, 1_000_000, 1_500_000, 12, None, None]
    tool = lambda t, c: one(spark, C.classify_tool(F.lit(t), F.lit(c)))
    assert [tool(*x) for x in (("run", "git status"), ("run", "pytest -q"), ("mcp.call", ""), ("exec", "rg foo"), ("", ""), ("x", "y"), ("auto_compact", "git"))] == ["git", "tests", "mcp", "rg", "model", "other-tool", "compaction"]
    assert one(spark, C.utf8_prefix(F.lit("aéé"), 4)) == "aé" and one(spark, C.utf8_prefix(F.lit("aé"), 10)) == "aé"
    assert one(spark, C.estimate_tokens(F.lit("abcde"))) == 2 and one(spark, C.estimate_tokens(F.lit(""))) == 1
    terms = one(spark, C.match_terms(F.lit("Foo bar_ba")))
    assert [(t.term, t.prefix) for t in terms.terms] == [("foo", False), ("bar_ba", True)]
    assert one(spark, C.redact_command(F.array(F.lit("git"), F.lit("push"), F.lit("x")))) == "git [+2 args]"
    assert one(spark, C.normalize_identity(F.lit("  Code_Owner--Name "))) == "code owner name"
    assert one(spark, C.excerpt(F.lit("a\nb\nhit\nd\ne"), F.lit("hit"), 1)) == "b\nhit\nd"


def test_sql_of_chunks_is_the_function():
    duckdb = pytest.importorskip("duckdb")

    from tallyloom.plans import catalogue

    texts = ["", "a", "a\n", "a\r\nb\rc\u2028d\x0be", "\n" * 400, "é" * 9000 + "\nz", "x" + "日本" * 6000, "x" * 8192 + "\n" + "y", "b\n" + "ü" * 4096 + "\n" + "c\n" * 130, ("w" * 100 + "\n") * 300, "k" * 16384, "\U0001f600" * 5000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 's')", list(enumerate(texts)))
    got = con.execute(f"SELECT path, byte_start, byte_end, start_line, end_line FROM ({catalogue.ORACLES['u1_chunk_files']})").fetchall()
    assert sorted(got) == sorted((f"s/en/{i}.md", *c[:4]) for i, t in enumerate(texts) for c in split_file(t))
