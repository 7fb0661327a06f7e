"""Secrets out of text and JSON. Vectorised helpers, because a private-key block spans lines and replacements are counted."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RESULT = T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])
MARK, KEY_MARK = "[REDACTED]", "[REDACTED PRIVATE KEY]"
# Token prefixes of vendors and the least length of the whole token.
PREFIXES = (("github_pat_", 24), ("ghp_", 20), ("gho_", 20), ("ghu_", 20), ("ghs_", 20), ("ghr_", 20), ("glpat-", 20), ("xoxb-", 20), ("xoxp-", 20), ("xoxa-", 20), ("xoxr-", 20), ("sk-proj-", 24), ("sk_live_", 20), ("rk_live_", 20), ("whsec_", 20), ("sk-", 20), ("pypi-", 20), ("npm_", 20), ("hf_", 20), ("AKIA", 20), ("ASIA", 20), ("AIza", 24), ("ya29.", 20), ("SG.", 20))
# Names of secrets, and names that only look like them.
SECRET_NAMES = ("secret", "token", "password", "passwd", "passphrase", "apikey", "privatekey", "privatekeyid", "authorization", "proxyauthorization", "credential", "credentials", "cookie", "setcookie", "xapikey", "xauthtoken", "clientsecret", "accesstoken", "refreshtoken", "authtoken", "webhooksecret", "signingsecret", "encryptionkey", "awssecretaccesskey", "databasepassword")
SECRET_ENDINGS = ("secret", "password", "privatekey", "credential", "token")
METRIC_PARTS = ("tokenbudget", "tokencount", "tokenlimit", "tokenusage", "tokenwindow", "contextwindow")
METRIC_NAMES = frozenset(("maxtoken", "mintoken"))

_RUN = r"[A-Za-z0-9_\-.~+/=]"
_VENDOR = [(re.compile(re.escape(p) + _RUN + "*"), n) for p, n in PREFIXES]
_DELIMITER = re.compile(r"(?<![=!<>])=(?!=)|(?<!:):(?![:/])")
_SCHEMES = [re.compile(rf"(?i)({s} )({_RUN}{{8,}})") for s in ("bearer", "basic")]
_URL = re.compile(r"://[^/?#\s]+@")
_JWT = re.compile(r"(?<![A-Za-z0-9_.\-])eyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?![A-Za-z0-9_.\-])")
_BEGIN, _END = re.compile(r"^-----BEGIN .*PRIVATE KEY-----$"), re.compile(r"^-----END .*PRIVATE KEY-----$")
_NUMBER = re.compile(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$", re.I)
#: A text without any of these has nothing to redact.
_MAYBE = re.compile(r"[=:]|(?i:bearer |basic )|-----BEGIN |eyJ|" + "|".join(re.escape(p) for p, _ in PREFIXES))


def sensitive_key(name: str) -> bool:
    n = re.sub(r"[^a-z0-9]", "", name.lower())
    if n.endswith("tokens") or n in METRIC_NAMES or any(p in n for p in METRIC_PARTS):
        return False
    return n in SECRET_NAMES or n.endswith(SECRET_ENDINGS)


def _assignment(line: str) -> tuple[str, int]:
    """Only the first delimiter of a line counts; what follows it goes, but for a last comma or semicolon."""
    m = _DELIMITER.search(line)
    if not m or not sensitive_key(re.search(r"[\w-]*$", line[: m.start()].rstrip())[0]):
        return line, 0
    value = line[m.end() :].strip()
    bare = value.rstrip(",;").strip("'\"").strip()
    if bare in ("", "null", "undefined", "true", "false") or _NUMBER.match(bare):
        return line, 0
    return line[: m.end()] + " " + MARK + (value[-1] if value[-1] in ",;" else ""), 1


def _long_enough(least: int):
    return lambda m: MARK if len(m[0]) >= least else m[0]


def _line(line: str) -> tuple[str, int]:
    line, n = _assignment(line)
    for pattern, least in _VENDOR:
        if pattern.pattern and pattern.search(line):
            n += sum(len(m[0]) >= least for m in pattern.finditer(line))
            line = pattern.sub(_long_enough(least), line)
    for pattern in _SCHEMES:
        line, k = pattern.subn(rf"\g<1>{MARK}", line)
        n += k
    line, k = _URL.subn(f"://{MARK}@", line)
    line, j = _JWT.subn(MARK, line)
    return line, n + k + j


def redact(text: str) -> tuple[str, int]:
    """The text with secrets replaced and their number; lines end at a line feed only."""
    if not _MAYBE.search(text):
        return text, 0
    out, count, inside = [], 0, False
    for line in text.split("\n"):
        bare = line.strip()
        if inside or _BEGIN.match(bare):
            count += 1
            out.append(KEY_MARK)
            inside = not _END.match(bare) if inside else True
        else:
            line, n = _line(line)
            count += n
            out.append(line)
    if text.endswith("\n") and inside and out[-1] == KEY_MARK:
        out[-1] = ""
        count -= 1
    return "\n".join(out), count


def _walk(v):
    if isinstance(v, dict):
        out, n = {}, 0
        for k, x in v.items():
            if sensitive_key(k) and not (x is None or isinstance(x, (bool, int, float))):
                out[k], m = MARK, 1
            else:
                out[k], m = _walk(x)
            n += m
        return out, n
    if isinstance(v, list):
        got = [_walk(x) for x in v]
        return [x for x, _ in got], sum(m for _, m in got)
    return redact(v) if isinstance(v, str) else (v, 0)


@F.pandas_udf(_RESULT)
def redact_text(text: pd.Series) -> pd.DataFrame:
    got = [(None, 0) if t is None else redact(t) for t in text]
    return pd.DataFrame(got, columns=["value", "count"])


@F.pandas_udf(_RESULT)
def redact_json(body: pd.Series) -> pd.DataFrame:
    """JSON text: values under sensitive keys are replaced unless null, boolean or number; other strings as text."""
    out = []
    for t in body:
        if t is None:
            out.append((None, 0))
            continue
        v, n = _walk(json.loads(t))
        out.append((json.dumps(v, ensure_ascii=False, separators=(",", ":")), n))
    return pd.DataFrame(out, columns=["value", "count"])


def sensitive_key_column(name: Column) -> Column:
    n = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    metric = n.endswith("tokens") | n.isin(*METRIC_NAMES) | n.rlike("|".join(METRIC_PARTS))
    return ~metric & (n.isin(*SECRET_NAMES) | n.rlike("(" + "|".join(SECRET_ENDINGS) + ")$"))


def sanitize_events(df: DataFrame, texts: list[str], metadata: str | None = "metadata") -> DataFrame:
    """Named text fields redacted; metadata values under sensitive keys replaced."""
    for c in texts:
        df = df.withColumn(c, redact_text(F.col(c))["value"])
    if metadata:
        df = df.withColumn(metadata, F.transform_values(metadata, lambda k, v: F.when(sensitive_key_column(k) & v.isNotNull(), F.lit(MARK)).otherwise(v)))
    return df
