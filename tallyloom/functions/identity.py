"""Identity tokens of free-form JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fields whose strings name something, and endings of such fields.
IDENTITY_FIELDS = ("path", "uri", "owner", "consumer", "source", "target", "record", "reference", "dependency", "package", "project", "rule", "route", "binding", "policy", "entrypoint", "script", "config", "command", "handler", "registration")
IDENTITY_ENDINGS = ("_id", "_key", "_path", "_uri", "_owner", "_consumer", "_source", "_target", "_record", "_reference")


def _named(name: str) -> bool:
    return name in IDENTITY_FIELDS or name.endswith(IDENTITY_ENDINGS)


def _strings(body: str) -> list[str]:
    """Folded, trimmed strings under identity fields, at any depth; items of a list stand under the list's field."""
    found: set[str] = set()
    todo = [(json.loads(body), "")]
    while todo:
        value, field = todo.pop()
        if isinstance(value, dict):
            todo += [(v, k.casefold()) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, field) for v in value]
        elif isinstance(value, str) and _named(field) and value.strip():
            found.add("value:" + value.strip().casefold())
    return sorted(found)


@F.pandas_udf(ArrayType(StringType()))
def _values(body: pd.Series) -> pd.Series:
    return body.map(lambda b: [] if b is None else _strings(b))


def identity_tokens(path: Column, body: Column) -> Column:
    """Distinct tokens of a row: its path and the identity strings of its JSON. A null body has none, a null path no path token."""
    valid = F.when(F.try_parse_json(body).isNotNull(), body)  # text that isn't JSON counts as null
    return F.concat(F.array_compact(F.array(F.concat(F.lit("path:"), F.lower(path)))), _values(valid))
