"""Record stores: idempotent upserts, links, retention, tombstones, contradictions, claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import utf8_prefix

KEY = ["kind", "origin_platform", "native_id"]


def upsert_records(store: DataFrame, batch: DataFrame, revive: bool = False) -> DataFrame:
    """The store after a batch, with an `outcome` for rows of the batch: insert, update, replay, reject (null: untouched).

    A replay agrees in state, sensitivity, expiry and payload hash. Rows that would change workspace or parent, or
    hit a tombstone (unless revived), are rejected. Of several rows of a key the last of the batch (seq) counts.
    """
    last = batch.groupBy(*KEY).agg(F.max_by(F.struct(*batch.columns), "seq").alias("n")).select("n")
    old = store.select(F.struct(*store.columns).alias("o"))
    cond = None
    for k in KEY:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        cond = c if cond is None else cond & c
    j = old.join(last, cond, "full_outer")
    same = lambda *cs: F.expr(" AND ".join(f"(o.{c} <=> n.{c})" for c in cs))
    dead = F.col("o.tombstoned_at_ms").isNotNull() & F.lit(not revive)
    outcome = F.when(F.col("n").isNull(), F.lit(None).cast("string")).when(F.col("o").isNull(), "insert").when(dead | ~same("workspace_key", "parent_id"), "reject").when(same("state", "sensitivity", "expires_at_ms", "payload_hash") & F.col("o.tombstoned_at_ms").isNull(), "replay").otherwise("update")
    j = j.withColumn("outcome", outcome)
    out = []
    for c in store.columns:
        new = F.col(f"n.{c}") if c in batch.columns else F.lit(None)
        keep = F.col(f"o.{c}")
        if c == "revision":
            value = F.when(F.col("outcome") == "insert", F.lit(1)).when(F.col("outcome") == "update", keep + 1).otherwise(keep)
        elif c == "tombstoned_at_ms":
            value = F.when(F.col("outcome") == "update", F.lit(None)).otherwise(keep)
        elif c in ("id", "created_at_ms"):
            value = F.when(F.col("outcome") == "insert", new).otherwise(keep)
        else:
            value = F.when(F.col("outcome").isin("insert", "update"), new).otherwise(keep)
        out.append(value.cast(store.schema[c].dataType).alias(c))
    return j.select(*out, "outcome")


def put_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Typed links, one a (source, relationship, target); the newest row wins."""
    both = links.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    rest = [c for c in links.columns if c not in ("source", "relationship", "target")]
    one = both.groupBy("source", "relationship", "target").agg(F.max_by(F.struct(F.lit(1).alias("__x"), *rest), "__n").alias("v"))
    return one.select("source", "relationship", "target", *[F.col(f"v.{c}") for c in rest])


def links_from(links: DataFrame, records: DataFrame, source) -> DataFrame:
    return links.filter(F.col("source") == source).join(records, F.col("target") == records["id"]).select("relationship", records["*"])


def apply_retention(records: DataFrame, policies: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Ids to remove, children first: expired rows and rows older than their exact workspace's policy (kind null: all kinds)."""
    live = records.filter(F.col("tombstoned_at_ms").isNull())
    expired = live.filter(F.col("expires_at_ms") <= now_ms).select("id")
    p = policies.filter("enabled").select("workspace_key", F.col("kind").alias("k"), "retain_for_ms")
    aged = live.join(F.broadcast(p), "workspace_key").filter((F.col("k").isNull() | (F.col("k") == F.col("kind"))) & (F.col("updated_at_ms") < now_ms - F.col("retain_for_ms"))).select("id")
    out = live.join(expired.unionByName(aged).distinct(), "id", "left_semi").select("id", F.col("parent_id").isNotNull().alias("child"), "updated_at_ms")
    # children of removed parents go with them
    kids = live.join(out.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", F.lit(True).alias("child"), "updated_at_ms")
    every = out.unionByName(kids).groupBy("id").agg(F.max("child").alias("child"), F.max("updated_at_ms").alias("updated_at_ms"))
    return every if limit is None else every.orderBy(F.desc("child"), "updated_at_ms", "id").limit(limit)


def tombstone(records: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    """Marks the ids: one revision more and the time of removal; marked rows stay as they are."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    fresh = F.col("__hit") & F.col("tombstoned_at_ms").isNull()
    return records.join(hit, "id", "left").withColumns({"revision": F.when(fresh, F.col("revision") + 1).otherwise(F.col("revision")), "tombstoned_at_ms": F.when(fresh, F.lit(now_ms)).otherwise(F.col("tombstoned_at_ms"))}).drop("__hit")


def purge(records: DataFrame, before_ms: int, limit: int | None = None) -> DataFrame:
    """The records without tombstones older than `before_ms`, children first when limited."""
    old = records.filter(F.col("tombstoned_at_ms") < before_ms)
    if limit is not None:
        old = old.orderBy(F.col("parent_id").isNull(), "tombstoned_at_ms", "id").limit(limit)
    return records.join(old.select("id"), "id", "left_anti")


def _active_contents(claims: DataFrame, key: list[str], most: int) -> DataFrame:
    """Each active content of a key with its first `most` ids, cut before they are collected, and the lowest of them."""
    active = claims.filter(F.col("state") == "active").withColumn("__i", F.row_number().over(W.partitionBy(*key, "content").orderBy(F.asc_nulls_last("id"))))
    return active.filter(F.col("__i") <= most).groupBy(*key, "content").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("low"))


def contradictions(claims: DataFrame, most: int | None = 8) -> DataFrame:
    """Claims against active ones of the same workspace, scope, type and subject with other content, `most` a claim (all, if None).

    Only the first most + 1 distinct contents of a group can be listed, so a group is cut to these before the join.
    """
    key = ["workspace_id", "scope", "claim_type", "subject"]
    if most is None:
        other = claims.filter(F.col("state") == "active").select(*key, F.col("content").alias("other_content"), F.col("id").alias("other_id"))
        return claims.join(other, key).filter((F.col("content") != F.col("other_content")) & (F.col("id") != F.col("other_id"))).select("id", "other_id", *key)
    active = _active_contents(claims, key, most)
    # a claim agrees with one content at most, so the first ids among most + 1 contents are enough
    near = active.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy("low"))).filter(F.col("__r") <= most + 1)
    other = near.select(*key, F.col("content").alias("other_content"), F.explode(F.slice("ids", 1, most)).alias("other_id"))
    j = claims.join(other, key).filter((F.col("content") != F.col("other_content")) & (F.col("id") != F.col("other_id")))
    r = F.row_number().over(W.partitionBy("id").orderBy("other_id"))
    return j.withColumn("__r", r).filter(F.col("__r") <= most).select("id", "other_id", *key)


def drifted(listing: DataFrame, cursors: DataFrame) -> DataFrame:
    """A row for each id updated past its scope's stored watermark, with the new one; a scope without any has one row of null id."""
    j = listing.join(F.broadcast(cursors.select("scope", "watermark")), "scope")
    past = (F.col("updated_at_ms") > F.col("watermark")) & F.col("id").isNotNull()
    marks = j.groupBy("scope").agg(F.greatest(F.max("updated_at_ms"), F.max("watermark")).alias("watermark"), F.count_if(past).alias("n"))  # no more rows than cursors
    rows = j.filter(past).select("scope", "id").join(F.broadcast(marks.select("scope", "watermark")), "scope")
    return rows.unionByName(marks.filter("n = 0").select("scope", F.lit(None).cast(listing.schema["id"].dataType).alias("id"), "watermark"))


def search_records(records: DataFrame, needle: str, scopes: list[str], limit: int | None = None, offset: int = 0, max_bytes: int | None = None, prefix_bytes: int | None = None) -> DataFrame:
    """Records of the scopes that hold the needle in any case, with their first line that isn't blank, by (scope, origin, path).

    With prefix_bytes also the start of the text, `content`, in at most so many bytes of whole characters.
    """
    hit = (records if max_bytes is None else records.filter(F.octet_length("text") <= max_bytes)).filter(F.col("scope").isin(scopes) & F.contains(F.lower("text"), F.lower(F.lit(needle))))
    first = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    content = [] if prefix_bytes is None else [utf8_prefix(F.col("text"), prefix_bytes).alias("content")]
    out = hit.select("scope", "origin", "path", F.trim(first).alias("summary"), *content).orderBy("scope", "origin", "path").offset(offset)
    return out if limit is None else out.limit(limit)


def export_records(records: DataFrame, scope: str, path: str) -> None:
    records.filter(F.col("scope") == scope).write.mode("overwrite").json(path)


def import_records(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that weren't imported before, by (original id, payload hash), under new ids, with their state."""
    new = incoming.dropDuplicates(["id", "payload_hash"]).withColumnRenamed("id", "original_id")
    fresh = new.join(store.select("original_id", "payload_hash"), ["original_id", "payload_hash"], "left_anti")
    return fresh.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "original_id", "payload_hash"), 256), 1, 24))


# The steps a claim may take.
CLAIM_STEPS = {"proposed": ("validated", "rejected", "tombstoned"), "validated": ("active", "rejected", "tombstoned"), "active": ("superseded", "tombstoned")}


def next_state(state: str, step: str) -> tuple[str, bool]:
    """The state after a step, and whether the step was allowed."""
    ok = step in CLAIM_STEPS.get(state, ())
    return (step if ok else state), ok


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    state, refused = "proposed", 0
    for step in rows.sort_values("seq")["to_state"]:
        state, ok = next_state(state, step)
        refused += not ok
    return pd.DataFrame({"claim_id": [rows["claim_id"].iloc[0]], "state": [state], "refused": [refused]})


def fold_claims(events: DataFrame) -> DataFrame:
    """Each claim's state after its steps in order, from proposed; a refused step leaves the state. One claim's steps are few."""
    return events.select("claim_id", "seq", "to_state").groupBy("claim_id").applyInPandas(_fold, f"claim_id {dict(events.dtypes)['claim_id']}, state string, refused long")
