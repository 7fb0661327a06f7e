"""Stateful operators with a state store: a key's state outlives micro-batches and restarts.

Both fold the rows of a key in the order of `seq`; a row that isn't above the last one folded is a repeat and changes nothing,
so that a replayed batch is harmless. Rows must come in that order from batch to batch, as from a log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyloom.operators.records import next_state

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame], after: int | None) -> pd.DataFrame:
    """A key's rows of one batch by seq, without those folded before and without repeats."""
    own = pd.concat(list(rows), ignore_index=True)
    own = own if after is None else own[own["seq"] > after]
    return own.drop_duplicates("seq").sort_values("seq")


class ClaimProcessor(StatefulProcessor):
    """(claim_id, seq, to_state): the state of each claim, how many steps it refused, and the last step's seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claim = handle.getValueState("claim", "state string, refused long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, refused, last = self.claim.get() if self.claim.exists() else ("proposed", 0, None)
        own = _in_order(rows, last)
        if own.empty:
            return
        for step in own["to_state"]:
            state, ok = next_state(state, step)
            refused += not ok
        last = int(own["seq"].iloc[-1])
        self.claim.update((state, refused, last))
        yield pd.DataFrame({"claim_id": [key[0]], "state": [state], "refused": [refused], "last": [last]})

    def close(self) -> None:
        pass


class CursorProcessor(StatefulProcessor):
    """(scope, seq, event_id, updated_at_ms, generation, durable): each scope's cursor.

    The last event is the one of the newest update time, the watermark never falls, and only durable events count as persisted.
    A new connection generation starts its count of rows anew; rows of an older one still advance the rest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "last_event_id string, watermark long, generation long, of_generation long, persisted long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        event, mark, generation, own_rows, persisted, last = self.cursor.get() if self.cursor.exists() else (None, None, None, 0, 0, None)
        own = _in_order(rows, last)
        if own.empty:
            return
        newest = own.sort_values(["updated_at_ms", "event_id"]).iloc[-1]
        if mark is None or (int(newest["updated_at_ms"]), str(newest["event_id"])) > (mark, event):
            event, mark = str(newest["event_id"]), int(newest["updated_at_ms"])
        top = int(own["generation"].max())
        if generation is None or top > generation:
            generation, own_rows = top, 0
        own_rows += int((own["generation"] == generation).sum())
        persisted += int(own["durable"].sum())
        last = int(own["seq"].iloc[-1])
        self.cursor.update((event, mark, generation, own_rows, persisted, last))
        yield pd.DataFrame({"scope": [key[0]], "last_event_id": [event], "watermark": [mark], "generation": [generation], "of_generation": [own_rows], "persisted": [persisted], "last": [last]})

    def close(self) -> None:
        pass


def claim_stream(events: DataFrame) -> DataFrame:
    """The claims that a micro-batch changed: claim_id, state, refused, last. For update mode and `start_stateful`."""
    own = events.select("claim_id", "seq", "to_state")
    return own.groupBy("claim_id").transformWithStateInPandas(ClaimProcessor(), f"claim_id {dict(events.dtypes)['claim_id']}, state string, refused long, last long", "Update", "None")


def cursor_stream(events: DataFrame) -> DataFrame:
    """The cursors that a micro-batch moved: scope, last_event_id, watermark, generation, of_generation, persisted, last."""
    own = events.selectExpr("scope", "seq", "cast(event_id AS string) AS event_id", "cast(updated_at_ms AS long) AS updated_at_ms", "cast(generation AS long) AS generation", "durable")
    return own.groupBy("scope").transformWithStateInPandas(CursorProcessor(), f"scope {dict(events.dtypes)['scope']}, last_event_id string, watermark long, generation long, of_generation long, persisted long, last long", "Update", "None")


def start_stateful(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query of stateful operators; their state store is set for it alone. Without a trigger it runs to the input's end."""
    conf = df.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return df.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
