"""Arrival-order window and duplicate check as keyed stream state."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerwatch.config import STATE_TTL_MS, WINDOW_MS
from ledgerwatch.functions.times import epoch_ms
from ledgerwatch.operators import arrival
from ledgerwatch.operators.arrival import RecentEntries
from ledgerwatch.schemas import AMOUNT

# The worker that prepares the state on the driver does not see shipped files, so the
# processor and what it uses travel inside the plan.
for _module in (arrival, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

OUT_SCHEMA = (
    "user_id string, event_id string, payload string, "
    "window_count long, window_sum decimal(38,12), duplicate boolean"
)
OUT_ROW = Row(*[field.split()[0] for field in OUT_SCHEMA.split(", ")])
# Ids of one value of the state, and values of a user that are read whole.
LEAST_PACK, MOST_PACK, MOST_PACKS = 8, 1024, 8
PACKS = "seen_packs"
PAYLOAD_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@dataclass(frozen=True)
class StateConfig:
    """``ttl_ms``: wall-clock life of a window entry, renewed when it is written again.
    ``seen_ttl_ms``: how long a scored id is remembered; 0 keeps it for good."""

    window_ms: int = WINDOW_MS
    ttl_ms: int = STATE_TTL_MS
    seen_ttl_ms: int = 24 * 60 * 60 * 1000


def in_order(rows: Iterator[Row]) -> list[Row]:
    """Rows of a user in order of arrival."""
    return sorted(rows, key=lambda row: (row.partition_no, row.offset_no))


class ArrivalWindowProcessor(StatefulProcessor):
    """Per user: live window entries (id -> time, amount) and ids already scored.

    A repeated id is flagged before the window is touched. Rows of a micro-batch are taken in
    (partition, offset) order; a micro-batch is bounded by the source's per-trigger limit.
    Rows are tuples, not data frames: most users have few of them in a micro-batch.

    A call to the state costs more than an event, so scored ids go into packs of many where a
    micro-batch has many of a user. Packs are read whole, so a user has ``MOST_PACKS`` at most;
    other ids are entries of their own, looked up singly.
    """

    def __init__(self, config: StateConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState(
            "entries", "event_id string", "ms long, amount decimal(38,12)", self.config.ttl_ms
        )
        self.seen = handle.getMapState(
            "seen", "event_id string", "flag boolean", self.config.seen_ttl_ms or None
        )
        self.packs = handle.getMapState(
            PACKS, "pack_no int", "ids string", self.config.seen_ttl_ms or None
        )

    def handleInputRows(
        self, key: Any, rows: Iterator[Row], timerValues: Any
    ) -> Iterator[Row]:
        window = RecentEntries(self.config.window_ms)
        where: dict[str, int] = {}
        stored: set[str] = set()
        for (event_id,), (at, amount) in self.entries.iterator():
            window.add(event_id, at, amount)
            where[event_id] = at
            stored.add(event_id)
        packs = {no: json.loads(ids) for (no,), (ids,) in self.packs.iterator()}
        packed = {event_id for ids in packs.values() for event_id in ids}
        single = self.seen.exists()
        fresh: set[str] = set()
        out = []
        for row in in_order(rows):
            event_id, at, amount, payload = row.event_id, row.ms, row.amount, row.payload
            if (
                event_id in fresh
                or event_id in packed
                or (single and self.seen.containsKey((event_id,)))
            ):
                out.append(OUT_ROW(key[0], event_id, payload, None, None, True))
                continue
            fresh.add(event_id)
            if event_id in where:
                window.remove(event_id, where.pop(event_id))
            if amount is not None:
                window.add(event_id, at, amount)
                where[event_id] = at
            for gone in window.evict_before(at - self.config.window_ms):
                where.pop(gone, None)
            out.append(OUT_ROW(key[0], event_id, payload, *window.up_to(at), False))
        live = {entry_id: amount for entry_id, amount in window.items[window.head :]}
        for event_id in stored - where.keys():
            self.entries.removeKey((event_id,))
        for event_id in where.keys() & fresh:
            self.entries.updateValue((event_id,), (where[event_id], live[event_id]))
        self._remember(list(fresh), packs.keys())
        yield from out

    def _remember(self, ids: list[str], taken: Iterable[int]) -> None:
        for no in sorted(set(range(MOST_PACKS)) - set(taken)):
            if len(ids) < LEAST_PACK:
                break
            self.packs.updateValue((no,), (json.dumps(ids[:MOST_PACK]),))
            ids = ids[MOST_PACK:]
        for event_id in ids:
            self.seen.updateValue((event_id,), (True,))

    def close(self) -> None:
        pass


def arrival_window_stream(events: DataFrame, config: StateConfig | None = None) -> DataFrame:
    """Window columns and the duplicate flag per event, in one stateful pass keyed by user.

    No watermark is set, so late events are answered from whatever state is left. The rest of
    the row travels through the operator as one text and is parsed again behind it.
    """
    narrow = events.select(
        "user_id",
        "event_id",
        F.col("partition_no").cast("long").alias("partition_no"),
        F.col("offset_no").cast("long").alias("offset_no"),
        epoch_ms(F.col("event_time")).alias("ms"),
        F.col("amount").cast(AMOUNT).alias("amount"),
        F.to_json(F.struct(*events.columns), PAYLOAD_TIMES).alias("payload"),
    )
    answered = narrow.groupBy("user_id").transformWithState(
        statefulProcessor=ArrivalWindowProcessor(config or StateConfig()),
        outputStructType=OUT_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    row = F.from_json("payload", events.schema, PAYLOAD_TIMES)
    return answered.select(
        row.alias("__row"), "window_count", "window_sum", "duplicate"
    ).select("__row.*", "window_count", "window_sum", "duplicate")


def stored_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a stopped stream's state holds, as a table read from its checkpoint: user_id,
    event_id, the value's fields, and ``expires_ms``, the wall-clock end of the entry's life
    (absent from state that lives for good). ``name`` is ``entries`` or ``seen``. Entries past
    their life are not there for the stream, whether or not they were swept already."""
    rows = _stored_map(spark, checkpoint, name)
    if name != "seen":
        return rows
    ids = F.explode(F.from_json("ids", "array<string>")).alias("event_id")
    packs = _stored_map(spark, checkpoint, PACKS).withColumn("flag", F.lit(True))
    packs = packs.select("user_id", ids, *rows.columns[2:])
    return rows.unionByName(packs)


def _stored_map(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    state = (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("stateVarName", name)
        .load()
    )
    value = "user_map_value.value" if "value" in state.schema["user_map_value"].dataType.names else "user_map_value"
    columns = ["key.user_id", "user_map_key.*", f"{value}.*"]
    if value != "user_map_value":
        columns.append("user_map_value.ttlExpirationMs as expires_ms")
    return state.selectExpr(*columns)
