"""Alias lookup by event time on two streams: each request gets the version that its alias had at the request's own instant.

Requests and alias events meet in keyed state. A request waits there until the watermark of both streams has passed its time, for only
then every event that could matter is known; a timer then answers it, and events that no later request can ask about are folded into
one base version per key. A promotion between two requests of one batch splits them, whatever order they arrive in.

A state key is a bucket of many (model, alias), and rows travel and wait as packed column batches, so Python works on columns and not on
rows or keys. A bucket remembers the watermark of the last batch, below which rows are late; all buckets are there from the first batch on.

The watermark follows the slower stream. A quiet alias stream holds answers back, so it should carry a heartbeat: a row without a model,
whose time alone counts. Requests without a model or a time are not answered. Rows that come after the watermark are late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from relyard.streaming.jobs import append_to

#: Python state lives in RocksDB, whose stores share a bound of memory in each executor; set while the job starts.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
ANSWER = "request_id bigint, model_name string, alias string, ts timestamp, version bigint"

EVENT, REQUEST = 0, 1
_OWNER = [("model_name", pa.string()), ("alias", pa.string()), ("at", pa.int64())]
#: Columns of packed rows; times in microseconds.
ROWS = {EVENT: pa.schema([*_OWNER, ("seq", pa.int64()), ("version", pa.int64())]), REQUEST: pa.schema([*_OWNER, ("request_id", pa.int64())])}
#: Bytes of rows that a task packs at once, and rows of a packed batch in the state.
HELD_BYTES, PACKED_ROWS = 8 << 20, 65_536


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """A number per distinct value, null being one, and how many there are."""
    coded = values.combine_chunks().dictionary_encode()
    return coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary) + 1


def _numbers(values: pa.ChunkedArray) -> np.ndarray:
    return values.fill_null(np.iinfo(np.int64).min).to_numpy()


def resolved(known: pa.Table, requests: pa.Table) -> tuple[pa.ChunkedArray, pa.Table]:
    """The version of each request, and the last of the known events per (model, alias).

    An event at the instant of a request counts, and equal instants go by seq, then by version; nulls come first.
    """
    known = known.take(np.lexsort((_numbers(known["version"]), _numbers(known["seq"]))))
    both = [pa.chunked_array([*known[c].chunks, *requests[c].chunks], ROWS[EVENT].field(c).type) for c in ("model_name", "alias", "at")]
    (model, _), (alias, aliases) = _codes(both[0]), _codes(both[1])
    key = model * aliases + alias
    # Events stand before requests and in their order, and the sort is stable.
    order = np.lexsort((both[2].to_numpy(), key))
    is_event = order < len(known)
    last = np.maximum.accumulate(np.where(is_event, np.arange(len(order)), -1))
    event = np.where((last >= 0) & (key[order[last]] == key[order]), order[last], -1)
    found = np.empty(len(requests), np.int64)
    found[order[~is_event] - len(known)] = event[~is_event]
    events = order[is_event]
    newest = events[np.append(key[events][1:] != key[events][:-1], True)] if len(events) else events
    return known["version"].take(pa.array(found, mask=found < 0)), known.take(newest)


def answer(base: tuple | None, events: list[tuple], requests: list[tuple], upto: int) -> tuple[tuple | None, list, list, list]:
    """One key in plain values: the requests (ts, id) with ts <= upto with their versions, the new base, and what is left of both lists.

    Events and base are (ts, seq, version).
    """
    due = sorted(r for r in requests if r[0] <= upto)
    known = [*([base] if base else []), *(e for e in events if e[0] <= upto)]
    table = lambda kind, rows: pa.table([*zip(*rows)], ROWS[kind]) if rows else ROWS[kind].empty_table()
    versions, newest = resolved(table(EVENT, [("", None, *e) for e in known]), table(REQUEST, [("", None, *r) for r in due]))
    base = next(zip(*(newest[c].to_pylist() for c in ("at", "seq", "version"))), None)
    out = [(request_id, ts, version) for (ts, request_id), version in zip(due, versions.to_pylist())]
    return base, out, [e for e in events if e[0] > upto], [r for r in requests if r[0] > upto]


def _packed(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
    """The earliest time and the bytes of each packed batch of rows."""
    for batch in rows.combine_chunks().to_batches(max_chunksize=PACKED_ROWS):
        yield pc.min(batch["at"]).as_py(), batch.serialize().to_pybytes()


def _unpacked(packed: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x), schema) for x in packed], schema)


def _packer(kind: int):
    """Rows of one stream as (bucket, kind, low, rows): one packed batch per bucket and some megabytes. Rows without a model or a time, which
    only move the watermark, end here: a filter in the plan would be moved below the watermark."""
    schema = ROWS[kind]

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        known = pc.and_(table["model_name"].is_valid(), table["at"].is_valid()).to_numpy()
        order = np.argsort(np.where(known, table["bucket"].to_numpy(), -1), kind="stable")[len(known) - known.sum() :]
        if not len(order):
            return
        table = table.take(order).combine_chunks()
        bucket, at = table["bucket"].to_numpy(), table["at"].to_numpy()
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rows = table.select(schema.names).cast(schema).to_batches()[0]
        parts = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts, [*starts[1:], len(bucket)])]
        columns = [pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), kind), pa.int32()), pa.array(np.minimum.reduceat(at, starts)), pa.array(parts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "low", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
        held.clear()
        pa.default_memory_pool().release_unused()

    return pack


class AsOf(StatefulProcessor):
    """State of one bucket: the last watermark, the base event of each key, later events, and waiting requests."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "ms bigint")
        self.base = handle.getListState("base", "low bigint, rows binary")
        self.waiting = {EVENT: handle.getListState("events", "low bigint, rows binary"), REQUEST: handle.getListState("requests", "low bigint, rows binary")}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._passed(0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = self.passed.get()[0] * 1000
        for batch in rows:
            for kind, state in self.waiting.items():
                own = batch[batch["kind"] == kind]
                given = _unpacked([*own["rows"]], ROWS[kind])
                if len(own) and own["low"].min() <= late:
                    given = given.filter(pc.greater(given["at"], late))
                # The store reads a list again with every value that is appended, so values are few.
                if kept := [*_packed(given)]:
                    state.appendList(kept)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        self._passed(upto)
        events, requests = (self._due(kind, upto * 1000) for kind in (EVENT, REQUEST))
        if not events.num_rows and not requests.num_rows:
            return
        base = _unpacked([x[1] for x in self.base.get()], ROWS[EVENT])
        versions, newest = resolved(pa.concat_tables([base, events]), requests)
        if events.num_rows:
            self.base.put([*_packed(newest)])
        for found in requests.append_column("version", versions).combine_chunks().to_batches(max_chunksize=PACKED_ROWS):
            yield found.to_pandas(types_mapper=pd.ArrowDtype)

    def close(self) -> None:
        pass

    def _passed(self, ms: int) -> None:
        """The next timer fires as soon as the watermark has moved on."""
        self.passed.update((ms,))
        self.handle.registerTimer(ms + 1)

    def _due(self, kind: int, upto: int) -> pa.Table:
        """Rows up to a time, which leave the state. Batches that are later as a whole stay packed."""
        held = [tuple(x) for x in self.waiting[kind].get()]
        rows = _unpacked([x for low, x in held if low <= upto], ROWS[kind])
        if rows.num_rows:
            due = pc.less_equal(rows["at"], upto)
            rest = [*((low, x) for low, x in held if low > upto), *_packed(rows.filter(pc.invert(due)))]
            self.waiting[kind].put(rest) if rest else self.waiting[kind].clear()
            rows = rows.filter(due)
        return rows


def answered(requests: DataFrame, events: DataFrame, delay: str, salts: int = 1, buckets: int = 1024) -> DataFrame:
    """(request_id, model_name, alias, ts, version) from streams of requests (request_id, model_name, alias, ts) and events (model_name,
    alias, version, ts, seq); version is null before the first event.

    ``salts`` deals the requests of a hot key to that many tasks; its few events go to each of them. ``buckets`` are the keys of the
    state: a task holds the waiting rows of one at a time. Both stay as they are while a checkpoint lives.
    """
    at = F.unix_micros("ts").alias("at")
    bucket = lambda salt: F.pmod(F.xxhash64("model_name", "alias", salt), F.lit(buckets)).cast("int").alias("bucket")
    packed = "bucket int, kind int, low bigint, rows binary"
    salt = F.pmod(F.xxhash64("request_id"), F.lit(salts)).cast("int")
    asked = requests.withWatermark("ts", delay).select(bucket(salt), "model_name", "alias", at, F.col("request_id").cast("bigint").alias("request_id"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    changed = events.withWatermark("ts", delay).select("*", every).select(
        bucket(F.col("salt")), "model_name", "alias", at, F.col("seq").cast("bigint").alias("seq"), F.col("version").cast("bigint").alias("version")
    )
    both = asked.mapInArrow(_packer(REQUEST), packed).union(changed.mapInArrow(_packer(EVENT), packed))
    first = requests.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).groupBy("bucket")
    found = both.groupBy("bucket").transformWithStateInPandas(
        AsOf(), "model_name string, alias string, at bigint, request_id bigint, version bigint", "Append", "EventTime", first
    )
    return found.select("request_id", "model_name", "alias", F.timestamp_micros("at").alias("ts"), "version")


def answer_to(requests: DataFrame, events: DataFrame, path: str, delay: str, salts: int = 1, buckets: int = 1024) -> DataFrame:
    """Run to the end of both streams; what the watermark has not passed yet stays in the state for the next run."""
    return append_to(answered(requests, events, delay, salts, buckets), path, STATE_SETTINGS)
