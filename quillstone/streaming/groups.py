"""Streams: groups as they become complete and what is left of them, scoring in batches, resumable appends without repeats."""

from __future__ import annotations

import time as time_module
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from quillstone.sources.files import work_path, write_outcomes


def complete_groups(samples: DataFrame, k: int) -> DataFrame:
    """(unique_id, members) as soon as k samples (sample_id, unique_id) of a group have arrived; its state is cleared then.

    A state holds fewer than k ids. Groups that never get k members give no row; see incomplete_groups.
    """

    def collect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held += f["sample_id"].tolist()
            full = len(held) // k * k
            if full:
                yield pd.DataFrame({"unique_id": key[0], "members": [held[i : i + k] for i in range(0, full, k)]})
                held = held[full:]
        if held:
            state.update((held,))
        elif state.exists:
            state.remove()

    return samples.select("sample_id", "unique_id").groupBy("unique_id").applyInPandasWithState(collect, "unique_id long, members array<long>", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def incomplete_groups(samples: DataFrame, emitted: DataFrame) -> DataFrame:
    """(unique_id, n): samples that are in no emitted group, once the stream has ended."""
    given = samples.groupBy("unique_id").agg(F.count("*").alias("n"))
    used = emitted.groupBy("unique_id").agg(F.sum(F.size("members")).alias("used"))
    return given.join(used, "unique_id", "left").select("unique_id", (F.col("n") - F.coalesce("used", F.lit(0))).alias("n")).where("n > 0")


def with_timers(spark: SparkSession) -> None:
    """Timers and expiring state need a state store that has them; one that the session names itself is left alone."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(key):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Gather(StatefulProcessor):
    """Members of one group; a timer runs from the last arrival on."""

    def __init__(self, k: int, wait_ms: int):
        self.k, self.wait_ms = k, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "sample_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        for f in rows:
            held += f["sample_id"].tolist()
            full = len(held) // self.k * self.k
            if full:
                yield pd.DataFrame({"unique_id": key[0], "members": [held[i : i + self.k] for i in range(0, full, self.k)], "complete": True})
                held = held[full:]
        if held:
            self.held.put([(int(x),) for x in held])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        self.held.clear()
        if held:
            yield pd.DataFrame({"unique_id": [key[0]], "members": [held], "complete": [False]})

    def close(self) -> None:
        pass


def timed_groups(samples: DataFrame, k: int, wait_ms: int) -> DataFrame:
    """(unique_id, members, complete): groups of k samples (sample_id, unique_id) as they become complete, and leftovers, complete
    being false, once nothing has arrived for their group for wait_ms; a group that goes on after that begins anew.

    A state holds fewer than k ids and one timer, and is cleared in either case.
    """
    with_timers(samples.sparkSession)
    schema = "unique_id long, members array<long>, complete boolean"
    return samples.select("sample_id", "unique_id").groupBy("unique_id").transformWithStateInPandas(_Gather(k, wait_ms), schema, "append", "ProcessingTime")


class _First(StatefulProcessor):
    """The first row of a key; what tells that it was seen expires."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for f in rows:
            if not known and len(f):
                known = True
                self.seen.update((True,))
                yield f.iloc[:1]

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, key: str, keep_ms: int, time: str | None = None) -> DataFrame:
    """stream without the rows whose key came before: within keep_ms of processing time, or, with a column of event times, within that much of it.

    State of a key expires after that, so that it is bounded by the keys that arrive within the time. With event times the work stays in the
    JVM; of rows that are as late as keep_ms behind the watermark none is kept.
    """
    if time:
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
        return stream.withWatermark(time, f"{keep_ms} milliseconds").dropDuplicatesWithinWatermark([key])
    with_timers(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(_First(keep_ms), stream.schema, "append", "ProcessingTime")


def run_dry(query: StreamingQuery, most_s: float = 600, emptied: bool = False) -> None:
    """Waits until a started query has taken all its input, and with emptied until no state is left; then stops it.

    Queries with timers run on without input, as their timers must fire. Stopping between two batches loses nothing: what is
    committed is in the checkpoint.
    """
    end = time_module.monotonic() + most_s
    while query.isActive:
        last = query.lastProgress
        if last and not last["numInputRows"] and (not emptied or not sum(s["numRowsTotal"] for s in last["stateOperators"])):
            break
        if time_module.monotonic() > end:
            query.stop()
            raise TimeoutError(f"the stream has not settled in {most_s} seconds: {last and last['stateOperators']}")
        time_module.sleep(0.05)
    query.stop()
    if query.exception():
        raise query.exception()


def drained(stream: DataFrame, name: str, timers: bool = False) -> DataFrame:
    """What a stream gives for all input that is there now, written to the shared folder and read back; with timers, until all state has expired."""
    spark, path = stream.sparkSession, work_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start(path)
    if timers:
        run_dry(query, emptied=True)
    else:
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def append_once(stream: DataFrame, key: str, ok: Column, path: str, keep_ms: int | None = None, time: str | None = None) -> None:
    """First rows by key (see first_rows), written to ``path``/batch=n/part=ok and part=failed in one pass over each batch.

    A batch that runs again after a failure replaces its own folder, so that an input that is not deterministic cannot be split in two ways.
    Without keep_ms the state holds every key for good: only for streams whose keys end.
    """

    def put(batch: DataFrame, number: int) -> None:
        write_outcomes(batch, ok, path, f"batch={number}")

    first = first_rows(stream, key, keep_ms, time) if keep_ms else stream.dropDuplicates([key])
    query = first.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start()
    if keep_ms and not time:
        run_dry(query)
    else:
        query.awaitTermination()


def scored_batches(stream: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], size: int) -> DataFrame:
    """stream with the column score; fn gets size rows at a time, and what is left of a task's share of a micro-batch as a shorter last one.

    Stateless: no row waits for a later micro-batch.
    """
    schema = f"{stream.schema.toDDL()}, score double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= size:
                rows = pd.concat(held, ignore_index=True)
                for i in range(0, n // size * size, size):
                    yield _scored(rows.iloc[i : i + size], fn)
                held, n = [rows.iloc[n // size * size :]], n % size
        if n:
            yield _scored(pd.concat(held, ignore_index=True), fn)

    return stream.mapInPandas(run, schema)


def _scored(rows: pd.DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> pd.DataFrame:
    rows = rows.reset_index(drop=True)
    values = fn(rows)
    if len(values) != len(rows):
        raise ValueError(f"{len(values)} values for {len(rows)} rows")
    return rows.assign(score=pd.Series(list(values), dtype="float64"))
