"""Keyed state in a stream: results that must agree, and requests that close.

Both run as ``transformWithState`` on a RocksDB store, which keeps a key's state
on the executor's disk and in the checkpoint, so that memory follows the keys of
a batch and not all keys.

``Agreed`` keeps a digest of each key's row.  The row that comes first goes
on; the same row again is dropped; another one under the key fails the batch,
before it is committed, now or after any number of restarts.

``Latency`` gathers the events of a request into sessions, those at most
``quiet`` apart being one, and gives a row when a session is over: once the
watermark has passed the end of its quiet time.  The watermark is the latest
event time less ``late``; events behind it come too late, are counted and change
no row that has been given.  In any other order events give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Stateful processors need RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


#: How a row passes through Python: as text that comes back as it was.
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Agreed(StatefulProcessor):
    """One row a key; rows of a key that differ are an error."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001  Spark's names
        known = self.seen.get()[0] if self.seen.exists() else None
        for batch in rows:
            for digest, row in zip(batch["digest"], batch["row"], strict=True):
                if known is None:
                    known = digest
                    self.seen.update((known,))
                    yield pd.DataFrame({"row": [row]})
                elif digest != known:
                    raise ValueError(f"conflicting rows for key {key[0]}")

    def close(self) -> None:
        pass


def agreed(rows: DataFrame, key: str) -> DataFrame:
    """rows of a stream, one a key; a row that differs from one that its key has
    had fails the stream.  A null key is an error too."""
    with_state_store(rows.sparkSession)
    null = F.raise_error(F.lit(f"row without {key}")).cast("boolean")
    whole = F.to_json(F.struct(*rows.columns), _JSON)
    told = rows.where(F.when(F.col(key).isNull(), null).otherwise(True)).select(F.col(key).alias("key"), whole.alias("row")).withColumn("digest", F.sha2(F.col("row").cast("binary"), 256))
    first = told.groupBy("key").transformWithStateInPandas(Agreed(), "row string", "Append", "None")
    return first.select(F.from_json("row", rows.schema, _JSON).alias("r")).select("r.*")


def ingest_agreed(spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, key: str, files_at_once: int | None = None) -> int:
    """Appends the rows of JSON-lines files that haven't been read yet to a
    Parquet log, one row a key, and gives how many batches had input."""
    with_state_store(spark)
    stream = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    return sum(p["numInputRows"] > 0 for p in _finished(agreed(stream.json(source), key), log, checkpoint))


def _finished(rows: DataFrame, log: str, checkpoint: str) -> list:
    """Progress of the batches that took what there was."""
    started = rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return list(started.recentProgress)


SESSION = "queued_us long, first_us long, finish_us long, events long"


def merged(sessions: list[tuple], quiet_us: int) -> list[tuple]:
    """(queued, first, finish, events) of sessions, those at most quiet apart
    made one."""
    out: list[tuple] = []
    for s in sorted(sessions, key=lambda s: s[0]):
        if out and s[0] - out[-1][2] <= quiet_us:
            queued, first, finish, events = out[-1]
            firsts = [x for x in (first, s[1]) if x is not None]
            out[-1] = (queued, min(firsts, default=None), max(finish, s[2]), events + s[3])
        else:
            out.append(s)
    return out


class Latency(StatefulProcessor):
    """Gathers the events of a key into sessions until their time is over."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SESSION)

    def _keep(self, sessions: list[tuple]) -> None:
        """Stores open sessions, with a timer for the one that is over first."""
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(min(self._due(s) for s in sessions))
        else:
            self.open.clear()

    def _due(self, session: tuple) -> int:
        return -(-session[2] // 1000) + self.quiet_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        sessions = [tuple(s) for s in self.open.get()]
        for batch in rows:
            new = [(t, t if opens else None, t, 1) for t, opens in zip(batch["us"].tolist(), batch["opens"].tolist(), strict=True)]
            sessions = merged(sessions + new, 1000 * self.quiet_ms)
        self._keep(sessions)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        now = timerValues.getCurrentWatermarkInMs()
        sessions = [tuple(s) for s in self.open.get()]
        over = [s for s in sessions if self._due(s) <= now]
        self._keep([s for s in sessions if self._due(s) > now])
        if over:
            columns = list(zip(*over, strict=True))
            yield pd.DataFrame({"request": [str(key[0])] * len(over), "queued_us": columns[0], "first_us": pd.array(columns[1], "Int64"), "finish_us": columns[2], "events": columns[3]})

    def close(self) -> None:
        pass


def latencies(events: DataFrame, request: str, ts: str, opens: Column, quiet_ms: int, late: str) -> DataFrame:
    """(request, queued_us, first_us, finish_us, events, ttft_us, decode_us,
    e2e_us) of a stream's requests, each given once: when the watermark is
    quiet_ms past its last event.  ``opens`` marks events that can be the first
    answer; without any, ttft and decode are null.  Events without a request or
    time are left out."""
    with_state_store(events.sparkSession)
    known = events.where(F.col(request).isNotNull() & F.col(ts).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rows = known.select(F.col(request).cast("string").alias("request"), "_ts", F.unix_micros("_ts").alias("us"), F.coalesce(opens, F.lit(False)).alias("opens"))
    out = rows.groupBy("request").transformWithStateInPandas(Latency(quiet_ms), f"request string, {SESSION}", "Append", "EventTime")
    return out.withColumns({"ttft_us": F.col("first_us") - F.col("queued_us"), "decode_us": F.col("finish_us") - F.col("first_us"), "e2e_us": F.col("finish_us") - F.col("queued_us")})


def run_latencies(spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, request: str, ts: str, opens: Column, quiet_ms: int, late: str, files_at_once: int | None = None) -> int:
    """Reads Parquet files that haven't been read yet and appends the requests
    that are over to a Parquet log; gives how many events came too late."""
    stream = spark.readStream.schema(schema)
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    rows = latencies(stream.parquet(source), request, ts, opens, quiet_ms, late)
    return sum(op["numRowsDroppedByWatermark"] for p in _finished(rows, log, checkpoint) for op in p["stateOperators"])
