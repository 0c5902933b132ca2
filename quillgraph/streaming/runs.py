"""Run events as a stream: latest state per run, progress until the run ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.runs import latest_per_key

TERMINAL = ("SUCCEEDED", "FAILED")


def run_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Run events that arrive as Parquet files in a folder; a path to one file reads that file of its folder."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.getFileSystem(conf).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(folder)


def latest_states(events: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last event of each key so far: last write wins. The state is one row per key."""
    return events.groupBy(*keys).agg(F.max(F.col(order)).alias(order), *(F.max_by(v, order).alias(v) for v in values))


def progress_stream(events: DataFrame, name: str, keys: list[str], order: str, values: list[str], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Start a query that keeps the in-memory table `name` of latest states up to date, for watching a run table of bounded size;
    without an interval it drains what is there and stops. For logs of any size there is upsert_stream()."""
    writer = latest_states(events, keys, order, values).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def upsert_stream(events: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append events of each batch to a log, one row per key and batch; the reader takes the latest. Replayed batches overwrite themselves."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def still_running(states: DataFrame, status: str = "status") -> DataFrame:
    return states.filter(~F.col(status).isin(*TERMINAL))


def ended_runs(events: DataFrame, timeout: int, delay: str = "0 seconds") -> DataFrame:
    """(key, run, started, ended, status, n): a row per run of a stream of events (key, at, status), once it has ended.

    A key's first event starts its run 1. An event whose status is terminal ends the run; so does silence: `timeout` seconds of event time
    after a run's last event it is TIMED_OUT, told by a timer as soon as the watermark is past that time, or by the next event.
    The next event then starts another run. The state of a key is one row, whatever its number of events; a batch's events of a key are
    sorted by time, so a batch should be bounded (files_per_trigger). Events later than the watermark are dropped.
    """
    limit = timeout * 1_000_000

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, started, last, n, is_open = state.get if state.exists else (0, 0, 0, 0, False)
        out: list[tuple] = []

        def end(at: int, status: str) -> None:
            nonlocal is_open
            out.append((key[0], run, started, at, status, n))
            is_open = False

        if state.hasTimedOut:
            end(last + limit, "TIMED_OUT")
        else:
            seen = pd.concat([b[["micros", "status"]] for b in batches]).sort_values("micros", kind="stable")
            for at, status in zip(seen["micros"].tolist(), seen["status"].tolist(), strict=True):
                if is_open and at - last > limit:
                    end(last + limit, "TIMED_OUT")
                if not is_open:
                    run, started, n, is_open = run + 1, at, 0, True
                last, n = max(last, at), n + 1
                if status in TERMINAL:
                    end(at, status)
            if is_open and last + limit < state.getCurrentWatermarkMs() * 1000:
                end(last + limit, "TIMED_OUT")
        state.update((run, started, last, n, is_open))
        if is_open:
            state.setTimeoutTimestamp(-(-(last + limit) // 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "run", "started", "ended", "status", "n"])

    timed = events.withWatermark("at", delay).select("key", "at", "status", F.unix_micros("at").alias("micros"))
    schema = f"key {events.schema['key'].dataType.simpleString()}, run long, started long, ended long, status string, n long"
    found = timed.groupBy("key").applyInPandasWithState(follow, schema, "run long, started long, last long, n long, is_open boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("started", F.timestamp_micros("started")).withColumn("ended", F.timestamp_micros("ended"))


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there into Parquet at `path`; its own log makes repeated batches appear once."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StateLog:
    """What upsert_stream() writes: a table for each batch and, after compact(), one of the latest rows up to some batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str) -> None:
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, list(keys), order

    def _fs(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _numbers(self, name: str) -> list[int]:
        """The numbers of complete tables `name=<number>`."""
        fs, path = self._fs(self.path)
        if not fs.exists(path):
            return []
        found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith(f"{name}=")]
        whole = [f for f in found if fs.exists(self._fs(f"{f}/_SUCCESS")[1])]
        return sorted(int(f.getName().partition("=")[2]) for f in whole)

    def latest(self) -> DataFrame:
        """The last row of each key: of the last compacted table and the batches after it."""
        upto = max(self._numbers("upto"), default=-1)
        parts = [f"{self.path}/upto={upto}"] if upto >= 0 else []
        parts += [f"{self.path}/batch={n}" for n in self._numbers("batch") if n > upto]
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return latest_per_key(rows, self.keys, self.order)

    def compact(self) -> None:
        """Write the latest rows as one table and delete what it stands for. If it breaks off, readers see what they saw, and it can run again."""
        batches, before = self._numbers("batch"), self._numbers("upto")
        if not batches:
            return
        upto = max(batches)
        if upto not in before:
            self.latest().write.mode("overwrite").parquet(f"{self.path}/upto={upto}")
        for folder in (*(f"upto={n}" for n in before if n < upto), *(f"batch={n}" for n in batches)):
            fs, path = self._fs(f"{self.path}/{folder}")
            fs.delete(path, True)
