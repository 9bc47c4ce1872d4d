"""Continuous input: streams of log files, event-time windows, sessions, ordered batches, live templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.tables import new_path
from ..functions.times import interval
from ..operators.folding import Cluster, Leaf
from ..sources import parsers

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk beside the executors instead of in their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a folder's lines; new files are picked up as they come."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).where("value <> ''")


def read_records(spark: SparkSession, path: str, format: str = "json", files_per_trigger: int | None = None, **options) -> DataFrame:
    """A stream of parsed records; lines that do not fit are dropped."""
    lines = read_lines(spark, path, files_per_trigger)
    return lines.select(parsers.parser(format)(F.col("value"), **options).alias("r")).where("r is not null").select("r.*")


def read_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(df: DataFrame, column: str = "ts", late: str | None = "1h") -> DataFrame:
    """df with its NTZ time as TIMESTAMP (the session's zone must be UTC), watermarked."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, f"{int(interval(late).total_seconds())} seconds") if late else out


def _size(text: str) -> str:
    return f"{int(interval(text).total_seconds())} seconds"


def window_counts(df: DataFrame, column: str = "ts", every: str = "1h", slide: str | None = None, by: list[str | Column] = ()) -> DataFrame:
    """Counts of tumbling (or, with slide, sliding) windows; window_start is NTZ again."""
    w = F.window(column, _size(every), _size(slide)) if slide else F.window(column, _size(every))
    out = df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")


def sessions(df: DataFrame, column: str = "ts", gap: str = "30m", by: str = "user_id") -> DataFrame:
    """Sessions per key that end after a gap: start, end, rows."""
    out = df.groupBy(F.session_window(column, _size(gap)).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def run_once(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Everything there is now, into the in-memory table name."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def for_each_batch(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Micro-batches to callback, in order; each batch number comes once, also after a restart."""
    writer = df.writeStream.outputMode(mode).foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_files(df: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    return df.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_CLUSTER = "text string, places string, first bigint"
_LIVE = "id bigint, leaf string, number int, template string"


class LeafState(StatefulProcessor):
    """A leaf's clusters as a map state, an entry a cluster: a batch writes those that it made or changed, no others.

    With expiry, a leaf that gets no line for so long is forgotten by a timer; its next line starts anew.
    """

    def __init__(self, threshold: float, expiry: int | None):
        self.threshold, self.expiry = threshold, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clusters = handle.getMapState("clusters", "number int", _CLUSTER)

    def _leaf(self) -> Leaf:
        leaf = Leaf(self.threshold)
        for (number,), (text, places, first) in sorted(self.clusters.iterator(), key=lambda kv: kv[0][0]):
            c = Cluster(number, text.split(" "), first)
            c.params = {int(p) for p in places.split(",") if p}
            c.note()
            leaf.clusters.append(c)
        return leaf

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values("id")
        leaf = self._leaf()
        ids = lines["id"].tolist()
        numbers, texts, _, changing = leaf.fold([" ".join(t) for t in lines["tokens"]], ids)
        for number in sorted({numbers[i] for i in changing}):
            c = leaf.clusters[number]
            self.clusters.updateValue((number,), (c.text, c.places, int(c.first)))
        if self.expiry is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expiry)
        yield pd.DataFrame({"id": ids, "leaf": key[0], "number": pd.Series(numbers, dtype="int32"), "template": texts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clusters.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_templates(lines: DataFrame, threshold: float = 0.5, expiry: str | None = None) -> DataFrame:
    """Templates of a stream of (id, leaf, tokens): id, leaf, number, template at parse time.

    Each leaf's clusters are its state, on disk (use_rocksdb is needed).  Leaves come from the caller
    (templates.leaves needs all lines for its caps; a stream uses a snapshot of kept keys), so caps on a stream are
    approximate.  expiry is for streams that run on: a batch may come at any time then, so they do not end by
    themselves.  Lines of one batch are taken in the order of id; a leaf's lines of a batch are one task.
    """
    size = None if expiry is None else int(interval(expiry).total_seconds() * 1000)
    mode = "none" if size is None else "processingTime"
    return lines.select("id", "leaf", "tokens").groupBy("leaf").transformWithStateInPandas(LeafState(threshold, size), _LIVE, "append", mode)


def collected(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what there is now, in a table of the shared folder.

    A complete result replaces the one before it, a batch at a time; appended batches are kept beside each other.
    """
    path = new_path(df.sparkSession, label)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure writes its own folder again
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    for_each_batch(df, keep, new_path(df.sparkSession, f"{label}-checkpoint"), mode).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
