"""Incremental work as streams: log tails, queue states, pages seen once, idempotent merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace import schemas
from millrace.functions import text as T

QUEUE_ROW = "op string, url string, status string, at bigint, error string, seq bigint"


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.LOG_LINES).json(path)


def tail(lines: DataFrame, last: int) -> DataFrame:
    """Lines after a sequence number."""
    return lines.where(F.col("seq") > last)


def retained(lines: DataFrame, most: int = 500) -> DataFrame:
    return lines.orderBy(F.desc("seq")).limit(most)


def keep_last(lines: DataFrame, path: str, most: int = 500):
    """A sink that keeps the newest lines of a stream; a batch that is tried again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/batch={number - 1}"
        held = batch
        if number > 0:
            held = batch.unionByName(spark.read.schema(batch.schema).parquet(before))
        retained(held.dropDuplicates(["seq"]), most).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(merge)


def queue_state(events: DataFrame) -> DataFrame:
    """The latest status of each queued item."""
    whole = F.struct("op", "url", "status", "at", "error")
    return events.groupBy("id").agg(F.max_by(whole, F.struct("at", "seq")).alias("row")).select("id", "row.*")


def waiting(states: DataFrame, most: int = 10) -> DataFrame:
    """The next items, first come first."""
    return states.where("status = 'pending'").orderBy("at", "id").limit(most)


def newest(states: DataFrame, most: int = 50) -> DataFrame:
    return states.orderBy(F.desc("at"), F.desc("id")).limit(most)


def held(states: DataFrame, most: int = 30) -> DataFrame:
    """All items that are not done, and the newest of those that are."""
    return states.where("status NOT IN ('done', 'error')").unionByName(finished(states, most))


def progress(events: DataFrame) -> DataFrame:
    """One row: the phase and page of the latest progress event, with the page's hash; a null phase means idle."""
    last = events.agg(F.max_by(F.struct("phase", "url"), F.struct("at", "seq")).alias("x"))
    return last.select("x.phase", F.when(F.col("x.url").isNotNull(), T.url_hash(F.col("x.url"))).alias("url_hash"), "x.url")


def queue_stream(events: DataFrame, path: str, most: int = 30):
    """A sink that keeps each item's latest state and, of those done, the newest; a batch tried again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, whole = batch.sparkSession, batch
        if number > 0:
            whole = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}"))
        latest = whole.groupBy("id").agg(F.max_by(F.struct(*whole.columns), F.struct("at", "seq")).alias("row")).select("row.*")
        held(latest, most).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(merge)


class Queue(StatefulProcessor):
    """A queue's live items and the newest of those that are done; the state is as large as these are."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "id string", QUEUE_ROW)
        self.done = handle.getMapState("done", "id string", QUEUE_ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.at, r.seq)):
            ident, row = (r.id,), (r.op, r.url, r.status, r.at, r.error, r.seq)
            before = self.live.getValue(ident) or self.done.getValue(ident)
            if before and (before[3], before[5]) > (r.at, r.seq):
                continue  # an older change that comes late
            here, there = (self.done, self.live) if r.status in ("done", "error") else (self.live, self.done)
            here.updateValue(ident, row)
            if there.containsKey(ident):
                there.removeKey(ident)
        # Of those done the newest stay, of equal times the first by id.
        ended = sorted(((k[0], v) for k, v in self.done.iterator()), key=lambda x: (-x[1][3], x[0]))
        for ident, _ in ended[self.most :]:
            self.done.removeKey((ident,))
        held = [(k[0], v) for k, v in self.live.iterator()] + ended[: self.most]
        yield pd.DataFrame([(key[0], ident, *v) for ident, v in held], columns=["queue", "id", "op", "url", "status", "at", "error", "seq"])

    def close(self) -> None:
        pass


def queue_held(changes: DataFrame, most: int = 30) -> DataFrame:
    """What each queue of a stream of changes (queue, id, op, url, status, at, error, seq) holds after each batch that touches it.

    The same rows as `held` over all changes so far. Of an item that is done and forgotten a late change counts as a new item.
    """
    ready = changes.selectExpr("queue", "id", "op", "url", "status", "cast(at AS bigint) at", "error", "cast(seq AS bigint) seq")
    return ready.groupBy("queue").transformWithStateInPandas(Queue(most), f"queue string, id string, {QUEUE_ROW}", "Update", "None")


def finished(states: DataFrame, most: int = 30) -> DataFrame:
    return states.where("status IN ('done', 'error')").orderBy(F.desc("at"), "id").limit(most)


def unseen_pages(pages: DataFrame, key: str = "url_hash", time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Each page of a stream once; with a time column, state older than the delay is dropped."""
    if time:
        return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return pages.dropDuplicates([key])


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs what is available through an idempotent merge and stops."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type and window, closed once the watermark has passed."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return windowed.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
