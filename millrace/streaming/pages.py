"""From fetched pages to the catalogue, incrementally: what a page gave before is remembered, pairs are rewritten once a batch.

Each page's state is the fingerprint (prompt and model) of its last extraction and the records that it gave. A page that
comes again with the same fingerprint is a hit and is not extracted again, in whatever batch, run or restart it comes.
Pages are dealt to groups by their hash, so that calls and frames are shared by the pages of a group; each keeps a memo of its own.

A batch first leaves its pages as early rows, then writes each pair that it touched as a whole. Both
are folders of the batch's number made from earlier batches alone, so a batch that is tried again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.sources.files import table_or_empty
from millrace.storage import removed_folder

#: From a text and a fingerprint to records, or None if it failed this time.
Extract = Callable[[str, str], "list[dict] | None"]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "url_hash string, seq bigint, url string, city string, topic string, text string, fingerprint string"
EARLY = "url_hash string, seq bigint, url string, city string, topic string, fingerprint string, status string, records string"
PAIR = ["city", "topic"]
#: Groups that pages are dealt to. One group's rows of a batch are in a task's memory at once.
GROUPS = 4096


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class PageMemo(StatefulProcessor):
    """What each page of a group gave at its last extraction; rows of one batch are taken in the order of `seq`."""

    def __init__(self, extract: Extract, keep_ms: int | None = None):
        self.extract, self.keep_ms = extract, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memo = handle.getMapState("memo", "url_hash string", "fingerprint string, records string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, before, held, out = self.memo.exists(), {}, {}, []
        for r in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: r.seq):
            page = r.url_hash
            if page not in held:
                held[page] = before[page] = (known and self.memo.getValue((page,))) or (None, None)
            status, records = "hit", held[page][1]
            if records is None or held[page][0] != r.fingerprint:
                found = self.extract(r.text, r.fingerprint)
                status, records = ("failed", None) if found is None else ("extracted", json.dumps(found, ensure_ascii=False))
                # A failure is no answer: what was remembered stays, and the next row tries again.
                held[page] = held[page] if found is None else (r.fingerprint, records)
            out.append((page, r.seq, r.url, r.city, r.topic, r.fingerprint, status, records))
        for page, memo in held.items():
            if memo != before[page]:
                self.memo.updateValue((page,), memo)
        yield pd.DataFrame(out, columns=["url_hash", "seq", "url", "city", "topic", "fingerprint", "status", "records"])

    def close(self) -> None:
        pass


def memoised(pages: DataFrame, extract: Extract, keep_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Each row of a stream of fetched pages (EVENT) with its status (hit, extracted, failed) and the page's records as JSON.

    With `keep_ms` a memo is forgotten so long after it was written. Columns of other names are not read. A checkpoint
    holds for one number of `groups`.
    """
    ready = pages.selectExpr(*[f"cast({c} AS {k}) {c}" for c, k in (x.split() for x in EVENT.split(", "))])
    mode = "None" if keep_ms is None else "ProcessingTime"
    dealt = ready.withColumn("part", F.pmod(F.xxhash64("url_hash"), F.lit(groups)))
    return dealt.groupBy("part").transformWithStateInPandas(PageMemo(extract, keep_ms), EARLY, "Append", mode)


def _versions(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The last batch before `before` that wrote each pair."""
    pairs = table_or_empty(spark, f"{path}/pairs", "city string, topic string, batch int")
    return pairs.where(F.col("batch") < before).groupBy(*PAIR).agg(F.max("batch").alias("batch"))


def _of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The pages of pairs at given batches; only folders of these batches are read."""
    batches = [r["batch"] for r in wanted.select("batch").distinct().collect()]  # numbers of batches, not of rows
    pages = table_or_empty(spark, f"{path}/pages", f"{EARLY}, batch int").where(F.col("batch").isin(batches))
    return pages.join(wanted, [*PAIR, "batch"], "left_semi").drop("batch")


def merged(batch: DataFrame, number: int, path: str) -> None:
    """Adds a batch of `memoised` rows to the catalogue at `path`: early rows, then the pairs that it touched."""
    spark = batch.sparkSession
    early = f"{path}/early/batch={number}"
    batch.write.mode("overwrite").parquet(early)
    rows = spark.read.schema(EARLY).parquet(early).where("status <> 'failed'")
    whole = F.struct(*[c for c in rows.columns if c not in (*PAIR, "url_hash")])
    new = rows.groupBy(*PAIR, "url_hash").agg(F.max_by(whole, "seq").alias("x")).select(*PAIR, "url_hash", "x.*").select(*rows.columns)
    touched = new.select(*PAIR).distinct()
    stored = _of(spark, path, _versions(spark, path, number).join(touched, PAIR, "left_semi"))
    kept = stored.join(new, [*PAIR, "url_hash"], "left_anti")
    kept.unionByName(new).write.mode("overwrite").parquet(f"{path}/pages/batch={number}")
    touched.write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")


def catalogue_sink(pages: DataFrame, path: str, checkpoint: str):
    """A stream of `memoised` rows into the catalogue at `path`; starts with what is available and stops."""
    writer = pages.writeStream.foreachBatch(lambda batch, number: merged(batch, number, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The pages of all pairs as they stand, with their records as JSON."""
    return _of(spark, path, _versions(spark, path, 1 << 30))


def tidied(spark: SparkSession, path: str) -> int:
    """Deletes pages of batches that no pair stands at any more; how many batches went."""
    stands = {r["batch"] for r in _versions(spark, path, 1 << 30).select("batch").distinct().collect()}
    there = {r["batch"] for r in table_or_empty(spark, f"{path}/pairs", "city string, topic string, batch int").select("batch").distinct().collect()}
    for batch in there - stands:
        removed_folder(spark, f"{path}/pages/batch={batch}")
    return len(there - stands)


def pair_counts(early: DataFrame) -> DataFrame:
    """Of each pair what its pages cost: extractions, hits, failures and records."""
    n = F.coalesce(F.json_array_length("records"), F.lit(0))
    return early.groupBy(*PAIR).agg(
        F.count_if(F.col("status") == "extracted").alias("extracted"), F.count_if(F.col("status") == "hit").alias("cache_hits_extract"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.sum(n).alias("records_extracted"),
    )


def recomputed(pages: DataFrame, extract: Extract) -> DataFrame:
    """What `memoised` gives for all rows at once, by windows: a page is extracted where its fingerprint changes. For extractions that don't fail."""
    by = Window.partitionBy("url_hash").orderBy("seq")
    changed = ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(by)) | (F.row_number().over(by) == 1)
    numbered = pages.withColumn("new", changed).withColumn("version", F.sum(F.col("new").cast("int")).over(by))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [json.dumps(extract(t, f), ensure_ascii=False) for t, f in zip(b["text"], b["fingerprint"])]
            yield b[["url_hash", "version"]].assign(records=found)

    answers = numbered.where("new").select("url_hash", "version", "text", "fingerprint").mapInPandas(run, "url_hash string, version bigint, records string")
    status = F.when(F.col("new"), "extracted").otherwise("hit").alias("status")
    return numbered.join(answers, ["url_hash", "version"]).select("url_hash", "seq", "url", *PAIR, "fingerprint", status, "records")
