"""Runs: their log as rows, totals, the last success, and what the dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import cache, serving

COUNTERS = ["urls_found", "fetch_failed", "cache_hits_scrape", "cache_hits_extract", "records_extracted"]


def record(path: str, run: DataFrame) -> None:
    """Adds a run's row to the stored runs; rows are only ever added."""
    run.write.mode("append").parquet(path)


def pair_rows(runs: DataFrame) -> DataFrame:
    """A row for each pair of each run's log; counters that a log lacks are null. Runs with an empty log give none."""
    return runs.select(F.col("id"), F.posexplode("pairs").alias("place", "pair")).select("id", "place", "pair.*")


def totals(runs: DataFrame) -> DataFrame:
    """Each run with the sums of its log's counters, summed within the row; an empty log sums to 0."""
    fields = {f.name for f in runs.schema["pairs"].dataType.elementType.fields}
    add = lambda c: F.aggregate(
        F.coalesce("pairs", F.array().cast(runs.schema["pairs"].dataType)), F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p[c].cast("long"), F.lit(0).cast("long"))
    )
    return runs.select(
        "id", F.coalesce(F.size("pairs"), F.lit(0)).alias("pairs"), *[add(c).alias(c) for c in COUNTERS if c in fields]
    )


def per_pair(status: DataFrame) -> DataFrame:
    """A run's counters for each pair from page rows: status (ok, failed), hit (scrape, extract or neither) and records."""
    return status.groupBy("city", "topic").agg(
        F.count("*").alias("urls_found"), F.count_if(F.col("status") == "failed").alias("fetch_failed"),
        F.count_if(F.col("hit") == "scrape").alias("cache_hits_scrape"), F.count_if(F.col("hit") == "extract").alias("cache_hits_extract"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records_extracted"),
    )


def recent(runs: DataFrame, most: int = 20) -> DataFrame:
    return runs.withColumn("success", F.col("success").cast("boolean")).orderBy(F.desc("id")).limit(most)


def last_success(runs: DataFrame) -> DataFrame:
    """One row: the last run that succeeded and when it was done; nulls where none has."""
    done = runs.where(F.col("success").cast("boolean"))
    return done.agg(F.max("id").alias("id"), F.max_by("finished_at", "id").alias("finished_at"))


def dashboard(records: DataFrame, entries: DataFrame, runs: DataFrame, most: int = 10) -> DataFrame:
    """(section, name, n): records by city and topic and in all, pages by how far they came, and the last runs' successes."""
    cells = serving.rollup(records).select(F.lit("records").alias("section"), F.concat_ws("/", "city", "topic").alias("name"), "n")
    found = cache.stats(entries)
    pages = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in found.columns])).alias("x"))
    pages = pages.select(F.lit("pages").alias("section"), "x.*")
    last = recent(runs, most).select(F.lit("runs").alias("section"), F.col("id").cast("string").alias("name"), F.col("success").cast("long").alias("n"))
    return cells.unionByName(pages).unionByName(last)
