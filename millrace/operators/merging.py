"""Keyed merges, partition replacement, marks and incremental misses over tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import table_or_empty


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest `order` of each key; partial aggregation, so hot keys are no burden."""
    whole = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.col(order)).alias("row")).select(*keys, "row.*")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    whole = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("row")).select(*keys, "row.*")


def stamped(rows: DataFrame, column: str = "updated_at") -> DataFrame:
    """Rows with the time of the write; all rows of one write have the same."""
    return rows.withColumn(column, F.current_timestamp())


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], merged: dict[str, Column] | None = None, order: list[str] | None = None, gathered: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of both by key; on a match the new row stands, but for columns with an expression over old.c and new.c.

    Of new rows with one key the last in `order` stands (default: by all other columns); lists named in `gathered` are those of all
    these rows, the last one's items first, each once.
    """
    others = [c for c in new.columns if c not in keys]
    by = F.struct(*(order or others))
    lists = F.collect_list(F.struct(by.alias("by"), *[F.coalesce(c, F.array().cast(new.schema[c].dataType)).alias(c) for c in gathered]))
    last_first = F.reverse(F.array_sort(lists))
    all_of = [F.array_distinct(F.flatten(last_first.getField(c))).alias(c) for c in gathered]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in others if c not in gathered]), by).alias("_row"), *all_of)
    a, b = old.alias("old"), last.select(*keys, "_row.*", *gathered).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    hit = F.col(f"new.{keys[0]}").isNotNull()
    columns = [F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            both = (merged or {}).get(c)
            value = F.col(f"new.{c}") if both is None else F.when(F.col(f"old.{keys[0]}").isNotNull(), both).otherwise(F.col(f"new.{c}"))
            columns.append(F.when(hit, value).otherwise(F.col(f"old.{c}")).alias(c))
    return a.join(b, on, "full_outer").select(*columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """`old` and the rows of `new` whose keys it lacks; of new rows with one key the first in `order` (default: all columns)."""
    first = first_seen(new, keys, order or [c for c in new.columns if c not in keys])
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def kept_or_new(old: DataFrame, new: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """For each key of `new` the value that holds from now on: the stored one where there is one, else the first new one."""
    wanted = first_seen(new, keys, order)
    held = old.select(*keys, F.col(value).alias("_held"))
    return wanted.join(held, keys, "left").select(*keys, F.coalesce("_held", value).alias(value))


def appended(old: DataFrame, content: DataFrame, keys: list[str], order: str = "version", text: str = "content") -> DataFrame:
    """`old` versions and a next one of each key whose new content differs from its last; a first one is version 1."""
    last = old.groupBy(*keys).agg(F.max_by(text, order).alias("_last"), F.count("*").alias("_n"))
    joined = content.join(last, keys, "left").where(~F.col(text).eqNullSafe(F.col("_last")) | F.col("_n").isNull())
    new = joined.withColumn(order, (F.coalesce("_n", F.lit(0)) + 1).cast(old.schema[order].dataType))
    return old.unionByName(new.drop("_last", "_n"))


def removed(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row: how many went and whether any did."""
    gone = rows.join(keys.distinct(), keys.columns, "left_semi").agg(F.count("*").alias("removed"))
    return delete_keys(rows, keys), gone.select("removed", (F.col("removed") > 0).alias("any"))


def truncated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No rows of the same columns, and one row: how many there were."""
    return rows.limit(0), rows.agg(F.count("*").alias("removed"))


def delete_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, keys.columns, "left_anti")


def replace_partitions(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Partitions that `new` has are replaced as wholes."""
    return old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def write_partitions(new: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions of a stored table that `new` has; others stay."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def marked(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows with a flag that says whether their key is listed."""
    flags = keys.distinct().withColumn(name, F.lit(True))
    return rows.join(flags, keys.columns, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cleared(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key is listed lose the given columns' values."""
    flagged = marked(rows, keys, "_hit")
    return flagged.withColumns({c: F.when(~F.col("_hit"), F.col(c)) for c in columns}).drop("_hit")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots."""
    a = before.select(*keys, F.xxhash64(*sorted(before.columns)).alias("h_before"))
    b = after.select(*keys, F.xxhash64(*sorted(after.columns)).alias("h_after"))
    change = F.when(F.col("h_before").isNull(), "added").when(F.col("h_after").isNull(), "removed").otherwise("changed")
    joined = a.join(b, keys, "full_outer").where(~F.col("h_before").eqNullSafe(F.col("h_after")))
    return joined.select(*keys, change.alias("change"))


def field_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, fields): rows added, removed or changed between two snapshots, each with its fields that differ as (field, old, new) in text.

    Added rows have all their fields as new, removed ones as old; fields that are null on both sides are left out.
    """
    fields = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*fields, F.lit(True).alias("_there")).alias("_a"))
    b = after.select(*keys, F.struct(*fields, F.lit(True).alias("_there")).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    old, new = (lambda c: F.col("_a").getField(c).cast("string")), (lambda c: F.col("_b").getField(c).cast("string"))
    each = [F.when(~old(c).eqNullSafe(new(c)), F.struct(F.lit(c).alias("field"), old(c).alias("old"), new(c).alias("new"))) for c in fields]
    joined = a.join(b, keys, "full_outer").select(*keys, change.alias("change"), F.array_compact(F.array(*each)).alias("fields"))
    return joined.where((F.size("fields") > 0) | (F.col("change") != "changed"))


def content(rows: DataFrame) -> str:
    """A name for what a table holds, whatever the order of its rows and its partitions; repeated rows count."""
    columns = sorted(rows.columns)
    typed = [F.lit(f"{c}:{rows.schema[c].dataType.simpleString()}") for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *typed, *[x for c in columns for x in (F.col(c), F.col(c).isNull())]).cast("decimal(38,0)")) for seed in (1, 2)]
    n, x, y = rows.agg(F.count("*"), *sums).first()
    return hashlib.sha256(f"{'|'.join(columns)}|{n}|{x}|{y}".encode()).hexdigest()[:32]


def snapshot(rows: DataFrame, path: str) -> tuple[str, bool]:
    """The name of a snapshot of `rows` under `path`, and whether it was written: what is already the newest is not written again."""
    spark, name = rows.sparkSession, content(rows)
    taken = snapshots(spark, path)
    if taken and taken[-1][1] == name:
        return name, False
    folder = f"{path}/content={name}"
    if all(name != n for _, n in taken):
        rows.write.mode("overwrite").parquet(folder)
    # The entry makes the snapshot valid, so it comes last.
    spark.createDataFrame([(len(taken) + 1, name)], "number int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{len(taken) + 1}")
    return name, True


def snapshots(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, name) of all snapshots under `path`, the oldest first."""
    found = table_or_empty(spark, f"{path}/log", "number int, name string", "*")
    return [tuple(r) for r in found.orderBy("number").collect()]  # one row for each snapshot


def between(spark: SparkSession, path: str, keys: list[str], old: int, new: int) -> DataFrame:
    """The field_changes from one snapshot, by its number, to another."""
    names = dict(snapshots(spark, path))
    read = lambda number: spark.read.parquet(f"{path}/content={names[number]}")
    return field_changes(read(old), read(new), keys)
