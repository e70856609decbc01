"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir, which all executors see.

    Where the session names none, a single machine uses its warehouse; on a cluster that is an error, as
    a folder of one machine is not seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        base = base if ":" in base else f"file://{base}"
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def removed_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if "/millrace-" in folder:
                removed_folder(table.sparkSession, folder)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks that it ran, not the
    plan behind them, and Spark knows the size of what it reads next.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
