"""File sources: dimensions from YAML, JSON exports, tables that may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas


def _documents(spark: SparkSession, path: str) -> list[str]:
    """Configuration files, read by Spark from wherever they lie."""
    return [r["value"] for r in spark.read.text(path, wholetext=True).collect()]


def _yaml(text: str) -> dict:
    """Plain YAML whose scalars stay strings, so that `no` is a language and not false."""
    import yaml

    return yaml.load(text, Loader=yaml.BaseLoader) or {}


def cities(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """The city dimension; country is empty and the name the only variant where they are missing."""
    rows = [
        (c["name"], c.get("country") or "", c.get("locale") or "en", c.get("search_variants") or [c["name"]])
        for text in _documents(spark, path)
        for c in _yaml(text).get("cities") or []
        if only is None or c["name"] in only
    ]
    return spark.createDataFrame(rows, schemas.CITIES)


def topics(spark: SparkSession, path: str) -> DataFrame:
    rows = [
        (t["name"], {k: list(v or []) for k, v in (t.get("search_terms") or {}).items()})
        for text in _documents(spark, path)
        for t in _yaml(text).get("topics") or []
    ]
    return spark.createDataFrame(rows, schemas.TOPICS)


#: Settings that a configuration may leave out.
DEFAULTS = {
    "local": {"max_text_chars": "3000"}, "fetch": {"blocked_domains": []}, "cache": {"skip_scraped": "true", "skip_extracted": "true"},
    "pipeline": {"test_mode": "false", "test_cities": [], "enrich_communities": "true"},
    "hosted": {"temperature": "0.1", "timeout_seconds": "60", "max_text_chars": "4000", "rate_limit_seconds": "4.0"},
}


def settings(spark: SparkSession, path: str, environment: dict[str, str] | None = None) -> dict:
    """Configuration over its defaults, section by section; SECTION__NAME of the environment stands over both."""
    merged: dict = {k: dict(v) for k, v in DEFAULTS.items()}
    for text in _documents(spark, path):
        for section, values in _yaml(text).items():
            merged[section] = {**merged.get(section, {}), **values} if isinstance(values, dict) else values
    for name, value in (environment or {}).items():
        section, _, key = name.lower().partition("__")
        if key and isinstance(merged.setdefault(section, {}), dict):
            merged[section][key] = value
    return merged


def allowed_cities(config: dict) -> list[str] | None:
    """The cities that a run is cut to in test mode; None for all."""
    pipeline = config.get("pipeline", {})
    return list(pipeline.get("test_cities") or []) if str(pipeline.get("test_mode", "false")).lower() == "true" else None


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(city, lat, lng) from a JSON Lines or CSV file with a header."""
    schema = "city string, lat double, lng double"
    return spark.read.schema(schema).csv(path, header=True) if path.endswith(".csv") else spark.read.schema(schema).json(path)


def negatives(spark: SparkSession, path: str) -> DataFrame:
    """Exported negative examples: missing reasons and sources are empty, a missing kind is extraction."""
    rows = spark.read.schema(schemas.FALSE_POSITIVES).json(path, multiLine=True)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("reason", "source_url")}
    return rows.withColumns({**blank, "fp_type": F.coalesce("fp_type", F.lit("extraction"))})


def prompt_history(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("extraction", "enrichment")) -> DataFrame:
    """Exported prompt versions, one file for each kind, whose kind the file's name says; kinds without a file have none."""
    out = spark.createDataFrame([], schemas.PROMPT_HISTORY)
    for kind in kinds:
        path = f"{folder}/prompt_history_{kind}.json"
        if _exists(spark, path):
            rows = spark.read.schema(schemas.PROMPT_HISTORY).json(path, multiLine=True)
            out = out.unionByName(rows.withColumns({"fp_type": F.lit(kind), "fp_count": F.coalesce("fp_count", F.lit(0))}))
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def table_or_empty(spark: SparkSession, path: str, schema: str, parts: str = "") -> DataFrame:
    """A stored table, or no rows where none has been written yet; `parts` is the pattern of its folders if it has several."""
    if _exists(spark, path):
        return spark.read.schema(schema).parquet(f"{path}/{parts}" if parts else path)
    return spark.createDataFrame([], schema)


def json_records(spark: SparkSession, glob: str, schema: str = schemas.RECORD_FIELDS) -> DataFrame:
    """Files that each hold an array of records; rows that can't be read come with _corrupt_record."""
    whole = f"{schema}, _corrupt_record string"
    return spark.read.schema(whole).json(glob, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def json_documents(spark: SparkSession, glob: str, schema: str = schemas.CACHE_PAGES) -> DataFrame:
    """Files that each hold one document, whose key is the file's stem where it has none."""
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    rows = spark.read.schema(schema).json(glob, multiLine=True).select("*", stem.alias("_stem"))
    return rows.withColumn("url_hash", F.coalesce("url_hash", "_stem")).drop("_stem")


def legacy_table(
    spark: SparkSession, url: str, table: str, by: str | None = None, partitions: int = 8, parts: list[str] | None = None, **options: str
) -> DataFrame:
    """A table of a relational database by JDBC.

    With `by`, a column of numbers, dates or times, ranges of it are read by `partitions` tasks, their bounds being
    asked of the database; with `parts`, each condition is one task's. Filters and columns are left to the database.
    """
    reader = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    if parts:
        return spark.read.jdbc(url, table, predicates=parts, properties=options)
    ranges = {}
    if by:
        low, high = reader(query=f"SELECT MIN({by}) AS low, MAX({by}) AS high FROM {table}").load().first()
        if low is not None:
            ranges = {"partitionColumn": by, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return reader(dbtable=table, **ranges).load()
