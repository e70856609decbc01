"""The documents' way from raw text to packed sequences, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fertility, near_dups, packing, quality_model, secrets
from millrace.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates of this stage share so many percent of their shingles; the limit of op7 is its own.
NEAR = 80


def _whole(docs: DataFrame) -> DataFrame:
    """`docs` with all of COLUMNS: one that is missing is null, others are dropped."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(
        *[(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]
    )


def _kept(judged: DataFrame, verdict: str = "kept") -> DataFrame:
    """The rows that their own verdict keeps, as they came. Verdicts carry their rows, so repeated and null ids are no matter."""
    return judged.where(verdict).select("carried.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the fertility bands of their language; texts of any length are read whole.

    Each row is judged by its own text: null or empty text fails, repeated rows and rows of
    one id stay or go each by itself, null ids are ids like others. Columns of `documents` that are missing are
    null, others are dropped. An empty table gives no rows.
    """
    # Readings are dear, so they are made once and written without texts. What they say depends on text and lang
    # alone: rows are found again by their id and the hash of these. A merge join at every size.
    keyed = _whole(docs).withColumn("key", F.xxhash64("text", "lang"))
    kept = fertility.quality(keyed, carry=("doc_id", "key")).where("kept").select("carried.*").distinct()
    found = written(kept.select(F.col("doc_id").alias("id"), F.col("key").alias("kept_key")))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("kept_key"))
    return keyed.join(found.hint("merge"), same, "left_semi").drop("key")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose posterior quality reaches the threshold; without labels all do. Texts of any length are read whole.

    Each row is judged by its own text and site (null: the empty one). Repeated rows, null ids, missing and
    additional columns and an empty table as in quality_rules. Labels of ids that don't occur, or
    of no quality, are not used.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(quality_model.classify(_whole(docs), labels, carry=tuple(COLUMNS)))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that with the smallest id, null ids last. Texts of any length are compared whole.

    Of equal rows one stays. Rows of one id with different texts link each by its own
    text. Rows without words are no duplicates of each other and all stay. Missing and additional columns and an
    empty table as in quality_rules.
    """
    return _kept(near_dups.near_duplicates(_whole(docs), NEAR, carry=tuple(COLUMNS)), "first")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets replaced by a mark; of overlapping ones one mark stands for all. Texts of any length are scanned whole.

    n_chars is that of the new text. Null text stays null with n_chars 0. Repeated rows, null ids, missing and additional
    columns and an empty table as in quality_rules.
    """
    found = _whole(docs).select(*COLUMNS, secrets.secret_spans(F.col("text")).alias("found"))
    safe = found.withColumn("text", secrets.redact(F.col("text"), F.col("found")))
    return safe.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, placed in sequences; a very long text is many pieces.

    Null text is one piece, the closing id. Repeated rows are packed as often as they
    come; a null id stays null on its pieces. Other columns are not read; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Tokenisers, sketches and compression have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
