"""Enrichment: research queries for bare records, and their replies merged into empty fields only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.extract import validated

FIELDS = ["website", "contact", "email", "phone"]


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column) == "", F.lit(True))


def needs_enrichment() -> Column:
    return _blank("website") & _blank("contact") & (F.coalesce(F.size("social_links"), F.lit(0)) == 0)


def research_queries(records: DataFrame) -> DataFrame:
    """The record's key and its quoted search, for records that lack any way of contact."""
    return records.where(needs_enrichment()).select("record_key", F.concat(F.lit('"'), "name", F.lit('" '), "city").alias("query"))


def first_success(replies: DataFrame, most: int = 2) -> DataFrame:
    """Of a record's first candidates the first that brings a website, contact or links."""
    useful = (F.coalesce("website", F.lit("")) != "") | (F.coalesce("contact", F.lit("")) != "") | (F.coalesce(F.size("social_links"), F.lit(0)) > 0)
    whole = F.struct(*FIELDS, "social_links")
    tried = replies.where((F.col("candidate_rank") < most) & useful)
    return tried.groupBy("record_key").agg(F.min_by(whole, "candidate_rank").alias("found")).select("record_key", "found.*")


def enriched(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records with what was found in the place of empty fields, validated again, and a flag for those that gained."""
    new = found.select("record_key", *[F.col(c).alias(f"_{c}") for c in (*FIELDS, "social_links")])
    joined = records.join(new, "record_key", "left")
    filled = {c: F.when(_blank(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in FIELDS}
    links = F.when(F.coalesce(F.size("social_links"), F.lit(0)) == 0, F.coalesce("_social_links", "social_links")).otherwise(F.col("social_links"))
    before = F.xxhash64(*FIELDS, "social_links")
    out = joined.withColumn("_before", before).withColumns({**filled, "social_links": links})
    out = out.withColumn("enriched", F.xxhash64(*FIELDS, "social_links") != F.col("_before"))
    return validated(out.drop("_before", *[f"_{c}" for c in (*FIELDS, "social_links")]))
