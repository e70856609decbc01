"""The page cache: its index, facets, work that starts from cached pages, and changes of single fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ranks import positions

INDEX = [
    "url_hash", "url", "domain", "city", "topic", "scraped_at", "scrape_duration_s", "extracted_at", "extract_duration_s",
    "enrich_scraped_at", "enrich_scrape_duration_s", "enrich_extracted_at", "enrich_extract_duration_s", "enrich_count",
    "record_count", "has_text", "extract_fingerprint", "extract_model",
]
#: What a cached page has besides the columns of the index.
CONTENT = ["raw_text", "records"]


def index(pages: DataFrame) -> DataFrame:
    """A row of 18 columns for each page; fields that pages lack are null, names are empty instead."""
    names = ["url_hash", "url", "domain", "city", "topic"]
    of = lambda c: F.col(c) if c in pages.columns else F.lit(None)
    shown = {c: F.coalesce(of(c).cast("string"), F.lit("")) if c in names else of(c) for c in INDEX}
    shown["record_count"] = F.coalesce(F.size("records"), F.lit(0)) if "records" in pages.columns else F.lit(0)
    shown["has_text"] = F.coalesce(of("raw_text") != "", F.lit(False))
    return pages.select(*[shown[c].alias(c) for c in INDEX])


def ordered(entries: DataFrame) -> DataFrame:
    """Unfinished pages first, then the newest; equal ones by hash. A sort by ranges, no window over all rows."""
    return entries.orderBy(*index_order())


def placed(entries: DataFrame) -> DataFrame:
    """Pages with their place in the index, from 1."""
    return positions(entries, [], index_order()).withColumn("place", F.col("pos") + 1).drop("pos", "total")


def index_order() -> list[Column]:
    done = F.col("scraped_at").isNotNull() & F.col("extracted_at").isNotNull()
    return [done.asc(), F.col("scraped_at").desc_nulls_last(), F.col("url_hash").asc()]


def stage(entries: DataFrame) -> Column:
    """How far a page has come."""
    return (
        F.when(F.col("enrich_extracted_at").isNotNull(), "enriched").when(F.col("extracted_at").isNotNull(), "extracted")
        .when(F.col("has_text"), "scraped").otherwise("empty")
    )


def faceted(entries: DataFrame, city: str = "", topic: str = "", stage_is: str = "", model: str = "") -> DataFrame:
    """Pages under any of the facets; an empty one holds for all. The model is compared by its short name."""
    out = entries
    for column, value in (("city", city), ("topic", topic)):
        out = out.where(F.col(column) == value) if value else out
    out = out.where(stage(out) == stage_is) if stage_is else out
    return out.where(T.model_short(F.col("extract_model")) == model) if model else out


def stats(entries: DataFrame) -> DataFrame:
    """One row: pages, and those with text, with an extraction, with an enrichment."""
    return entries.agg(
        F.count("*").alias("total"), F.count_if("has_text").alias("with_text"),
        F.count_if(F.col("extracted_at").isNotNull()).alias("with_extract"), F.count_if(F.col("enrich_extracted_at").isNotNull()).alias("with_enrich"),
    )


def stage_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(stage(entries).alias("stage")).agg(F.count("*").alias("n"))


def facet_values(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a facet in order, without null and blank ones."""
    return rows.where(F.coalesce(F.col(column) != "", F.lit(False))).select(column).distinct().orderBy(column)


def with_text(pages: DataFrame) -> DataFrame:
    """(url, raw_text, city, topic) of pages that were fetched and hold text."""
    found = pages.where(F.col("scraped_at").isNotNull() & (F.col("raw_text") != ""))
    return found.select("url", "raw_text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("city", "topic")])


def pages_of_pairs(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Every pair with each of its cached pages; a pair without any has one row without a page."""
    return pairs.join(with_text(pages), ["city", "topic"], "left")


def listed_by_pair(pages: DataFrame, most: int | None = None) -> DataFrame:
    """The URLs of each pair in order as one list, and how many there are; with `most` the list has the first so many.

    A pair's list is one value; `pages_of_pairs` has the same as rows.
    """
    urls = pages.groupBy("city", "topic").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))
    by = pages.select("city", "topic", "url").distinct()
    if most is not None:
        by = by.selectExpr("*", "row_number() OVER (PARTITION BY city, topic ORDER BY url) AS place").where(F.col("place") <= most)
    lists = by.groupBy("city", "topic").agg(F.array_sort(F.collect_list("url")).alias("listed"))
    return urls.join(lists, ["city", "topic"])


def valid_extraction(pages: DataFrame, fingerprint: Column | None = None) -> Column:
    """Whether a cached extraction stands: made, with records that all have a name, and of the given fingerprint."""
    whole = F.col("extracted_at").isNotNull() & F.col("records").isNotNull() & F.forall("records", lambda r: F.coalesce(r["name"] != "", F.lit(False)))
    return whole if fingerprint is None else whole & F.col("extract_fingerprint").eqNullSafe(fingerprint)


def timings(calls: DataFrame) -> DataFrame:
    """Seconds of fetching and of extraction, and calls, for each page; calls have url_hash, kind (scrape or extract) and seconds."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("seconds"))), F.lit(0.0))
    return calls.groupBy("url_hash").agg(of("scrape").alias("scrape_s"), of("extract").alias("extract_s"), F.count("*").alias("calls"))


def updated(pages: DataFrame, changes: DataFrame, key: str = "url_hash") -> DataFrame:
    """Pages with the columns of `changes` replaced where it has the page and a value; pages that it alone has are added."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = pages.join(new, key, "full_outer")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in pages.columns])


def records_of_page(records: DataFrame, url: str) -> DataFrame:
    """Stored records that came from a page."""
    return records.where(F.col("source_url") == url)


def related_entries(entries: DataFrame, url_hash: str) -> DataFrame:
    """Other cached pages of the pair that a page belongs to; a look-up of one page, not a join of all with all."""
    own = entries.where(F.col("url_hash") == url_hash).select("city", "topic").limit(1)
    fits = (F.col("city") != "") & (F.col("topic") != "") & (F.col("url_hash") != url_hash)
    return entries.where(fits).join(F.broadcast(own), ["city", "topic"], "left_semi")


def detail(pages: DataFrame, url_hash: str, template: str, most: int = 6000) -> DataFrame:
    """One page with the prompt that its extraction was asked with: the template over topic, city, source_url and the text's start."""
    page = pages.where(F.col("url_hash") == url_hash)
    values = {"topic": F.col("topic"), "city": F.col("city"), "source_url": F.col("url"), "page_text": F.substr("raw_text", F.lit(1), F.lit(most))}
    known = (F.col("raw_text") != "") & (F.col("topic") != "") & (F.col("city") != "")
    prompt = F.when(F.coalesce(known, F.lit(False)), T.interpolated(template, values)).otherwise("")
    return page.withColumn("extract_prompt", prompt)
