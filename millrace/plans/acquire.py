"""Search work from dimensions, and its reconciliation with what is cached."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs(cities: DataFrame, topics: DataFrame) -> DataFrame:
    """All combinations of two small dimensions."""
    return cities.crossJoin(topics)


def search_queries(combined: DataFrame) -> DataFrame:
    """The query strings of each pair, numbered.

    The first two terms with the first variant, the first term with the second
    variant if there is one. Terms come from the pair's locale, or from English
    where that has none; without terms there are no queries.
    """
    own = F.try_element_at("search_terms", F.col("locale"))
    english = F.coalesce(F.try_element_at("search_terms", F.lit("en")), F.array().cast("array<string>"))
    terms = F.when(F.size(own) > 0, own).otherwise(english)
    ready = combined.withColumn("_terms", terms)
    first = F.get("search_variants", F.lit(0))
    second = F.get("search_variants", F.lit(1))
    main = F.transform(F.slice("_terms", 1, 2), lambda t: F.concat_ws(" ", t, first))
    more = F.when(second.isNotNull() & (F.size("_terms") > 0), F.array(F.concat_ws(" ", F.get("_terms", F.lit(0)), second)))
    every = F.concat(main, F.coalesce(more, F.array().cast("array<string>")))
    return ready.select("city", "topic", F.posexplode(every).alias("query_no", "query"))


def first_pages(results: DataFrame, pair: list[str], url: str, order: str, most: int) -> DataFrame:
    """Each URL once per pair, where it came first; then the first `most` of each pair."""
    once = results.groupBy(*pair, url).agg(F.min(order).alias(order))
    place = F.row_number().over(Window.partitionBy(*pair).orderBy(order)).cast("long")
    return once.withColumn("n", place).where(F.col("n") <= most)


def numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows numbered from 1 within each group, in order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))


def with_hits(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows with a flag for those that the cache holds."""
    known = cached.select(*keys).distinct().withColumn("hit", F.lit(True))
    return wanted.join(known, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What must be fetched or extracted: nothing that the cache holds under the same keys."""
    return wanted.join(cached.select(*keys), keys, "left_anti")


def related(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Other rows of the same pair."""
    other = rows.select(*by, F.col(key).alias("related"))
    return rows.join(other, by).where(F.col(key) != F.col("related")).select(key, "related")
