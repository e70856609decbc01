"""Read queries over the catalogue: counts, matrices, top groups with members, versions, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ranks import positions


def topic_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("topic").agg(F.count("*").alias("n"))


def city_topic_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("city", "topic").agg(F.count("*").alias("n"))


def city_topic_map(records: DataFrame) -> DataFrame:
    """A map of counts for each city."""
    counts = city_topic_counts(records).groupBy("city")
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("topics"))


def top_cities(records: DataFrame, most: int) -> DataFrame:
    return records.groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(most)


def zero_filled(records: DataFrame, cities: DataFrame, topics: DataFrame) -> DataFrame:
    """A count for every combination of two small dimensions."""
    counts = city_topic_counts(records)
    every = cities.crossJoin(topics).join(counts, ["city", "topic"], "left")
    return every.select("city", "topic", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_bucket(n: Column) -> Column:
    """The facet of a count: 0, 1 or 2+."""
    return F.when(n >= 2, "2+").otherwise(n.cast("string"))


def faceted(counts: DataFrame, cities: list[str] = (), topics: list[str] = (), bucket: str | None = None, countries: list[str] = ()) -> DataFrame:
    """Counts under any of the filters; an empty filter holds for all. Countries need a column, as with_country gives it."""
    out = counts
    for column, wanted in (("city", cities), ("topic", topics), ("country", countries)):
        if wanted:
            out = out.where(F.col(column).isin(list(wanted)))
    return out if bucket is None else out.where(count_bucket(F.col("n")) == bucket)


def rollup(records: DataFrame) -> DataFrame:
    """Counts of each city and topic, of each city, and of all; * stands for all."""
    totals = records.rollup("city", "topic").agg(F.count("*").alias("n"))
    return totals.select(F.coalesce("city", F.lit("*")).alias("city"), F.coalesce("topic", F.lit("*")).alias("topic"), "n")


def top_cities_with_members(records: DataFrame, cities: int, members: int) -> DataFrame:
    """The largest cities of each topic, their topic's total, and the first members of each.

    Counts shrink to a row for each city and topic before they are ranked, and
    members are cut to the first few of each group within the window.
    """
    counts = city_topic_counts(records)
    by_size = Window.partitionBy("topic").orderBy(F.desc("n"), "city")
    ranked = counts.withColumns(
        {"place": F.row_number().over(by_size).cast("long"), "total": F.sum("n").over(Window.partitionBy("topic"))}
    ).where(F.col("place") <= cities)
    nth = F.row_number().over(Window.partitionBy("topic", "city").orderBy("id")).cast("long")
    first = records.select("topic", "city", "id", "name").withColumn("nth", nth).where(F.col("nth") <= members)
    return ranked.join(first, ["topic", "city"]).select("topic", "city", "n", "place", "total", "nth", "id", "name")


def versions(rows: DataFrame, key: str, order: str, content: str, base: str = "base") -> DataFrame:
    """Rows whose content differs from the one before, numbered, with what stood before."""
    by = Window.partitionBy(key).orderBy(order)
    changed = rows.withColumn("before", F.lag(content).over(by)).where(~F.col("before").eqNullSafe(F.col(content)))
    number = F.row_number().over(by).cast("long")
    return changed.select(key, order, content, F.coalesce("before", F.lit(base)).alias("before"), number.alias("version"))


def bullets(rows: DataFrame, by: str, text: str, order: str) -> DataFrame:
    """The negative examples of each group as a list of lines."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(order, text))),
        lambda x: F.concat(F.lit("- "), x[text], F.lit(" ("), x[order].cast("string"), F.lit(")")),
    )
    return rows.groupBy(by).agg(F.array_join(lines, "\n").alias("bullets"))


def jsonld(record: dict[str, Column]) -> Column:
    """A schema.org object as JSON from name, city, topic, description, website, location, contact, social_links and
    meeting_schedule; what is null or empty is left out, a record without a name is null."""
    of = lambda c: F.nullif(record.get(c, F.lit(None)).cast("string"), F.lit(""))
    typed = lambda kind, value, *fields: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("@type"), *fields))
    place = F.struct(F.lit("Place").alias("@type"), of("city").alias("addressLocality"), of("location").alias("name"))
    contact, times = of("contact"), of("meeting_schedule")
    links = record.get("social_links", F.lit(None).cast("array<string>"))
    whole = F.struct(
        T.schema_type(record.get("topic", F.lit(""))).alias("@type"), of("name").alias("name"), of("description").alias("description"),
        of("website").alias("url"), place.alias("location"),
        typed("ContactPoint", contact, F.lit("general").alias("contactType"), contact.alias("description")).alias("contactPoint"),
        F.when(F.size(links) > 0, links).alias("sameAs"),
        typed("OpeningHoursSpecification", times, times.alias("description")).alias("openingHoursSpecification"),
    )
    return F.when(of("name").isNotNull(), F.to_json(whole))


def jsonld_graph(documents: DataFrame, column: str, by: str, most: int | None = None) -> DataFrame:
    """One document for each group, all its objects in order in a graph, with `most` the first so many; without objects no document."""
    shown = documents.where(F.col(column).isNotNull()).select(by, column)
    if most is not None:
        place = F.row_number().over(Window.partitionBy(by).orderBy(column))
        shown = shown.withColumn("_place", place).where(F.col("_place") <= most)
    objects = F.array_join(F.array_sort(F.collect_list(column)), ",")
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), objects, F.lit("]}"))
    return shown.groupBy(by).agg(graph.alias("document"))


def with_country(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows with the country of their city, empty where it isn't known."""
    known = cities.select("city", F.col("country").alias("_country"))
    return rows.join(known, "city", "left").withColumn("country", F.coalesce("_country", F.lit(""))).drop("_country")


def home(records: DataFrame, cities: DataFrame, most: int = 8) -> DataFrame:
    """(kind, name, country, n): records of each topic, and the largest cities with their countries."""
    topics = topic_counts(records).select(F.lit("topic").alias("kind"), F.col("topic").alias("name"), F.lit("").alias("country"), "n")
    top = with_country(top_cities(records, most).where("n > 0"), cities)
    return topics.unionByName(top.select(F.lit("city").alias("kind"), F.col("city").alias("name"), "country", "n"))


def about(records: DataFrame, cities: DataFrame, topics: DataFrame, most: int = 12) -> DataFrame:
    """The home page's rows with more cities, and totals: cities, topics and records."""
    totals = [("cities", cities), ("topics", topics), ("records", records)]
    rows = [
        rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), F.lit("").alias("country"), "n")
        for name, rows in totals
    ]
    out = home(records, cities, most)
    for row in rows:
        out = out.unionByName(row)
    return out


def world_map(records: DataFrame, cities: DataFrame, coordinates: DataFrame, topics: DataFrame) -> DataFrame:
    """(name, country, lat, lng, count) of the cities that have coordinates, those without records too.

    Only records of listed topics count.
    """
    counts = records.join(topics.select("topic").distinct(), "topic", "left_semi").groupBy("city").agg(F.count("*").alias("n"))
    placed = cities.join(coordinates, "city").join(counts, "city", "left")
    return placed.select(F.col("city").alias("name"), "country", "lat", "lng", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def map_totals(features: DataFrame) -> DataFrame:
    """One row: all records, cities with some, cities on the map."""
    return features.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count_if(F.col("count") > 0).alias("cities_with_data"), F.count("*").alias("cities_tracked")
    )


def non_empty_topics(records: DataFrame, city: str, topics: DataFrame) -> DataFrame:
    """The listed topics that have records in a city, and how many."""
    counts = records.where(F.col("city") == city).groupBy("topic").agg(F.count("*").alias("n"))
    return counts.join(topics.select("topic").distinct(), "topic", "left_semi").where("n > 0")


def city_sections(records: DataFrame, city: str, topics: DataFrame, chosen: list[str] = ()) -> DataFrame:
    """A city's records under their topics: those chosen, or all that are listed; `of_topic` and `total` count them."""
    own = records.where(F.col("city") == city)
    own = own.where(F.col("topic").isin(list(chosen))) if chosen else own.join(topics.select("topic").distinct(), "topic", "left_semi")
    counts = own.groupBy("topic").agg(F.count("*").alias("of_topic"))
    # A row for each topic.
    counts = counts.withColumn("total", F.sum("of_topic").over(Window.partitionBy()))
    return own.join(counts, "topic")


def chips(sections: DataFrame, topics: list[str] = ()) -> DataFrame:
    """The sections' records that the chosen chips show (none chosen: all), counted."""
    shown = sections.where(F.col("topic").isin(list(topics))) if topics else sections
    return shown.agg(F.count("*").alias("visible"))


def all_shown(sections: DataFrame, cross_city: DataFrame) -> DataFrame:
    """The records of all sections, as one page describes them."""
    columns = ["topic", "city", "id", "name"]
    return sections.select(*columns).unionByName(cross_city.select(*columns))


def topic_labels(topics: DataFrame, labels: DataFrame, language: str) -> DataFrame:
    """(topic, label): the language's word, else the English one, else the name in title case; labels have topic, language and label."""
    of = lambda code, name: labels.where(F.col("language") == code).select("topic", F.col("label").alias(name))
    both = topics.select("topic").join(of("en", "_base"), "topic", "left").join(of(language, "_own"), "topic", "left")
    return both.select("topic", F.coalesce("_own", "_base", T.title_case(F.col("topic"))).alias("label"))


def overlaid(base: Column, over: Column) -> Column:
    """A map with another laid over it: keys of both, the second's values winning."""
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    return F.map_concat(kept, over)


def languages(known: DataFrame) -> DataFrame:
    """Languages by their own names, with the direction that they are written in; `known` has code and name."""
    return known.withColumn("direction", T.text_direction(F.col("code"))).orderBy("name", "code")


def city_locale(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows with the locale of their city, English where the city isn't known."""
    known = cities.select("city", F.col("locale").alias("_locale"))
    return rows.join(known, "city", "left").withColumn("locale", F.coalesce("_locale", F.lit("en"))).drop("_locale")


def with_url(records: DataFrame) -> DataFrame:
    """Records with the id and the address that their own page has, where they have none yet."""
    of = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    return records.withColumns(
        {
            "community_id": F.coalesce(F.nullif(of("community_id"), F.lit("")), T.community_id(F.col("name"), F.col("city"))),
            "community_url": F.coalesce(of("community_url"), T.community_url(F.col("city"), F.col("name"))),
        }
    )


def community_by_slug(records: DataFrame, city_slug: str, name_slug: str, cities: DataFrame | None = None) -> DataFrame:
    """At most one record: of those in the city and with the name that give these slugs, that with the smallest id.

    The city is found among the cities (default: those of the records), so only its own records' names are made slugs of.
    """
    every = (records if cities is None else cities).select("city").distinct()
    own = records.join(every.where(T.slug(F.col("city")) == city_slug), "city", "left_semi")
    return with_url(own.where(T.slug(F.col("name")) == name_slug).orderBy("id").limit(1))


def community_by_id(records: DataFrame, community_id: str) -> DataFrame:
    """At most one record; of several with one derived id that with the smallest id."""
    return with_url(records).where(F.col("community_id") == community_id).orderBy("id").limit(1)


def routes(requests: DataFrame, cities: DataFrame, topics: DataFrame, records: DataFrame) -> DataFrame:
    """What an address of two segments (city_slug, segment) shows: a topic's section, a record's page, or the way back.

    `kind` is home (no such city), topic, community or city; `target` is the city's and topic's or record's name, or where to go.
    """
    known = cities.select("city", T.slug(F.col("city")).alias("city_slug")).groupBy("city_slug").agg(F.min("city").alias("city"))
    named = topics.select("topic").distinct()
    asked = requests.join(known, "city_slug", "left").withColumn("_as_topic", F.replace("segment", F.lit("-"), F.lit("_")))
    # Slugs are made of names in cities that are asked for.
    wanted = records.join(known.join(requests, "city_slug", "left_semi").select("city"), "city", "left_semi")
    slugs = wanted.select("city", T.slug(F.col("name")).alias("segment"), "id").groupBy("city", "segment").agg(F.min("id").alias("record"))
    as_is = named.select(F.col("topic").alias("segment"), F.col("topic").alias("_topic_a"))
    changed = named.select(F.col("topic").alias("_as_topic"), F.col("topic").alias("_topic_b"))
    found = asked.join(as_is, "segment", "left").join(changed, "_as_topic", "left").join(slugs, ["city", "segment"], "left")
    topic = F.coalesce("_topic_a", "_topic_b")
    kind = F.when(F.col("city").isNull(), "home").when(topic.isNotNull(), "topic").when(F.col("record").isNotNull(), "community").otherwise("city")
    target = (
        F.when(kind == "home", "/").when(kind == "topic", F.concat_ws("/", "city", topic))
        .when(kind == "community", F.col("record").cast("string")).otherwise(F.concat(F.lit("/"), "city_slug"))
    )
    return found.select("city_slug", "segment", kind.alias("kind"), target.alias("target"))


def result_detail(records: DataFrame, city: str, topic: str) -> DataFrame:
    """The records of a pair with the hash of the page that each came from."""
    own = records.where((F.col("city") == city) & (F.col("topic") == topic))
    return own.withColumn("url_hash", F.when(F.col("source_url") != "", T.url_hash(F.col("source_url")))).orderBy("id")


def negative_rows(negatives: DataFrame) -> DataFrame:
    """Negative examples with empty texts for null ones."""
    return negatives.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in negatives.dtypes])


def subscription_list(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions, the newest first, each with its place from 1 and how many there are."""
    placed = positions(subscriptions, [], [F.desc("id")])
    return placed.withColumn("place", F.col("pos") + 1).drop("pos").orderBy("place")
