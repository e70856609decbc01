"""Queries that serve pages and work, over the given tables, and the SQL that each must equal.

Besides what `queries` takes for places, topics and records: orders are cached pages
of a priority and a status, conversations are runs whose turns are pairs, toxic documents are negative examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import merging
from millrace.plans import acquire, cache, enrich, extract, runs, serving
from millrace.queries import RECORDS, Tables, query, records
from millrace.sources import connectors
from millrace.streaming import logs


def cities(t: Tables) -> DataFrame:
    """Nations as cities; the locale goes by the key."""
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    locale = F.get(F.array(*map(F.lit, ("en", "de", "fr", "hu", "xx", "pt"))), F.col("n_nationkey") % 6)
    return named.select(F.col("n_name").alias("city"), F.col("r_name").alias("country"), locale.alias("locale"), "n_nationkey")


CITIES = "(SELECT n_name AS city, r_name AS country, ['en', 'de', 'fr', 'hu', 'xx', 'pt'][n_nationkey % 6 + 1] AS locale, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"


def topics(t: Tables) -> DataFrame:
    """Market segments as listed topics, but for one that is no longer listed."""
    return t.customer.select(F.col("c_mktsegment").alias("topic")).distinct().where("topic <> 'HOUSEHOLD'")


TOPICS = "(SELECT DISTINCT c_mktsegment AS topic FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')"


def coordinates(t: Tables) -> DataFrame:
    """Coordinates of most cities, by the suppliers' mean balances of each nation that has a positive one."""
    mean = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("k"))
    placed = t.nation.join(mean, F.col("n_nationkey") == F.col("s_nationkey"))
    return placed.select(F.col("n_name").alias("city"), (F.col("n") * 2.0 - 60).alias("lat"), (F.col("k") % 180 * 1.0).alias("lng"))


COORDINATES = "(SELECT n_name AS city, cast(n * 2 - 60 AS DOUBLE) AS lat, cast(k % 180 AS DOUBLE) AS lng FROM nation JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS k FROM supplier GROUP BY s_nationkey) ON n_nationkey = s_nationkey)"


def pages(t: Tables) -> DataFrame:
    """Orders as cached pages."""
    key, price, date = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")
    names = F.transform(F.sequence(F.lit(1), (F.col("o_custkey") % 3 + 1).cast("int")), lambda i: F.struct(F.when(key % 7 + i != 3, F.concat(F.lit("r"), i.cast("string"))).alias("name")))
    return t.orders.select(
        T.url_hash(key.cast("string")).alias("url_hash"), F.concat(F.lit("http://p/"), key.cast("string")).alias("url"), F.lit("p").alias("domain"),
        F.col("o_orderpriority").alias("city"), F.col("o_orderstatus").alias("topic"), F.when(key % 10 != 0, date).alias("scraped_at"),
        F.when(key % 4 != 0, F.concat(F.lit("text "), F.col("o_custkey").cast("string"))).alias("raw_text"),
        F.when(price > 100000, date).alias("extracted_at"), F.when(price > 300000, date).alias("enrich_extracted_at"),
        F.when(price > 100000, F.when(key % 2 == 0, "m:1").otherwise("n")).alias("extract_model"),
        F.when(price > 100000, F.when(key % 3 == 0, "f1").otherwise("f2")).alias("extract_fingerprint"),
        F.when(price > 150000, names).alias("records"), "o_orderkey",
    )


PAGES = """(SELECT sha256(o_orderkey::VARCHAR)[1:16] AS url_hash, 'http://p/' || o_orderkey AS url, 'p' AS domain, o_orderpriority AS city, o_orderstatus AS topic,
 CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS scraped_at, CASE WHEN o_orderkey % 4 <> 0 THEN 'text ' || o_custkey END AS raw_text,
 CASE WHEN o_totalprice > 100000 THEN o_orderdate END AS extracted_at, CASE WHEN o_totalprice > 300000 THEN o_orderdate END AS enrich_extracted_at,
 CASE WHEN o_totalprice > 100000 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'm:1' ELSE 'n' END END AS extract_model,
 CASE WHEN o_totalprice > 100000 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'f1' ELSE 'f2' END END AS extract_fingerprint,
 CASE WHEN o_totalprice > 150000 THEN o_custkey % 3 + 1 END AS n_records, o_orderkey FROM orders)"""
STAGE = "CASE WHEN enrich_extracted_at IS NOT NULL THEN 'enriched' WHEN extracted_at IS NOT NULL THEN 'extracted' WHEN raw_text IS NOT NULL THEN 'scraped' ELSE 'empty' END"


@query(f"""SELECT 'topic' AS kind, topic AS name, '' AS country, count(*) AS n FROM {RECORDS} GROUP BY topic
UNION ALL SELECT 'city', r.city, coalesce(country, ''), n FROM (SELECT city, count(*) AS n FROM {RECORDS} GROUP BY city ORDER BY n DESC, city LIMIT 8) r LEFT JOIN {CITIES} c ON r.city = c.city""")
def home_page(t: Tables) -> DataFrame:
    return serving.home(records(t), cities(t))


@query(f"""SELECT 'topic' AS kind, topic AS name, '' AS country, count(*) AS n FROM {RECORDS} GROUP BY topic
UNION ALL SELECT 'city', r.city, coalesce(country, ''), n FROM (SELECT city, count(*) AS n FROM {RECORDS} GROUP BY city ORDER BY n DESC, city LIMIT 12) r LEFT JOIN {CITIES} c ON r.city = c.city
UNION ALL SELECT 'total', 'cities', '', count(*) FROM nation UNION ALL SELECT 'total', 'topics', '', count(*) FROM {TOPICS} UNION ALL SELECT 'total', 'records', '', count(*) FROM {RECORDS}""")
def about_page(t: Tables) -> DataFrame:
    return serving.about(records(t), cities(t), topics(t))


_MAP = f"SELECT c.city AS name, country, lat, lng, coalesce(n, 0) AS count FROM {CITIES} c JOIN {COORDINATES} x ON c.city = x.city LEFT JOIN (SELECT city, count(*) AS n FROM {RECORDS} WHERE topic IN (SELECT topic FROM {TOPICS}) GROUP BY city) r ON r.city = c.city"


@query(_MAP)
def world_map(t: Tables) -> DataFrame:
    return serving.world_map(records(t), cities(t), coordinates(t), topics(t))


@query(f"SELECT cast(coalesce(sum(count), 0) AS BIGINT) AS total, cast(count_if(count > 0) AS BIGINT) AS cities_with_data, count(*) AS cities_tracked FROM ({_MAP})")
def world_map_totals(t: Tables) -> DataFrame:
    return serving.map_totals(serving.world_map(records(t), cities(t), coordinates(t), topics(t)))


@query(f"SELECT topic, count(*) AS n FROM {RECORDS} WHERE city = 'NATION_3' OR city = 'FRANCE' GROUP BY topic HAVING topic IN (SELECT topic FROM {TOPICS}) AND count(*) > 0")
def non_empty_topics(t: Tables) -> DataFrame:
    both = [serving.non_empty_topics(records(t), city, topics(t)) for city in ("NATION_3", "FRANCE")]
    return both[0].unionByName(both[1]).groupBy("topic").agg(F.sum("n").alias("n"))


def _some_city(t: Tables) -> str:
    """The first city by name: whatever the table calls it."""
    return t.nation.agg(F.min("n_name").alias("c")).first()["c"]


_CITY = "(SELECT min(n_name) FROM nation)"


@query(f"SELECT id, topic, count(*) OVER (PARTITION BY topic) AS of_topic, count(*) OVER () AS total FROM {RECORDS} WHERE city = {_CITY} AND topic IN (SELECT topic FROM {TOPICS})")
def city_page(t: Tables) -> DataFrame:
    """All sections of a city's page."""
    return serving.city_sections(records(t), _some_city(t), topics(t)).select("id", "topic", "of_topic", "total")


@query(f"SELECT id, topic, count(*) OVER (PARTITION BY topic) AS of_topic, count(*) OVER () AS total FROM {RECORDS} WHERE city = {_CITY} AND topic IN ('BUILDING', 'HOUSEHOLD')")
def city_page_chosen(t: Tables) -> DataFrame:
    """The sections of the chosen topics, listed or not."""
    return serving.city_sections(records(t), _some_city(t), topics(t), ["BUILDING", "HOUSEHOLD"]).select("id", "topic", "of_topic", "total")


@query(f"SELECT count(*) AS visible FROM {RECORDS} WHERE city = {_CITY} AND topic IN ('BUILDING', 'MACHINERY')")
def topic_chips(t: Tables) -> DataFrame:
    return serving.chips(serving.city_sections(records(t), _some_city(t), topics(t)), ["BUILDING", "MACHINERY"])


@query(f"""WITH n AS (SELECT topic, city, count(*) AS n FROM {RECORDS} GROUP BY topic, city), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, city) AS place FROM n),
m AS (SELECT *, row_number() OVER (PARTITION BY topic, city ORDER BY id) AS nth FROM {RECORDS})
SELECT topic, city, id, name FROM {RECORDS} WHERE city = {_CITY} AND topic IN (SELECT topic FROM {TOPICS})
UNION ALL SELECT topic, city, id, name FROM m JOIN r USING (topic, city) WHERE place <= 6 AND nth <= 4""")
def sections_together(t: Tables) -> DataFrame:
    own = serving.city_sections(records(t), _some_city(t), topics(t))
    return serving.all_shown(own, serving.top_cities_with_members(records(t), 6, 4))


def _slug_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""SELECT id, city, topic, sha256(lower(name) || '|' || lower(city))[1:12] AS community_id, '/' || {_slug_sql('city')} || '/' || {_slug_sql('name')} AS community_url FROM {RECORDS}""")
def community_urls(t: Tables) -> DataFrame:
    return serving.with_url(records(t)).select("id", "city", "topic", "community_id", "community_url")


@query(f"SELECT id, name, '/' || {_slug_sql('city')} || '/' || {_slug_sql('name')} AS community_url FROM {RECORDS} WHERE id = (SELECT max(c_custkey) FROM customer)")
def community_page(t: Tables) -> DataFrame:
    """The last record, found by the two slugs of its address."""
    last = records(t).agg(F.max_by(F.struct(T.slug(F.col("city")).alias("c"), T.slug(F.col("name")).alias("n")), "id").alias("x")).first()["x"]
    return serving.community_by_slug(records(t), last["c"], last["n"]).select("id", "name", "community_url")


@query(f"SELECT id, name, sha256(lower(name) || '|' || lower(city))[1:12] AS community_id FROM {RECORDS} WHERE id = (SELECT min(c_custkey) FROM customer)")
def community_by_id(t: Tables) -> DataFrame:
    first = records(t).agg(F.min_by(T.community_id(F.col("name"), F.col("city")), "id").alias("x")).first()["x"]
    return serving.community_by_id(records(t), first).select("id", "name", "community_id")


@query(f"""WITH asked AS (SELECT CASE WHEN id % 11 = 0 THEN 'nowhere' ELSE {_slug_sql('city')} END AS city_slug,
 CASE id % 3 WHEN 0 THEN topic WHEN 1 THEN {_slug_sql('name')} ELSE 'unknown-' || id END AS segment, id, city, topic FROM {RECORDS})
SELECT city_slug, segment, CASE WHEN city_slug = 'nowhere' THEN 'home' WHEN id % 3 = 0 AND topic IN (SELECT topic FROM {TOPICS}) THEN 'topic' WHEN id % 3 = 1 THEN 'community' ELSE 'city' END AS kind,
 CASE WHEN city_slug = 'nowhere' THEN '/' WHEN id % 3 = 0 AND topic IN (SELECT topic FROM {TOPICS}) THEN city || '/' || topic WHEN id % 3 = 1 THEN cast(id AS VARCHAR) ELSE '/' || city_slug END AS target FROM asked""")
def page_routes(t: Tables) -> DataFrame:
    slug = F.when(F.col("id") % 11 == 0, "nowhere").otherwise(T.slug(F.col("city")))
    segment = F.when(F.col("id") % 3 == 0, F.col("topic")).when(F.col("id") % 3 == 1, T.slug(F.col("name"))).otherwise(F.concat(F.lit("unknown-"), F.col("id").cast("string")))
    asked = records(t).select(slug.alias("city_slug"), segment.alias("segment"))
    return serving.routes(asked, cities(t), topics(t), records(t))


@query(f"SELECT id, name, sha256('http://s/' || id % 50)[1:16] AS url_hash FROM {RECORDS} WHERE city = {_CITY} AND topic = 'BUILDING'")
def result_detail(t: Tables) -> DataFrame:
    found = records(t).withColumn("source_url", F.concat(F.lit("http://s/"), (F.col("id") % 50).cast("string")))
    return serving.result_detail(found, _some_city(t), "BUILDING").select("id", "name", "url_hash")


@query("SELECT s_suppkey, 'de' AS locale, coalesce(CASE s_nationkey % 3 WHEN 0 THEN 'eigen' || s_nationkey END, CASE s_nationkey % 2 WHEN 0 THEN 'base' || s_nationkey END, 'Topic ' || s_nationkey) AS label FROM supplier")
def topic_labels(t: Tables) -> DataFrame:
    """A language's words over English ones over names in title case."""
    key = F.col("n_nationkey")
    name = F.concat(F.lit("topic_"), key.cast("string"))
    of = lambda code, word, every: t.nation.where(key % every == 0).select(name.alias("topic"), F.lit(code).alias("language"), F.concat(F.lit(word), key.cast("string")).alias("label"))
    found = serving.topic_labels(t.nation.select(name.alias("topic")), of("en", "base", 2).unionByName(of("de", "eigen", 3)), "de")
    asked = t.supplier.select("s_suppkey", F.concat(F.lit("topic_"), F.col("s_nationkey").cast("string")).alias("topic"))
    return asked.join(found, "topic").select("s_suppkey", F.lit("de").alias("locale"), "label")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'old' AS b, CASE WHEN o_custkey % 2 = 0 THEN 'new' END AS c FROM orders")
def map_overlay(t: Tables) -> DataFrame:
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    over = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    whole = serving.overlaid(base, over)
    return t.orders.select("o_orderkey", *[F.try_element_at(whole, F.lit(k)).alias(k) for k in "abc"])


@query(f"SELECT id, locale, CASE locale WHEN 'hu' THEN 'hu-HU' WHEN 'de' THEN 'de-DE' WHEN 'fr' THEN 'fr-FR' ELSE 'en-US' END AS language, CASE locale WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'pt' THEN 'BR' ELSE 'US' END AS country FROM {RECORDS} JOIN {CITIES} USING (city)")
def search_locales(t: Tables) -> DataFrame:
    found = serving.city_locale(records(t), cities(t))
    return found.select("id", "locale", T.api_language(F.col("locale")).alias("language"), T.api_country(F.col("locale")).alias("country"))


@query(f"SELECT id, 'q' || id AS q, '20' AS count, CASE locale WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'pt' THEN 'BR' ELSE 'US' END AS country, locale AS search_lang FROM {RECORDS} JOIN {CITIES} USING (city)")
def search_parameters(t: Tables) -> DataFrame:
    asked = serving.city_locale(records(t), cities(t)).withColumn("call", connectors.keyed_search(F.concat(F.lit("q"), F.col("id").cast("string")), F.col("locale"), 50))
    return asked.select("id", *[F.col("call")[k].alias(k) for k in ("q", "count", "country", "search_lang")])


@query("SELECT o_orderkey, 0 AS rank, 'http://r/' || o_custkey AS url, '' AS title, 's' AS snippet FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 1, '', 't', '' FROM orders WHERE o_orderkey % 5 <> 0")
def search_replies(t: Tables) -> DataFrame:
    """Replies of a search service to rows; every fifth can't be read."""
    items = F.array(
        F.struct(F.concat(F.lit("http://r/"), F.col("o_custkey").cast("string")).alias("url"), F.lit(None).cast("string").alias("title"), F.lit("s").alias("content")),
        F.struct(F.lit(None).cast("string").alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("content")),
        F.struct(F.lit("third").alias("url"), F.lit("t").alias("title"), F.lit("s").alias("content")),
    )
    reply = F.when(F.col("o_orderkey") % 5 != 0, F.to_json(F.struct(items.alias("results")))).otherwise("no answer")
    return connectors.search_results(t.orders.select("o_orderkey", reply.alias("reply")), "$.results", "content", 2)


@query("SELECT event_id, CASE WHEN value < 20 OR value >= 90 THEN 'failed' WHEN value < 40 THEN 'quota' ELSE 'ok' END AS status FROM events")
def search_states(t: Tables) -> DataFrame:
    code = F.when(F.col("value") < 20, 500).when(F.col("value") < 30, 402).when(F.col("value") < 40, 429).when(F.col("value") < 90, 200)
    return t.events.select("event_id", connectors.search_status(code).alias("status"))


@query(f"SELECT url_hash, url, city, topic, coalesce(n_records, 0) AS record_count, raw_text IS NOT NULL AS has_text, extract_model, {STAGE} AS stage FROM {PAGES}")
def cache_index(t: Tables) -> DataFrame:
    entries = cache.index(pages(t))
    return entries.select("url_hash", "url", "city", "topic", "record_count", "has_text", "extract_model", cache.stage(entries).alias("stage"))


@query(f"SELECT url_hash FROM {PAGES} ORDER BY scraped_at IS NOT NULL AND extracted_at IS NOT NULL, scraped_at DESC NULLS LAST, url_hash LIMIT 100")
def cache_index_first_page(t: Tables) -> DataFrame:
    """The first page of the index: a top-k, not a sort of all."""
    return cache.ordered(cache.index(pages(t))).select("url_hash").limit(100)


@query(f"SELECT url_hash FROM {PAGES} WHERE city = '1-URGENT' AND {STAGE} = 'extracted' AND regexp_replace(extract_model, ':.*$', '') = 'm'")
def cache_facets(t: Tables) -> DataFrame:
    return cache.faceted(cache.index(pages(t)), city="1-URGENT", stage_is="extracted", model="m").select("url_hash")


@query(f"SELECT {STAGE} AS stage, count(*) AS n FROM {PAGES} GROUP BY 1")
def cache_stages(t: Tables) -> DataFrame:
    return cache.stage_counts(cache.index(pages(t)))


@query(f"SELECT count(*) AS total, cast(count(raw_text) AS BIGINT) AS with_text, count(extracted_at) AS with_extract, count(enrich_extracted_at) AS with_enrich FROM {PAGES}")
def cache_totals(t: Tables) -> DataFrame:
    return cache.stats(cache.index(pages(t)))


@query(f"SELECT DISTINCT extract_model FROM {PAGES} WHERE extract_model <> ''")
def cache_models(t: Tables) -> DataFrame:
    return cache.facet_values(cache.index(pages(t)), "extract_model")


@query(f"SELECT url, raw_text, city, topic FROM {PAGES} WHERE scraped_at IS NOT NULL AND raw_text <> ''")
def cached_texts(t: Tables) -> DataFrame:
    return cache.with_text(pages(t))


_PAIRS = "(SELECT * FROM (SELECT DISTINCT o_orderpriority AS city FROM orders) CROSS JOIN (SELECT unnest(['F', 'O', 'P', 'X']) AS topic))"


@query(f"SELECT p.city, p.topic, url FROM {_PAIRS} p LEFT JOIN (SELECT * FROM {PAGES} WHERE scraped_at IS NOT NULL AND raw_text <> '') x ON p.city = x.city AND p.topic = x.topic")
def pages_of_pairs(t: Tables) -> DataFrame:
    names = t.orders.select(F.col("o_orderpriority").alias("city")).distinct()
    pairs = names.select("city", F.explode(F.array(*map(F.lit, "FOPX"))).alias("topic"))
    return cache.pages_of_pairs(pairs, pages(t)).select("city", "topic", "url")


@query(f"SELECT city, topic, count(*) AS n, count(DISTINCT url) AS urls, (list_sort(list(DISTINCT url)))[1:3] AS listed FROM {PAGES} GROUP BY city, topic")
def pages_listed_by_pair(t: Tables) -> DataFrame:
    return cache.listed_by_pair(pages(t), 3)


@query(f"SELECT url_hash, n_records IS NOT NULL AND extract_fingerprint = 'f1' AND NOT (3 - o_orderkey % 7 BETWEEN 1 AND n_records) AS valid FROM {PAGES} WHERE extracted_at IS NOT NULL")
def valid_extractions(t: Tables) -> DataFrame:
    found = pages(t).where("extracted_at IS NOT NULL")
    return found.select("url_hash", F.coalesce(cache.valid_extraction(found, F.lit("f1")), F.lit(False)).alias("valid"))


@query("SELECT cast(user_id AS VARCHAR) AS url_hash, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS scrape_s, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS extract_s, count(*) AS calls FROM events GROUP BY user_id")
def page_timings(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "scrape").when(F.col("event_type") == "purchase", "extract")
    found = cache.timings(t.events.select(F.col("user_id").cast("string").alias("url_hash"), kind.alias("kind"), F.col("value").alias("seconds")))
    return found.select("url_hash", F.round("scrape_s", 4).alias("scrape_s"), F.round("extract_s", 4).alias("extract_s"), "calls")


@query(f"SELECT url_hash, CASE WHEN topic = 'F' AND n_records IS NOT NULL THEN 'new' ELSE extract_model END AS extract_model, CASE WHEN topic = 'F' THEN 'f3' ELSE extract_fingerprint END AS extract_fingerprint FROM {PAGES}")
def partial_update(t: Tables) -> DataFrame:
    changes = pages(t).where("topic = 'F'").select("url_hash", F.when(F.col("records").isNotNull(), "new").alias("extract_model"), F.lit("f3").alias("extract_fingerprint"))
    return cache.updated(pages(t), changes).select("url_hash", "extract_model", "extract_fingerprint")


@query(f"SELECT url_hash, CASE WHEN topic <> 'F' THEN raw_text END AS raw_text, CASE WHEN topic <> 'F' THEN scraped_at END AS scraped_at, extract_model FROM {PAGES}")
def cleared_fields(t: Tables) -> DataFrame:
    gone = pages(t).where("topic = 'F'").select("url_hash")
    return merging.cleared(pages(t), gone, ["raw_text", "scraped_at"]).select("url_hash", "raw_text", "scraped_at", "extract_model")


_FIRST = "(SELECT min(o_orderkey) FROM orders)"


@query(f"SELECT url_hash FROM {PAGES} WHERE (city, topic) = (SELECT (city, topic) FROM {PAGES} WHERE o_orderkey = {_FIRST}) AND o_orderkey <> {_FIRST}")
def related_pages(t: Tables) -> DataFrame:
    """A look-up: other pages of the first page's pair."""
    first = t.orders.agg(T.url_hash(F.min("o_orderkey").cast("string")).alias("h")).first()["h"]
    return cache.related_entries(cache.index(pages(t)), first).select("url_hash")


@query(f"SELECT url_hash, CASE WHEN raw_text IS NULL THEN '' ELSE topic || '/' || city || ' ' || url || ': ' || raw_text[1:6] END AS extract_prompt FROM {PAGES} WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def cache_detail(t: Tables) -> DataFrame:
    last = t.orders.agg(T.url_hash(F.max("o_orderkey").cast("string")).alias("h")).first()["h"]
    return cache.detail(pages(t), last, "{topic}/{city} {source_url}: {page_text}", 6).select("url_hash", "extract_prompt")


@query(f"SELECT id, name FROM {RECORDS} WHERE 'http://s/' || id % 50 = 'http://s/7'")
def records_of_page(t: Tables) -> DataFrame:
    found = records(t).withColumn("source_url", F.concat(F.lit("http://s/"), (F.col("id") % 50).cast("string")))
    return cache.records_of_page(found, "http://s/7").select("id", "name")


def run_table(t: Tables) -> DataFrame:
    """Conversations as runs, their turns as the log's pairs."""
    size = F.length("text")
    pair = F.struct("turn", F.col("role").alias("city"), F.lit("t").alias("topic"), (size % 10).cast("int").alias("urls_found"), F.when(size % 3 == 0, (size % 4).cast("int")).alias("fetch_failed"))
    found = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(pair)).alias("pairs"), F.max("turn").alias("top"))
    finished = F.timestamp_seconds(F.col("id") + 1_700_000_000)
    return found.select("id", "pairs", (F.col("top") % 2).cast("int").alias("success"), finished.alias("finished_at"))


@query("SELECT conv_id AS id, turn, role AS city, cast(length(text) % 10 AS INTEGER) AS urls_found, CASE WHEN length(text) % 3 = 0 THEN cast(length(text) % 4 AS INTEGER) END AS fetch_failed FROM conversations")
def run_detail(t: Tables) -> DataFrame:
    return runs.pair_rows(run_table(t)).select("id", "turn", "city", "urls_found", "fetch_failed")


@query("SELECT conv_id AS id, cast(count(*) AS INTEGER) AS pairs, cast(sum(length(text) % 10) AS BIGINT) AS urls_found, cast(coalesce(sum(length(text) % 4) FILTER (length(text) % 3 = 0), 0) AS BIGINT) AS fetch_failed FROM conversations GROUP BY conv_id")
def run_totals(t: Tables) -> DataFrame:
    return runs.totals(run_table(t))


@query("SELECT conv_id AS id, max(turn) % 2 = 1 AS success FROM conversations GROUP BY conv_id ORDER BY id DESC LIMIT 10")
def run_history(t: Tables) -> DataFrame:
    return runs.recent(run_table(t), 10).select("id", "success")


@query("SELECT max(id) AS id, max(make_timestamp((id + 1700000000) * 1000000)) AS finished_at FROM (SELECT conv_id AS id FROM conversations GROUP BY conv_id HAVING max(turn) % 2 = 1)")
def last_successful_run(t: Tables) -> DataFrame:
    return runs.last_success(run_table(t))


@query(f"""SELECT 'records' AS section, coalesce(city, '*') || '/' || coalesce(topic, '*') AS name, count(*) AS n FROM {RECORDS} GROUP BY ROLLUP (city, topic)
UNION ALL SELECT 'pages', 'total', count(*) FROM {PAGES} UNION ALL SELECT 'pages', 'with_text', count(raw_text) FROM {PAGES}
UNION ALL SELECT 'pages', 'with_extract', count(extracted_at) FROM {PAGES} UNION ALL SELECT 'pages', 'with_enrich', count(enrich_extracted_at) FROM {PAGES}
UNION ALL SELECT 'runs', cast(id AS VARCHAR), n FROM (SELECT conv_id AS id, cast(max(turn) % 2 AS BIGINT) AS n FROM conversations GROUP BY conv_id ORDER BY id DESC LIMIT 10)""")
def dashboard(t: Tables) -> DataFrame:
    return runs.dashboard(records(t), cache.index(pages(t)), run_table(t))


@query("SELECT lang AS city, source AS topic, count(*) AS urls_found, cast(count_if(n_chars < 500) AS BIGINT) AS fetch_failed, cast(count_if(n_chars >= 500 AND n_chars < 900) AS BIGINT) AS cache_hits_scrape, cast(count_if(n_chars >= 900 AND n_chars < 1500) AS BIGINT) AS cache_hits_extract, cast(sum(n_chars % 5) AS BIGINT) AS records_extracted FROM documents GROUP BY lang, source")
def run_counters(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    status = t.documents.select(
        F.col("lang").alias("city"), F.col("source").alias("topic"), F.when(n < 500, "failed").otherwise("ok").alias("status"),
        F.when(n.between(500, 899), "scrape").when(n.between(900, 1499), "extract").alias("hit"), (n % 5).alias("records"),
    )
    return runs.per_pair(status)


def negatives(t: Tables) -> DataFrame:
    """Toxic documents as negative examples; those of even ids are of enrichment."""
    marked = t.documents.join(t.labels.where("toxic = 1").select("doc_id").distinct(), "doc_id")
    kind = F.when(F.col("doc_id") % 2 == 0, "enrichment").otherwise("extraction")
    return marked.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("city"), F.col("source").alias("topic"),
        F.when(F.col("n_chars") % 2 == 0, "spam").alias("reason"), F.lit(None).cast("string").alias("source_url"), kind.alias("fp_type"), F.col("doc_id").alias("marked_at"),
    )


NEGATIVES = "(SELECT 'd' || doc_id AS name, lang AS city, source AS topic, CASE WHEN n_chars % 2 = 0 THEN 'spam' END AS reason, CASE WHEN doc_id % 2 = 0 THEN 'enrichment' ELSE 'extraction' END AS fp_type, doc_id AS marked_at FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"


@query(f"""SELECT city, 'Extract.' || chr(10) || chr(10) || 'Not to be extracted:' || chr(10) || string_agg('- "' || name || '": ' || coalesce(reason, ''), chr(10) ORDER BY marked_at) AS prompt, count(*) AS fp_count FROM {NEGATIVES} WHERE fp_type = 'extraction' GROUP BY city""")
def effective_prompts(t: Tables) -> DataFrame:
    return extract.effective_prompts("Extract.", negatives(t), ["city"])


@query(f"SELECT cast(count_if(fp_type = 'extraction') AS BIGINT) AS extraction, cast(count_if(fp_type = 'enrichment') AS BIGINT) AS enrichment FROM {NEGATIVES}")
def negative_counts(t: Tables) -> DataFrame:
    return extract.negative_counts(negatives(t))


@query(f"SELECT name FROM {NEGATIVES} WHERE fp_type = 'enrichment' AND city = 'en'")
def relevant_negatives(t: Tables) -> DataFrame:
    return extract.relevant(negatives(t), city="en", kind="enrichment").select("name")


@query(f"SELECT name, coalesce(reason, '') AS reason, '' AS source_url FROM {NEGATIVES}")
def negative_rows(t: Tables) -> DataFrame:
    return serving.negative_rows(negatives(t)).select("name", "reason", "source_url")


@query()
def prompt_versions(t: Tables) -> DataFrame:
    """Turns of a role as versions of a text, with line differences."""
    history = t.conversations.select(F.concat_ws("-", F.col("conv_id").cast("string"), "role").alias("fp_type"), F.col("turn").alias("version"), F.col("text").alias("content"))
    return extract.prompt_versions(history, "base").select("fp_type", "version", "diff_html")


@query("SELECT user_id AS id, CASE WHEN new IS DISTINCT FROM old THEN 2 ELSE 1 END AS versions, CASE WHEN new IS DISTINCT FROM old THEN new ELSE old END AS content FROM (SELECT user_id, arg_min(event_type, event_id) AS old, arg_max(event_type, event_id) AS new FROM events GROUP BY user_id)")
def version_append(t: Tables) -> DataFrame:
    """A version is added only where the content differs from the last."""
    ends = t.events.groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", "event_id").alias("old"), F.max_by("event_type", "event_id").alias("new"))
    stored = ends.select("id", F.lit(1).alias("version"), F.col("old").alias("content"))
    whole = merging.appended(stored, ends.select("id", F.col("new").alias("content")), ["id"])
    return whole.groupBy("id").agg(F.max("version").alias("versions"), F.max_by("content", "version").alias("content"))


@query("SELECT o_custkey AS id, o_orderpriority AS topic, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey)) AS token FROM orders GROUP BY ALL")
def subscribe(t: Tables) -> DataFrame:
    """Finished orders are stored subscriptions, the others ask for one: a stored token stands, else the first new one."""
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("token"), "o_orderstatus")
    stored = merging.first_seen(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), ["id", "topic"], ["token"])
    asked = rows.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return merging.insert_absent(stored, asked, ["id", "topic"], ["token"])


@query("SELECT count(*) AS removed, count(*) > 0 AS any FROM orders WHERE o_orderstatus = 'F'")
def unsubscribe(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return merging.removed(t.orders, keys)[1]


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def delete_by_key(t: Tables) -> DataFrame:
    return merging.delete_keys(t.orders, t.orders.where("o_orderstatus = 'F'").select("o_orderkey")).select("o_orderkey")


@query("SELECT count(*) AS removed FROM orders")
def truncate(t: Tables) -> DataFrame:
    return merging.truncated(t.orders)[1]


@query("SELECT o_orderkey AS id, o_orderdate AS created_at, row_number() OVER (ORDER BY o_orderkey DESC) AS place, count(*) OVER () AS total FROM orders")
def subscription_list(t: Tables) -> DataFrame:
    return serving.subscription_list(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")))


@query("""SELECT c_custkey, '{"@type":"' || CASE c_custkey % 4 WHEN 0 THEN 'SportsClub' WHEN 1 THEN 'MusicGroup' ELSE 'Organization' END || '","name":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"url":"https://c/' || c_custkey || '"' ELSE '' END
|| ',"location":{"@type":"Place","addressLocality":"' || n_name || '"}' || CASE WHEN c_custkey % 3 = 0 THEN ',"contactPoint":{"@type":"ContactPoint","contactType":"general","description":"call"}' ELSE '' END
|| CASE WHEN c_custkey % 5 = 0 THEN ',"sameAs":["http://s"]' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN ',"openingHoursSpecification":{"@type":"OpeningHoursSpecification","description":"Mo"}' ELSE '' END || '}' AS document FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def schema_documents(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    every = lambda n, value: F.when(F.col("c_custkey") % n == 0, value)
    record = {
        "name": F.col("c_name"), "city": F.col("n_name"), "topic": F.get(F.array(*map(F.lit, ("running", "choir", "chess", "art"))), (F.col("c_custkey") % 4).cast("int")),
        "website": every(2, F.concat(F.lit("https://c/"), F.col("c_custkey").cast("string"))), "contact": every(3, F.lit("call")),
        "social_links": every(5, F.array(F.lit("http://s"))), "meeting_schedule": every(7, F.lit("Mo")), "description": F.lit(""),
    }
    return rows.select("c_custkey", serving.jsonld(record).alias("document"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'http://own' WHEN c_custkey % 4 = 1 THEN 'http://a' END AS website, CASE WHEN c_custkey % 6 = 0 THEN 'call' END AS contact,
 CASE WHEN c_custkey % 4 = 1 THEN 'http://a http://b' ELSE '' END AS links, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 's' || c_custkey END AS sources FROM customer""")
def display_rules(t: Tables) -> DataFrame:
    """What a record's page shows for its website, contact, links and sources."""
    key = F.col("c_custkey")
    links = F.when(key % 4 == 1, F.array(*map(F.lit, ("no link", "http://a", "http://b", "http://c")))).otherwise(F.array().cast("array<string>"))
    website = F.when(key % 4 == 0, "http://own").when(key % 4 == 2, "own")
    source = F.concat(F.lit("s"), key.cast("string"))
    contact = T.shown_contact(F.lit("call"), F.when(key % 2 == 1, "a@b"), F.when(key % 3 != 0, "+1").otherwise(""))
    return t.customer.select(
        "c_custkey", T.shown_website(website, links).alias("website"), contact.alias("contact"), F.array_join(T.first_links(links), " ").alias("links"),
        F.array_join(T.shown_sources(F.when(key % 2 == 0, F.array(F.lit("x"))), source), " ").alias("sources"),
    )


@query("SELECT doc_id, CASE WHEN lang IN ('ar', 'fa', 'he', 'ur') THEN 'rtl' ELSE 'ltr' END AS direction, upper(source[1:1]) || lower(source[2:]) AS title, CASE WHEN doc_id % 2 = 0 THEN '/' || source ELSE '/' END AS target, doc_id % 3 = 0 AS free FROM documents")
def text_rules(t: Tables) -> DataFrame:
    target = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/"), "source")).otherwise(F.concat(F.lit("http://evil/"), "source"))
    fee = F.when(F.col("doc_id") % 3 == 0, "Gratis").when(F.col("doc_id") % 3 == 1, "5 EUR")
    return t.documents.select(
        "doc_id", T.text_direction(F.col("lang")).alias("direction"), T.title_case(F.col("source")).alias("title"),
        T.safe_redirect(target).alias("target"), T.is_free(fee).alias("free"),
    )


@query("SELECT l_orderkey, l_linenumber, 'local' AS provider, 'm' AS short, round_even(l_tax * l_quantity, 2) AS seconds FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'hosted', 'large', round_even(l_tax * l_quantity, 2) FROM lineitem WHERE l_linenumber % 2 = 1")
def model_names(t: Tables) -> DataFrame:
    model = F.when(F.col("l_linenumber") % 2 == 0, "m:4b").otherwise("large")
    seconds = T.rounded(F.col("l_tax") * F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", T.model_provider(model).alias("provider"), T.model_short(model).alias("short"), seconds.alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE ts END AS at FROM events")
def parsed_times(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("soon")
    return t.events.select("event_id", T.parse_iso(text).alias("at"))


@query("SELECT c_custkey AS id, '\"' || c_name || '\" c' AS query FROM customer WHERE c_custkey % 2 = 1")
def research_queries(t: Tables) -> DataFrame:
    """Searches for records that lack website, contact and links."""
    none = F.lit(None).cast("string")
    rows = t.customer.select(
        F.col("c_custkey").alias("record_key"), F.col("c_name").alias("name"), F.lit("c").alias("city"), F.when(F.col("c_custkey") % 4 == 0, "w").alias("website"),
        F.lit("").alias("contact"), F.when(F.col("c_custkey") % 4 == 2, F.array(F.lit("http://x"))).alias("social_links"), none.alias("email"),
    )
    return enrich.research_queries(rows).select(F.col("record_key").alias("id"), "query")


@query("SELECT o_custkey AS record_key, arg_min(o_orderkey, nth) AS found FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth FROM orders) WHERE nth < 2 AND o_orderstatus <> 'F' GROUP BY o_custkey")
def first_of_two_candidates(t: Tables) -> DataFrame:
    """Of a record's first two candidates the first that brings something."""
    ranked = acquire.numbered(t.orders, ["o_custkey"], "o_orderkey")
    none = F.lit(None).cast("string")
    replies = ranked.select(
        F.col("o_custkey").alias("record_key"), (F.col("n") - 1).alias("candidate_rank"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("website"),
        none.alias("contact"), none.alias("email"), none.alias("phone"), F.lit(None).cast("array<string>").alias("social_links"),
    )
    return enrich.first_success(replies).select("record_key", F.col("website").cast("long").alias("found"))


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS place FROM (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages)) WHERE place <= 5")
def pages_to_fetch(t: Tables) -> DataFrame:
    """The first five pages of each host."""
    rows = t.pages.select("page_id", "url", T.authority(F.col("url")).alias("host"))
    return connectors.first_urls(rows, ["host"], "page_id", 5).select("page_id", "url")


def _items(t: Tables) -> DataFrame:
    """Users as queue items whose events are their changes of state."""
    status = F.get(F.array(*map(F.lit, ("pending", "running", "done", "error"))), (F.col("event_id") % 4).cast("int"))
    return logs.queue_state(t.events.select(
        F.col("user_id").alias("id"), F.lit("extract").alias("op"), F.lit("u").alias("url"), status.alias("status"), F.col("ts").alias("at"),
        F.lit(None).cast("string").alias("error"), F.col("event_id").alias("seq"),
    ))


_ITEMS = "(SELECT user_id AS id, max(ts) AS since, ['pending', 'running', 'done', 'error'][arg_max(event_id, (ts, event_id)) % 4 + 1] AS status FROM events GROUP BY user_id)"


@query(f"SELECT id, status FROM {_ITEMS} WHERE status = 'pending' ORDER BY since, id LIMIT 10")
def queue_waiting(t: Tables) -> DataFrame:
    return logs.waiting(_items(t)).select("id", "status")


@query(f"SELECT id, status FROM {_ITEMS} ORDER BY since DESC, id DESC LIMIT 50")
def queue_newest(t: Tables) -> DataFrame:
    return logs.newest(_items(t)).select("id", "status")


@query(f"SELECT id, status FROM {_ITEMS} WHERE status IN ('pending', 'running') UNION ALL SELECT * FROM (SELECT id, status FROM {_ITEMS} WHERE status IN ('done', 'error') ORDER BY since DESC, id LIMIT 30)")
def queue_held(t: Tables) -> DataFrame:
    return logs.held(_items(t)).select("id", "status")


@query("SELECT event_type AS phase, sha256('u' || user_id)[1:16] AS url_hash, 'u' || user_id AS url FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def current_progress(t: Tables) -> DataFrame:
    url = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return logs.progress(t.events.select(F.col("event_type").alias("phase"), url.alias("url"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))


@query("SELECT event_id AS seq, event_type AS text FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 100")
def log_tail(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("event_id").alias("m")).first()["m"]
    return logs.tail(t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("text")), last - 100)
