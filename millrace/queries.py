"""The catalogue's queries over the given tables, and the SQL that each must equal.

Places are nations, topics are market segments, records are customers; pages and
documents are crawled pages, orders are runs, events are log lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dedupe, merging
from millrace.plans import acquire, cache, enrich, extract, serving
from millrace.sources import connectors, services
from millrace.storage import removed_folder, shared_folder
from millrace.streaming import gate, logs
from millrace.streaming import pages as page_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The given tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


def records(t: Tables) -> DataFrame:
    """Customers as records of a place and a topic."""
    places = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"), "n_regionkey")
    return t.customer.join(places, "c_nationkey").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "city", F.col("c_mktsegment").alias("topic"),
        F.col("c_acctbal").alias("score"), "n_regionkey",
    )


RECORDS = "(SELECT c_custkey AS id, c_name AS name, n_name AS city, c_mktsegment AS topic, c_acctbal AS score, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"SELECT topic, count(*) AS n FROM {RECORDS} GROUP BY topic")
def topic_counts(t: Tables) -> DataFrame:
    return serving.topic_counts(records(t))


@query(f"SELECT city, topic, count(*) AS n FROM {RECORDS} GROUP BY city, topic")
def city_topic_counts(t: Tables) -> DataFrame:
    return serving.city_topic_counts(records(t))


@query(f"SELECT city, string_agg(topic || '=' || n, ',' ORDER BY topic) AS counts FROM (SELECT city, topic, count(*) AS n FROM {RECORDS} GROUP BY city, topic) GROUP BY city")
def city_topic_map(t: Tables) -> DataFrame:
    nested = serving.city_topic_map(records(t))
    pairs = F.transform(F.array_sort(F.map_entries("topics")), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return nested.select("city", F.array_join(pairs, ",").alias("counts"))


@query(f"SELECT city, count(*) AS n FROM {RECORDS} GROUP BY city ORDER BY n DESC, city LIMIT 8")
def city_totals(t: Tables) -> DataFrame:
    return serving.top_cities(records(t), 8)


@query(f"SELECT count(*) AS n FROM {RECORDS}")
def total_count(t: Tables) -> DataFrame:
    return records(t).agg(F.count("*").alias("n"))


@query(f"SELECT n_name AS city, s.topic, count(r.id) AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS topic FROM customer) s LEFT JOIN {RECORDS} r ON r.city = n_name AND r.topic = s.topic GROUP BY n_name, s.topic")
def city_topic_matrix_zero(t: Tables) -> DataFrame:
    cities = t.nation.select(F.col("n_name").alias("city"))
    topics = t.customer.select(F.col("c_mktsegment").alias("topic")).distinct()
    return serving.zero_filled(records(t), cities, topics)


@query(f"""
WITH n AS (SELECT topic, city, count(*) AS n FROM {RECORDS} GROUP BY topic, city),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, city) AS place, sum(n) OVER (PARTITION BY topic) AS total FROM n),
m AS (SELECT topic, city, id, name, row_number() OVER (PARTITION BY topic, city ORDER BY id) AS nth FROM {RECORDS})
SELECT topic, city, n, place, cast(total AS BIGINT) AS total, nth, id, name FROM r JOIN m USING (topic, city) WHERE place <= 6 AND nth <= 4""")
def cross_city_top6_first4(t: Tables) -> DataFrame:
    return serving.top_cities_with_members(records(t), 6, 4)


@query(f"SELECT city, topic, n, coalesce(r_name, '') AS country FROM (SELECT city, topic, n_regionkey, count(*) AS n FROM {RECORDS} GROUP BY ALL) LEFT JOIN region ON n_regionkey = r_regionkey")
def results_with_country(t: Tables) -> DataFrame:
    cities = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), F.col("r_name").alias("country"))
    return serving.with_country(serving.city_topic_counts(records(t)), cities).select("city", "topic", "n", "country")


@query(f"SELECT city, topic, n FROM (SELECT city, topic, count(*) AS n FROM {RECORDS} GROUP BY ALL) WHERE CASE WHEN n >= 2 THEN '2+' ELSE cast(n AS VARCHAR) END = '2+' AND topic IN ('BUILDING', 'MACHINERY')")
def faceted_results(t: Tables) -> DataFrame:
    return serving.faceted(serving.city_topic_counts(records(t)), topics=["BUILDING", "MACHINERY"], bucket="2+")


@query(f"""WITH counts AS (SELECT n_name AS city, s.topic, coalesce(r_name, '') AS country, count(r.id) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT DISTINCT c_mktsegment AS topic FROM customer) s
    LEFT JOIN (SELECT * FROM {RECORDS} WHERE score < -800) r ON r.city = n_name AND r.topic = s.topic GROUP BY ALL)
SELECT city, topic, country, n, CASE WHEN n >= 2 THEN '2+' ELSE n::VARCHAR END AS bucket FROM counts
WHERE country IN ('ASIA', 'EUROPE', 'AFRICA') AND topic <> 'MACHINERY' AND n <= 1""")
def facets_of_four(t: Tables) -> DataFrame:
    """Pairs without records and with one, of three countries and some topics: all four facets together."""
    cities = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), F.col("r_name").alias("country"))
    topics = t.customer.select(F.col("c_mktsegment").alias("topic")).distinct()
    counts = serving.with_country(serving.zero_filled(records(t).where("score < -800"), cities.select("city"), topics), cities)
    shown = counts.select("city", "topic", "country", "n", serving.count_bucket(F.col("n")).alias("bucket"))
    wanted = [r["topic"] for r in topics.where("topic <> 'MACHINERY'").collect()]  # the facet's own values
    some = lambda bucket: serving.faceted(shown, topics=wanted, bucket=bucket, countries=["ASIA", "EUROPE", "AFRICA"])
    return some("0").unionByName(some("1"))


@query("SELECT cast(count(*) AS BIGINT) AS total, cast(count_if(props IS NOT NULL) AS BIGINT) AS with_text, cast(count_if(event_type = 'purchase') AS BIGINT) AS with_extract, cast(count_if(value > 50) AS BIGINT) AS with_enrich FROM events")
def cache_stats(t: Tables) -> DataFrame:
    return t.events.agg(
        F.count("*").alias("total"), F.count_if(F.col("props").isNotNull()).alias("with_text"),
        F.count_if(F.col("event_type") == "purchase").alias("with_extract"), F.count_if(F.col("value") > 50).alias("with_enrich"),
    )


@query("SELECT CASE WHEN value > 50 THEN 'enriched' WHEN event_type = 'purchase' THEN 'extracted' WHEN props IS NOT NULL THEN 'scraped' ELSE 'empty' END AS stage, count(*) AS n FROM events GROUP BY 1")
def stage_facets(t: Tables) -> DataFrame:
    stage = F.when(F.col("value") > 50, "enriched").when(F.col("event_type") == "purchase", "extracted")
    stage = stage.when(F.col("props").isNotNull(), "scraped").otherwise("empty")
    return t.events.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query("SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS facet_values FROM events WHERE event_type IS NOT NULL")
def facet_values(t: Tables) -> DataFrame:
    return t.events.agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("facet_values"))


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey) AS place FROM orders")
def cache_index_order(t: Tables) -> DataFrame:
    """All pages with their places in the order of the index, by ranges, without a window over all of them."""
    entries = t.orders.select(F.col("o_orderkey").alias("url_hash"), F.col("o_orderdate").alias("scraped_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("extracted_at"))
    return cache.placed(entries).select(F.col("url_hash").alias("o_orderkey"), F.col("scraped_at").alias("o_orderdate"), "place")


@query(r"SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, sha256(url)[1:16] AS url_hash FROM pages")
def url_domain_hash(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.authority(F.col("url")).alias("domain"), T.url_hash(F.col("url")).alias("url_hash"))


BLOCKED = ["example.net", "www."]


@query(r"SELECT page_id, url FROM pages WHERE NOT contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'example.net') AND NOT contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.')")
def blocked_domains(t: Tables) -> DataFrame:
    return t.pages.where(~T.blocked(F.col("url"), BLOCKED)).select("page_id", "url")


@query("SELECT page_id, 'https://' || regexp_replace(url, '^https?://', '') AS website FROM pages")
def ensure_scheme(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.ensure_scheme(T.without_scheme(F.col("url"))).alias("website"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS name_key FROM part")
def norm_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.norm_key(F.col("p_name")).alias("name_key"))


@query(f"SELECT id, sha256(lower(name) || '|' || lower(city))[1:12] AS community_id FROM {RECORDS}")
def community_id(t: Tables) -> DataFrame:
    return records(t).select("id", T.community_id(F.col("name"), F.col("city")).alias("community_id"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(replace(strip_accents(text), 'ß', ''), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slug(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, regexp_replace(lower(trim(text)), '^(a|az|the|die|le|la|el|los|las) ', '') AS bare FROM documents")
def strip_article(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.strip_article(F.col("text")).alias("bare"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.html_title(F.col("html")).alias("title"))


def _text_nodes(html: str) -> str:
    """The same text from the other side: what stands between tags is gathered, not the tags taken out."""
    nodes = f"array_to_string(regexp_extract_all('>' || {html}, '(?s)>([^<]*)', 1), ' ')"
    for entity, char in T.ENTITIES.items():
        nodes = f"replace({nodes}, '{entity}', chr({ord(char)}))"
    return f"trim(regexp_replace({nodes}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def _without(names: list[str]) -> str:
    html = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for name in names:
        html = f"regexp_replace({html}, '(?is)<{name}[^>]*>.*?</{name}>', ' ', 'g')"
    return html


def _dense_sql() -> str:
    r"""Blocks as rows, the best run by sums from the start: the largest difference of a sum and the least before it."""
    left_out = "'(?is)<!--.*?-->'"
    html = f"regexp_replace(html, {left_out}, ' ', 'g')"
    for name in [*T.HIDDEN, *T.AROUND, "head"]:
        html = f"regexp_replace({html}, '(?is)<{name}(?:\\s[^>]*)?>.*?</{name}\\s*>', ' ', 'g')"
    blank = "(?:<[^>]*>|[ \\t\\n\\r\\f\\x{A0}])+"
    bare = lambda x: f"trim(regexp_replace({x}, '{blank}', ' ', 'g'))"
    text = "string_agg(text, ' ' ORDER BY i)"
    for entity, char in T.ENTITIES.items():
        text = f"replace({text}, '{entity}', chr({ord(char)}))"
    return f"""
WITH pieces AS (
    SELECT page_id, unnest(x) AS piece, unnest(range(1, len(x) + 1)) AS p
    FROM (SELECT page_id, string_split_regex({html}, '(?i)</?(?:{"|".join(T.BLOCKS)})(?:\\s[^>]*)?/?>') AS x FROM pages)
), blocks AS (
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p) AS i, text, length(text) - {T.LINKED} * links - {T.COST} AS score FROM (
        SELECT page_id, p, {bare("piece")} AS text, length({bare("array_to_string(regexp_extract_all(piece, '(?is)<a(?:\\s[^>]*)?>(.*?)</a\\s*>', 1), ' ')")}) AS links FROM pieces) WHERE text <> ''
), sums AS (
    SELECT *, sum(score) OVER (PARTITION BY page_id ORDER BY i) AS total, coalesce(sum(score) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks
), least AS (
    SELECT *, min({{'v': before, 'i': -i}}) OVER (PARTITION BY page_id ORDER BY i) AS low FROM sums
), best AS (
    SELECT page_id, max({{'v': total - low.v, 'i': -i}}) AS b FROM least GROUP BY page_id
), runs AS (
    SELECT l.page_id, -low.i AS a, l.i AS z FROM least l JOIN best ON best.page_id = l.page_id AND l.i = -b.i AND b.v > 0
)
SELECT p.page_id, coalesce(text, '') AS text FROM pages p LEFT JOIN (SELECT k.page_id, trim({text}) AS text FROM blocks k JOIN runs r ON r.page_id = k.page_id AND i BETWEEN a AND z GROUP BY k.page_id) USING (page_id)"""


@query(_dense_sql())
def dense_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.dense_text(F.col("html")).alias("text"))


@query(f"""SELECT page_id, text FROM (SELECT page_id, CASE WHEN length(a) >= 100 THEN a WHEN length(b) >= 100 THEN b WHEN length(c) >= 100 THEN c END AS text FROM (SELECT page_id,
 {_text_nodes("regexp_extract(html, '(?is)<article>(.*?)</article>', 1)")} AS a, d.text AS b, {_text_nodes(_without(["script", "style"]))} AS c FROM pages JOIN ({_dense_sql()}) d USING (page_id))) WHERE text IS NOT NULL""")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.main_text(F.col("html")).alias("text")).where("text IS NOT NULL")


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Stored rows, and a delta that overlaps them: orders that aren't open, and those that aren't finished with another status."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    return rows.where("status <> 'O'"), rows.where("status <> 'F'").withColumn("status", F.lit("N"))


@query("SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN b.o_orderkey IS NULL THEN a.o_orderstatus WHEN a.o_orderkey IS NULL THEN 'N' ELSE 'N<' || a.o_orderstatus END AS status FROM (SELECT * FROM orders WHERE o_orderstatus <> 'O') a FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') b ON a.o_orderkey = b.o_orderkey")
def keyed_upsert(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return merging.upsert(old, new, ["o_orderkey"], {"status": F.concat_ws("<", "new.status", "old.status")})


@query("""WITH new AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey),
listed AS (SELECT o_custkey, string_agg(p, ',' ORDER BY side, k DESC) AS sources FROM (SELECT o_custkey, o_orderpriority AS p, min(side) AS side, arg_min(k, side) AS k FROM
 (SELECT o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS side, max(o_orderkey) AS k FROM orders
  WHERE o_orderstatus <> 'F' OR o_orderkey IN (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) GROUP BY ALL) GROUP BY ALL) GROUP BY o_custkey)
SELECT o_custkey, coalesce(new.k, old.k) AS o_orderkey, coalesce(new.status, 'F') AS status, sources
FROM listed LEFT JOIN new USING (o_custkey) LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) old USING (o_custkey)""")
def upsert_of_repeated_keys(t: Tables) -> DataFrame:
    """Each customer's last finished order is stored; all others come new, of which the last stands and the priorities of all are kept."""
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.array("o_orderpriority").alias("sources"))
    old = merging.last_write(rows.where("status = 'F'"), ["o_custkey"], "o_orderkey")
    both = {"sources": T.merged_distinct(F.col("new.sources"), F.col("old.sources"))}
    done = merging.upsert(old, rows.where("status <> 'F'"), ["o_custkey"], both, ["o_orderkey"], ("sources",))
    return done.withColumn("sources", F.array_join("sources", ","))


@query("SELECT o_orderkey, true AS now, 1 AS times FROM orders WHERE o_orderstatus = 'P'")
def stamped_rows(t: Tables) -> DataFrame:
    """Rows with the time of their write: all the same, and that of now."""
    rows = merging.stamped(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"))
    times = rows.agg(F.count_distinct("updated_at").cast("int").alias("times"), F.max("updated_at").alias("last"))
    near = F.abs(F.unix_timestamp("updated_at") - F.unix_timestamp(F.current_timestamp())) < 3600
    return rows.join(times, F.col("updated_at") == F.col("last")).select("o_orderkey", near.alias("now"), "times")


@query("SELECT p.doc_id, p.lang, p.source, p.n_chars FROM documents p WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND d.doc_id = p.doc_id AND d.lang = p.lang AND d.source = p.source AND d.n_chars = p.n_chars)")
def delete_by_four_columns(t: Tables) -> DataFrame:
    """Rows that a list names by four columns together are gone."""
    rows = t.documents.select("doc_id", "lang", "source", "n_chars")
    gone = rows.join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return merging.delete_keys(rows, gone)


@query("SELECT o_orderkey, o_orderpriority AS topic, 'old' AS side FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '3') UNION ALL SELECT o_orderkey, o_orderpriority, 'new' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '3'")
def replace_partition(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("topic"), "o_orderstatus")
    new = rows.where("o_orderstatus = 'P' AND topic < '3'").withColumn("side", F.lit("new")).drop("o_orderstatus")
    rows = rows.drop("o_orderstatus")
    return merging.replace_partitions(rows.withColumn("side", F.lit("old")), new, ["topic"])


@query("""SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY side, k) AS sources FROM (SELECT o_custkey, o_orderpriority, min(side) AS side, arg_min(k, side) AS k FROM
(SELECT o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS side, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY ALL) GROUP BY o_custkey""")
def merge_source_urls(t: Tables) -> DataFrame:
    """Priorities as sources: those of finished orders are stored, the others come new and stand first."""
    first = t.orders.groupBy("o_custkey", (F.col("o_orderstatus") == "F").alias("old"), "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    listed = lambda rows: F.transform(F.array_sort(F.collect_list(F.when(rows, F.struct("k", "o_orderpriority")))), lambda x: x.o_orderpriority)
    sides = first.groupBy("o_custkey").agg(listed(~F.col("old")).alias("new"), listed(F.col("old")).alias("old"))
    return sides.select("o_custkey", F.array_join(T.merged_distinct(F.col("new"), F.col("old")), ",").alias("sources"))


@query("SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY k) AS tags FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY min(c_custkey)) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE n <= 3 GROUP BY c_nationkey")
def tags_cap(t: Tables) -> DataFrame:
    # A row for each nation and segment before anything is listed.
    first = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("k"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "c_mktsegment"))), lambda x: F.concat(F.lit("\t"), x.c_mktsegment))
    return first.groupBy("c_nationkey").agg(ordered.alias("tags")).select("c_nationkey", F.array_join(T.clean_tags(F.col("tags"), 3), ",").alias("tags"))


@query("SELECT sha256(text)[1:16] AS text_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def first_seen_text(t: Tables) -> DataFrame:
    rows = t.documents.select(T.sha_prefix(F.col("text"), 16).alias("text_hash"), "doc_id", "source")
    return merging.first_seen(rows, ["text_hash"], ["doc_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_write_wins(t: Tables) -> DataFrame:
    return merging.last_write(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_id, event_type, coalesce(before, 'base') AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def version_changes(t: Tables) -> DataFrame:
    return serving.versions(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT o_orderpriority, string_agg('- ' || o_orderstatus || ' (' || k || ')', chr(10) ORDER BY k) AS bullets FROM (SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_orderpriority")
def negative_bullets(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.min("o_orderkey").alias("k"))
    return serving.bullets(rows, "o_orderpriority", "o_orderstatus", "k")


@query("""SELECT n_nationkey, '{"@type":"Organization","name":"' || n_name || '","location":{"@type":"Place","addressLocality":"' || r_name || '"}}' AS document FROM nation JOIN region ON n_regionkey = r_regionkey""")
def jsonld_doc(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", serving.jsonld({"name": F.col("n_name"), "city": F.col("r_name"), "topic": F.lit("chess")}).alias("document"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN q < 60 THEN printf('%.1f', q) || 's' ELSE cast(floor(q / 60) AS INTEGER) || 'm ' || cast(floor(q) % 60 AS INTEGER) || 's' END AS took FROM (SELECT *, l_quantity * 3 AS q FROM lineitem)")
def fmt_duration(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", T.duration(F.col("l_quantity") * 3).alias("took"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%H:%M:%S') AS clock FROM events")
def fmt_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.minute(F.col("ts")).alias("minute"), T.clock(F.col("ts")).alias("clock"))


@query(f"SELECT city, n, round(greatest(7.0, least(22.0, 5 + sqrt(n) * 1.6)), 6) AS radius FROM (SELECT city, count(*) AS n FROM {RECORDS} GROUP BY city)")
def map_radius(t: Tables) -> DataFrame:
    counts = records(t).groupBy("city").agg(F.count("*").alias("n"))
    return counts.select("city", "n", F.round(T.map_radius(F.col("n")), 6).alias("radius"))


@query("SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS negative FROM documents")
def mark_negative(t: Tables) -> DataFrame:
    return merging.marked(t.documents.select("doc_id", "source"), t.labels.where("toxic = 1").select("doc_id"), "negative")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_negative(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT d.doc_id, sha256(text)[1:16] AS text_hash, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def cache_lookup(t: Tables) -> DataFrame:
    wanted = t.documents.select("doc_id", T.sha_prefix(F.col("text"), 16).alias("text_hash"))
    return acquire.with_hits(wanted, t.labels.where("quality = 1").select("doc_id"), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def anti_cache_miss(t: Tables) -> DataFrame:
    return acquire.misses(t.documents.select("doc_id"), t.labels.where("quality = 1"), ["doc_id"])


@query("SELECT a.o_orderkey, b.o_orderkey AS related FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey")
def self_related(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return acquire.related(rows, ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("""SELECT n_name AS city, topic, query_no, CASE query_no WHEN 0 THEN lower(topic) || ' ' || n_name WHEN 1 THEN lower(topic) || ' club ' || n_name ELSE lower(topic) || ' ' || n_name || ' ' || r_name END AS query
FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT DISTINCT c_mktsegment AS topic FROM customer) CROSS JOIN (SELECT unnest([0, 1, 2]) AS query_no)""")
def query_generator(t: Tables) -> DataFrame:
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    cities = named.select(
        F.col("n_name").alias("city"), F.lit("xx").alias("locale"), F.array("n_name", F.concat_ws(" ", "n_name", "r_name")).alias("search_variants")
    )
    word = F.lower("topic")
    terms = F.create_map(F.lit("en"), F.array(word, F.concat_ws(" ", word, F.lit("club")), F.concat_ws(" ", word, F.lit("group"))))
    topics = t.customer.select(F.col("c_mktsegment").alias("topic")).distinct().select("topic", terms.alias("search_terms"))
    return acquire.search_queries(acquire.pairs(cities, topics)).select("city", "topic", F.col("query_no").cast("int"), "query")


@query("SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY k, o_orderkey) AS n FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, min(o_orderkey) AS k FROM orders GROUP BY ALL)) WHERE n <= 5")
def pages_per_pair(t: Tables) -> DataFrame:
    """Of results that several queries found the first, then the first five of each pair."""
    found = t.orders.select("o_custkey", F.col("o_orderpriority").alias("url"), "o_orderkey")
    return acquire.first_pages(found, ["o_custkey"], "url", "o_orderkey", 5).select("o_custkey", "o_orderkey", "n")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS success, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def recent_runs(t: Tables) -> DataFrame:
    runs = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("success"), "o_orderdate")
    return runs.orderBy(F.desc("o_orderkey")).limit(20)


@query("SELECT max(o_orderkey) AS id, arg_max(o_orderdate, o_orderkey) AS finished_at FROM orders WHERE o_orderstatus = 'F'")
def last_success(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").agg(F.max("o_orderkey").alias("id"), F.max_by("o_orderdate", "o_orderkey").alias("finished_at"))


@query("SELECT user_id, event_type, count(*) AS urls_found, cast(count_if(value > 90) AS BIGINT) AS fetch_failed, cast(count_if(value < 20) AS BIGINT) AS cache_hits, cast(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS of_user FROM events GROUP BY user_id, event_type")
def run_log_rollup(t: Tables) -> DataFrame:
    pairs = t.events.groupBy("user_id", "event_type").agg(
        F.count("*").alias("urls_found"), F.count_if(F.col("value") > 90).alias("fetch_failed"), F.count_if(F.col("value") < 20).alias("cache_hits")
    )
    return pairs.withColumn("of_user", F.sum("urls_found").over(Window.partitionBy("user_id")))


@query(f"SELECT coalesce(city, '*') AS city, coalesce(topic, '*') AS topic, count(*) AS n FROM {RECORDS} GROUP BY ROLLUP (city, topic)")
def city_topic_rollup(t: Tables) -> DataFrame:
    return serving.rollup(records(t))


@query("SELECT conv_id, turn, 'Page for {text} ' || role || chr(10) || substr(text, 1, 120) || ' {none}' AS prompt, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS short FROM conversations")
def prompt_render(t: Tables) -> DataFrame:
    """A value that holds a name in braces is not filled in again."""
    role = F.concat(F.lit("{text} "), "role")
    prompt = T.interpolated("Page for {role}\n{text} {none}", {"role": role, "text": F.substr("text", F.lit(1), F.lit(120))})
    return t.conversations.select("conv_id", "turn", prompt.alias("prompt"), T.clipped(F.col("text"), 40).alias("short"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("SELECT p_partkey, cast(p_brand <> '' AS INTEGER) + cast(p_type <> '' AS INTEGER) + 2 AS richness FROM part")
def richness(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.richness([F.col("p_brand"), F.col("p_type")], F.array(F.lit("a"), F.lit("b"))).cast("int").alias("richness"))


@query("SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM orders WHERE o_orderstatus <> 'O') a FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') b ON a.o_orderkey = b.o_orderkey")
def snapshot_diff(t: Tables) -> DataFrame:
    return merging.snapshot_diff(*_halves(t), ["o_orderkey"])


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
    array_to_string(list_filter([CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey:' || coalesce(a.o_custkey::VARCHAR, '-') || '>' || coalesce(b.o_custkey::VARCHAR, '-') END,
        CASE WHEN a.o_orderpriority IS DISTINCT FROM b.p THEN 'priority:' || coalesce(a.o_orderpriority, '-') || '>' || coalesce(b.p, '-') END,
        CASE WHEN a.o_orderstatus IS DISTINCT FROM b.s THEN 'status:' || coalesce(a.o_orderstatus, '-') || '>' || coalesce(b.s, '-') END], lambda x: x IS NOT NULL), ' ') AS fields
FROM (SELECT * FROM orders WHERE o_orderstatus <> 'O') a FULL JOIN (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END AS p, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE 'N' END AS s FROM orders WHERE o_orderstatus <> 'F') b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderpriority IS DISTINCT FROM b.p OR a.o_orderstatus IS DISTINCT FROM b.s""")
def field_changes(t: Tables) -> DataFrame:
    """Which fields of an order changed, from what to what; of new orders some lose their priority and some get another status."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    new = rows.where("status <> 'F'").withColumns({"priority": F.when(F.col("o_custkey") % 2 == 0, F.col("priority")), "status": F.when(F.col("o_custkey") % 3 == 0, F.col("status")).otherwise("N")})
    place = shared_folder(t.spark)
    # As two snapshots; the second is taken again and not written.
    for state in (rows.where("status <> 'O'"), new, new):
        merging.snapshot(state, place)
    found = merging.between(t.spark, place, ["o_orderkey"], 1, 2)
    shown = F.transform("fields", lambda x: F.concat(x["field"], F.lit(":"), F.coalesce(x["old"], F.lit("-")), F.lit(">"), F.coalesce(x["new"], F.lit("-"))))
    return found.select("o_orderkey", "change", F.array_join(shown, " ").alias("fields"))


_PARTS = ["p_partkey", "p_name", "p_brand", "p_size", "p_type"]


@query(dedupe.oracle_sql("""SELECT *, p_brand || '|' || p_size AS block, p_name AS name, length(p_type) AS rich, p_partkey AS seq,
    CASE WHEN p_partkey % 4 > 0 THEN 'http://' || lower(p_type) || CASE WHEN p_partkey % 4 = 1 THEN '/' ELSE '' END END AS site FROM part""", _PARTS))
def fuzzy_dedupe(t: Tables) -> DataFrame:
    """Parts of one brand and size; three in four have a site, of which one is written with a closing slash."""
    fourth = F.col("p_partkey") % 4
    site = F.when(fourth > 0, F.concat(F.lit("http://"), F.lower("p_type"), F.when(fourth == 1, "/").otherwise("")))
    return dedupe.fuzzy_dedupe(t.part.select(*_PARTS), ["p_brand", "p_size"], F.col("p_name"), site, F.length("p_type"), F.col("p_partkey"))


@query(dedupe.oracle_sql("""SELECT *, r_name AS block, c_name AS name, length(c_mktsegment) AS rich, c_custkey AS seq, NULL::VARCHAR AS site
    FROM (SELECT c_custkey, n_name || ' ' || c_custkey % 97 || ' ' || c_mktsegment AS c_name, c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0) JOIN region ON n_regionkey = r_regionkey""", ["c_custkey", "c_name"]))
def fuzzy_dedupe_of_names(t: Tables) -> DataFrame:
    """Customers in debt by names of their nation, a number and their segment: blocks of a region, in which many names are close."""
    debtors = t.customer.where("c_acctbal < 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat_ws(" ", "n_name", (F.col("c_custkey") % 97).cast("string"), "c_mktsegment")
    rows = debtors.select("c_custkey", name.alias("c_name"), "c_mktsegment", "r_name")
    done = dedupe.fuzzy_dedupe(rows, ["r_name"], F.col("c_name"), F.lit(None).cast("string"), F.length("c_mktsegment"), F.col("c_custkey"))
    return done.select("c_custkey", "c_name")


@query("SELECT user_id, time_bucket(INTERVAL 1 hour, ts) AS hour, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def events_tumbling(t: Tables) -> DataFrame:
    """An extension: the reference has no event-time windows."""
    return t.events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(
        "user_id", F.col("w.start").alias("hour"), "n", "top"
    )


@query("SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minute THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY user_id, s")
def events_session(t: Tables) -> DataFrame:
    """An extension: sessions with a gap of 30 minutes."""
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("first"), "n"
    )


@query(f"""SELECT id, name, 'https://' || lower(city) || '.example.org' AS website, 'a,b' AS tags, sha256(lower(name) || '|' || lower(city))[1:12] AS community_id, 'x@y' AS email
FROM {RECORDS} WHERE id % 5 <> 0""")
def extract_records(t: Tables) -> DataFrame:
    """Replies as a service would give them, parsed, validated and cut to those that may be joined."""
    item = F.struct(
        "name", F.concat(F.lower("city"), F.lit(".example.org ")).alias("website"), F.array(F.lit(" a"), F.lit("b"), F.lit("a"), F.lit("")).alias("tags"),
        F.lit("x@y").alias("email"), F.lit("none").alias("phone"), (F.col("id") % 5 != 0).alias("joinable"), F.array(F.lit("no link")).alias("social_links"),
    )
    raw = F.to_json(F.struct(F.array(item, F.struct(*[F.lit(None).cast(k).alias(n) for n, k in (("name", "string"), ("website", "string"), ("tags", "array<string>"), ("email", "string"), ("phone", "string"), ("joinable", "boolean"), ("social_links", "array<string>"))])).alias("communities")))
    replies = records(t).select("city", "topic", F.concat(F.lit("http://p/"), F.col("id").cast("string")).alias("url"), raw.alias("raw"))
    found = extract.joinable(extract.parsed(replies))
    return found.select(
        F.substring_index("source_url", "/", -1).cast("long").alias("id"), "name", "website", F.array_join("tags", ",").alias("tags"), "community_id", "email"
    )


@query("SELECT c_custkey AS record_key, CASE WHEN c_custkey % 3 = 0 THEN 'https://own' WHEN o.k IS NOT NULL THEN 'https://found/' || o.k END AS website, c_custkey % 3 <> 0 AND o.k IS NOT NULL AS enriched FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) WHERE nth <= 2 AND o_orderstatus <> 'F' GROUP BY o_custkey) o ON o_custkey = c_custkey")
def enrich_fill(t: Tables) -> DataFrame:
    """Records without a website get that of their first candidate that has one."""
    text, links = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    record = t.customer.select(
        F.col("c_custkey").alias("record_key"), F.col("c_name").alias("name"), F.lit("c").alias("city"), F.lit("http://s").alias("source_url"),
        F.when(F.col("c_custkey") % 3 == 0, "own").alias("website"),
        *[text.alias(c) for c in (*extract.TEXTS, "email", "community_id")], *[links.alias(c) for c in ("social_links", "tags", "source_urls")],
        F.lit(True).alias("joinable"), F.lit(0).alias("founding_year"),
    )
    useful = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("https://found/"), F.col("o_orderkey").cast("string")))
    replies = acquire.numbered(t.orders, ["o_custkey"], "o_orderkey").select(
        F.col("o_custkey").alias("record_key"), (F.col("n") - 1).alias("candidate_rank"), useful.alias("website"),
        *[text.alias(c) for c in ("contact", "email", "phone")], links.alias("social_links"),
    )
    done = enrich.enriched(record.withColumn("website", T.ensure_scheme(F.col("website"))), enrich.first_success(replies))
    return done.select("record_key", "website", "enriched")


@query("SELECT page_id, CASE WHEN contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'example.net') THEN 'blocked' WHEN page_id % 10 = 0 THEN 'error' WHEN page_id % 10 = 1 THEN 'not_html' ELSE 'ok' END AS status FROM pages")
def page_status(t: Tables) -> DataFrame:
    pages = t.pages.select(
        "page_id", "url", F.when(F.col("page_id") % 10 == 0, 404).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 10 == 1, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), "html",
    )
    return connectors.usable_pages(pages, ["example.net"]).select("page_id", "status")


@query("SELECT lower(trim(email)) AS email, topic, arg_min(token, token) AS token FROM (SELECT ' C' || o_custkey || '@X.org' AS email, o_orderpriority AS topic, o_orderkey AS token FROM orders) GROUP BY ALL")
def subscriptions(t: Tables) -> DataFrame:
    """First come, first kept: odd orders are stored, even ones are added where absent."""
    email = T.email_key(F.concat(F.lit(" C"), F.col("o_custkey").cast("string"), F.lit("@X.org")))
    rows = t.orders.select(email.alias("email"), F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("token"))
    return merging.first_seen(rows, ["email", "topic"], ["token"])


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def queue_latest(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("id"), F.lit("extract").alias("op"), F.lit("u").alias("url"), F.col("event_type").alias("status"),
        F.col("event_id").alias("at"), F.lit(None).cast("string").alias("error"), F.col("event_id").alias("seq"),
    )
    return logs.queue_state(rows).select("id", "status", F.col("at").alias("seq"))


@query("SELECT event_id AS seq, event_type || '  user=' || user_id AS text FROM events ORDER BY event_id DESC LIMIT 500")
def log_ring_buffer(t: Tables) -> DataFrame:
    text = T.log_text(F.col("event_type"), F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    return logs.retained(t.events.select(F.col("event_id").alias("seq"), text.alias("text")))


@query("""SELECT o_orderpriority AS topic, 'Extract.' || chr(10) || chr(10) || 'Not to be extracted:' || chr(10) || string_agg('- "' || o_orderstatus || '": ' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'r' END, chr(10) ORDER BY k) AS prompt, count(*) AS fp_count
FROM (SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def prompts_with_negatives(t: Tables) -> DataFrame:
    kinds = t.orders.groupBy(F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("name")).agg(F.min("o_orderkey").alias("marked_at"))
    negatives = kinds.withColumns({"reason": F.when(F.col("name") != "P", "r"), "fp_type": F.lit(None).cast("string")})
    return extract.effective_prompts("Extract.", negatives, ["topic"])


@query("SELECT r_name AS country, '{\"@context\":\"https://schema.org\",\"@graph\":[' || string_agg('{\"@type\":\"Organization\",\"name\":\"' || n_name || '\",\"location\":{\"@type\":\"Place\"}}', ',' ORDER BY n_name) || ']}' AS document FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def jsonld_graph(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    one = serving.jsonld({"name": F.col("n_name")})
    return serving.jsonld_graph(rows.select(F.col("r_name").alias("country"), one.alias("one")), "one", "country")


@query("SELECT c_custkey, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS band, s >= 0.5 AS sure FROM (SELECT c_custkey, (c_custkey % 10) / 10.0 AS s FROM customer)")
def confidence_bands(t: Tables) -> DataFrame:
    score = (F.col("c_custkey") % 10) / 10.0
    return t.customer.select("c_custkey", T.confidence_band(score).alias("band"), (score >= 0.5).alias("sure"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'en' END AS lang FROM customer")
def accepted_language(t: Tables) -> DataFrame:
    header = F.when(F.col("c_custkey") % 3 == 0, "xx, de-AT;q=0.5, fr").when(F.col("c_custkey") % 3 == 1, "FR-ca,en").otherwise("zz")
    return t.customer.select("c_custkey", T.accepted_language(header, ["en", "de", "fr"]).alias("lang"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(t: Tables) -> DataFrame:
    """The same counts by a stream over the table: what is there is read in batches, then the stream stops."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")
    counts = source.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    place = shared_folder(t.spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(f"{place}/rows")
    latest = rows.groupBy("event_type", "w").agg(F.max_by("n", "batch").alias("n"))
    return latest.select("event_type", F.col("w.start").alias("start"), "n")


def _observed(t: Tables) -> DataFrame:
    """Pages as they were fetched in three rounds: texts differ by the round, half of the pages meet a new model in the second, all in the third."""
    rows = t.pages.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(2))))
    model = F.when((F.col("round") == 0) | ((F.col("round") == 1) & (F.col("page_id") % 2 == 1)), "m1").otherwise("m2")
    topic = F.when((F.col("round") == 1) & (F.col("page_id") % 3 == 0), "again").otherwise(F.regexp_extract("url", "^https?://[^/]*/([^/]*)/", 1))
    return rows.select(
        T.url_hash(F.col("url")).alias("url_hash"), (F.col("round") * F.lit(1_000_000_000).cast("long") + F.col("page_id")).alias("seq"), "url", T.authority(F.col("url")).alias("city"), topic.alias("topic"),
        F.concat(F.col("round").cast("string"), F.lit("|"), "html").alias("text"), model.alias("fingerprint"),
    )


def _titles(text: str, fingerprint: str) -> list[dict]:
    """The heading of a page as its only record, with the round that it was read in; none without one."""
    start, _, rest = text.partition("<h1>")
    return [{"name": f"{fingerprint} {start[0]} {rest.partition('</h1>')[0]}"}] if rest else []


_OBSERVED_SQL = r"""
WITH seen AS (
    SELECT sha256(url)[1:16] AS url_hash, round * 1000000000 + page_id AS seq, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS city,
        CASE WHEN round = 1 AND page_id % 3 = 0 THEN 'again' ELSE regexp_extract(url, '^https?://[^/]*/([^/]*)/', 1) END AS topic, html, round,
        CASE WHEN round = 0 OR (round = 1 AND page_id % 2 = 1) THEN 'm1' ELSE 'm2' END AS model
    FROM pages, (SELECT unnest([0, 1, 2]) AS round)
), changes AS (
    SELECT *, model IS DISTINCT FROM lag(model) OVER (PARTITION BY url_hash ORDER BY seq) AS new FROM seen
), versions AS (
    SELECT *, sum(new::INT) OVER (PARTITION BY url_hash ORDER BY seq) AS version FROM changes
), answered AS (
    SELECT *, first_value(round) OVER (PARTITION BY url_hash, version ORDER BY seq) AS of_round, first_value(html) OVER (PARTITION BY url_hash, version ORDER BY seq) AS of_html FROM versions
), shown AS (
    SELECT city, topic, url_hash, seq, new, CASE WHEN contains(of_html, '<h1>') THEN model || ' ' || of_round || ' ' || split_part(split_part(of_html, '<h1>', 2), '</h1>', 1) END AS name FROM answered
)
"""


def _streamed(t: Tables) -> str:
    """The rounds as a stream into a catalogue, a run for each: the next starts where the one before has stopped. A run takes a round's files as one batch; they go once it is over."""
    place = shared_folder(t.spark)
    observed = _observed(t).withColumn("round", F.floor(F.col("seq") / 1_000_000_000).cast("int"))
    with page_stream.keyed_state(t.spark):
        for number in range(3):
            observed.where(F.col("round") == number).drop("round").write.parquet(f"{place}/in/{number}")
            source = t.spark.readStream.schema(page_stream.EVENT).parquet(f"{place}/in/*")
            page_stream.catalogue_sink(page_stream.memoised(source, _titles), f"{place}/out", f"{place}/state").awaitTermination()
            removed_folder(t.spark, f"{place}/in/{number}")
    return f"{place}/out"


@query(_OBSERVED_SQL + "SELECT city, topic, url_hash, arg_max(name, seq) AS name FROM (SELECT city, topic, url_hash, coalesce(name, '') AS name, seq FROM shown) GROUP BY ALL")
def incremental_catalogue(t: Tables) -> DataFrame:
    """The catalogue that a stream with remembered pages leaves; each page is extracted only where its model changes."""
    name = F.coalesce(F.get_json_object("records", "$[0].name"), F.lit(""))
    return page_stream.catalogue(t.spark, _streamed(t)).select("city", "topic", "url_hash", name.alias("name"))


@query(_OBSERVED_SQL + "SELECT city, topic, cast(count_if(new) AS BIGINT) AS extracted, cast(count_if(NOT new) AS BIGINT) AS cache_hits_extract, 0::BIGINT AS failed, count(name) AS records_extracted FROM shown GROUP BY ALL")
def incremental_counts(t: Tables) -> DataFrame:
    """What the same costs each pair, by the batch plan over all rows at once."""
    return page_stream.pair_counts(page_stream.recomputed(_observed(t), _titles))


def _served(t: Tables, reader):
    path = services.recorded(t.pages.select("page_id", "url", "html"), "page_id")
    options = {"client": "millrace.sources.services:Recorded", "path": path, "order": "page_id", "columns": "page_id bigint, url string, html string", "size": "50"}
    return reader.format(services.NAME).options(**options).option("partitions", 4)


@query("SELECT page_id, sha256(url)[1:16] AS url_hash, length(html) AS n_chars FROM pages")
def service_pages(t: Tables) -> DataFrame:
    """All pages from a service that lists them by number, in four partitions of calls of fifty."""
    pages = _served(t, services.registered(t.spark).read).load()
    return pages.select("page_id", T.url_hash(F.col("url")).alias("url_hash"), F.length("html").alias("n_chars"))


@query(r"SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1")
def service_stream(t: Tables) -> DataFrame:
    """The same service as a stream: each item comes once, whatever batches it takes."""
    place = shared_folder(t.spark)
    pages = _served(t, services.registered(t.spark).readStream).load().select("page_id", T.authority(F.col("url")).alias("domain"))
    run = pages.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.schema(pages.schema).parquet(f"{place}/rows")
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


def _answers():
    """A service that takes no more calls once a value says so, and has no answer to some."""

    def call(value: str) -> str | None:
        if '"k": 77' in value:
            raise connectors.QuotaSpent
        return value[::-1] if "3" in value else None

    return call


@query("""WITH asked AS (
    SELECT event_type AS service, event_id, coalesce(props, '') AS value, epoch_us(ts) // 1000 AS came, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id::VARCHAR) AS i FROM events
), paced AS (
    SELECT *, max(came - i * 40000) OVER (PARTITION BY service ORDER BY i) + i * 40000 AS begun, coalesce(min(CASE WHEN contains(value, '"k": 77') THEN i END) OVER (PARTITION BY service), 1 << 40) AS halt FROM asked
)
SELECT service, event_id, CASE WHEN i <= halt THEN begun - (SELECT epoch_us(min(ts)) // 1000 FROM events) END AS waited_ms, least(i, halt) AS nth,
    CASE WHEN i >= halt THEN 'quota' WHEN contains(value, '3') THEN 'ok' ELSE 'empty' END AS status
FROM paced p WHERE (i <= halt AND begun <= (SELECT epoch_us(max(ts)) // 1000 FROM events)) OR (i > halt AND EXISTS (SELECT 1 FROM paced q WHERE q.service = p.service AND q.i = q.halt AND q.begun <= (SELECT epoch_us(max(ts)) // 1000 FROM events)))""")
def service_gate(t: Tables) -> DataFrame:
    """Requests to one service for each kind of event, forty seconds between the starts of its calls; a spent quota stops it for good."""
    place = shared_folder(t.spark)
    t.events.select(F.col("event_type").alias("service"), F.col("event_id").alias("id"), F.coalesce("props", F.lit("")).alias("value"), F.col("ts").cast("timestamp").alias("at")).write.parquet(f"{place}/in")
    source = t.spark.readStream.schema("service string, id bigint, value string, at timestamp").parquet(f"{place}/in")
    with page_stream.keyed_state(t.spark):
        run = gate.through_gate(source, _answers, 40_000).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.schema(gate.ANSWER).parquet(f"{place}/out")
    first = t.events.agg(F.unix_millis(F.min("ts").cast("timestamp")).alias("first"))
    # The call that spent the quota is the first that found it spent.
    spent = rows.where("status = 'quota'").groupBy("service").agg(F.min(F.struct("started_ms", "id")).alias("spent"))
    called = (F.col("status") != "quota") | (F.struct("started_ms", "id") == F.col("spent"))
    since = F.when(called, F.col("started_ms") - F.col("first"))
    placed = rows.join(F.broadcast(spent), "service", "left").join(F.broadcast(first))
    return placed.select("service", F.col("id").cast("long").alias("event_id"), since.alias("waited_ms"), "nth", "status")
