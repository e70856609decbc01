"""Benchmark decontamination: windows of benchmark items that documents hold word by word, as a prefix-filtered set join.

A window is the set of its shingles, each with its place. A document that holds the window holds all of them, so
the join needs a prefix of one: the shingle that is rarest in the documents. Where documents hold it, the
place of the shingle says where the window would start (positional bound) and whether it fits into the
document (length bound); then its words are compared one by one.

Only columns and joins of Spark are used. Documents are read once. A filter of fixed size over the
items' shingles is laid on each text before anything is exploded, so what is shuffled are the few shingles that
items have too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

#: Words of a window, and of a shingle (fewer in shorter windows).
WINDOW, SHINGLE = 10, 5
#: 64-bit words of the filter for each shingle, and all at most (8 MB); a fuller filter lets more through and loses none.
ROOM, MOST = 1, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _places(count: Column, size: int) -> Column:
    """0, 1, ... where runs of `size` of so many words start."""
    return F.when(count >= size, F.sequence(F.lit(0), count - size)).otherwise(F.array().cast("array<int>"))


def _shingle(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(size)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, key, parts): each distinct window of each item; key joins its words with spaces. Items without words have none."""
    ready = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = F.least(F.size("w"), F.lit(window))
    each = ready.select("item_id", "w", short.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - short)).alias("at"))
    parts = each.select("item_id", F.slice("w", F.col("at") + 1, F.col("length")).alias("parts"))
    return parts.select("item_id", F.array_join("parts", " ").alias("key"), "parts").distinct()


def _shingles(distinct: DataFrame, size: int) -> DataFrame:
    """(key, parts, size, place, s): the shingles of each window; windows of fewer words are one shingle."""
    hashed = distinct.select("key", "parts", F.transform("parts", lambda x: F.xxhash64(x)).alias("h"))
    out = []
    for k in range(1, size + 1):
        own = hashed.where(F.size("h") >= size if k == size else F.size("h") == k)
        each = own.select("key", "parts", "h", F.explode(_places(F.size("h"), k)).alias("place"))
        out.append(each.select("key", "parts", F.lit(k).alias("size"), "place", _shingle(F.col("h"), F.col("place"), k).alias("s")))
    return reduce(DataFrame.unionByName, out)


def _bit(s: Column, by: int) -> Column:
    return F.shiftright(s, by).bitwiseAND(63).cast("int")


def _word(s: Column, room: int) -> Column:
    """The filter's word that a shingle belongs to."""
    return s.bitwiseAND(room - 1)


def _bits(s: Column) -> Column:
    """A shingle's three bits in that word."""
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), _bit(s, by))
    return one(58).bitwiseOR(one(51)).bitwiseOR(one(44))


def _filter(shingles: DataFrame, room: int) -> DataFrame:
    """One row, one array of `room` 64-bit words, whatever the number of shingles."""
    marked = shingles.select(_word(F.col("s"), room).alias("id"), _bits(F.col("s")).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    every = shingles.sparkSession.range(room).join(marked, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return every.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("filter"))


def _room(shingles: int) -> int:
    room = 1 << 10
    while room < min(MOST, shingles * ROOM):
        room *= 2
    return room


def _occurrences(documents: DataFrame, shingles: DataFrame, window: int, sizes: list[int], room: int) -> DataFrame:
    """(row, doc_id, n_words, found) of each document; found are places where the filter knows the shingle, and the words around."""
    ready = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    ready = ready.select("*", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"), _filter(shingles, room).scalar().alias("filter"))

    def of(size: int) -> Column:
        every = F.transform(_places(F.col("n"), size), lambda i: F.struct(i.alias("at"), _shingle(F.col("h"), i, size).alias("s")))

        word = lambda x: F.get("filter", _word(x["s"], room).cast("int"))
        # One bit first, as it costs little and few shingles have it.
        likely = F.filter(every, lambda x: F.getbit(word(x), _bit(x["s"], 58)) == 1)
        known = F.filter(likely, lambda x: word(x).bitwiseAND(_bits(x["s"])) == _bits(x["s"]))
        first = lambda x: F.greatest(x["at"] - (window - size), F.lit(0))
        around = lambda x: F.slice("w", first(x) + 1, x["at"] + window - first(x))
        return F.transform(known, lambda x: F.struct(x["at"].alias("at"), x["s"].alias("s"), first(x).alias("first"), around(x).alias("around")))

    found = F.concat(*[of(k) for k in sizes]) if sizes else F.array().cast("array<struct<at:int,s:bigint,first:int,around:array<string>>>")
    return ready.select("row", "doc_id", F.col("n").alias("n_words"), found.alias("found"))


def _rarest(shingles: DataFrame, times: DataFrame) -> DataFrame:
    """(s, key, parts, place): of each window the shingle that documents hold least often; windows with one that none holds are gone."""
    counted = shingles.join(times, "s", "left")
    least = counted.groupBy("key").agg(F.min_by(F.struct("s", "place", "parts"), F.struct("n", "place")).alias("x"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    return least.where("all").select("key", "x.*")


def contaminations(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (row, doc_id, n_words), each window where it occurs (row, start, length, key), and the windows of items (item_id, key)."""
    items = written(windows(benchmark, window))
    shingles = written(_shingles(items.select("key", "parts").distinct(), shingle))
    kinds = shingles.groupBy("size").agg(F.count_distinct("s").alias("n")).collect()  # a row for each size of a shingle
    sizes = sorted(r["size"] for r in kinds)
    found = written(_occurrences(documents, shingles, window, sizes, _room(sum(r["n"] for r in kinds))))
    times = found.select(F.explode("found.s").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    rarest = written(_rarest(shingles, times))
    met = found.select("row", "n_words", F.inline("found")).join(rarest, "s")
    start, length = F.col("at") - F.col("place"), F.size("parts")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    held = met.where(fits).where(F.slice("around", start - F.col("first") + 1, length) == F.col("parts"))
    hits = held.select("row", start.alias("start"), length.alias("length"), "key")
    return found.select("row", "doc_id", "n_words"), written(hits), items


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Of every document its words, those that lie in a window of an item, and the items whose windows it holds.

    Null and empty texts have no words and are not contaminated; an item without words has no window, one of fewer words than a window
    is one. Items with a null id count as one of empty id; items of one id are one. Repeated documents give repeated rows,
    null doc_ids stay null. Texts are read whole, whatever their length. Without documents there are no rows, without items none
    is contaminated; columns of other names are not read.
    """
    every, hits, items = contaminations(documents, benchmark, window, shingle)
    end = F.col("start") + F.col("length")
    before = F.coalesce(F.max(end).over(Window.partitionBy("row").orderBy("start", "length", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("row", F.greatest(end - F.greatest("start", before), F.lit(0)).alias("more")).groupBy("row").agg(F.sum("more").alias("n_hit"))
    listed = hits.select("row", "key").distinct().join(items.select("item_id", "key"), "key").select("row", "item_id").distinct()
    of_items = listed.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    joined = every.join(covered, "row", "left").join(of_items, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), zero(F.col("n_hit")).alias("n_hit"), zero(F.col("n_items")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (zero(F.col("n_hit")) > 0).alias("contaminated"),
    )


def oracle_sql(window: int = WINDOW) -> str:
    """The same by comparing all runs of words with all windows of their length, in DuckDB."""
    parts = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '')"
    run = "array_to_string(w[a : a + length - 1], ' ')"
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, {parts} AS w FROM documents
), items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item_id, w, least(len(w), {window}) AS length
    FROM (SELECT item_id, {parts} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, length, {run} AS key FROM (SELECT *, unnest(range(1, len(w) - length + 2)) AS a FROM items)
), runs AS (
    SELECT row, a, length, {run} AS key
    FROM (SELECT row, w, length, unnest(range(1, len(w) - length + 2)) AS a FROM docs, (SELECT DISTINCT length FROM windows) WHERE len(w) >= length)
), held AS (
    SELECT row, a, runs.length, item_id FROM runs JOIN windows USING (key, length)
), words_hit AS (
    SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(a, a + length)) AS p FROM held) GROUP BY row
), items_hit AS (
    SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY encode(item_id)) AS ids FROM (SELECT DISTINCT row, item_id FROM held) GROUP BY row
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (row) LEFT JOIN items_hit USING (row)
"""
