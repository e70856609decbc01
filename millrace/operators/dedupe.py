"""Fuzzy duplicates of named records: a greedy fold in order of name within each block, found by rounds of joins.

A record joins the first kept place whose record it equals, and takes the place over if it is richer. Two
records can equal each other only if they share a site, one name contains the other, or the names are close; those links are found
by joins on keys that lose none.

Which place a record joins depends on who holds the places just then, and so on all records before it. The
fold is therefore a fixed point: given a place for every record, each place's holders over time follow from
the first record of each richness in it, and given the holders, each record's first match follows by a join. What is right for
the first records stays right, and each round makes more of them right, so repeating this until nothing
changes gives the fold exactly, and no task ever holds a block or a connected part.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip_article
from millrace.storage import removed, written

#: Names closer than this are the same.
RATIO = 0.88


def _close(a: str, b: str) -> list[bool]:
    """Whether the ratio from the first to the second exceeds RATIO, and that from the second to the first.

    What both hold of each letter bounds either ratio; it is counted once for both.
    """
    length = len(a) + len(b)
    if 2 * min(len(a), len(b)) <= RATIO * length or 2.0 * sum(min(a.count(c), b.count(c)) for c in set(a)) / length <= RATIO:
        return [False, False]
    return [SequenceMatcher(None, x, y).ratio() > RATIO for x, y in ((a, b), (b, a))]


def _grams(name: Column, size: int) -> Column:
    """All runs of `size` characters; none of shorter names."""
    last = F.greatest(F.length(name) - size, F.lit(-1))
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(name, i + 1, F.lit(size)))


def containments(names: DataFrame) -> DataFrame:
    """(a, b) of names, by id, in one block, of which one is within the other, both ways round.

    A name looks for its rarest run of three characters (shorter names: for themselves) among the runs of others.
    """
    runs = lambda sizes: F.array_distinct(F.flatten(F.array(*[_grams(F.col("bare"), k) for k in sizes])))
    held = names.select("block", "id", "bare", F.explode(runs([1, 2, 3])).alias("gram"))
    times = written(held.groupBy("block", "gram").agg(F.count("*").alias("n")))
    own = F.when(F.length("bare") < 3, F.array("bare")).otherwise(F.array_distinct(_grams(F.col("bare"), 3)))
    asks = names.select("block", "id", "bare", F.explode(own).alias("gram")).join(times, ["block", "gram"])
    rare = asks.groupBy("block", "id", "bare").agg(F.min(F.struct("n", "gram")).alias("r")).where("r.n > 1")
    rare = rare.select("block", F.col("id").alias("a"), F.col("bare").alias("x"), F.col("r.gram").alias("gram"))
    met = rare.join(held.withColumnRenamed("id", "b"), ["block", "gram"])
    found = met.where((F.col("a") != F.col("b")) & F.contains("bare", F.col("x")))
    return found.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def close_names(names: DataFrame) -> DataFrame:
    """(a, b) of names, by id, in one block, whose ratio from the first to the second exceeds RATIO; the other way round it may not.

    Of la + lb characters at most 12 % are unmatched, so the matched blocks hold over 0.32 * (la + lb) - 1 common
    pairs of letters; the shorter is at least 0.785 times as long as the longer. So two such names share one of the
    floor(0.43 * length) + 2 rarest pairs (repeats numbered) of each.
    """
    pairs = F.posexplode(_grams(F.col("bare"), 2)).alias("at", "gram")
    each = names.select("block", "id", "bare", pairs)
    numbered = each.selectExpr("block", "id", "bare", "concat(gram, '#', row_number() OVER (PARTITION BY block, id, gram ORDER BY at)) AS token")
    times = written(numbered.groupBy("block", "token").agg(F.count("*").alias("n")))
    ranked = numbered.join(times, ["block", "token"]).groupBy("block", "id", "bare").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("r"))
    most = (F.floor(F.length("bare") * 0.43) + 2).cast("int")
    rare = written(ranked.select("block", "id", "bare", F.explode(F.slice("r", F.lit(1), most)).alias("r")).where("r.n > 1").select("block", "id", "bare", "r.token"))
    other = rare.select("block", "token", F.col("id").alias("b"), F.col("bare").alias("y"))
    small, large = F.least(F.length("bare"), F.length("y")), F.greatest(F.length("bare"), F.length("y"))
    met = rare.join(other, ["block", "token"]).where((F.col("id") < F.col("b")) & (small >= large * 0.78))
    met = met.select(F.col("id").alias("a"), "b", "bare", "y").distinct()

    @F.arrow_udf("array<boolean>")
    def close(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([_close(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.list_(pa.bool_()))

    judged = met.select("a", "b", close("bare", "y").alias("is"))
    both = F.filter(F.array(F.struct("a", "b", F.col("is")[0].alias("is")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("is")[1].alias("is"))), lambda x: x["is"])
    return judged.select(F.inline(both)).select("a", "b")


def _holders(state: DataFrame) -> DataFrame:
    """(slot, at, until): who holds a place from its own turn on, until the turn of the next (null: to the end).

    Only the first record of each richness can take a place over, so what meets for a place are as many rows as
    it has richnesses, however many records. A place goes by the first record in it: where the one that it was named after
    turns out to stand elsewhere, the others follow at once, not one after another.
    """
    first = state.groupBy("slot", "_rich").agg(F.min("_at").alias("at"))
    turns = Window.partitionBy("slot").orderBy("at")
    best = F.max("_rich").over(turns.rowsBetween(Window.unboundedPreceding, -1))
    taken = first.withColumn("best", best).where(F.col("best").isNull() | (F.col("_rich") > F.col("best")))
    return taken.select(F.first("at").over(turns).alias("slot"), "at", F.lead("at").over(turns).alias("until"))


def _nodes(records: DataFrame) -> DataFrame:
    """A row for each of the nodes (name and site) that a record stands at."""
    return records.select("_at", F.explode(F.array_compact(F.array("_node", "_place"))).alias("node"))


def _round(state: DataFrame, active: DataFrame, meets: DataFrame) -> DataFrame:
    """Each record's place by the holders that the places of the round before give, and whether it changed."""
    standing = active.select(F.col("_at").alias("at"), "_node", "_place")
    held = _holders(state).join(standing, "at").select("slot", "at", "until", F.explode(F.array_compact(F.array("_node", "_place"))).alias("b"))
    seen = meets.join(held, "b").select(F.col("a").alias("node"), "slot", "at", "until")
    then = (F.col("at") < F.col("_at")) & (F.col("until").isNull() | (F.col("_at") <= F.col("until")))
    match = _nodes(active).join(seen, "node").where(then).groupBy("_at").agg(F.min("slot").alias("match"))
    joined = state.join(match, "_at", "left").withColumn("now", F.coalesce("match", "_at"))
    return joined.select("_at", "_rich", F.col("now").alias("slot"), (F.col("now") != F.col("slot")).alias("moved"))


def fuzzy_dedupe(rows: DataFrame, block: list[str], name: Column, website: Column, rich: Column, order: Column) -> DataFrame:
    """Survivors of each block: in order of name, a record joins the first one it equals, the richer staying.

    Null names and sites are empty and match nothing; names are compared without their article, sites without closing slashes. Equal names
    are one node, so copies make no pairs. A richness has a bounded number of values (fields that are filled, links).
    """
    site = F.when(website != "", F.rtrim(website, F.lit("/")))
    ready = rows.withColumns(
        {
            "_name": F.coalesce(name, F.lit("")), "_bare": F.nullif(F.coalesce(strip_article(name), F.lit("")), F.lit("")), "_rich": rich, "_seq": order,
            "_site": site, "_block": F.to_json(F.struct(*block), {"ignoreNullFields": "false"}),
        }
    )
    turn = ["_block", "_name", "_seq"]
    # Numbers rise in the order of the turns; written, they stay.
    placed = written(ready.repartitionByRange(*turn).sortWithinPartitions(*turn).withColumn("_at", F.monotonically_increasing_id()))
    # A node is known by its first record, that of a site by a number below zero.
    names = written(placed.where("_bare IS NOT NULL").groupBy("_block", "_bare").agg(F.min("_at").alias("_node"), F.count("*").alias("n")))
    sites = written(placed.where("_site IS NOT NULL").groupBy("_block", "_site").agg((-1 - F.min("_at")).alias("_place"), F.count("*").alias("n")))
    known = names.select(F.col("_block").alias("block"), F.col("_bare").alias("bare"), F.col("_node").alias("id"))
    other = written(containments(known).unionByName(close_names(known)).distinct())
    crowded = other.select(F.col("a").alias("node")).unionByName(other.select(F.col("b").alias("node")))
    for table, node in ((names, "_node"), (sites, "_place")):
        crowded = crowded.unionByName(table.where("n > 1").select(F.col(node).alias("node")))
    crowded = crowded.distinct()
    own = crowded.select(F.col("node").alias("a"), F.col("node").alias("b"))
    meets = written(other.unionByName(own).distinct())
    slim = placed.join(names.drop("n"), ["_block", "_bare"], "left").join(sites.drop("n"), ["_block", "_site"], "left").select("_at", "_rich", "_node", "_place")
    # The others equal nothing and stay.
    meet = _nodes(slim).join(crowded, "node", "left_semi").select("_at").distinct()
    active = written(slim.join(meet, "_at", "left_semi"))
    state = written(active.select("_at", "_rich", F.coalesce("_node", -1 - F.col("_place")).alias("slot")))
    while True:
        step = written(_round(state, active, meets))
        removed(state)
        state = step.drop("moved")
        if not step.where("moved").take(1):
            break
    lost = active.select("_at").join(_holders(state).where("until IS NULL").select(F.col("at").alias("_at")), "_at", "left_anti")
    return placed.join(lost, "_at", "left_anti").select(*rows.columns)


def oracle_sql(rows: str, columns: list[str]) -> str:
    """The same in DuckDB: the fold itself, one record of each block after another, and the ratio by its definition.

    `rows` gives block, name, site, rich and seq beside `columns`.
    """
    text = lambda c: f"coalesce({c}, '')"
    bare = "regexp_replace(lower(trim(name)), '^(a|az|the|die|le|la|el|los|las) ', '')"
    return f"""
WITH RECURSIVE r AS (
    SELECT *, {text(bare)} AS bare, row_number() OVER (PARTITION BY block ORDER BY encode({text("name")}), seq) AS i FROM ({rows})
), near AS (
    SELECT row_number() OVER () AS p, x, y FROM (
        SELECT DISTINCT a.bare AS x, b.bare AS y FROM r a JOIN r b ON a.block = b.block AND a.i > b.i
        WHERE a.bare <> '' AND b.bare <> '' AND NOT contains(a.bare, b.bare) AND NOT contains(b.bare, a.bare)
        AND 2 * least(length(a.bare), length(b.bare)) > {RATIO} * (length(a.bare) + length(b.bare)))
), cells AS (
    SELECT p, i, j, i - j AS d, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS run
    FROM (SELECT p, x, y, i, unnest(range(1, length(y) + 1)) AS j FROM (SELECT p, x, y, unnest(range(1, length(x) + 1)) AS i FROM near)) WHERE x[i] = y[j]
), equal AS (
    SELECT p, i, j, max(i) OVER (PARTITION BY p, d, run) - i + 1 AS n FROM cells
), parts AS (
    SELECT p, 1 AS x0, length(x) + 1 AS x1, 1 AS y0, length(y) + 1 AS y1, 0 AS matched FROM near
    UNION ALL
    SELECT p, s.x0, s.x1, s.y0, s.y1, s.matched FROM (
        SELECT p, unnest([{{'x0': x0, 'x1': -m.i, 'y0': y0, 'y1': -m.j, 'matched': m.n}}, {{'x0': -m.i + m.n, 'x1': x1, 'y0': -m.j + m.n, 'y1': y1, 'matched': 0}}]) AS s
        FROM (
            SELECT q.p, x0, x1, y0, y1, max({{'n': cast(least(n, x1 - i, y1 - j) AS INTEGER), 'i': cast(-i AS INTEGER), 'j': cast(-j AS INTEGER)}}) AS m
            FROM parts q JOIN equal e ON e.p = q.p AND i >= x0 AND i < x1 AND j >= y0 AND j < y1 GROUP BY ALL))
), close AS (
    SELECT x, y FROM near JOIN (SELECT p, sum(matched) AS m FROM parts GROUP BY p) USING (p) WHERE 2.0 * m / (length(x) + length(y)) > {RATIO}
), equals AS (
    SELECT a.block, a.i, list(b.i) AS those FROM r a JOIN r b ON a.block = b.block AND a.i > b.i LEFT JOIN close ON x = a.bare AND y = b.bare
    WHERE (a.site <> '' AND b.site <> '' AND rtrim(a.site, '/') = rtrim(b.site, '/'))
        OR (a.bare <> '' AND b.bare <> '' AND (contains(a.bare, b.bare) OR contains(b.bare, a.bare))) OR x IS NOT NULL
    GROUP BY ALL
), ready AS (
    SELECT r.block, r.i, rich, coalesce(those, []) AS those FROM r LEFT JOIN equals USING (block, i)
), fold AS (
    SELECT DISTINCT block, 0::BIGINT AS i, []::BIGINT[] AS kept, []::BIGINT[] AS riches FROM r
    UNION ALL
    SELECT block, i,
        CASE WHEN spot = 0 THEN kept || [i] WHEN rich > riches[spot] THEN kept[1 : spot - 1] || [i] || kept[spot + 1 :] ELSE kept END,
        CASE WHEN spot = 0 THEN riches || [rich] WHEN rich > riches[spot] THEN riches[1 : spot - 1] || [rich] || riches[spot + 1 :] ELSE riches END
    FROM (
        SELECT f.block, n.i, kept, riches, cast(n.rich AS BIGINT) AS rich, coalesce(list_position(list_transform(kept, lambda k: list_contains(n.those, k)), true), 0) AS spot
        FROM fold f JOIN ready n ON n.block = f.block AND n.i = f.i + 1)
), ended AS (
    SELECT block, unnest(kept) AS i FROM (SELECT block, arg_max(kept, i) AS kept FROM fold GROUP BY block)
)
SELECT {", ".join(columns)} FROM r JOIN ended USING (block, i)
"""
