"""MinHash near-duplicates by an LSH forest, links confirmed on full shingle sets.

Each tree orders the documents by a sequence of minhashes. Documents that share
the first of them form a region; a region with too many members goes down the
tree to where it parts. Within a region, in the tree's order, the neighbour with
the longest common prefix (of several the nearest by a sketch, four bits of each
minhash) becomes a candidate, one for each document, and is confirmed on the full sets.

Then what the sketches of a region still show between different components is
settled: the members concerned, never their pairs, go back to their region with
their full sets, and only links that join components leave it. Members of regions
that were too large meet there by their rarest shingles instead: two sets at the
limit share one of the few rarest of each, so that this loses nothing, and what
most members of a large region share brings none of them together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import mix, shingle_hashes, word_hashes, written
from millrace.operators.components import components

WORDS = 5
#: Links have 100 * intersection >= limit * union; this is the limit unless another is given.
PERCENT = 85
TREES = 16
#: Minhashes shared at each level of a tree. Regions share the first, deeper ones order and part their members.
#: At the first, 16 trees miss a pair of similarity 0.85 once in 4 million.
DEPTHS = (3, 5, 8, 12)
#: A region of more members, or with more shingles in all, is too large for one task.
REGION, SHINGLES = 2048, 4_000_000
#: Share of pairs at the limit whose sketches may differ in more places than the bound; they are lost.
LOST = 1e-5
#: Ids whose full sets are wanted are broadcast to the scan of the texts up to this number (some 50 MB); more are joined.
BROADCAST_IDS = 2_000_000

_HASHES = TREES * DEPTHS[-1]
_SEEDS = mix(np.arange(2 * _HASHES, dtype=np.uint64))
_XOR = _SEEDS[:_HASHES].astype(np.uint32)[:, None]
_FACTOR = (_SEEDS[_HASHES:].astype(np.uint32) | np.uint32(1))[:, None]
#: Shingles that are hashed at a time.
_BLOCK = 4096


def most_differing(percent: int) -> int:
    """Places of the sketch that may differ: the binomial bound that pairs at the limit exceed with a chance of LOST."""
    p = (1 - percent / 100) * 15 / 16
    upto, chance = -1, 0.0
    while 1 - chance > LOST:
        upto += 1
        chance += comb(_HASHES, upto) * p**upto * (1 - p) ** (_HASHES - upto)
    return upto


def _minhashes(shingles: np.ndarray) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(_HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(h), _BLOCK):
        np.minimum(low, ((h[None, at : at + _BLOCK] ^ _XOR) * _FACTOR).min(axis=1), out=low)
    return low


def _labels(low: np.ndarray) -> np.ndarray:
    """For each tree and level, a 64-bit hash of the minhashes down to there."""
    tree = low.reshape(TREES, DEPTHS[-1]).astype(np.uint64)
    out, h = np.empty((TREES, len(DEPTHS)), dtype=np.uint64), np.arange(TREES, dtype=np.uint64)
    for depth in range(DEPTHS[-1]):
        h = mix(h ^ tree[:, depth])
        if depth + 1 in DEPTHS:
            out[:, DEPTHS.index(depth + 1)] = h
    return out


def _sketch(low: np.ndarray) -> bytes:
    """Four bits of each minhash; they agree wherever the minhashes do, and else once in 16."""
    four = (mix(low.astype(np.uint64) + (np.arange(_HASHES, dtype=np.uint64) << np.uint64(32))) >> np.uint64(60)).astype(np.uint8)
    return (four[::2] << np.uint8(4) | four[1::2]).tobytes()


_ONES = np.uint64(0x1111111111111111)


def _differ(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Places in which each of some sketches and each of others differ."""
    out = np.zeros((len(rows), len(columns)), dtype=np.int16)
    for left, right in zip(rows.T, columns.T):
        x = left[:, None] ^ right[None]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        out += np.bitwise_count(x & _ONES)
    return out


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of a text's set; only A to Z are put in lower case."""
    return shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower()), WORDS)


_SIGNED = pa.struct(
    [("n", pa.int64()), ("print", pa.binary()), ("labels", pa.list_(pa.int64())), ("sketch", pa.binary())]
)


def signatures(text: Column) -> Column:
    """struct<n, print, labels, sketch> of each text; print names its set (null: an empty set)."""

    @F.arrow_udf("struct<n:bigint,print:binary,labels:array<bigint>,sketch:binary>")
    def sign(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            s = shingle_set(t.as_py() or "")
            if not len(s):
                rows.append({"n": 0})
                continue
            low = _minhashes(s)
            name = np.array([np.bitwise_xor.reduce(mix(s)), mix(s ^ mix(s >> np.uint64(7))).sum()], dtype=np.uint64)
            rows.append(
                {
                    "n": len(s), "print": name.tobytes() + len(s).to_bytes(4, "little"),
                    "labels": _labels(low).ravel().view(np.int64), "sketch": _sketch(low),
                }
            )
        return pa.array(rows, type=_SIGNED)

    return sign(text)


def shingle_sets(text: Column) -> Column:
    """array<bigint>: the full set of each text."""

    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py() or "").view(np.int64) for t in texts], type=pa.list_(pa.int64()))

    return sets(text)


def _too_large() -> Column:
    return (F.col("members") > REGION) | (F.col("shingles") > SHINGLES)


def regions(classes: DataFrame) -> DataFrame:
    """(at, id, n, tree, place, large, head) of the members of every region with two or more.

    `at` names the region, place holds the labels of the member in that tree at all
    depths, large says whether the region is too large for one task, head is its smallest member.
    """
    tree = F.posexplode(
        F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("labels", t * len(DEPTHS) + 1, len(DEPTHS)))
    ).alias("tree", "place")
    # Labels hold the tree, so the label alone names a region.
    rows = classes.select("id", "n", tree).withColumn("at", F.col("place")[0])
    sizes = rows.groupBy("at").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("id").alias("head"))
    sizes = written(sizes.where("members > 1").select("at", "head", _too_large().alias("large")))
    # Merge joins wherever both sides grow with the documents, so that plans are alike at every size.
    return written(rows.join(sizes.hint("merge"), "at"))


def deeper(large: DataFrame) -> DataFrame:
    """Members of large regions under the first deeper label that few share; what never parts is dealt by hash."""
    out, rest = None, large
    for level in range(1, len(DEPTHS)):
        keyed = rest.withColumn("key", F.col("place")[level])
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        over = written(sizes.where(_too_large()))
        parted = keyed.join(over, "key", "left_anti")
        out = parted if out is None else out.unionByName(parted)
        rest = keyed.join(over, "key")
        if level < len(DEPTHS) - 1:
            rest = rest.drop("key", "members", "shingles")
    parts = F.ceil(F.greatest(F.col("members") / REGION, F.col("shingles") / SHINGLES))
    rest = rest.withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("at", "id"), parts)))
    return out.unionByName(rest.drop("members", "shingles"))


def by_rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id) of each set's rarest shingles, so many that two sets at the limit share one of them.

    Of n shingles at least percent * n / 100 are shared, so one of the first n - that + 1 in any common
    order is; the order is by how many sets hold a shingle.
    """
    each = sets.select("id", "n", F.explode("s").alias("shingle"))
    held = written(each.groupBy("shingle").agg(F.count("*").alias("sets")))
    ranked = each.join(held, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("r"))
    most = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    rare = ranked.select("id", F.explode(F.slice("r", F.lit(1), most)).alias("r")).where("r.sets > 1")
    return rare.select(F.col("r.shingle").alias("key"), "id")


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(by).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut and held:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


_MEMBER = "key bigint, part int, tree int, id bigint, n bigint, place array<bigint>, firsts array<bigint>, sketch binary, component bigint"


class _Members:
    """The members of whole groups, in columns, and which of them are candidates of each other."""

    def __init__(self, table: pa.Table, percent: int):
        self.table = table = table.combine_chunks()
        self.percent, self.most = percent, most_differing(percent)
        self.key, self.part, self.ids, self.n, self.tree, self.component = (
            table[c].to_numpy() for c in ("key", "part", "id", "n", "tree", "component")
        )
        self.sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint64).reshape(len(self.ids), -1)
        self.place, self.firsts = (table[c].combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1) for c in ("place", "firsts"))

    def groups(self) -> Iterator[tuple[slice, slice]]:
        """The rows that meet, of each group with several components."""
        edges = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1], True])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if (self.component[low:high] != self.component[low]).any():
                # Rows are sorted by part, so that the first of two parts comes first.
                middle = low + int(np.searchsorted(self.part[low:high], self.part[high - 1]))
                yield (slice(low, high),) * 2 if middle == low else (slice(low, middle), slice(middle, high))

    def near(self, rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        """Places in which sketches differ, and whether they and the sizes allow a link."""
        apart = _differ(self.sketch[rows], self.sketch[columns])
        small = np.minimum.outer(self.n[rows], self.n[columns])
        good = (apart <= self.most) & (100 * small >= self.percent * np.maximum.outer(self.n[rows], self.n[columns]))
        if rows == columns:
            good &= self.ids[rows, None] > self.ids[None, columns]
        return apart, good

    def pending(self, rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        """Possible links between different components, in the first tree that shows them, as rows of the table."""
        good = self.near(rows, columns)[1]
        i, j = np.nonzero(good & (self.component[rows, None] != self.component[None, columns]))
        i, j = i + rows.start, j + columns.start
        new = np.ones(len(i), dtype=bool)
        for t in range(self.tree[rows.start]):
            new &= self.firsts[i, t] != self.firsts[j, t]
        return i[new], j[new]


def _neighbours(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, differ): for each member b, of those with a smaller id that share the longest prefix with it, the nearest by sketch."""
    for table in _grouped(batches, "key"):
        m = _Members(table, percent)
        a, b, far = [], [], []
        for rows, columns in m.groups():
            apart, good = m.near(rows, columns)
            # A label stands for the whole prefix down to its level.
            prefix = sum((column[rows, None] == column[None, columns]).astype(np.int16) for column in m.place.T)
            score = np.where(good, apart - 1000 * prefix, 9999)
            # Of equally near ones the last in the tree's order.
            j = score.shape[1] - 1 - score[:, ::-1].argmin(axis=1)
            i = np.flatnonzero(good.any(axis=1))
            j = j[i]
            a.append(m.ids[columns][j])
            b.append(m.ids[rows][i])
            far.append(apart[i, j])
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b, far)], names=["a", "b", "differ"]
            )


def _pending(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members that may link with one of another component; each at most once, whatever the number of its pairs."""
    for table in _grouped(batches, "key"):
        m = _Members(table, percent)
        some = np.zeros(len(m.ids), dtype=bool)
        for rows, columns in m.groups():
            for side in m.pending(rows, columns):
                some[side] = True
        if some.any():
            yield from m.table.filter(pa.array(some)).to_batches()


def _joining(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): links, confirmed on full sets, that join components; fewer than there are members."""
    for table in _grouped(batches, "key"):
        m, a, b = _Members(table, percent), [], []
        held = m.table["s"].combine_chunks()
        ends, sets = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
        for rows, columns in m.groups():
            root = {c: c for c in np.unique(np.r_[m.component[rows], m.component[columns]]).tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            i, j = m.pending(rows, columns)
            edges = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else [0]
            for low, high in zip(edges[:-1], edges[1:]):
                one, mine = i[low], find(int(m.component[i[low]]))
                others = np.array([x for x in j[low:high] if find(int(m.component[x])) != mine], dtype=np.int64)
                if not len(others):
                    continue
                own = sets[ends[one] : ends[one + 1]]
                size = ends[others + 1] - ends[others]
                theirs = np.concatenate([sets[ends[x] : ends[x + 1]] for x in others])
                at = np.searchsorted(own, theirs)
                at[at == len(own)] = 0
                common = np.add.reduceat((own[at] == theirs).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
                for x in others[100 * common >= percent * (len(own) + size - common)].tolist():
                    p, q = find(int(m.component[one])), find(int(m.component[x]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(min(m.ids[one], m.ids[x]))
                        b.append(max(m.ids[one], m.ids[x]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.int64)) for x in (a, b)], names=["a", "b"])


def _together(rows: DataFrame, run: Callable, percent: int, schema: str) -> DataFrame:
    """`run` over whole groups; a group is bounded by REGION and SHINGLES, or is two such parts."""
    parted = rows.repartition("key").sortWithinPartitions("key", "part", "place", "id")
    return parted.mapInArrow(lambda batches: run(batches, percent), schema)


def _sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, s): the full sets of the classes in question. Texts are not shuffled while the ids are few."""
    ids = written(ids.distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return written(texts.join(ids, "id", "left_semi").select("id", "n", shingle_sets(F.col("text")).alias("s")))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    pairs = written(pairs)
    sets = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    # Merge joins at every size, as both sides grow with the documents.
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return written(both.where(common * 100 >= union * percent).select("a", "b"))


def _rare_members(large: DataFrame, classes: DataFrame, texts: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Members of large regions in groups by rare shingles, where a group has several components; large groups part by part."""
    sets = _sets(texts, large.select("id"))
    rare = by_rare_shingles(sets, percent).join(classes.select("id", "n", "sketch"), "id").join(parts, "id", "left")
    rare = written(rare.withColumn("component", F.coalesce("component", "id")))
    sizes = rare.groupBy("key").agg(
        F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("component").alias("x"), F.max("component").alias("y")
    ).where("x <> y")
    split = F.ceil(F.greatest(F.col("members") / REGION, F.col("shingles") / SHINGLES)).cast("int")
    own = rare.join(written(sizes.select("key", split.alias("parts"))), "key")
    own = own.withColumn("part", F.pmod(F.xxhash64("key", "id"), F.col("parts")).cast("int"))
    # Every part of a large group meets every part.
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Tree 0: no tree before it shows a pair.
    return own.select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "part", F.lit(0).alias("tree"), "id", "n",
        F.array_repeat("id", len(DEPTHS)).alias("place"), F.array_repeat("id", TREES).alias("firsts"), "sketch", "component",
    )


def class_components(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the classes that link with another one."""
    members = regions(classes)
    firsts = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.get("labels", t * len(DEPTHS)))
    signs = classes.select("id", firsts.alias("firsts"), "sketch")
    first = members.where("NOT large").withColumn("key", F.col("at"))
    large = members.where("large")
    any_large = not large.isEmpty()
    ordered = first.unionByName(deeper(large)) if any_large else first
    ready = ordered.withColumn("part", F.lit(0)).join(signs.hint("merge"), "id").withColumn("component", F.col("id"))
    ready = written(ready.select("large", *[c.split()[0] for c in _MEMBER.split(", ")]))
    near = _together(ready.drop("large"), _neighbours, percent, "a bigint, b bigint, differ bigint")
    nearest = near.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")).select("a", "b")
    ties = large.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    links = confirmed(nearest.unionByName(ties).distinct() if any_large else nearest, texts, percent)
    parts = written(components(links))
    known = ready.where("NOT large").drop("large", "component").join(parts.hint("merge"), "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    if any_large:
        known = known.unionByName(_rare_members(large, classes, texts, parts, percent))
    open_members = written(_together(known.select(*[c.split()[0] for c in _MEMBER.split(", ")]), _pending, percent, _MEMBER))
    if open_members.isEmpty():
        return parts
    sets = _sets(texts, open_members.select("id")).drop("n")
    more = written(_together(open_members.join(sets.hint("merge"), "id"), _joining, percent, "a bigint, b bigint"))
    return parts if more.isEmpty() else written(components(links.unionByName(more)))


def near_duplicates(documents: DataFrame, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, first) of every row; links reach `percent` of the union.

    Equal sets are one class from the start, so copies cost one grouped minimum.
    Null, empty and blank texts have no set: each is its own component. Texts
    are taken whole; other columns are not read, but for those in `carry`, which the
    rows keep in a struct `carried`. An empty table gives no rows.
    Rows are told apart whatever their ids, so rows of one id with different texts link
    each by its own text. A component's id is the smallest that is not null (null if none has
    one); kept says whether the row has that id, first is true for one row of each component.
    """
    also = [F.struct(*carry).alias("carried")] if carry else []
    # Texts are kept once, in what is carried or beside it.
    own = [] if "text" in carry else ["text"]
    text = F.col("text") if own else F.col("carried.text")
    signed = documents.select("doc_id", *own, *also, signatures(F.col("text")).alias("x"))
    # Written with its rows numbered, so that the numbers stay.
    signed = written(signed.select("doc_id", *own, *["carried"] * bool(carry), "x.*", F.monotonically_increasing_id().alias("row")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("head")
    heads = written(signed.where("n > 0").groupBy("print").agg(least))
    of_class = signed.where("n > 0").join(heads.select("head.row").hint("merge"), "row", "left_semi").withColumnRenamed("row", "id")
    classes = written(of_class.select("id", "n", "labels", "sketch"))
    parts = class_components(classes, signed.where("n > 0").select(F.col("row").alias("id"), "n", text.alias("text")), percent)
    named = heads.withColumn("id", F.col("head.row")).join(parts.hint("merge"), "id", "left")
    named = written(named.select("print", "head", F.coalesce("component", "id").alias("component")))
    of_component = named.groupBy("component").agg(F.min("head").alias("top"))
    named = written(named.join(of_component.hint("merge"), "component").select("print", "top"))
    # A set with very many copies is one hot key; its rows' side can be split.
    found = signed.drop(*own, "labels", "sketch").join(named.hint("merge"), "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("first"),
        *["carried"] * bool(carry),
    )
