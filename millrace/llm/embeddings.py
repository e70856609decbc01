"""Embedding near-duplicates by an inverted multi-index, links verified in double precision.

Unit vectors are cut in halves; a codebook for each half makes a grid of cells.
A vector lives in its nearest cell and visits others in the order of their
distance (multi-sequence traversal) until the target recall, which is measured
on neighbours at the limit. Visitors meet members cell by cell; a cell with many of
either is cut into blocks, so hot cells spread over many tasks. They first meet with a
byte for each component, whose error is bounded; only those that may reach the limit
come again with their vectors. Counts and a spanning forest of links leave a block. Vectors
of each length have an index of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.operators.components import components

COSINE = 0.95
#: Vectors that the codebooks are fitted on, at most; all are indexed.
SAMPLE = 20_000
#: Vectors that a cell should hold; codebooks grow with the root of the rows, up to one codeword for so many vectors of the sample.
PER_CELL, PER_CODE = 32, 4
#: Share of neighbours at the limit whose cell is visited, measured on TRIALS of them. Links are seen from both ends.
RECALL, TRIALS = 0.999, 2_000
#: Rows of either side in a block.
BLOCK = 1024
ROUNDS, SEED = 8, 7


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, without the linear algebra library's threads."""
    return (x * x).sum(1)[:, None] - 2 * np.einsum("id,kd->ik", x, centres) + (centres * centres).sum(1)[None]


def _codebook(x: np.ndarray, codes: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), codes, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([_squares(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        for k in np.unique(own):
            centres[k] = x[own == k].mean(0)
    return centres


def traversal(first: np.ndarray, second: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The `count` nearest cells of the grid: pairs (i, j) by first[i] + second[j], lowest first.

    Multi-sequence traversal: both lists are sorted, and a heap holds the pairs
    whose neighbours before them have all been given out.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(first[a[x]] + second[b[y]]), x, y))
    return out


class MultiIndex:
    """Codebooks of both halves, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, rows: int):
        rng = np.random.default_rng(SEED)
        self.half = max(1, sample.shape[1] // 2)
        codes = int(np.clip(round((rows / PER_CELL) ** 0.5), 1, max(1, len(sample) // PER_CODE)))
        self.books = [_codebook(sample[:, s].copy(), codes, rng) for s in (slice(self.half), slice(self.half, None))]
        self.visits = self._visits(sample, rng)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, : self.half], self.books[0]), _squares(x[:, self.half :], self.books[1])

    def _visits(self, sample: np.ndarray, rng: np.random.Generator) -> int:
        """Cells that must be visited for the target recall, for neighbours at exactly the limit."""
        x = sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)]
        other = rng.standard_normal(x.shape)
        other -= (other * x).sum(1, keepdims=True) * x
        other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
        y = COSINE * x + (1 - COSINE**2) ** 0.5 * other
        (xa, xb), (ya, yb) = self.distances(x), self.distances(y)
        there, back = _rank(xa, xb, ya.argmin(1), yb.argmin(1)), _rank(ya, yb, xa.argmin(1), xb.argmin(1))
        return int(np.ceil(np.quantile(np.minimum(there, back), RECALL))) + 1

    def cells(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits; the first is where it lives. Their numbers hold the vectors' length."""
        codes, width = len(self.books[0]), x.shape[1] << 40
        a, b = self.distances(x)
        return [[width + i * codes + j for i, j in traversal(a[k], b[k], self.visits)] for k in range(len(x))]


def _rank(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many cells are nearer than cell (i, j)."""
    rows = np.arange(len(a))
    limit = a[rows, i] + b[rows, j]
    out = np.zeros(len(a), dtype=np.int64)
    sorted_b = np.sort(b, axis=1)
    for r in range(len(a)):
        out[r] = np.searchsorted(sorted_b[r], limit[r] - a[r], side="left").sum()
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v of length one, in double precision; v is null for vectors that link with nothing."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    # The largest component first, so that squares neither overflow nor vanish.
    top = F.array_max(F.transform(x, lambda e: F.abs(e)))
    usable = F.coalesce(~bad & (F.size(x) > 0) & (top > 0), F.lit(False))
    scaled = vectors.select("vec_id", F.when(usable, F.transform(x, lambda e: e / top)).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    return scaled.select("vec_id", F.transform("x", lambda e: e / norm).alias("v"))


def fit(units: DataFrame, rows: int) -> MultiIndex:
    """An index fitted on at most SAMPLE vectors, chosen by the hash of their ids."""
    sample = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    return MultiIndex(np.stack(sample["v"].to_numpy()).astype(float), rows)


def bytes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components as bytes, what one step of a byte is worth, and how far each vector is from what its bytes say."""
    step = np.maximum(np.abs(x).max(1), 1e-300) / 127
    code = np.rint(x / step[:, None]).astype(np.int8)
    return code, step, np.linalg.norm(x - code * step[:, None], axis=1)


def _visit(indexes: dict[int, MultiIndex], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            rows = part.column("v").to_numpy(zero_copy_only=False)
            widths = np.array([len(v) for v in rows])
            cells, code, step, off = [None] * len(rows), [None] * len(rows), np.zeros(len(rows)), np.zeros(len(rows))
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                x = np.stack(rows[own])
                short, step[own], off[own] = bytes_of(x)
                for k, c, s in zip(own.tolist(), indexes[width].cells(x), short):
                    cells[k], code[k] = c, s.tobytes()
            more = [pa.array(cells, pa.list_(pa.int64())), pa.array(code, pa.binary()), pa.array(step), pa.array(off)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "cells", "code", "step", "off"])


_FOUND = "id bigint, other bigint, links bigint"


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that span whatever a matrix of links ties together, breadth first."""
    rows, columns = near.any(1), near.any(0)
    i, j = [], []
    while rows.any():
        front = np.array([int(rows.argmax())])
        rows[front] = False
        while len(front):
            new = np.flatnonzero(near[front].any(0) & columns)
            columns[new] = False
            i.append(front[near[np.ix_(front, new)].argmax(0)] if len(new) else new)
            j.append(new)
            front = np.flatnonzero(near[:, new].any(1) & rows)
            rows[front] = False
            i.append(front)
            j.append(new[near[np.ix_(front, new)].argmax(1)] if len(front) else front)
    return (np.concatenate(i), np.concatenate(j)) if i else (np.empty(0, int), np.empty(0, int))


def _may_link(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block the visitors and members that may reach the limit by their bytes."""
    visitors, members = rows[rows["visits"]], rows[~rows["visits"]]
    if not len(visitors) or not len(members):
        return rows.iloc[:0][_SHORT]
    v, m = (np.stack([np.frombuffer(c, np.int8) for c in x["code"]]) * x["step"].to_numpy()[:, None] for x in (visitors, members))
    v_off, m_off = visitors["off"].to_numpy()[:, None], members["off"].to_numpy()[None]
    # With vectors v + e and m + f of length one, v . m is that far from their cosine at most.
    bound = (1 + v_off) * m_off + (1 + m_off) * v_off + v_off * m_off + 1e-9
    near = np.einsum("id,jd->ij", v, m) + bound >= COSINE
    near &= visitors["id"].to_numpy()[:, None] != members["id"].to_numpy()[None]
    return pd.concat([visitors[near.any(1)], members[near.any(0)]])[_SHORT]


_SHORT = ["cell", "x", "y", "visits", "id"]


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the visitors and the members of a block.

    Gives (id, null, links) for counts, and (id, other, 0) for links that span what hangs together.
    """
    visitors, members = rows[rows["visits"]], rows[~rows["visits"]]
    if not len(visitors) or not len(members):
        return pd.DataFrame({"id": [], "other": [], "links": []})
    v, m = np.stack(visitors["v"].to_numpy()), np.stack(members["v"].to_numpy())
    vi, mi = visitors["id"].to_numpy(), members["id"].to_numpy()
    near = (np.einsum("id,jd->ij", v, m) >= COSINE) & (vi[:, None] != mi[None])
    # A pair is seen from both ends if each visits the other's cell; then the visit of the smaller id counts.
    homes, home = np.unique(visitors["home"].to_numpy(), return_inverse=True)
    back = np.stack([np.isin(homes, c) for c in members["cells"]], axis=1)
    near &= ~back[home] | (vi[:, None] < mi[None])
    # Exact copies stand behind an id: their number counts for the other end.
    from_v = (near * members["copies"].to_numpy()[None]).sum(1)
    from_m = (near * visitors["copies"].to_numpy()[:, None]).sum(0)
    i, j = _forest(near)
    ids = np.concatenate([vi[from_v > 0], mi[from_m > 0], vi[i]])
    links = np.concatenate([from_v[from_v > 0], from_m[from_m > 0], np.zeros(len(i), dtype=np.int64)])
    other = pd.array([None] * (len(ids) - len(i)) + mi[j].tolist(), dtype="Int64")
    return pd.DataFrame({"id": ids, "other": other, "links": links})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Equal vectors are one class with a count from the start. Vectors of
    different lengths are never links; each length has its index. Repeated ids repeat in the result, each row
    linked by its own vector; a component's id is the smallest that is not null, and rows with a null id are
    kept where no row of their component has one. Extra columns are not read; an empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    units = written(unit_vectors(vectors.select("vec_id", "embedding")))
    classes = units.where("v IS NOT NULL").withColumn("print", F.xxhash64("v"))
    least = F.min(F.struct(F.col("vec_id").isNull().alias("unnamed"), "vec_id")).alias("least")
    heads = classes.groupBy("print", "v").agg(least, F.count("*").alias("copies"))
    # Written with its rows numbered, so that the numbers stay; a class is known by its number.
    heads = written(heads.withColumn("id", F.monotonically_increasing_id()))
    # A row for each length of vectors, of which a table has a few.
    widths = {r["w"]: r["n"] for r in heads.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()}
    rows = heads.select("id", "copies", "v")
    index = spark.sparkContext.broadcast({w: fit(rows.where(F.size("v") == w), n) for w, n in widths.items()})  # two codebooks each
    fields = "id bigint, copies bigint, v array<double>, cells array<bigint>, code binary, step double, off double"
    placed = rows.repartition("id").mapInArrow(lambda batches: _visit(index.value, batches), fields)
    placed = written(placed.withColumn("home", F.col("cells")[0]))
    lives = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("members"))
    comes = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    # A row for each cell with members.
    sizes = written(lives.join(comes, "cell"))
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    short = ["id", "code", "step", "off"]
    # In a large cell each member meets each block of visitors, and each visitor each block of members.
    member = (
        placed.select(F.col("home").alias("cell"), *short).join(sizes, "cell")
        .withColumn("x", F.pmod(F.xxhash64("id"), parts("members")).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), parts("visitors") - 1)))
        .select("cell", "x", "y", F.lit(False).alias("visits"), *short)
    )
    visitor = (
        placed.select(F.explode("cells").alias("cell"), *short).join(sizes, "cell")
        .withColumn("y", F.pmod(F.xxhash64("id"), parts("visitors")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), parts("members") - 1)))
        .select("cell", "x", "y", F.lit(True).alias("visits"), *short)
    )
    met = member.unionByName(visitor).groupBy("cell", "x", "y")
    some = written(met.applyInPandas(_may_link, "cell bigint, x int, y int, visits boolean, id bigint"))
    again = some.join(placed.select("id", "copies", "v", "home", "cells"), "id")
    found = written(again.groupBy("cell", "x", "y").applyInPandas(_block, _FOUND))
    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    parted = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes_of = heads.join(counts, "id", "left").join(parted, "id", "left").withColumn("component", F.coalesce("component", "id"))
    classes_of = written(classes_of.select("print", "v", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component", "least"))
    top = classes_of.groupBy("component").agg(F.min("least").vec_id.alias("component_id"))
    named = units.withColumn("print", F.xxhash64("v")).join(classes_of.join(top, "component"), ["print", "v"], "left")
    component = F.when(F.col("print").isNull() | F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return named.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
