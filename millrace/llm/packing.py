"""Packing documents into fixed-length sequences as a cutting-stock problem.

Documents become token ids and are cut at multiples of the sequence length;
what is left of each is a piece shorter than a sequence, or, where the histogram shows
that whole ones would leave much padding, several smaller pieces. The histogram of piece
lengths, of a fixed number of classes whatever the number of documents, goes
into a linear program over patterns (how many pieces of each class share one
sequence). Columns are priced by a knapsack dynamic program. The rounded
patterns are then dealt to the pieces by their rank within their class: plain
arithmetic on ranks, so no task and not the driver ever sees the pieces of a
class together.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

LENGTH = 1024
#: What is left of a document is cut to pieces of so many ids if whole ones need more than PADDING of all room.
SMALL, PADDING = 128, 0.02
#: Piece lengths are rounded up to a multiple of this for the linear program only.
GRAIN = 8
#: Columns that are priced at most, and how far from the best bound the program may end; its size doesn't depend on the data's.
ROUNDS, GAP = 3000, 1e-3
#: Merges by rank, and the file whose added tokens are found in texts.
VOCABULARY, ADDED = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Spaced words remembered by each worker process, in each of two generations, and characters encoded at a time.
REMEMBERED, CHUNK = 400_000, 2_000_000


class Tokens:
    """Ids of texts by a byte-level vocabulary, one id 0 behind each text.

    The ids are those that the library `tokenizers` gives with the JSON file and
    add_special_tokens=False: its added tokens are found in the text first, what lies between
    them is encoded by itself. Merges come from the same vocabulary's rank file, whose library
    needs a third of the time.
    """

    def __init__(self, path: str, json_path: str):
        import tiktoken

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        with open(json_path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        # Longest first, as one may begin another.
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.model = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = [array("I", self.model.encode_ordinary(t)) for t in texts]
        if sys.byteorder == "big":
            for ids in found:
                ids.byteswap()
        return [ids.tobytes() for ids in found]

    def _parts(self, text: str) -> list[str]:
        """The text between added tokens, and these."""
        if any(map(text.__contains__, self.added)):
            return [p for p in self.marks.split(text) if p]
        return [text] if text else []

    def _spaced(self, text: str) -> list[str]:
        first, *rest = text.split(" ")
        words = [" " + w for w in rest]
        return [first, *words] if first else words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Byte-level pre-tokens never cross a space that stands before a visible
        character, so texts in which no space stands before white space or the end are put together from their spaced words.
        """
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        self.new.update(self.added)
        parted = []
        for t in texts:
            parts = self._parts(t)
            parted.append(self._spaced(t) if len(parts) == 1 and t not in self.added else [w for p in parts for w in ([p] if p in self.added else self._spaced(p))])
        missing = []
        for p in set().union(*parted):
            if p in self.new:
                continue
            if (ids := self.old.get(p)) is not None:
                self.new[p] = ids
            else:
                missing.append(p)
        # A space before white space or the end: such words are never remembered.
        odd = {p for p in missing if p[0] == " " and not p[1:2].strip()}
        if odd:
            whole: set[str] = set()
            for i, words in enumerate(parted):
                if not odd.isdisjoint(words):
                    parted[i] = self._parts(texts[i])
                    whole.update(parted[i])
            missing = [p for p in whole.union(set(missing) - odd) if p not in self.new]
        self.new.update(zip(missing, self._ids(missing)))
        out = [b"".join(map(self.new.__getitem__, parts)) + b"\0\0\0\0" for parts in parted]
        for p in missing:
            if len(p) >= 64 or " " in p[1:]:
                del self.new[p]
        return out


_tokens: dict[tuple[str, str], Tokens] = {}


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    yield ids[at:], texts[at:]


_SMALL = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("class", pa.int32()), ("rank", pa.int64())])
)
_PIECE = [
    ("doc_id", "bigint", pa.int64()), ("start", "bigint", pa.int64()), ("length", "bigint", pa.int64()),
    ("ids_crc32", "bigint", pa.int64()), ("doc_tokens", "bigint", pa.int64()), ("part", "int", pa.int32()), ("class", "int", pa.int32()),
    ("rank", "bigint", pa.int64()),
    ("small", "array<struct<start:bigint,length:bigint,ids_crc32:bigint,class:int,rank:bigint>>", _SMALL), ("ids", "binary", pa.binary()),
]


def cut(
    documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, with_ids: bool = False, added: str | None = None
) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, and where they rank.

    `part` is the task that cut the piece, `class` its length in grains, `rank` its place among that
    task's pieces of its class. What is left of a document and longer than SMALL has in `small` the pieces that it may be cut to,
    ranked among their like (null: the piece stays). with_ids adds the ids; `vocabulary` is the rank file, `added` the JSON file with the added tokens.
    """
    paths = vocabulary or public_tokenizers.path(VOCABULARY), added or public_tokenizers.path(ADDED)
    fields = _PIECE if with_ids else _PIECE[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _tokens:
            _tokens[paths] = Tokens(*paths)
        part, seen = TaskContext.get().partitionId(), Counter()

        def ranked(way: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The class of each piece, and its rank among this task's pieces of its class."""
            kinds = -(-lengths // GRAIN)
            order = np.argsort(kinds, kind="stable")
            own, first, times = np.unique(kinds[order], return_index=True, return_counts=True)
            ranks = np.empty(len(kinds), dtype=np.int64)
            ranks[order] = np.arange(len(kinds)) - np.repeat(first - [seen[way, k] for k in own.tolist()], times)
            seen.update({(way, k): n for k, n in zip(own.tolist(), times.tolist())})
            return kinds, ranks

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for own, some in _chunks(docs, texts):
                rows, small_crcs = [], []
                for doc, ids in zip(own, _tokens[paths].encode(some)):
                    total = len(ids) // 4
                    for start in range(0, total, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        n = len(piece) // 4
                        rows.append((doc, start, n, zlib.crc32(piece), total, piece))
                        if SMALL < n < length:
                            small_crcs += [zlib.crc32(piece[at : at + 4 * SMALL]) for at in range(0, 4 * n, 4 * SMALL)]
                if rows:
                    names, starts, sizes, crcs, totals, pieces = zip(*rows)
                    starts, n = np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64)
                    parts = (n > SMALL) & (n < length)
                    kinds, ranks = np.empty_like(n), np.empty_like(n)
                    for way, chosen_rows in (("whole", parts), ("stays", ~parts)):
                        kinds[chosen_rows], ranks[chosen_rows] = ranked(way, n[chosen_rows])
                    times = np.where(parts, -(-n // SMALL), 0)
                    ends = np.r_[0, np.cumsum(times)]
                    at = (np.arange(ends[-1]) - np.repeat(ends[:-1], times)) * SMALL
                    small_sizes = np.minimum(SMALL, np.repeat(n, times) - at)
                    small_kinds, small_ranks = ranked("small", small_sizes)
                    inner = [np.repeat(starts, times) + at, small_sizes, np.array(small_crcs, dtype=np.int64), small_kinds.astype(np.int32), small_ranks]
                    small = pa.StructArray.from_arrays([pa.array(x) for x in inner], fields=list(_SMALL.value_type))
                    small = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), small, type=_SMALL, mask=pa.array(~parts))
                    columns = [names, starts, n, crcs, totals, np.full(len(n), part, dtype=np.int32), kinds.astype(np.int32), ranks, small, pieces]
                    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, _, t) in zip(columns, fields)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[f[0] for f in fields])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))


def _best_pattern(worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable pattern that fits in the room; worth and pattern go by size, from 0."""
    best, choice = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    for u in range(1, room + 1):
        values = worth[1 : u + 1] + best[u - 1 :: -1]
        choice[u] = i = values.argmax()
        best[u] = values[i]
    pattern, u = np.zeros(room + 1, dtype=np.int64), room
    while u > 0:
        pattern[choice[u] + 1] += 1
        u -= int(choice[u]) + 1
    return float(best[room]), pattern


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b without the linear algebra library, whose threads can hang in a process that has forked."""
    return np.einsum("ij,j->i", a, b) if b.ndim == 1 else np.einsum("ij,jk->ik", a, b)


def patterns(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: pieces}, times) that hold the demand of each class.

    Revised simplex over generated columns; the program is as large as the
    number of classes. Fractions are rounded down; what that leaves goes into
    further patterns, largest class first, each where it leaves least room.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[c] for c in sizes.tolist()], dtype=float)
    columns = np.diag(room // sizes).astype(float)  # each class by itself
    inverse, amount = np.diag(1 / np.diag(columns)), need / np.diag(columns)
    worth, bound = np.zeros(room + 1), 0.0
    for step in range(ROUNDS):
        # A size without demand is worth nothing: it stands for empty room.
        worth[sizes] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = _best_pattern(worth, room)
        pattern = pattern[sizes] * (worth[sizes] > 0)
        bound = max(bound, amount.sum() / value)  # no solution needs fewer sequences
        if amount.sum() <= bound * (1 + GAP):
            break
        move = _product(inverse, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, amount / move, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = pattern
        inverse[out] /= move[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(move[others], inverse[out])
        if step % 100 == 99:  # against rounding
            inverse = 2 * inverse - _product(inverse, _product(columns, inverse))
        amount = np.maximum(_product(inverse, need), 0)
    left, out = need.astype(np.int64), []
    for column, times in zip(columns.T.astype(np.int64), np.floor(amount + 1e-6).astype(np.int64)):
        if times > 0:
            # Never more of a pattern than the pieces that are left can fill.
            used = column > 0
            times = min(int(times), int((left[used] // column[used]).min()))
            if times > 0:
                left -= column * times
                out.append(({int(c): int(a) for c, a in zip(sizes[used], column[used])}, times))
    made: Counter = Counter()
    while left.any():
        pattern: dict[int, int] = {}
        space = room
        for i in np.flatnonzero(left)[::-1].tolist():
            if (n := min(int(left[i]), space // int(sizes[i]))) > 0:
                pattern[int(sizes[i])] = n
                left[i] -= n
                space -= n * int(sizes[i])
        made[tuple(sorted(pattern.items()))] += 1
    return out + [(dict(p), n) for p, n in made.items()]


def pack(
    documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, with_ids: bool = False, added: str | None = None
) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    What is left of documents is cut small where whole pieces would leave over PADDING of all room; the
    histogram of lengths decides, the number of documents doesn't matter.

    Null text is empty: one piece, the closing id 0. Repeated rows are packed
    as often as they come. Extra columns are not read; an empty table gives no rows. Texts of any length are encoded
    whole; their pieces are rows of their own.
    """
    spark = documents.sparkSession
    every = written(cut(documents, vocabulary, length, with_ids, added))
    columns = [c for c in every.columns if c not in ("small",)]
    stays, rest = every.where("small IS NULL"), every.where("small IS NOT NULL")
    ids = F.substr("ids", (F.col("piece.start") - F.col("start")).cast("int") * 4 + 1, F.col("piece.length").cast("int") * 4)
    cut_small = rest.withColumn("piece", F.explode("small")).select(
        "doc_id", "piece.start", "piece.length", "piece.ids_crc32", "doc_tokens", "part", "piece.class", "piece.rank",
        *[ids.alias("ids")] * with_ids,
    )
    room, best = length // GRAIN, None
    for pieces in (rest.select(*columns), cut_small):
        pieces = stays.select(*columns, F.lit(0).alias("way")).unionByName(pieces.withColumn("way", F.lit(1)))
        counts = written(pieces.groupBy("part", "way", "class").agg((F.max("rank") + 1).alias("n"), F.sum("length").alias("ids")))
        # One row for each class, of which there are length / GRAIN at most.
        sums = counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).collect()
        found = patterns({r["class"]: r["n"] for r in sums}, room)
        needed = sum(times for _, times in found)
        if best is None or needed < best[0]:
            best = needed, pieces, counts, found
        if needed * length * (1 - PADDING) <= sum(r["ids"] for r in sums):
            break
    _, pieces, counts, found = best
    slots, sequence, taken = [], 0, Counter()
    for pattern, times in found:
        for kind, each in pattern.items():
            slots.append((kind, taken[kind], taken[kind] + each * times, each, sequence))
            taken[kind] += each * times
        sequence += times
    deal = spark.createDataFrame(slots, "class int, low bigint, high bigint, each bigint, first bigint")
    deal = deal.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "first"))).alias("deal"))
    # A row for each class and task.
    before = counts.withColumn(
        "before",
        F.sum("n").over(Window.partitionBy("class").orderBy("way", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
    ).drop("n", "ids")
    ranked = pieces.join(before, ["part", "way", "class"]).join(F.broadcast(deal), "class")
    at = F.col("rank") + F.col("before")
    placed = ranked.withColumn("at", at).withColumn(
        "slot", F.get(F.filter("deal", lambda d: (d.low <= F.col("at")) & (F.col("at") < d.high)), F.lit(0))
    )
    nth = F.col("at") - F.col("slot.low")
    placed = placed.select(
        *pieces.columns,
        (F.col("slot.first") + F.floor(nth / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (nth % F.col("slot.each")).alias("nth"),
    )
    # A sequence holds a few pieces, however many documents there are.
    beside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "nth")
    offset = F.coalesce(F.sum("length").over(beside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset.cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary) and the documents of each sequence, from pack(..., with_ids=True)."""
    piece = F.struct("offset", "ids", "doc_id", "length")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda out, p: F.concat(out, p.ids))
    return whole.select(
        "sequence_id", joined.alias("ids"), F.transform("p", lambda p: F.struct(p.doc_id, p.offset, p.length)).alias("pieces")
    )
