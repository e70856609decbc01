"""Spelling variants: words that one code point tells apart, found by search schemes on bidirectional FM-indexes.

If two words differ by one inserted, deleted or replaced code point, one half of a word stands unchanged at the same end of the
other. So a word is searched twice: its left half exactly behind a delimiter, then across the right half with one
error; and the mirror of this. An index keeps suffix-rank intervals in the delimited vocabulary and in its reverse in
step, so a pattern grows at either end.

The vocabulary is cut into shards of bounded size: neighbours in sorted order share left halves, neighbours in the order of
the reversed words share right halves. A word goes only to shards that hold its half.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import positions, written

#: Words of a shard, whose index takes about 4 kB a word, and code points of the longest words that are searched in indexes.
SHARD, LONGEST = 8192, 64
#: The least code points and occurrences of a word, and of how many runs one is misspelt.
LONG, OFTEN, MISSPELT = 5, 3, 97
#: Words that a task counts before it hands its counts on.
COUNTED = 300_000
RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def noised(doc_id: bytes, run: str) -> str:
    """The run, or, if its checksum says so, the run without one of its code points."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc_id))
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: str) -> Counter:
    """How often each run of letters occurs in a text, A-Z lower-cased."""
    lower = text.encode("utf-8", "replace").translate(_LOWER).decode()
    # Long texts are not held as lists of runs.
    return Counter(RUN.findall(lower) if len(lower) < 1 << 20 else (m.group() for m in RUN.finditer(lower)))


def vocabulary(documents: DataFrame, least: int = OFTEN, held: int = COUNTED) -> DataFrame:
    """(word, n) of words of LONG code points and more that occur `least` times and more in all documents.

    Tasks count what they read and hand on sums, once they hold more than `held` words and at the end, so frequent words are no burden to the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=_COUNTS)

        total: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = b"%s:" % (b"" if doc_id is None else str(doc_id).encode())
                for run, n in runs_of(text.as_py() or "").items():
                    word = noised(start, run)
                    if len(word) >= LONG:
                        total[word] = total.get(word, 0) + n
                if len(total) > held:
                    yield out()
                    total = {}
        if total:
            yield out()

    counted = documents.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _rotations(text: np.ndarray) -> np.ndarray:
    """Where the rotations of a text start, in order; by doubling from eight symbols on."""
    n, k = len(text), 8
    key = np.zeros(n, dtype=np.int64)
    for i in range(k):
        key = key << 7 | np.roll(text, -i)
    while True:
        order = np.argsort(key, kind="stable")
        seen = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.r_[0, np.cumsum(seen[1:] != seen[:-1])]
        if rank[order[-1]] == n - 1:
            return order
        key = rank * n + np.roll(rank, -k)
        k *= 2


def _ranks(text: np.ndarray, order: np.ndarray, symbols: int) -> np.ndarray:
    """ranks[i, c]: how many of the first i symbols of the Burrows-Wheeler transform are smaller than c."""
    ranks = np.zeros((len(text) + 1, symbols + 1), dtype=np.int32)
    ranks[np.arange(1, len(text) + 1), text[order - 1] + 1] = 1
    np.cumsum(ranks, axis=0, out=ranks)
    return np.cumsum(ranks, axis=1, out=ranks)


class Intervals:
    """Suffix-rank intervals of many patterns: starts in the index of the side that grows and in the other one, and sizes."""

    def __init__(self, here: np.ndarray, there: np.ndarray, size: np.ndarray):
        self.here, self.there, self.size = here, there, size

    def __getitem__(self, at) -> Intervals:
        return Intervals(self.here[at], self.there[at], self.size[at])

    def turned(self) -> Intervals:
        return Intervals(self.there, self.here, self.size)


class Index:
    """A bidirectional FM-index of delimited words. Symbol 0 is the delimiter; a pattern grows by symbols at either end."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), dtype=np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        text = text.astype(np.int64)
        self.symbols = len(self.alphabet)
        self.order = _rotations(text)
        self.number = np.cumsum(text == 0) - 1  # of the word that starts here
        back = text[::-1].copy()
        self.left = _ranks(text, self.order, self.symbols)
        self.right = _ranks(back, _rotations(back), self.symbols)
        self.first = np.searchsorted(np.sort(text), np.arange(self.symbols + 1))

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of symbols for each word (-1: not in this index, and behind the end) and the words' lengths."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), self.symbols - 1)
        out = np.full((len(words), int(lengths.max(initial=0))), -1, dtype=np.int64)
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.where(self.alphabet[at] == points, at, -1)
        return out, lengths

    def whole(self, n: int) -> Intervals:
        """The intervals of n empty patterns."""
        zero = np.zeros(n, dtype=np.int64)
        return Intervals(zero, zero, np.full(n, len(self.order), dtype=np.int64))

    def grown(self, table: np.ndarray, x: Intervals, symbol: np.ndarray) -> Intervals:
        """The patterns with one more symbol at the side of the table; here and there are as that side sees them."""
        c = np.maximum(symbol, 0)
        end = x.here + x.size
        below, below_end = table[x.here, c], table[end, c]
        start = table[x.here, c + 1] - below
        size = table[end, c + 1] - below_end - start
        return Intervals(self.first[c] + start, x.there + (below_end - below), np.where(symbol < 0, 0, size).astype(np.int64))

    def following(self, table: np.ndarray, x: Intervals) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, symbol) of all symbols but the delimiter that any occurrence of a pattern has next."""
        least = np.diff(table[x.here], axis=1)
        pattern, symbol = np.nonzero((np.diff(table[x.here + x.size], axis=1) - least)[:, 1:])
        return pattern, symbol + 1

    def near(self, words: list[str], left_exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in `words`, number of an indexed word) of pairs that differ by one code point and share the half asked for.

        Mirrored, the tables and the words are turned round: the pattern grows at its left end.
        """
        q, m = self.encoded(words)
        half = m // 2
        inner, outer = self.left, self.right
        if not left_exact:
            at = np.arange(q.shape[1])
            q = np.where(at < m[:, None], np.take_along_axis(q, np.maximum(m[:, None] - 1 - at, 0), axis=1), -1)
            half, inner, outer = m - half, self.right, self.left
        # The half that must stand, from its inner end to its outer one, and the delimiter there.
        x = self.whole(len(words))
        for j in range(int(half.max(initial=0)) - 1, -1, -1):
            step = self.grown(inner, x, q[:, j])
            on = j < half
            x = Intervals(np.where(on, step.here, x.here), np.where(on, step.there, x.there), np.where(on, step.size, x.size))
        x = self.grown(inner, x, np.zeros(len(words), dtype=np.int64)).turned()
        # Across the other half: before the error, each pattern with all that the error can be at this place.
        word = np.flatnonzero(x.size)
        x, j = x[word], half[word]
        branched: list[tuple[np.ndarray, np.ndarray, Intervals]] = []
        while len(word):
            inside = j < m[word]
            own = np.where(inside, q[word, np.minimum(j, q.shape[1] - 1)], -1)
            of, symbol = self.following(outer, x)
            more = self.grown(outer, x[of], symbol)
            branched.append((word[of], j[of], more))  # inserted
            other = inside[of] & (symbol != own[of])
            branched.append((word[of][other], j[of][other] + 1, more[other]))  # replaced
            branched.append((word[inside], j[inside] + 1, x[inside]))  # deleted
            x = self.grown(outer, x, own)
            on = x.size > 0
            word, j, x = word[on], j[on] + 1, x[on]
        if not branched:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        word, j = (np.concatenate([b[k] for b in branched]) for k in (0, 1))
        x = Intervals(*[np.concatenate([getattr(b[2], k) for b in branched]) for k in ("here", "there", "size")])
        # Behind the error the rest must stand, and the delimiter.
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            done = j == m[word]
            x = self.grown(outer, x, np.where(done, 0, q[word, np.minimum(j, q.shape[1] - 1)]))
            on = x.size > 0
            hit = on & done
            at = (x.there if left_exact else x.here)[hit]
            found.append((word[hit], self.number[self.order[at]]))
            on &= ~done
            word, j, x = word[on], j[on] + 1, x[on]
        word, number = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        # One word may be reached by several errors (a letter of a doubled pair).
        pair = np.unique(word * len(self.order) + number)
        return pair // len(self.order), pair % len(self.order)


def _halves(word: Column, left: bool) -> tuple[Column, Column]:
    """A word's own half, and the starts (or ends) under which words of its length, one less and one more look for it."""
    length = F.length(word)
    cut = lambda n: F.substr(word, F.lit(1), n) if left else F.right(word, n)
    of = lambda n: F.floor(n / 2).cast("int") if left else (n - F.floor(n / 2)).cast("int")
    return cut(of(length)), F.array_distinct(F.array(*[cut(of(length + d)) for d in (-1, 0, 1)]))


def _searched(words: DataFrame, left: bool, shard: int, longest: int) -> DataFrame:
    """(word, near, near_n) of pairs that share the left half of the first word, or else (not both) its right half."""
    order = F.col("word") if left else F.reverse("word")
    placed = positions(words.select("word", "n", F.lit(0).alias("all"), order.alias("order")), ["all"], ["order"])
    members = written(placed.select("word", "n", F.floor(F.col("pos") / shard).alias("shard")))
    own, starts = _halves(F.col("word"), left)
    # Which shards hold a half at all.
    held = members.select(F.explode(starts).alias("half"), "shard").distinct()
    asked = words.where(F.length("word") <= longest).select("word", own.alias("half")).join(held, "half")
    rows = members.select("shard", F.lit(0).alias("kind"), "word", "n").unionByName(asked.select("shard", F.lit(1).alias("kind"), "word", F.lit(None).cast("long").alias("n")))
    count = (members.agg(F.max("shard")).first()[0] or 0) + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each shard the members come first; what asks is searched batch by batch.
        index, now, words, times = None, None, [], []
        for batch in batches:
            shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                if shards[a] != now:
                    index, now, words, times = None, shards[a], [], []
                if kinds[a] == 0:
                    words += part.column(2).to_pylist()
                    times += part.column(3).to_pylist()
                    continue
                if index is None:
                    index = Index(words)
                asking = part.column(2).to_pylist()
                pairs = zip(*(x.tolist() for x in index.near(asking, left)))
                found = [(asking[i], words[k], times[k]) for i, k in pairs]
                if not left:
                    found = [f for f in found if f[0][: len(f[0]) // 2] != f[1][: len(f[0]) // 2]]  # else the other search has it
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _NEAR.types)], schema=_NEAR)

    return rows.repartition(count, "shard").sortWithinPartitions("shard", "kind").mapInArrow(search, "word string, near string, near_n bigint")


def _long(words: DataFrame, longest: int) -> DataFrame:
    """The same for first words of more than `longest` code points, which would make indexes large: they meet by their
    length and an exact half, and are then compared."""
    asked, members = words.where(F.length("word") > longest), words.where(F.length("word") >= longest)
    out = []
    for left in (True, False):
        own, _ = _halves(F.col("word"), left)
        asking = asked.select("word", F.length("word").alias("size"), F.xxhash64(own).alias("half"))
        of = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.length("word") + d)).alias("size")
        known = members.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "word", of)
        half = F.floor(F.col("size") / 2).cast("int")
        start = F.substr("word", F.lit(1), half) if left else F.right("word", F.col("size") - half)
        known = known.select("near", "near_n", "size", F.xxhash64(start).alias("half"))
        out.append(asking.join(known, ["size", "half"]).where(F.col("word") != F.col("near")).select("word", "near", "near_n"))
    met = out[0].unionByName(out[1]).distinct()
    return met.where(F.levenshtein("word", "near", 1) == 1)


def near_pairs(words: DataFrame, shard: int = SHARD, longest: int = LONGEST) -> DataFrame:
    """(word, near, near_n): each pair of distinct words that one inserted, deleted or replaced code point tells apart, both ways round."""
    short = words.where(F.length("word") <= longest + 1)
    found = _searched(short, True, shard, longest).unionByName(_searched(short, False, shard, longest))
    return found.unionByName(_long(words, longest))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: where forms lead in the end. Each step doubles how far a word sees."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").take(1):
            return now


def variants(documents: DataFrame, least: int = OFTEN, shard: int = SHARD, longest: int = LONGEST) -> DataFrame:
    """The frequent words of all documents with the near word that each is a variant of, and where such steps lead.

    Null and empty texts have no words; texts and words of any length are taken whole; a null doc_id counts as an empty one. Repeated documents count as often as they
    come. Of near words with equal counts the first in code-point order is the form. A form is at least twice as
    frequent as its word, so steps never come back. An empty table gives no rows; columns of other names are not read.
    """
    words = written(vocabulary(documents, least))
    near = near_pairs(words, shard, longest)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("b"))
    joined = words.join(best, "word", "left")
    stands = F.col("b.near_n") >= 2 * F.col("n")
    formed = written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, F.col("b.near")).alias("form"), F.when(stands, F.col("b.near_n")).alias("form_n"))
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc_table() -> list[int]:
    """The checksum's table by its rule: each byte shifted out bit by bit."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return table


def oracle_sql() -> str:
    """The same in DuckDB: near words share a deletion of one code point, or are one."""
    table = str(_crc_table())
    points = "flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN ord(s[i]) < 128 THEN [ord(s[i])::BIGINT] ELSE [195::BIGINT, ord(s[i])::BIGINT - 64] END))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || {points}, lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-zÀ-ÿ]+')) AS run FROM documents
), runs AS (
    SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM found GROUP BY doc_id, run
), hashed AS (
    SELECT run, times, {crc} AS h FROM runs
), spelt AS (
    SELECT CASE WHEN h % {MISSPELT} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM hashed
), words AS (
    SELECT word, cast(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= {LONG} GROUP BY word HAVING sum(times) >= {OFTEN}
), cut AS (
    SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
    SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.short = b.short AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.short = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.short = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS near_n FROM pairs GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), steps AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON s.next = f.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM steps WHERE next IS NULL) USING (word)
"""
