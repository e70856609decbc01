"""Byte-level BPE by a rank file: a minimal perfect hash first, a heap of merges after.

A pre-token that is in the vocabulary as a whole is found by a minimal perfect
hash over the vocabulary. Any other is merged: its bytes are a doubly linked
list, a heap holds the ranks of neighbouring pairs, and the lowest rank (the
leftmost of equal ones) is joined until no pair has one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens and spaced words remembered by each worker process, in each of two generations, and characters from which on none is.
REMEMBERED, LONGEST = 400_000, 64


class PerfectHash:
    """A minimal perfect hash over byte strings: n keys, n slots, a seed for each bucket of about two keys.

    Buckets are placed largest first; each tries seeds until all its keys fall on
    free slots. `find` compares the key in the slot, so strangers are told apart.
    """

    def __init__(self, keys: dict[bytes, int]):
        n = max(1, len(keys))
        self.n, self.buckets = n, max(1, n // 2)
        self.seeds = np.zeros(self.buckets, dtype=np.int64).tolist()
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        members: dict[int, list[bytes]] = {}
        for k in keys:
            members.setdefault(xxhash.xxh3_64_intdigest(k) % self.buckets, []).append(k)
        free = [i for i in range(n)]
        for bucket in sorted(members, key=lambda b: (-len(members[b]), b)):
            own = members[bucket]
            if len(own) == 1 and len(free) > 0:
                # Lone keys take the free slots that are left; the seed then names the slot.
                while self.slots[free[-1]] is not None:
                    free.pop()
                places, seed = [free.pop()], None
                self.seeds[bucket] = -1 - places[0]
            else:
                seed = 1
                while True:
                    places = [xxhash.xxh3_64_intdigest(k, seed) % n for k in own]
                    if len(set(places)) == len(own) and all(self.slots[p] is None for p in places):
                        break
                    seed += 1
                self.seeds[bucket] = seed
            for k, p in zip(own, places):
                self.slots[p], self.values[p] = k, keys[k]

    def find(self, key: bytes) -> int | None:
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        at = -1 - seed if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return self.values[at] if self.slots[at] == key else None


class Bpe:
    """Encodes and decodes by a file of ranks, as its pattern splits."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.whole = PerfectHash(self.ranks)
        self.bytes_of: list[bytes] = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern)
        self.breaks = regex.compile(r" \s")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that the vocabulary doesn't hold."""
        ranks, n = self.ranks, len(token)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: joined to another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != upto:
                continue  # one of the two has changed meanwhile
            end[i], end[middle] = upto, 0
            if upto < n:
                before[upto] = i
                if (r := ranks.get(token[i : end[upto]])) is not None:
                    heapq.heappush(heap, (r, i, end[upto]))
            if (j := before[i]) >= 0 and (r := ranks.get(token[j:upto])) is not None:
                heapq.heappush(heap, (r, j, upto))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = end[i]
        return out

    def _pretoken(self, piece: str) -> bytes:
        if (ids := self.new.get(piece) or self.old.get(piece)) is None:
            token = piece.encode("utf-8", "replace")
            whole = self.whole.find(token)
            ids = np.array([whole] if whole is not None else self.merge(token), dtype="<u4").tobytes()
        if len(piece) < LONGEST:
            self.new[piece] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a part of a text that no pre-token overlaps."""
        if (ids := self.old.get(part)) is None:
            ids = b"".join([self._pretoken(p) for p in self.split.findall(part)])
        if len(part) < LONGEST:
            self.new[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        if not text:
            return b""
        if self.breaks.search(text):
            return b"".join([self._pretoken(p) for p in self.split.findall(text)])
        # Every space stands before a visible character and goes with it: pre-tokens never cross it.
        first, *rest = text.split(" ")
        known = self.new
        out = [self._part(first)] if first else []
        for word in rest:
            part = " " + word
            out.append(known.get(part) or self._part(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.bytes_of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_coders: dict[tuple[str, str], Bpe] = {}


def coder(path: str, pattern: str) -> Bpe:
    """This process's coder, made once."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Bpe(path, pattern)
    return _coders[path, pattern]


def _source(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    return vocabulary or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


def encode(text: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Token ids of each text as binary (little-endian unsigned 32-bit); null counts as empty."""
    at = _source(vocabulary, pattern)

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        bpe = coder(*at)
        return pa.array([bpe.encode(t.as_py() or "") for t in texts], type=pa.binary())

    return run(text)


def decode(ids: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """The bytes that ids stand for; null counts as no ids."""
    at = _source(vocabulary, pattern)

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        bpe = coder(*at)
        return pa.array([bpe.decode(r.as_py() or b"") for r in rows], type=pa.binary())

    return run(ids)


_DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of what they decode to.

    Null and empty texts have no tokens. Texts of any length are encoded whole;
    repeated rows repeat; extra columns are not read; an empty table gives no rows.
    """
    at = _source(vocabulary, pattern)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        bpe = coder(*at)
        rows = []
        for t in texts:
            ids = bpe.encode(t.as_py() or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), r)) for r in rows], type=_DIGESTS)

    return documents.select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")
