"""A Merkle manifest of a dataset: what it holds, one digest for all, and short proofs for each row.

Rows are leaves of a 16-ary tree for each source, the sources' roots are leaves of one more tree. A block of
4,096 neighbouring leaves is three levels of a tree and is built by one task in memory; the blocks' tops
are the leaves of the next round, so every table after the first is 4,096 times smaller and no
source, however large, meets in one task.

A parent keeps a copy of the hash's state before each of its children. To fold a changed leaf, the state before its
place is resumed with the changed digest and the siblings at its right; those at its left are never hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import positions, written

#: Children of a node, as a power of two, and levels that one task builds of a block.
BITS, LEVELS = 4, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_NODE = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("level", pa.int32()), ("digest", pa.string())])
_NODE_DDL = "key string, pos bigint, total bigint, level int, digest string"
_STEP = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
_STEPS = "array<struct<left:binary,right:binary>>"
_PATH = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("path", _STEP), ("root", pa.string())])
_PATH_DDL = f"key string, pos bigint, path {_STEPS}, root string"
_PROOF = pa.schema(
    [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
     ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]
)
_PROOF_DDL = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class Parent:
    """A node over its children's digests, with the hash's state before each child."""

    def __init__(self, children: bytes):
        self.children = children
        self.states = []
        state = hashlib.sha256()
        for at in range(0, len(children), 64):
            self.states.append(state.copy())
            state.update(children[at : at + 64])
        self.digest = state.hexdigest().encode()

    def sides(self, slot: int) -> tuple[bytes, bytes]:
        """The digests of a child's siblings to its left and right."""
        return self.children[: slot * 64], self.children[slot * 64 + 64 :]

    def folded(self, slot: int, digest: bytes) -> bytes:
        """The node's digest if a child's were another."""
        state = self.states[slot].copy()
        state.update(digest + self.children[slot * 64 + 64 :])
        return state.hexdigest().encode()


class Step(NamedTuple):
    """One level of a path above a block: the state behind the left siblings, resumed with what is folded and the right ones."""

    state: hashlib._hashlib.HASH
    right: bytes

    def folded(self, digest: bytes) -> bytes:
        state = self.state.copy()
        state.update(digest + self.right)
        return state.hexdigest().encode()


def height(total: int, bits: int = BITS) -> int:
    """Levels above `total` leaves until one node remains."""
    up = 0
    while total > 1:
        total, up = -(-total >> bits), up + 1
    return up


def built(leaves: list[bytes], levels: int, bits: int = BITS) -> list[list[bytes]]:
    """The digests of a block, level by level, its leaves first; the last run of a level may be shorter."""
    out, size = [leaves], 1 << bits
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256(b"".join(below[i : i + size])).hexdigest().encode() for i in range(0, len(below), size)])
    return out


def _field(c: Column, kind: str) -> Column:
    shown = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The digest of a row: of each field `-` for null, else its length in bytes, a colon and its value."""
    return F.sha2(F.concat(*[_field(c, name) for name, c in fields.items()]), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def leaves(documents: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """(doc_id, key, leaf, folded): a row's digest, and that of the row with `changed` as its text where `tampered` holds.

    The key sorts like the source with null first. Columns that are missing count as null.
    """
    of = {c: F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in FIELDS}
    leaf = leaf_digest(of)
    other = leaf if tampered is None else F.when(tampered, leaf_digest(of | {"text": changed})).otherwise(leaf)
    key = F.when(of["source"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), of["source"].cast("string")))
    return documents.select(of["doc_id"].cast("long").alias("doc_id"), key.alias("key"), leaf.alias("leaf"), other.alias("folded"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows by blocks, each block's in order; a path to the root (pos -1) before the rest."""
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _grouped(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each block, which come one after another; one block at most is held."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for row in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]):
            if row[:2] != now:
                if held:
                    yield now, held
                now, held = row[:2], []
            held.append(row[2:])
    if held:
        yield now, held


def _tops(nodes: DataFrame, bits: int, levels: int) -> DataFrame:
    """The nodes above `nodes` that lie in their blocks, with their level; the last level are the blocks' tops."""
    span = bits * levels

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), rows in _grouped(batches, ["key", "block", "total", "digest"]):
            total = rows[0][0]
            up = min(levels, height(total, bits))
            out = {n: [] for n in _NODE.names}
            for level, digests in enumerate(built([r[1].encode() for r in rows], up, bits)[1:], 1):
                first = block << (span - bits * level)
                out["pos"] += range(first, first + len(digests))
                out["total"] += [-(-total >> bits * level)] * len(digests)
                out["level"] += [level] * len(digests)
                out["digest"] += [d.decode() for d in digests]
            if not up:  # a lone leaf is its own top
                out["pos"], out["total"], out["level"], out["digest"] = [block], [1], [0], [rows[0][1]]
            out["key"] = [key] * len(out["pos"])
            yield pa.RecordBatch.from_pydict(out, schema=_NODE)

    ready = nodes.select("key", F.shiftright("pos", span).alias("block"), "pos", "total", "digest")
    return _blocks(ready).mapInArrow(build, _NODE_DDL)


def _of_blocks(made: DataFrame, levels: int) -> DataFrame:
    """The tops among the nodes of a round: those of its last level, or of the level where one node remains."""
    return made.where((F.col("level") == levels) | (F.col("total") == 1)).select("key", "pos", "total", "digest")


def _rounds(nodes: DataFrame, bits: int, levels: int) -> list[DataFrame]:
    """The nodes above `nodes`, a table for each round of blocks, until one node of each key remains."""
    out = []
    while True:
        out.append(written(_tops(nodes, bits, levels)))
        nodes = _of_blocks(out[-1], levels)
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            return out


def _climb(levels_of: list[list[bytes]], bits: int) -> Iterator[tuple[int, list[tuple[Parent, int]]]]:
    """Each leaf of a block with its parents and its places in them; only the parents above it are held."""
    above: list[tuple[int, Parent]] = [(-1, None)] * (len(levels_of) - 1)
    size, mask = 1 << bits, (1 << bits) - 1
    for i in range(len(levels_of[0])):
        way, at = [], i
        for level, below in enumerate(levels_of[:-1]):
            if above[level][0] != at >> bits:
                first = at >> bits << bits
                above[level] = at >> bits, Parent(b"".join(below[first : first + size]))
            way.append((above[level][1], at & mask))
            at >>= bits
        yield i, way


def _paths(nodes: DataFrame, rounds: list[DataFrame], bits: int, levels: int) -> DataFrame:
    """(key, pos, path, root) of all nodes: the siblings on the way to the root of their key, left and right, level by level."""
    if not rounds:
        return nodes.select("key", "pos", F.array().cast(_STEPS).alias("path"), F.col("digest").alias("root"))
    span = bits * levels
    upper = _paths(_of_blocks(rounds[0], levels), rounds[1:], bits, levels)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _), (first, *rows) in _grouped(batches, ["key", "block", "pos", "total", "digest", "path", "root"]):
            path, root = [(s["left"], s["right"]) for s in first[3]], first[4]
            block = built([r[2].encode() for r in rows], min(levels, height(rows[0][1], bits)), bits)
            out = {n: [] for n in _PATH.names}
            for i, way in _climb(block, bits):
                steps = [parent.sides(slot) for parent, slot in way] + path
                for n, v in zip(_PATH.names, (key, rows[i][0], [{"left": a, "right": b} for a, b in steps], root)):
                    out[n].append(v)
                if len(out["pos"]) == 1000:
                    yield pa.RecordBatch.from_pydict(out, schema=_PATH)
                    out = {n: [] for n in _PATH.names}
            yield pa.RecordBatch.from_pydict(out, schema=_PATH)

    ready = nodes.select("key", F.shiftright("pos", span).alias("block"), "pos", "total", "digest")
    ways = upper.select("key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "root")
    both = ready.unionByName(ways, allowMissingColumns=True)
    return written(_blocks(both).mapInArrow(climb, _PATH_DDL))


class Manifest(NamedTuple):
    """`nodes`: all nodes above the leaves; `placed`: the leaves in their places; `above`: the way from each block to the root."""

    nodes: DataFrame
    placed: DataFrame
    above: DataFrame


def manifest(leaf_rows: DataFrame, bits: int = BITS, levels: int = LEVELS) -> Manifest:
    """The tree over `leaves`: subtrees by key, leaves by doc_id (null first, ties by digest), subroots by key.

    `nodes` has the source, level, position and digest of each node of a source's tree (level 0: a lone row, which is
    its source's root); `top` marks those of the tree over the sources.
    Repeated rows are leaves of their own. No rows: no nodes.
    """
    placed = positions(leaf_rows, ["key"], ["doc_id", "leaf", "folded"])
    rounds = _rounds(placed.withColumnRenamed("leaf", "digest"), bits, levels)
    inner = _paths(_of_blocks(rounds[0], levels), rounds[1:], bits, levels)
    subroots = inner.where("pos = 0").select("key", F.col("root").alias("digest"), F.lit("").alias("all"))
    sources = positions(subroots, ["all"], ["key"])
    named = sources.select(F.col("all").alias("key"), "pos", "total", "digest")
    top_rounds = _rounds(named, bits, levels)
    outer = _paths(named, top_rounds, bits, levels).select("pos", F.col("path").alias("top"), F.col("root").alias("whole"))
    of_source = sources.select("key", "pos").join(outer, "pos").drop("pos")
    above = inner.join(of_source, "key").select(
        "key", F.col("pos").alias("block"), F.concat("path", "top").alias("path"), F.col("root").alias("subroot"), F.col("whole").alias("root")
    )
    nodes = _every_node(rounds, F.lit(False), levels).unionByName(_every_node(top_rounds, F.lit(True), levels))
    return Manifest(nodes, placed, written(above))


def _every_node(rounds: list[DataFrame], top: Column, levels: int) -> DataFrame:
    """The nodes of all rounds; one that is carried on unchanged into a later round comes once."""
    source = F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source")
    shown = [
        made.where(F.lit(k == 0) | (F.col("level") > 0)).select(top.alias("top"), source, (F.col("level") + k * levels).alias("level"), "pos", "digest")
        for k, made in enumerate(rounds)
    ]
    return reduce(DataFrame.unionByName, shown)


def proofs(tree: Manifest, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Each leaf's proof, and the root that its `folded` digest gives with the original siblings."""
    span = bits * levels

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "block", "doc_id", "total", "leaf", "folded", "path", "subroot", "root"]
        for _, (first, *rows) in _grouped(batches, names):
            *_, path, subroot, root = first
            upper = [Step(hashlib.sha256(s["left"]), s["right"]) for s in path]
            rest = b"".join([s["left"] + s["right"] for s in path])
            block = built([r[2].encode() for r in rows], min(levels, height(rows[0][1], bits)), bits)
            out = {n: [] for n in _PROOF.names}
            for i, way in _climb(block, bits):
                proof = hashlib.sha256(b"".join([side for parent, slot in way for side in parent.sides(slot)]))
                proof.update(rest)
                digest = rows[i][3].encode()
                for parent, slot in way:
                    digest = parent.folded(slot, digest)
                for step in upper:
                    digest = step.folded(digest)
                folded = digest.decode()
                for n, v in zip(_PROOF.names, (rows[i][0], rows[i][2], subroot, root, proof.hexdigest(), folded, folded == root)):
                    out[n].append(v)
                if len(out["leaf"]) == 10_000:
                    yield pa.RecordBatch.from_pydict(out, schema=_PROOF)
                    out = {n: [] for n in _PROOF.names}
            yield pa.RecordBatch.from_pydict(out, schema=_PROOF)

    ready = tree.placed.select("key", F.shiftright("pos", span).alias("block"), "pos", "total", "doc_id", "leaf", "folded")
    ways = tree.above.withColumn("pos", F.lit(-1).cast("long"))
    both = ready.unionByName(ways, allowMissingColumns=True)
    return _blocks(both).mapInArrow(prove, _PROOF_DDL)


def proved(documents: DataFrame, tampered: Column | None = None, changed: Column | None = None, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Every document's leaf, roots and proof, and whether its text as `changed` still gives the root.

    Null fields are told from empty ones; a null doc_id stands before all others and is never tampered by its number.
    Texts are hashed whole, whatever their length. Repeated rows are leaves of their own, one behind the other. An empty table gives
    no rows; columns of other names are not read, missing ones are null.
    """
    rows = written(leaves(documents, tampered, changed))
    return proofs(manifest(rows, bits, levels), bits, levels)


def tampered_by_number() -> Column:
    """Rows whose decimal doc_id has an unsigned crc32 that 5 divides."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


#: Levels that the SQL has: leaves of one source, and sources, up to 16 ** 8.
_SQL_LEVELS = 8


def oracle_sql() -> str:
    """The same tree level by level in DuckDB, each fold a hash over left siblings, digest and right siblings."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in [*FIELDS[:-1], text]) + ")"
    bits8 = "[0, 0, 0, 0, 0, 0, 0, 0]"
    step = f"list_reduce([xor(c, b)] || {bits8}, lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT), lambda c, b: {step}), 4294967295)"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"

    def tree(name: str, group: str) -> list[str]:
        out = []
        for k in range(1, _SQL_LEVELS + 1):
            out.append(
                f"{name}{k} AS (SELECT {group}, pos // 16 AS pos, (any_value(m) + 15) // 16 AS m, "
                f"CASE WHEN any_value(m) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{k - 1} GROUP BY {group}, pos // 16)"
            )
        for k in range(_SQL_LEVELS):
            run = f"string_agg(d, '') OVER (PARTITION BY {group}, pos // 16 ORDER BY pos ROWS BETWEEN"
            out.append(
                f"{name}s{k} AS (SELECT {group}, pos, m > 1 AS up, coalesce({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
        return out

    def folded(name: str, frm: str, on: str, at: str) -> list[str]:
        out = []
        for k in range(_SQL_LEVELS):
            out.append(
                f"{name}f{k} AS (SELECT f.* EXCLUDE (fold, proof), CASE WHEN up THEN sha256(l || fold || r) ELSE fold END AS fold, "
                f"proof || l || r AS proof FROM {frm if k == 0 else f'{name}f{k - 1}'} f JOIN {name}s{k} s ON {on} AND s.pos = f.{at} // {16**k})"
            )
        return out

    last = _SQL_LEVELS
    parts = [
        f"named AS (SELECT *, doc_id::VARCHAR AS s, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, {lower} AS low FROM documents)",
        f"hashed AS (SELECT doc_id, key, {digest('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest('low')} ELSE {digest('text')} END AS fold FROM named)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS m, '' AS proof FROM hashed)",
        "a0 AS (SELECT key, place AS pos, m, leaf AS d FROM placed)",
        *tree("a", "key"),
        # Keys compare like their UTF-8 bytes.
        f"b0 AS (SELECT 1 AS one, row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS m, d, key FROM a{last})",
        *tree("b", "one"),
        *folded("a", "placed", "f.key = s.key", "place"),
        f"joined AS (SELECT f.*, b0.pos AS nth, b0.d AS subroot FROM af{last - 1} f JOIN b0 ON f.key = b0.key)",
        *folded("b", "joined", "s.one = 1", "nth"),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, b{last}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, "
        f"fold = b{last}.d AS verified FROM bf{last - 1} CROSS JOIN b{last}"
    )
