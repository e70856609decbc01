"""The Merkle manifest against a plain tree over all rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from millrace.llm import manifest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, pos string, block string, leaf string, level string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*map(field, (doc_id, source, lang, n_chars, text)))


def levels_of(leaves, size):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + size]) for i in range(0, len(out[-1]), size)])
    return out


def climbed(levels, at, leaf, size):
    """Siblings on the way up, and what a leaf's digest gives at the top."""
    siblings = []
    for below in levels[:-1]:
        first = at // size * size
        run = below[first : first + size]
        siblings += run[: at - first] + run[at - first + 1 :]
        run[at - first] = leaf
        leaf, at = digest(*run), at // size
    return siblings, leaf


def brute(rows, size):
    groups = defaultdict(list)
    for r in rows:
        r = r[:5]
        low = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[3]].append((r[0], leaf_of(*r), leaf_of(r[0], low, *r[2:]) if hit else leaf_of(*r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels_of([x[1] for x in groups[s]], size)
    top = levels_of([trees[s][-1][0] for s in order], size)
    out = []
    for n, s in enumerate(order):
        for i, (doc_id, leaf, changed) in enumerate(groups[s]):
            low, folded = climbed(trees[s], i, changed, size)
            high, folded = climbed(top, n, folded, size)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, digest(*low, *high), folded, folded == root))
    return out, trees, top


def rows_of(n, sources, seed=3):
    rng = random.Random(seed)
    texts = [None, "", "Ünïcode ÀÉ and ABC", "lower only", "x" * 30_000 + "Y", "A"]
    out = []
    for i in range(n):
        text = rng.choice(texts) if rng.random() < 0.5 else f"Row {i} Of {n}"
        lang = rng.choice([None, "", "en"])
        source = rng.choice(sources)
        out.append((None if i % 31 == 0 else i - 5, text, lang, source, rng.choice([None, 0, 7]), *"abcde"))
    return out + out[:4] + [(7, "same id", "en", sources[0], 1, *"abcde")]


def proved(spark, rows, **shape):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return manifest.proved(df, manifest.tampered_by_number(), manifest.ascii_lower(F.col("text")), **shape)


def found(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


@pytest.mark.parametrize(("bits", "levels"), [(4, 4), (4, 1), (1, 2)])
def test_equals_a_plain_tree(spark, bits, levels):
    sources = ["hot", "hot", "hot", None, "", "é", "Z", "a", *[f"s{i}" for i in range(20)]]
    rows = rows_of(300, sources)
    want, _, _ = brute(rows, 1 << bits)
    frame = proved(spark, rows, bits=bits, levels=levels)
    assert frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found(frame) == sorted(map(repr, want))
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "Only", "en", "s", 4, *"abcde")], [(None, None, None, None, None, *"abcde")] * 3, [(1, "T", "en", "s", 1, *"abcde")] * 17])
def test_odd_tables(spark, rows):
    want, _, _ = brute(rows, 16) if rows else ([], None, None)
    assert found(proved(spark, rows)) == sorted(map(repr, want))


def test_missing_columns_are_null(spark):
    frame = manifest.proved(spark.createDataFrame([(3, "t")], "doc_id int, text string"))
    assert [tuple(r)[:2] for r in frame.collect()] == [(3, leaf_of(3, "t", None, None, None))]


@pytest.mark.parametrize(("bits", "levels"), [(4, 4), (1, 2)])
def test_nodes_of_the_manifest(spark, bits, levels):
    rows = rows_of(120, ["hot", "hot", None, "a", "b", "lone"])
    rows = [r for r in rows if r[3] != "lone"] + [(900, "one", "en", "lone", 3, *"abcde")]
    _, trees, top = brute(rows, 1 << bits)
    tree = manifest.manifest(manifest.leaves(spark.createDataFrame(rows, SCHEMA)), bits, levels)
    want = set()
    for is_top, name, t in [*[(False, s, t) for s, t in trees.items()], (True, None, top)]:
        for level, digests in enumerate(t):
            if level or len(t) == 1:
                want |= {(is_top, name, level, i, d) for i, d in enumerate(digests)}
    got = [tuple(r) for r in tree.nodes.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_states_are_resumed_not_rehashed():
    children = [digest(str(i)) for i in range(16)]
    parent = manifest.Parent("".join(children).encode())
    assert parent.digest.decode() == digest(*children)
    for slot in range(16):
        other = digest("other")
        assert parent.folded(slot, other.encode()).decode() == digest(*children[:slot], other, *children[slot + 1 :])
    assert manifest.Parent(children[0].encode()).folded(0, other.encode()).decode() == digest(other)


def test_sql_says_the_same(spark, tmp_path):
    rows = rows_of(400, ["hot", "hot", None, "", "é", *[f"s{i}" for i in range(30)]], seed=9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/d.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT doc_id, text, lang, source, n_chars FROM '{tmp_path}/d.parquet/*.parquet'")
    want = base.execute(manifest.oracle_sql()).fetchall()
    assert sorted(map(repr, want)) == sorted(map(repr, brute(rows, 16)[0]))
