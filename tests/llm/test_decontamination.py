"""Decontamination against a comparison of every run of words with every window."""

import hashlib
import random
import re

import duckdb
import pytest
from millrace.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCUMENTS = "doc_id bigint, text string, row string, key string, found string, item_id string"
ITEMS = "item_id string, text string, key string, s string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(documents, items, window):
    known = {}
    for item_id, text, *_ in items:
        w = WORD.findall(lower(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            known.setdefault(tuple(w[i : i + size]), set()).add(item_id or "")
    out = []
    for doc_id, text, *_ in documents:
        w = WORD.findall(lower(text))
        hit, ids = set(), set()
        for size in {len(k) for k in known}:
            for i in range(len(w) - size + 1):
                if names := known.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    ids |= names
        listed = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), listed, bool(hit)))
    return sorted(map(repr, out))


def tables():
    rng = random.Random(12)
    vocabulary = ["a", "b", "the", "of", "Straße", "naïve", "x1", "42", "日本語", *["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]]
    make = lambda n, words=vocabulary: [rng.choice(words) for _ in range(n)]
    items = [(f"i{k}", " ".join(make(rng.choice([10, 11, 25, 40])))) for k in range(25)]
    items += [("i1", "again the first id, with another text of eleven words or so here"), ("one", "42"), ("two", "X1 日本語"), ("five", "a b the of a"), ("nine", " ".join(make(9)))]
    items += [("none", " ,.! "), ("null", None), (None, " ".join(make(12))), ("same", items[0][1]), ("loop", "a a a a a a a a a a a a"), ("turn", "a b " * 8)]
    documents = [(0, None), (1, ""), (2, "  ..\n\t"), (3, "42"), (4, "x1-日本語"), (None, items[0][1]), (None, None)]
    for k, (_, text) in enumerate(items):
        words = (text or "").split()
        around = make(30), make(30)
        whole = " ".join([*around[0], *words, *around[1]])
        broken = [*words]
        if len(broken) > 12:
            broken[rng.randrange(len(broken))] = "changed"
        documents += [(100 + k, whole.upper()), (200 + k, "...".join(broken)), (300 + k, " ".join(words[1:])), (400 + k, " ".join(words * 3))]
    documents += [(500 + k, " ".join(make(rng.choice([5, 9, 10, 200])))) for k in range(30)]
    documents += [(600, "a " * 3000), (601, " ".join(make(4000) + items[2][1].split() + make(4000))), (602, "x" * 100_000)]
    documents += documents[7:12] + [(100, "other text of one id")]
    return [(*d, *"rkfi") for d in documents], [(*i, *"ks") for i in items]


@pytest.mark.parametrize(("window", "shingle"), [(10, 5), (10, 1), (10, 10), (4, 3)])
def test_equals_brute_force(spark, window, shingle):
    documents, items = tables()
    frame = decontamination.decontaminate(spark.createDataFrame(documents, DOCUMENTS).repartition(3), spark.createDataFrame(items, ITEMS), window, shingle)
    assert frame.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(repr, map(tuple, frame.collect()))) == brute(documents, items, window)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    documents, items = tables()
    monkeypatch.setattr(decontamination, "_room", lambda n: 2)
    frame = decontamination.decontaminate(spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(items, ITEMS))
    assert sorted(map(repr, map(tuple, frame.collect()))) == brute(documents, items, 10)


def test_odd_tables(spark):
    documents, items = tables()
    docs, bench = spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(items, ITEMS)
    assert decontamination.decontaminate(docs.limit(0), bench).collect() == []
    for none in (bench.limit(0), bench.where("item_id IN ('none', 'null')")):
        found = decontamination.decontaminate(docs, none).collect()
        assert sorted(map(repr, map(tuple, found))) == brute(documents, [], 10)


def test_every_window_comes_with_its_place(spark):
    documents = [(1, "p q r s one two three four five six seven eight nine ten t u")]
    items = [("x", "One two three four five six seven eight nine ten"), ("y", "u")]
    every, hits, _ = decontamination.contaminations(spark.createDataFrame(documents, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted((r.start, r.length, r.key) for r in hits.collect()) == [(4, 10, items[0][1].lower()), (15, 1, "u")]
    assert [r.n_words for r in every.collect()] == [16]


def test_no_python_in_the_plan(spark):
    documents, items = tables()
    frame = decontamination.decontaminate(spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(items, ITEMS))
    plan = frame._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_sql_says_the_same(spark, tmp_path):
    documents, items = tables()
    base = duckdb.connect()
    for name, rows, schema in (("documents", documents, DOCUMENTS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}")
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert sorted(map(repr, base.execute(decontamination.oracle_sql()).fetchall())) == brute(documents, items, 10)
