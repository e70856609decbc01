"""Spelling variants against comparisons of all words with all others."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from millrace.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, shard string, kind string, near string"


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def brute(rows):
    words = counted(rows)
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(map(repr, out))


def corpus():
    rng = random.Random(11)
    letters = "abcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words = list(base)
    for w in base * 3:
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "ababab", "abababa", "zürich", "Zürich", "ZÜRICH", "zurich", "×××××", "÷×÷×÷", "naïveté", "naivete"]
    weights = [1 / (1 + i % 40) for i in range(len(words))]
    rows = []
    for k in range(60):
        text = rng.choice([" ", ", ", "1", "\n", "Ā"]).join(rng.choices(words, weights, k=80))
        rows.append((None if k % 20 == 7 else k, text.upper() if k % 5 == 0 else text))
    rows += [(900, None), (901, ""), (902, "12 34 ..."), (903, "longword" * 5000), (904, "longword" * 5000), (905, "longword" * 5000 + "x")]
    long = "abcdefgh" * 20
    rows += [(910 + k, t) for k, t in enumerate([long] * 7 + [long + "x"] * 3 + [long[:3] + long[4:]] * 3 + [long[:150] + "é" + long[151:]] * 4 + ["x" + long[1:] + "y"] * 3)]
    rows += [(906, "spelling spelling spelling " * 40_000)] + rows[:5] + [(None, "tied words tiedx tiedy tied tiedx tiedy tiedx tiedy tiedz tiedz tiedz")]
    return [(*r, "w", 1, "s", "k", "n") for r in rows]


@pytest.mark.parametrize(("shard", "longest"), [(8192, 64), (40, 6), (3, 64), (40, 5)])
def test_equals_brute_force(spark, shard, longest):
    rows = corpus()
    frame = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(3), shard=shard, longest=longest)
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(repr, map(tuple, frame.collect())))
    assert got == brute(rows) and sum(", None, " not in g for g in got) > 20


def test_tasks_hand_on_sums(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    want = counted(rows)
    for held in (1, 50, 300_000):
        assert {r.word: r.n for r in spelling.vocabulary(frame, held=held).collect()} == want


def test_odd_tables(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    assert spelling.variants(frame.limit(0)).collect() == []
    assert spelling.variants(frame.where("doc_id IN (900, 901, 902)")).collect() == []
    lone = [(1, "single single single", "w", 1, "s", "k", "n")]
    assert [tuple(r) for r in spelling.variants(spark.createDataFrame(lone, SCHEMA)).collect()] == [("single", None, "single", 3, 0, None)]


def test_long_texts_are_counted_as_others():
    text = "Ab cÉ ab, x" * 200_000
    assert spelling.runs_of(text) == Counter(re.findall("[a-zÀ-ÿ]+", text.replace("A", "a")))


def test_intervals_of_both_sides_are_in_step():
    words = ["abcab", "abcde", "bcabc", "cabca", "dabce", "ééaéé"]
    index = spelling.Index(words)
    text = "\n" + "\n".join(words) + "\n"
    cyclic = text + text
    rng = random.Random(1)
    for _ in range(60):
        x, pattern = index.whole(1), ""
        for _ in range(rng.randint(1, 5)):
            c = rng.choice("abcdé")
            symbol = index.encoded([c])[0][0]
            if rng.random() < 0.5:
                x, pattern = index.grown(index.left, x, symbol), c + pattern
            else:
                x, pattern = index.grown(index.right, x.turned(), symbol).turned(), pattern + c
        places = {i for i in range(len(text)) if cyclic.startswith(pattern, i)}
        assert int(x.size[0]) == len(places)
        if places:
            lo, n = int(x.here[0]), int(x.size[0])
            assert set(index.order[lo : lo + n].tolist()) == places


@pytest.mark.parametrize("left", [True, False])
def test_each_search_finds_what_shares_its_half(left):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(400)})
    asked = [*words[:150], "zzzzz", "abcabz", "ü" * 6]
    place, number = spelling.Index(words).near(asked, left)
    got = {(asked[i], words[k]) for i, k in zip(place.tolist(), number.tolist())}
    assert len(got) == len(place)
    half = lambda w: w[: len(w) // 2] if left else w[len(w) // 2 :]
    shares = lambda q, c: c.startswith(half(q)) if left else c.endswith(half(q))
    assert got == {(q, c) for q in asked for c in words if one_apart(q, c) and shares(q, c)}


def test_sql_says_the_same(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/d")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{tmp_path}/d/*.parquet'")
    assert sorted(map(repr, base.execute(spelling.oracle_sql()).fetchall())) == brute(rows)
