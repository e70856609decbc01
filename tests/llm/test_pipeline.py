"""The pipeline against the same stages in plain Python, one document after another."""

import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from millrace.llm import fertility, near_dups, quality_model, secrets

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    make = lambda n, end="": " ".join(rng.choice(words) + end for _ in range(n))
    texts = []
    for i in range(150):
        texts.append(make(rng.randint(60, 260)))
    for i in range(0, 40):
        own = texts[i].split()
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own) if i % 2 else texts[i])
    texts += [make(80, "###") for _ in range(30)]
    texts += ["same words again " * 30, "short text", "", None, "é" * 300]
    texts += [make(70) + ' token = "ad9b9ab81594e97f2d82ac69ac6544142c4f1d40" ' + make(20) for _ in range(4)]
    texts.append(make(20_000))  # a very long one, which all stages take whole
    rows = [(i, t, None if i % 9 == 0 else "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int("###" not in (texts[i] or "")), 0) for i in range(0, len(texts), 2)]
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def rules(rows):
    pieces = fertility.WordPieces(public_tokenizers.path(fertility.VOCABULARY), public_tokenizers.path(fertility.BYTES))
    read = {r[0]: fertility.reading(r[1] or "", pieces) for r in rows}
    good, values = {}, {}
    for i, x in read.items():
        good[i] = x["n_words"] >= 50 and 100 * x["n_repeat_words"] <= 50 * x["n_words"]
        n = x["n_tokens"]
        values[i] = [x["word_chars"] / n, x["n_bytes"] / n, x["entropy"], x["word_chars"] / x["n_byte_tokens"]] if n else None
    groups = defaultdict(list)
    for r in rows:
        if good[r[0]]:
            groups[r[2] or ""].append(values[r[0]])
    kept = []
    for r in rows:
        i, ok = r[0], good[r[0]]
        if ok:
            scatter = max(1.0, math.sqrt(fertility.STEADY / read[i]["n_tokens"]))
            for k in range(4):
                low, high = np.percentile([round(v[k], 5) for v in groups[r[2] or ""]], [25, 75], method="inverted_cdf")
                reach = scatter * fertility.WIDTH * max(high - low, 1e-3)
                ok &= low - reach <= values[i][k] <= high + reach
        if ok:
            kept.append(r)
    return kept


def weight(groups):
    """groups: (documents, evidence, mean above them)."""
    some = [g for g in groups if g[0] > 1]
    n = sum(g[0] for g in some)
    if not n:
        return 1e9
    between = (sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in some) - sum(g[2] * (1 - g[2]) for g in some)) / n
    within = sum(g[0] * g[2] * (1 - g[2]) for g in some) / n
    return within / max(between, 1e-9)


def classifier(rows, labels):
    x = {r[0]: np.array(quality_model.features_of(r[1] or "")) for r in rows}
    known = {i: q for i, q, _ in labels if i in x}
    *w, constant = quality_model.fit(np.stack([x[i] for i in sorted(known)]), np.array([float(known[i] > 0) for i in sorted(known)]))
    logit = {i: float(v @ np.array(w)) + constant for i, v in x.items()}
    evidence = {i: 1 / (1 + math.exp(-v)) for i, v in logit.items()}
    prior = sum(evidence.values()) / len(evidence)
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in rows:
        hosts[r[3]].append(evidence[r[0]])
        paths[r[3], r[2] or ""].append(evidence[r[0]])
    top = weight([(len(e), sum(e), prior) for e in hosts.values()])
    mean = {h: (top * prior + sum(e)) / (top + len(e)) for h, e in hosts.items()}
    inner = weight([(len(e), sum(e), mean[k[0]]) for k, e in paths.items()])
    odds = lambda p: math.log(p / (1 - p))
    out = []
    for r in rows:
        own, host, path = evidence[r[0]], hosts[r[3]], paths[r[3], r[2] or ""]
        above = (top * prior + sum(host) - own) / (top + len(host) - 1)
        site = (inner * above + sum(path) - own) / (inner + len(path) - 1)
        if logit[r[0]] + odds(site) - odds(prior) >= 0:
            out.append(r)
    return out


def dedup(rows):
    sets = {r[0]: set(near_dups.shingle_set(r[1] or "").tolist()) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= corpus_pipeline.NEAR * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for r in rows if find(r[0]) == r[0]]


def redacted(rows):
    out = []
    for r in rows:
        text, at, safe = r[1] or "", 0, ""
        for s in secrets.spans_of(text):
            if s["start"] >= at:
                safe += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        out.append((r[0], safe + text[at:], *r[2:4], len(safe + text[at:])))
    return out


def test_stages(spark, corpus):
    folder, rows, labels = corpus
    wanted = rows
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = [rules, lambda rows: classifier(rows, labels), dedup, redacted]
    for (name, stage), same in zip(corpus_pipeline.STAGES, plain):
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        wanted = same(wanted)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert sorted(tuple(r) for r in docs.collect()) == sorted(wanted), name
    assert 100 < len(wanted) < 160 and any("[SECRET]" in r[1] for r in wanted)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, folder).collect()
    held = defaultdict(int)
    for r in packed:
        held[r["doc_id"]] += r["length"]
    assert dict(held) == {r[0]: len(model.encode(r[1], add_special_tokens=False).ids) + 1 for r in wanted}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_dedup_limit(spark):
    base = [f"w{i}" for i in range(60)]
    changed = [*base[:30], "other", *base[31:]]  # 51 of 61 shingles in common
    far = [*base[:10], "x", *base[11:45], "y", *base[46:]]  # 46 of 66
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate([base, changed, far])], SCHEMA)
    got = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]
    assert all(r["kept"] for r in near_dups.near_duplicates(docs).collect())


def test_stages_of_odd_rows(spark):
    """Rows of one id stay or go by their own text, null ids stay, missing columns are null, others don't matter."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    whole = [make(120) for _ in range(40)]
    rows = [(i, t, "k") for i, t in enumerate(whole)] + [(1, "too short", "k"), (None, make(130), "k"), (None, None, "k"), (5, whole[5], "k"), (None, whole[6], "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    passed = corpus_pipeline.quality_rules(spark, docs, "")
    assert passed.columns == corpus_pipeline.COLUMNS
    got = passed.collect()
    assert (1, "too short") not in {(r["doc_id"], r["text"]) for r in got} and (1, whole[1]) in {(r["doc_id"], r["text"]) for r in got}
    assert sum(r["doc_id"] is None for r in got) == 2 and all(r["lang"] is None for r in got)
    alone = corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()
    assert sum(r["doc_id"] == 5 for r in alone) == 1 and {r["text"] for r in alone} == {r[1] for r in rows}
    assert next(r["doc_id"] for r in alone if r["text"] == whole[6]) == 6
    safe = corpus_pipeline.secret_scans(spark, docs, "").collect()
    assert len(safe) == len(rows) and sorted(str(r["doc_id"]) for r in safe) == sorted(str(r[0]) for r in rows)
    assert corpus_pipeline.pack(spark, docs, "").where("doc_id IS NULL AND start = 0").count() == 3
