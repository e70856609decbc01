"""Each operator against plain Python over small tables with odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from millrace.llm import bpe, chat, embeddings, fertility, licenses, near_dups, packing, quality_model, secrets, warc
from millrace.operators.components import components
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, print string, component string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = vocabulary(rng)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [None, "", "   \n\t ", "one two", "One TWO", "one two three four five", make(3000), "x" * 20000]
    for _ in range(12):
        base = make(120).split()
        out.append(" ".join(base))
        out.append(" ".join(base).upper() if rng.random() < 0.3 else " ".join(base))
        for cut in (1, 3, 8, 20):
            changed = list(base)
            for i in rng.sample(range(len(base)), cut // 2 + 1):
                changed[i] = rng.choice(words)
            out.append(" ".join(changed[: 120 - cut]))
    shared = make(60)
    out += [shared + " " + make(40) for _ in range(25)]
    out += ["line a\nline a\nline b c\n\n  \nline a", "a b c a b c a b c", "é ß 　 \x1c\x85 ' 's we'll 12 34  \n\n x", "a  b\t\tc \n d"]
    out += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n<|endoftext|", "<|endoftext|> " * 300]
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", "s", 0, "q", "q", "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in got}
    assert {n for a, b in edges if a != b for n in (a, b)} <= set(got)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(spark, documents, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = by_id(near_dups.near_duplicates(documents))
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), find(i), find(i) == i)
    assert near_dups.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_large_region(spark, monkeypatch):
    """Regions beyond the bound are looked at deeper, and nothing is lost."""
    monkeypatch.setattr(near_dups, "REGION", 8)
    rng = random.Random(9)
    words = vocabulary(rng)
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    got = by_id(near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {r["component_id"] for r in got.values()} == {0}


def test_near_duplicates_hot_template(spark, monkeypatch):
    """Pages just under the limit to each other; pairs above it are found whatever the region's size."""
    monkeypatch.setattr(near_dups, "REGION", 32)
    texts = []
    for page in range(200):
        own = [f"w{i}" for i in range(434)]
        # No two pages change more than one place in common: 0.83 or 0.8495.
        for x in range(4):
            own[4 + 5 * (19 * x + (page // 19 * x + page) % 19)] = f"p{page}x{x}"
        texts.append(own)
    for page in range(40):
        own = list(texts[page])
        for k in range(388, 424, 7):
            own[k] = f"q{page}x{k}"  # 0.87 to its page
        texts.append(own)
    sets = [set(near_dups.shingle_set(" ".join(t)).tolist()) for t in texts]
    links = [(j, i) for i, s in enumerate(sets) for j in range(i) if 100 * len(s & sets[j]) >= 85 * len(s | sets[j])]
    assert links == [(i, 200 + i) for i in range(40)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = by_id(near_dups.near_duplicates(frame))
    assert all(got[i]["component_id"] == (i - 200 if i >= 200 else i) for i in range(240))


def test_near_duplicates_of_rows_whose_ids_clash(spark):
    base = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    change = lambda words, at: " ".join([*words[:at], "new", *words[at + 1 :]])
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, change(base, 50)), (8, change(other, 50)), (9, " ".join(base)), (9, " ".join(base)),
            (None, change(base, 20)), (None, "alone in the world"), (None, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("head", F.lit(1)).coalesce(1)
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(frame).collect()]
    wanted = [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 5, False), (9, 5, False), (None, 5, False),
              (None, None, True), (None, None, True), (3, 3, True)]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    assert sum(r["first"] for r in near_dups.near_duplicates(frame).collect()) == 5


@pytest.mark.parametrize("region", [16, 64, 5000])
def test_near_duplicates_equal_brute_force_whatever_the_region(spark, monkeypatch, region):
    """A template whose pages are at 0.72 to 0.83 to each other, with planted pairs at the limit and chains."""
    monkeypatch.setattr(near_dups, "REGION", region)
    rng = random.Random(11)
    words = vocabulary(rng)
    base = [rng.choice(words) for _ in range(160)]
    texts = []
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(160), rng.randint(2, 4)):
            own[at] = rng.choice(words) + str(rng.randrange(1000))
        texts.append(own)
    for k in range(40):
        own = list(texts[k])
        own[rng.randrange(160)] += "x"
        texts.append(own)
    texts += [texts[3], texts[4]]
    sets = [set(near_dups.shingle_set(" ".join(t)).tolist()) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = by_id(near_dups.near_duplicates(frame))
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_sketch_bound_loses_few_links(percent):
    p = (1 - percent / 100) * 15 / 16
    bound = near_dups.most_differing(percent)
    lost = sum(math.comb(192, k) * p**k * (1 - p) ** (192 - k) for k in range(bound + 1, 193))
    assert lost <= 1e-5


def test_quality_rules(spark, documents, texts):
    got = by_id(fertility.quality(documents))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORDS.findall(t)
        windows = defaultdict(list)
        for k in range(len(w) - 2):
            windows[tuple(w[k : k + 3])].append(k)
        covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
        seen, same = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                same += line in seen
                seen.add(line)
        row = got[i]
        assert row["n_words"] == len(w) and row["word_chars"] == sum(map(len, w))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert row["n_dup_lines"] == same and row["n_repeat_words"] == len(covered)
        assert row["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (row["base_failed"] and row["kept"])
    assert fertility.quality(empty(spark)).count() == 0


def test_fertility_readings_equal_a_plain_encode(texts):
    """Tokens of whole words by the libraries, one text after another."""
    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(fertility.VOCABULARY))
    with open(public_tokenizers.path(fertility.BYTES), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = fertility.WordPieces(public_tokenizers.path(fertility.VOCABULARY), public_tokenizers.path(fertility.BYTES))
    for t in [*texts, "日本 𝒳 ok", "\u1234" * 30]:
        words = WORDS.findall(t or "")
        ids = [i for w in words for i in model.encode(w)]
        read = fertility.reading(t or "", pieces)
        assert read["n_tokens"] == len(ids) and read["n_bytes"] == sum(model.is_byte(i) for i in ids)
        assert read["n_byte_tokens"] == sum(len(library.encode_ordinary(" " + w)) for w in words)
        size, windows = min(64, len(ids)), []
        if size > 1:
            windows = [ids[k : k + size] for k in range(0, len(ids) - size + 1, size)] + ([ids[-size:]] if len(ids) % size else [])
        entropy = [-sum(w.count(i) / size * math.log2(w.count(i) / size) for i in set(w)) / math.log2(size) for w in windows]
        assert read["entropy"] == pytest.approx(sum(entropy) / len(entropy) if entropy else 0.0)


def test_quality_rules_of_odd_rows(spark):
    rows = [(1, "a b " * 40, "en"), (1, "a b " * 40, "en"), (None, None, None), (2, "w" * 500_000, "en")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("band", F.lit(1)).withColumn("entropy", F.lit(2))
    got = fertility.quality(frame).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in got) == [("1", 80, False), ("1", 80, False), ("2", 1, False), ("None", 0, False)]
    assert len(fertility.quality(frame.drop("lang")).collect()) == 4


def test_quality_rules_reject_odd_text(spark):
    rng = random.Random(4)
    words = vocabulary(rng)
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)), "en") for i in range(60)]
    rows.append((60, " ".join("".join(chr(rng.randrange(0x13000, 0x13400)) for _ in range(4)) for _ in range(200)), "en"))
    got = by_id(fertility.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert all(got[i]["kept"] for i in range(60)) and not got[60]["kept"] and not got[60]["base_failed"]


def test_quality_rules_reject_symbols_at_every_length(spark):
    rng = random.Random(7)
    words = vocabulary(rng)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([80, 300, 1500]))), "en") for i in range(150)]
    for i, size in enumerate([80, 300, 1500] * 4):
        rows.append((150 + i, " ".join(rng.choice(words) + rng.choice(["", "", "###", "$$$", "***"]) for _ in range(size)), "en"))
    got = by_id(fertility.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert sum(got[i]["kept"] for i in range(150)) >= 149
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(150, 162))


def test_entropy_is_of_like_lengths():
    ids = np.array([random.Random(1).randrange(40) for _ in range(64)])
    assert fertility.windowed_entropy(np.tile(ids, 50)) == pytest.approx(fertility.windowed_entropy(ids))
    assert fertility.windowed_entropy(np.arange(100)) == 1.0 and fertility.windowed_entropy(np.zeros(100, int)) == 0.0
    assert fertility.windowed_entropy(np.arange(0)) == fertility.windowed_entropy(np.arange(1)) == 0.0


def test_byte_bpe(spark, documents, texts):
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.round_trip(documents))
    for i, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes()
        assert got[i]["n_tokens"] == len(ids) // 4
        assert got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    both = documents.select("doc_id", bpe.encode(F.col("text")).alias("ids")).select("doc_id", bpe.decode(F.col("ids")).alias("b"))
    assert {r["doc_id"]: bytes(r["b"]).decode() for r in both.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(empty(spark)).count() == 0


def test_byte_bpe_of_odd_tables(spark):
    rows = [(1, "twice the same", 1), (1, "twice the same", 1), (None, "null id", 2), (2, "x" * 300_000 + " é" * 1000, 3), (3, "", 4), (4, None, 5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, d int").withColumn("n_tokens", F.lit("clash"))
    got = bpe.round_trip(frame).collect()
    assert len(got) == len(rows) and bpe.round_trip(frame.limit(0)).count() == 0
    for doc_id, text, _ in rows:
        want = hashlib.sha256((text or "").encode()).hexdigest()
        assert sum(r["doc_id"] == doc_id and r["decoded_sha256"] == want for r in got) == sum(x[0] == doc_id and x[1] == text for x in rows)


def test_perfect_hash():
    keys = {f"k{i}".encode(): i for i in range(2000)}
    found = bpe.PerfectHash(keys)
    assert all(found.find(k) == v for k, v in keys.items()) and None not in found.slots
    assert all(found.find(f"x{i}".encode()) is None for i in range(500))


def test_packing(spark, documents, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(documents, with_ids=True)
    rows = packed.collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, dtype="<u4").tobytes()
        assert all(r["doc_tokens"] == len(ids) for r in own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
    assert len(sequences) <= sum(r["length"] for r in rows) / packing.LENGTH * 1.03 + 1
    assert packing.sequences(packed).count() == len(sequences)
    odd = texts.index("a <|endoftext|> b")
    assert np.frombuffer(bytes(pieces[odd][0]["ids"]), dtype="<u4").tolist() == [64, 220, 50256, 275, 0]
    assert packing.pack(empty(spark)).count() == 0


def test_packing_cuts_where_whole_pieces_leave_padding(spark):
    """Documents of some 600 ids: no two of them share a sequence whole. Repeated rows are packed as often as they come."""
    rng = random.Random(2)
    rows = [(i // 2, " ".join("abcdefgh"[rng.randrange(8)] for _ in range(600))) for i in range(60)] + [(None, None), (None, "a b")]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class", F.lit("x")).coalesce(2), with_ids=True).collect()
    used = defaultdict(int)
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
        used[r["sequence_id"]] += r["length"]
    assert sum(used.values()) == 60 * 601 + 1 + 3 and max(used.values()) <= 1024
    assert len(used) * 1024 < 1.05 * sum(used.values()) + 1024


def test_patterns_are_near_the_bound():
    rng = random.Random(1)
    demand = defaultdict(int)
    for _ in range(20000):
        demand[rng.randint(1, 128)] += 1
    made = defaultdict(int)
    found = packing.patterns(dict(demand), 128)
    for pattern, times in found:
        assert sum(c * n for c, n in pattern.items()) <= 128
        for c, n in pattern.items():
            made[c] += n * times
    assert made == demand
    assert sum(n for _, n in found) <= 1.01 * sum(c * n for c, n in demand.items()) / 128
    assert packing.patterns({}, 128) == []


def test_secrets(spark):
    hexes = "0123456789abcdef" * 2
    rows = [
        (0, None), (1, ""), (2, "secret: token: abcdefgh"), (3, 'API_KEY = "abc123XYZ" and é password=short'),
        (4, "AKIA" + "A" * 16 + " AKIA123"), (5, f"sum {hexes} end"), (6, "the api key is Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6 here"),
        (7, "token name client_secret_2024_key here"), (8, "ſecret=abcdefgh passwd:abcdefg"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(secrets.scan_secrets(frame))
    for i, t in rows:
        t, base = t or "", []
        for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t):
            base += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[1]) >= 6 else []
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(x for _, _, x in sorted(base))
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))
    assert got[6]["n_novel"] == 1 and got[7]["n_novel"] == 0 and got[2]["n_assign"] == 0
    shown = frame.select("doc_id", "text", secrets.secret_spans(F.col("text")).alias("s"))
    safe = by_id(shown.select("doc_id", secrets.redact(F.col("text"), F.col("s")).alias("t")))
    assert safe[6]["t"] == "the api key is [SECRET] here" and safe[0]["t"] is None and safe[3]["t"].startswith("[SECRET]")


def test_secret_novelty_on_planted_strings():
    """Recall on random strings of four alphabets, and precision beside names that stand where secrets do."""
    rng = random.Random(1)
    small = "abcdefghijklmnopqrstuvwxyz"
    alphabets = {"b64": small + small.upper() + "0123456789+/", "letters": small + small.upper(), "small": small + "0123456789", "alnum": small + small.upper() + "0123456789"}
    places = ["Authorization: Bearer ", "api key is ", "X-Auth-Signature ", "private_key -> ", 'credential("', "aws secret key, "]
    names = """client_secret_2024_key application/vnd.api+json test_password_reset_token_expired getUserAuthenticationToken2 ConnectionRefusedError
    AuthenticationMiddleware org/apache/hadoop/security/UserGroupInformation access_token_refresh_interval_seconds XXXXXXXXXXXXXXXXXXXX1 session_token_2024_01_01
    aaaaaaaaaaaaaaaaaaaa1 my-super-secret-password-1234 Donaudampfschifffahrt 2024-01-01T00-00-00Z1 secret_manager_v1beta1 PASSWORD_HASHERS_DEFAULT_2
    src/main/java/com/example/auth/TokenProvider1 password_confirmation2 4845168114407329 erschlichchstscher anthrererendanhe""".split()
    line = lambda x: f"some code here\nconfig.get(name) # note\n{rng.choice(places)}{x} and more text follows\n"
    novel = lambda t: sum(s["kind"] == "novel" for s in secrets.spans_of(t))
    found = {k: sum(novel(line("".join(rng.choice(a) for _ in range(rng.randint(20, 40))))) for _ in range(200)) / 200 for k, a in alphabets.items()}
    assert found["b64"] > 0.95 and found["alnum"] > 0.95 and found["letters"] > 0.85 and found["small"] > 0.9, found
    wrong = sum(novel(line(n)) for n in names for _ in range(10))
    assert wrong <= 0.03 * 10 * len(names)
    assert novel("".join(rng.choice(alphabets["b64"]) for _ in range(40)) + " stands where nothing says what it is") == 0


def test_novelty_is_the_margin_by_brute_force():
    """Every long run of token characters near a sensitive word, its margin by compressing anew with the same dictionary."""
    import zstandard

    rng = random.Random(31)
    known = (secrets.CODE_NAMES + secrets.IDENTIFIERS).encode()

    def size(text):
        words = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=9, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(packer.compress(text.encode()))

    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    names = ["getUserAuthenticationToken2", "application/vnd.api+json", "refresh_interval_seconds_12", "Donaudampfschifffahrtsgesellschaft"]
    seen = 0
    for k in range(60):
        token = "".join(rng.choice(alphabet) for _ in range(rng.randint(16, 44))) if k % 2 else rng.choice(names)
        text = f"some lines of text {'and more ' * rng.randrange(90)} bearer {token} end {'of it ' * rng.randrange(90)}"
        at = text.index(token)
        before, after = text[max(0, at - secrets.AROUND) : at], text[at + len(token) : at + len(token) + secrets.AROUND]
        margin = (size(before + token + after) - size(before + after)) / len(token)
        assert secrets.novelty(text, at, at + len(token)) == margin
        one_case = not (any(c.islower() for c in token) and any(c.isupper() for c in token))
        wanted = margin >= (secrets.NOVELTY_ONE_CASE if one_case else secrets.NOVELTY) and secrets._odd(token)
        assert [(s["start"], s["end"]) for s in secrets.spans_of(text) if s["kind"] == "novel"] == ([(at, at + len(token))] if wanted else []), (text, margin)
        seen += wanted
    assert 20 < seen < 40


def test_the_dictionary_is_fixed():
    """The same names whatever runs it: nothing of the interpreter is read."""
    assert not {"sys", "os", "builtins", "keyword"} & set(vars(secrets))
    assert all(secrets.SENSITIVE) and "SECRET_KEY" in secrets.CODE_NAMES


def test_secrets_of_odd_tables(spark):
    rows = [(1, "x " * 200_000 + "token=abcdef12"), (1, "x " * 200_000 + "token=abcdef12"), (None, "secret=abcdefg"), (2, "t" * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("found", F.lit(1)).withColumn("spans", F.lit("s"))
    got = secrets.scan_secrets(frame).collect()
    assert sorted((str(r["doc_id"]), r["spans"]) for r in got) == [("1", "assign:400000:400014")] * 2 + [("2", ""), ("None", "assign:0:14")]
    assert secrets.scan_secrets(frame.where("doc_id = 77")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be \\ <kind>"), (1, 1, "user", "hi</turn>\n### x"), (1, 2, "assistant", "\\b\\l\\h ok"), (1, 3, "user", None),
            (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", "alone"), (3, 0, None, "x"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"),
            (4, 0, "ass\nistant:", "####")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat.format_conversations(turns)
    got = by_id(chat.conversation_digests(examples), "conv_id")
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(r["is_target"] for r in examples.collect()) == 4
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.conversation_digests(chat.format_conversations(none)).count() == 0


def test_warc(spark):
    big, small = "é" * 800, "x" * 900
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", "y" * 5000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha1", F.lit(0))
    got = by_id(warc.archive_and_read(pages), "page_id")
    for page, _, html in rows:
        data = (html or "").encode()
        kind, refers = ("revisit", 3) if page in (1, 2) else ("response", None)
        assert (got[page]["payload_bytes"], got[page]["record_type"], got[page]["refers_to"]) == (len(data), kind, refers)
        assert got[page]["payload_digest"] == hashlib.sha1(data).hexdigest()
    assert warc.archive_and_read(pages.where("page_id < 0")).count() == 0
    odd = [(None, None, big), (None, "u", big), (4, "u", big), (4, "u", big), (5, "u", "z" * 2000), (None, "u", None), (None, "u", "q" * 1500), (None, "u", "q" * 1500)]
    got = warc.archive_and_read(spark.createDataFrame(odd, "page_id bigint, url string, html string")).collect()
    shown = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in got)
    assert shown == sorted([("None", 1600, "revisit", "4")] * 2 + [("4", 1600, "response", "None")] * 2 + [("5", 2000, "response", "None"), ("None", 0, "response", "None")] + [("None", 1500, "response", "None")] * 2)


def test_warc_of_large_pages(spark):
    """Pages of several megabytes, one of which comes twice."""
    large = "".join(chr(33 + i * i % 9000) for i in range(1_500_000))
    rows = [(1, "u", large), (2, "v", large), (3, "w", large[::-1]), (4, "x", "small")]
    got = by_id(warc.archive_and_read(spark.createDataFrame(rows, "page_id bigint, url string, html string")), "page_id")
    for page_id, _, html in rows:
        data = html.encode()
        assert (got[page_id]["payload_bytes"], got[page_id]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 4)] == [("revisit", 2), ("response", None), ("response", None), ("response", None)]


def test_chat_of_long_turns(spark):
    long = "\\### Assistant: </turn> é\n" * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", "short")]
    got = by_id(chat.conversation_digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))), "conv_id")
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()).hexdigest()


def test_warc_reader_rejects_damage():
    import io

    data = warc.record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    assert [p for _, _, p in warc.read_records(io.BytesIO(data + data))] == [b"hello"] * 2
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-9])))
    packer = zlib.compressobj(4, zlib.DEFLATED, warc.GZIP)
    changed = packer.compress(zlib.decompress(data, warc.GZIP).replace(b"hello", b"jello")) + packer.flush()
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(changed)))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    rows = [v.tolist() for v in x]
    for i in range(60):
        rows.append((x[i % 5] + rng.standard_normal(16) * 0.08).astype(np.float32).tolist())
    rows += [rows[0], rows[0], [2 * float(v) for v in rows[1]], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [0.0] * 15]
    n = len(rows)
    v = np.array([r if r and len(r) == 16 and None not in r else [np.nan] * 16 for r in rows], dtype=np.float32).astype(float)
    with np.errstate(all="ignore"):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = (unit @ unit.T >= 0.95) & ~np.eye(n, dtype=bool)
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        p, q = find(int(a)), find(int(b))
        root[max(p, q)] = min(p, q)
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<float>").withColumn("v", F.lit(0))
    got = by_id(embeddings.near_duplicates(frame), "vec_id")
    assert len(got) == n
    assert [got[i]["n_links"] for i in range(n)] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(n)] == [find(i) for i in range(n)]
    assert all(got[i]["kept"] == (find(i) == i) for i in range(n))
    assert embeddings.near_duplicates(frame.where("vec_id < 0")).count() == 0


def test_embeddings_of_several_lengths_and_clashing_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 16)).astype(np.float32).tolist()
    rows = list(enumerate(x)) + [(100, x[0][:8]), (101, [2 * v for v in x[0][:8]]), (102, x[0][:8] + [0.0] * 8), (103, x[1][:3]), (104, x[1][:3])]
    rows += [(7, x[3]), (None, x[5]), (None, [1.0, 2.0]), (None, None), (50, x[9]), (50, x[10])]
    got = defaultdict(list)
    for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert got[100] == [(1, 100, True)] and got[101] == [(1, 100, False)] and got[102] == [(0, 102, True)]
    assert got[103] == [(1, 103, True)] and got[104] == [(1, 103, False)]
    assert sorted(got[7]) == [(0, 7, True), (1, 3, False)] and got[3] == [(1, 3, True)]
    assert sorted(got[None], key=repr) == sorted([(1, 5, False), (0, None, True), (0, None, True)], key=repr)
    assert sorted(got[50]) == [(1, 9, False), (1, 10, False)]


def test_traversal_goes_by_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(12), rng.random(12)
    cells = embeddings.traversal(a, b, 144)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == 144


def test_quality_model(spark):
    rng = random.Random(6)
    words = vocabulary(rng)
    rows, labels = [], []
    for i in range(400):
        good = i % 5 > 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["###", "$$$", "!!"])) for _ in range(80))
        rows.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, int(good)))
    rows += [(400, None, None, None), (401, "", "en", "new")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("evidence", F.lit("x"))
    known = spark.createDataFrame(labels[:200], "doc_id bigint, quality int")
    got = by_id(quality_model.classify(docs, known))
    assert len(got) == 402
    assert np.mean([got[i]["kept"] == bool(q) for i, q in labels[200:]]) > 0.98
    assert quality_model.classify(docs.where("doc_id < 0"), known).count() == 0
    assert all(r["kept"] for r in quality_model.classify(docs, known.where("doc_id < 0")).collect())


def _plain_features(text):
    """The same statistics by counting characters one by one."""
    data = text.encode()
    classes = [b"#*$%&<>@^~_=+{}[]\\", b"!?", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", bytes(range(128, 256))]
    shares = [math.sqrt(sum(c in k for c in data) / max(1, len(data))) for k in classes]
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    return [*shares, min(40, len(data) / n), len(inside) / n, len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), math.log(1 + len(words))]


def _plain_fit(xs, ys):
    """Ridge logistic regression by steepest descent with a shrinking step, on standardised features; the constant is hardly drawn."""
    k = len(xs[0])
    mean = [sum(x[j] for x in xs) / len(xs) for j in range(k)]
    sd = [max(1e-6, math.sqrt(sum((x[j] - mean[j]) ** 2 for x in xs) / len(xs))) for j in range(k)]
    z = np.array([[(x[j] - mean[j]) / sd[j] for j in range(k)] + [1.0] for x in xs])
    y, w = np.array(ys, dtype=float), np.zeros(k + 1)
    penalty = np.array([1.0] * k + [1e-3])
    loss = lambda w: np.sum(np.logaddexp(0, z @ w) - y * (z @ w)) + 0.5 * np.sum(penalty * w * w)
    rate = 1.0
    for _ in range(60_000):
        slope = z.T @ (1 / (1 + np.exp(-(z @ w))) - y) + penalty * w
        if np.abs(slope).max() < 1e-7:
            break
        while loss(w - rate * slope) > loss(w) - 0.3 * rate * slope @ slope and rate > 1e-9:
            rate /= 2
        w = w - rate * slope
        rate *= 1.5
    return lambda x: float(sum((x[j] - mean[j]) / sd[j] * w[j] for j in range(k)) + w[k])


def test_quality_model_equals_an_independent_version(spark):
    """Features, fit, posteriors and verdicts written again from their definitions; nothing of the module is used."""
    rng = random.Random(16)
    words = vocabulary(rng, 120)
    rows, labels = [], []
    for i in range(240):
        host = rng.choice(["good", "good", "good", "bad", "mixed", ""])
        odd = rng.random() < {"good": 0.1, "bad": 0.8, "mixed": 0.5, "": 0.3}[host]
        n = rng.choice([3, 20, 60])
        text = rng.choice([" ", "\n"]).join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) + (rng.choice(["#", "!!", "|", "7"]) if odd and rng.random() < 0.4 else "") for _ in range(n))
        rows.append((i, text + (" again and again" * 5 if rng.random() < 0.1 else ""), rng.choice(["en", "de", None]), host or None))
        if i % 2 == 0:
            labels.append((i, int(not odd if rng.random() < 0.85 else odd)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    got = by_id(quality_model.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")))
    known = dict(labels)
    x = {r[0]: _plain_features(r[1]) for r in rows}
    logit = _plain_fit([x[i] for i in known], [known[i] for i in known])
    ev = {i: 1 / (1 + math.exp(-logit(x[i]))) for i in x}
    site = {r[0]: (r[3] or "", r[2] or "") for r in rows}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, (h, p) in site.items():
        hosts[h].append(ev[i])
        paths[h, p].append(ev[i])
    prior = sum(ev.values()) / len(ev)

    def weight(groups):  # of (values, mean they are drawn to)
        some = [(len(v), sum(v) / len(v) - m, m) for v, m in groups if len(v) > 1]
        n = sum(g[0] for g in some)
        between = max((sum(k * off * off for k, off, _ in some) - sum(m * (1 - m) for *_, m in some)) / n, 1e-9)
        return sum(m * (1 - m) * k for k, _, m in some) / n / between

    hw = weight([(v, prior) for v in hosts.values()])
    mean_of = {h: (hw * prior + sum(v)) / (hw + len(v)) for h, v in hosts.items()}
    pw = weight([(v, mean_of[h]) for (h, _), v in paths.items()])
    odds = lambda p: math.log(p / (1 - p))
    differ = 0
    for i, (h, p) in site.items():
        own_host = (hw * prior + sum(hosts[h]) - ev[i]) / (hw + len(hosts[h]) - 1)
        own_site = (pw * own_host + sum(paths[h, p]) - ev[i]) / (pw + len(paths[h, p]) - 1)
        posterior = 1 / (1 + math.exp(-(logit(x[i]) + odds(own_site) - odds(prior))))
        for name, value in (("evidence", ev[i]), ("host_mean", own_host), ("site", own_site), ("posterior", posterior)):
            assert abs(got[i][name] - value) < 1e-4, (i, name, got[i][name], value)
        if abs(posterior - 0.5) > 1e-4:
            assert got[i]["kept"] == (posterior >= 0.5)
        differ += (posterior >= 0.5) != (ev[i] >= 0.5)
    assert differ > 0  # sites decide some


def test_site_posteriors_shrink(spark):
    rows = [("a", "x", 0.9)] * 500 + [("a", "y", 0.1)] + [("b", "x", 0.3)] * 500
    got = {(r["host"], r["path"]): r for r in quality_model.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert got["a", "x"]["site"] > 0.85 and got["b", "x"]["site"] < 0.35
    assert got["a", "y"]["site"] > 0.3  # one document moves its site little


def test_site_changes_verdicts(spark):
    """The same doubtful texts: kept where their host is good, not where it is bad; alone on a host they stand by themselves."""
    rng = random.Random(8)
    words = vocabulary(rng)
    make = lambda share: " ".join(rng.choice(words) + ("###" if rng.random() < share else "") for _ in range(80))
    rows, labels = [], []
    for i in range(600):
        good = i % 2
        rows.append((i, make(0.0 if good else 0.5), "en", "good" if good else "bad"))
        labels.append((i, good))
    doubtful = [make(0.0) + " " + " ".join(rng.choice(words) + "###" for _ in range(n)) for n in range(2, 40, 2)]
    for k, host in enumerate(["good", "bad", "lone"]):
        rows += [(1000 * (k + 1) + i, t, "en", host if host != "lone" else f"lone{i}") for i, t in enumerate(doubtful)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = by_id(quality_model.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")))
    kept = {h: [got[1000 * (k + 1) + i]["kept"] for i in range(len(doubtful))] for k, h in enumerate(["good", "bad", "lone"])}
    by_evidence = [got[1000 + i]["evidence"] >= 0.5 for i in range(len(doubtful))]
    assert sum(kept["bad"]) <= sum(by_evidence) <= sum(kept["good"]) and sum(kept["bad"]) < sum(kept["good"])
    # Without its own evidence a document that is alone says nothing about its site.
    assert kept["lone"] == by_evidence
    assert all(got[3000 + i]["site"] == pytest.approx(got[3000]["site"]) for i in range(len(doubtful)))


def test_quality_model_of_odd_rows(spark):
    rows = [(1, "good words here " * 30, "en", "s"), (1, "### $$$ " * 40, "en", "s"), (None, None, None, None), (2, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n", F.lit(0)).withColumn("site", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == 4 and all(r["posterior"] is not None and r["kept"] is not None for r in got)


def test_licenses(spark, documents):
    apache = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 100)
    rows = [(0, None), (1, "Some text.\nReleased under the MIT License."), (2, apache.replace("agreed", "aggreed")), (3, "nothing here"), (4, "under the")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(licenses.scan_licenses(frame))
    assert (got[1]["license"], got[1]["dice"], got[2]["license"]) == ("MIT", 1.0, "Apache-2.0")
    assert got[0]["license"] is None and got[3]["license"] is None and got[4]["licenses"] == ""
    everything = frame.unionByName(documents.select("doc_id", "text"))
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(base.execute(licenses.oracle_sql()).fetchall()) == sorted(tuple(got[i]) for i, _ in rows)
    assert licenses.scan_licenses(everything).count() == everything.count()


def _dice_of_all_windows(text):
    """The best coefficient of each licence over every run of words, lines and paragraphs aside."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    best = defaultdict(float)
    for name, template in licenses.TEMPLATES:
        own = set(licenses.template_bigrams(template))
        for i in range(len(grams)):
            seen, shared = set(), 0
            for g in grams[i : i + licenses.longest_window(template)]:
                shared += g in own and g not in seen
                seen.add(g)
                best[name] = max(best[name], 2 * shared / (len(seen) + len(own)))
    return best


def test_best_windows_are_found(spark):
    """Templates with words left out, put in and repeated: the best window of all decides, to the last digit."""
    rng = random.Random(6)
    rows = []
    for name, template in [t for t in licenses.TEMPLATES if 20 <= len(t[1].split()) <= 120]:
        for share in (0.04, 0.08, 0.1, 0.12, 0.15):
            words = []
            for w in template.split():
                x = rng.random()
                words += [] if x < share / 2 else [w, f"extra{rng.randrange(99)}"] if x < share else [w] * rng.choice([1] * 40 + [2])
            rows.append((len(rows), f"before it {' '.join(words)} and behind " + "more words " * rng.randrange(30)))
    got = by_id(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)))
    sure = 0
    for i, text in rows:
        best = _dice_of_all_windows(text)
        top = max(best.values())
        sure += top >= licenses.DICE
        if top >= licenses.DICE:
            assert abs(got[i]["dice"] - round(top, 6)) < 1e-9 and best[got[i]["license"]] == top, (text, top, got[i])
        else:  # lines and paragraphs are windows too
            assert got[i]["license"] is None
    assert len(rows) * 0.4 < sure < len(rows)
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(base.execute(licenses.oracle_sql()).fetchall()) == sorted(tuple(got[i]) for i, _ in rows)


def test_licenses_in_running_text(spark):
    rng = random.Random(3)
    words = vocabulary(rng)
    around = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(0, around(400)), (1, ""), (2, None)]
    for name, template in licenses.TEMPLATES:
        broken = template.split(" ")
        for at in range(7, len(broken), 11):
            broken[at] = "\n * " + broken[at] if at % 2 else "\n\n" + broken[at]
        rows.append((len(rows), f"{around(30)}. {' '.join(broken)} {around(30)}"))
        if len(broken) > 30:
            changed = list(broken)
            for at in rng.sample(range(len(changed)), len(changed) // 25):
                changed[at] = "changed"
            rows.append((len(rows), f"{around(30)} {' '.join(changed)} {around(3000)}"))
    plain = [t for t in rows if "changed" not in (t[1] or "") and t[0] > 2]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows] + [(*rows[3], "x", "y")], "doc_id bigint, text string, license string, m string")
    found = licenses.scan_licenses(frame).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + 1 and [got[i]["license"] for i in range(3)] == [None] * 3
    assert [(got[i]["license"], got[i]["dice"]) for i, _ in plain] == [(name, 1.0) for name, _ in licenses.TEMPLATES]
    for i, text in rows[3:]:
        best = _dice_of_all_windows(text[:4000])
        top = max(best.values())
        assert top >= licenses.DICE and got[i]["dice"] == round(top, 6), (i, top, got[i])
        assert best[got[i]["license"]] == top
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(base.execute(licenses.oracle_sql()).fetchall()) == sorted(tuple(got[i]) for i, _ in rows)
    assert licenses.scan_licenses(empty(spark)).count() == 0
