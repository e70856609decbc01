"""Streams with keyed state against batch plans and plain Python."""

import json
import os
import random
import sys

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from millrace import queries
from millrace.sources import connectors, files, services
from millrace.operators import merging
from millrace.streaming import gate, logs, pages

register_pickle_by_value(sys.modules[__name__])  # workers don't see this module


def words(text, fingerprint):
    if text == "bad":
        return None
    return [{"name": f"{fingerprint}:{w}"} for w in text.split()]


def observations(rng, n, failing=False):
    out = []
    for seq in range(n):
        k = rng.randrange(12)
        text = "bad" if failing and rng.random() < 0.3 else rng.choice(["", "a b", "é", "x " * rng.randint(0, 4)])
        out.append((f"h{k}", seq, f"http://h/{k}", rng.choice(["A", "B", "é"]), rng.choice(["t", "u"]), text, rng.choice(["f1", "f1", "f2"])))
    return out


def plain(rows):
    memo, out = {}, []
    for h, seq, url, city, topic, text, mark in rows:
        status, records = "hit", memo.get(h, (None, None))[1]
        if h not in memo or memo[h][0] != mark:
            found = words(text, mark)
            status, records = ("failed", None) if found is None else ("extracted", json.dumps(found, ensure_ascii=False))
            if found is not None:
                memo[h] = (mark, records)
        out.append((h, seq, url, city, topic, mark, status, records))
    last = {}
    for r in out:
        if r[6] != "failed":
            last[r[3], r[4], r[0]] = r
    return out, sorted(last.values(), key=repr)


def put(folder, number, rows):
    names = [x.split()[0] for x in pages.EVENT.split(", ")]
    path = folder / f"{number}.json"
    path.write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
    os.utime(path, (1_700_000_000 + number,) * 2)


def run(spark, folder):
    source = spark.readStream.schema(pages.EVENT).option("maxFilesPerTrigger", 1).json(f"file://{folder}/in")
    with pages.keyed_state(spark):
        pages.catalogue_sink(pages.memoised(source, words), f"file://{folder}/out", f"file://{folder}/state").awaitTermination()


def state(spark, folder):
    found = pages.catalogue(spark, f"file://{folder}/out").select(*[x.split()[0] for x in pages.EARLY.split(", ")])
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("failing", [False, True])
def test_incremental_pages_equal_the_batch_plan(spark, tmp_path, failing):
    """Five batches in two runs, a hidden restart between them, and the last batch once more."""
    rows = observations(random.Random(failing), 120, failing)
    (tmp_path / "in").mkdir()
    for number in range(3):
        part = rows[number * 24 : number * 24 + 24]
        random.Random(number).shuffle(part)  # rows of a batch come in any order
        put(tmp_path / "in", number, part)
    run(spark, tmp_path)
    assert state(spark, tmp_path) == plain(rows[:72])[1]
    for number in (3, 4):
        put(tmp_path / "in", number, rows[number * 24 : number * 24 + 24])
    run(spark, tmp_path)
    early, want = plain(rows)
    assert state(spark, tmp_path) == want
    names = [x.split()[0] for x in pages.EARLY.split(", ")]
    got = spark.read.parquet(f"file://{tmp_path}/out/early").select(*names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(early, key=repr)
    if not failing:
        batch = pages.recomputed(spark.createDataFrame(rows, pages.EVENT), words)
        assert sorted(map(tuple, batch.collect()), key=repr) == sorted(early, key=repr)
    again = spark.read.schema(pages.EARLY).parquet(f"file://{tmp_path}/out/early/batch=4")
    again = spark.createDataFrame(again.collect(), pages.EARLY)
    pages.merged(again, 4, f"file://{tmp_path}/out")
    assert state(spark, tmp_path) == want
    gone = pages.tidied(spark, f"file://{tmp_path}/out")
    assert state(spark, tmp_path) == want and gone == 5 - len(os.listdir(tmp_path / "out/pages"))


def test_nothing_new_extracts_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("h", 0, "u", "A", "t", "a b", "f"), ("h", 1, "u", "A", "t", "other", "f"), ("h", 2, "u", "B", "t", "other", "f")]
    put(tmp_path / "in", 0, rows[:1])
    run(spark, tmp_path)
    run(spark, tmp_path)  # nothing is there
    put(tmp_path / "in", 1, rows[1:])
    run(spark, tmp_path)
    early = spark.read.parquet(f"file://{tmp_path}/out/early")
    assert sorted((r["seq"], r["status"]) for r in early.collect()) == [(0, "extracted"), (1, "hit"), (2, "hit")]
    assert sorted((r["city"], r["seq"]) for r in pages.catalogue(spark, f"file://{tmp_path}/out").collect()) == [("A", 1), ("B", 2)]
    counts = pages.pair_counts(early.where(F.col("city") == "A")).first()
    assert tuple(counts) == ("A", "t", 1, 1, 0, 4)


def shaky(tmp_path, reader, **options):
    folder = tmp_path / "service"
    folder.mkdir(exist_ok=True)
    given = {"client": "tests.clients:Shaky", "folder": str(folder), "columns": "n bigint, url string", "size": "10", "pause": "0.01", **options}
    return reader.format(services.NAME).options(**given), folder


def test_service_partitions_and_retries(spark, tmp_path):
    reader, folder = shaky(tmp_path, services.registered(spark).read, fails="2", retries="2", partitions="3")
    (folder / "count").write_text("95")
    frame = reader.load()
    assert frame.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, frame.collect())) == [(i, f"u{i}") for i in range(95)]
    assert sorted(p.name for p in folder.glob("tried-*")) == sorted(f"tried-{10 * i}" for i in range(10))


@pytest.mark.parametrize(("kind", "retries", "well"), [("limit", "1", True), ("error", "0", False), ("quota", "9", False)])
def test_service_that_refuses(spark, tmp_path, kind, retries, well):
    reader, folder = shaky(tmp_path, services.registered(spark).read, fails="1", kind=kind, retries=retries, partitions="1")
    (folder / "count").write_text("7")
    if well:
        assert reader.load().count() == 7
    else:
        with pytest.raises(Exception, match="QuotaSpent|OSError"):
            reader.load().collect()
        # A spent quota is not asked again.
        assert os.path.getsize(folder / "tried-0") == 1


def test_service_without_items(spark, tmp_path):
    reader, folder = shaky(tmp_path, services.registered(spark).read)
    (folder / "count").write_text("0")
    assert reader.load().count() == 0


def test_service_as_a_stream_goes_on_where_it_was(spark, tmp_path):
    reader, folder = shaky(tmp_path, services.registered(spark).readStream, fails="1", partitions="2")
    seen = []
    for there in (25, 25, 60):
        (folder / "count").write_text(str(there))
        stream = reader.load().writeStream.format("parquet").option("path", f"file://{tmp_path}/rows").option("checkpointLocation", f"file://{tmp_path}/state")
        stream.trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.schema("n bigint, url string").parquet(f"file://{tmp_path}/rows").count())
    assert seen == [25, 25, 60]
    assert sorted(r["n"] for r in spark.read.parquet(f"file://{tmp_path}/rows").collect()) == list(range(60))


def test_a_recorded_service_reads_what_a_call_asks_for(tmp_path):
    """Row groups in order are reached by their counts, others don't have to be read; those that meet are put in order."""
    numbers = list(range(0, 900, 3))
    table = pa.table({"n": numbers, "s": [f"v{n}" for n in numbers]})
    want = table.to_pylist()
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=100, compression="none", use_dictionary=False)
    client = services.Recorded({"path": f"file://{tmp_path}/a.parquet", "order": "n"})
    assert client.count() == 300 and client.items(95, 205) == want[95:205] and client.items(300, 300) == []
    column = pq.ParquetFile(tmp_path / "a.parquet").metadata.row_group(0).column(0)
    with open(tmp_path / "a.parquet", "r+b") as file:
        file.seek(column.data_page_offset)
        file.write(b"\xff" * column.total_compressed_size)
    assert services.Recorded({"path": f"{tmp_path}/a.parquet", "order": "n"}).items(150, 230) == want[150:230]
    (tmp_path / "b").mkdir()
    for k in range(3):
        pq.write_table(table.take([i for i in reversed(range(300)) if i < 200 and i % 2 == k or i >= 200 and k == 2]), tmp_path / f"b/{k}.parquet")
    mixed = services.Recorded({"path": f"{tmp_path}/b", "order": "n"})
    assert [r for at in range(0, 300, 70) for r in mixed.items(at, min(300, at + 70))] == want


def test_ranges_are_whole_calls():
    for first, last, most, size in [(0, 95, 3, 10), (0, 0, 4, 10), (7, 8, 4, 10), (3, 1003, 7, 100), (0, 5, 9, 1)]:
        found = services.ranges(first, last, most, size)
        covered = [i for r in found for i in range(r.first, r.last)]
        assert covered == list(range(first, last)) and len(found) <= most
        assert all((r.first - first) % size == 0 for r in found)


def answering(folder):
    """Limits by the values: `limit` asks for a pause the first time that it is called, as a folder remembers."""

    def client():
        def call(value):
            if value == "quota":
                raise connectors.QuotaSpent
            if value == "bad":
                raise OSError
            if value.startswith("limit") and not os.path.exists(f"{folder}/{value}"):
                open(f"{folder}/{value}", "w").close()
                raise connectors.RateLimited(30)
            return value.upper() if value != "none" else None

        return call

    return client


def answered(rows, gap, folder):
    """The same in one loop for each service."""
    out = []
    for service in sorted({r[0] for r in rows}):
        call, start_at, open_at, spent, calls = answering(folder)(), 0, 0, False, 0
        for _, ident, value, at in sorted((r for r in rows if r[0] == service), key=lambda r: (r[3], str(r[1]))):
            while True:
                start = max(at, start_at, open_at)
                reply, status = None, "quota"
                if not spent:
                    calls, start_at = calls + 1, start + gap
                    try:
                        reply = call(value)
                        status = "ok" if reply else "empty"
                    except connectors.QuotaSpent:
                        spent = True
                    except connectors.RateLimited as limit:
                        open_at = start + int(limit.seconds * 1000)
                        continue
                    except OSError:
                        status = "failed"
                break
            out.append((service, str(ident), value, calls, start, reply, status))
    return sorted(map(repr, out))


def test_a_gate_for_a_whole_service(spark, tmp_path):
    """Requests of three batches in several files: one pace, a pause that a timer ends, a quota that stops for good."""
    rng = random.Random(4)
    begin = 1_700_000_000_000
    rows = []
    for i in range(60):
        service = rng.choice(["a", "b", "c"])
        value = rng.choice(["x", "y", "none", "bad", f"limit{i}" if service != "c" else "z"])
        rows.append((service, i, "quota" if service == "b" and i > 40 else value, begin + i * 4000))
    for name in ("in", "one", "two"):
        (tmp_path / name).mkdir()
    source = spark.readStream.schema("service string, id int, value string, at timestamp").option("maxFilesPerTrigger", 1)
    for number in range(3):
        part = rows[number * 20 : number * 20 + 20]
        frame = spark.createDataFrame(part, "service string, id int, value string, ms bigint").selectExpr("service", "id", "value", "timestamp_millis(ms) AS at")
        frame.coalesce(1).write.parquet(f"file://{tmp_path}/in/{number}")
        if number == 2:  # the time that passes afterwards
            late = spark.createDataFrame([("clock", 999, "x", begin + 10_000_000)], "service string, id int, value string, ms bigint")
            late.selectExpr("service", "id", "value", "timestamp_millis(ms) AS at").coalesce(1).write.parquet(f"file://{tmp_path}/in/3")
        with pages.keyed_state(spark):
            found = gate.through_gate(source.parquet(f"file://{tmp_path}/in/*"), answering(str(tmp_path / "one")), 5000)
            run = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state")
            run.trigger(availableNow=True).start().awaitTermination()
        got = [r for r in spark.read.schema(gate.ANSWER).parquet(f"file://{tmp_path}/out").collect() if r["service"] != "clock"]
        if number == 0:
            assert len(got) < 20  # some wait
    want = answered(rows, 5000, tmp_path / "two")
    assert sorted(map(repr, map(tuple, got))) == want
    starts = sorted(r["started_ms"] for r in got if r["service"] == "a")
    assert all(b - a >= 5000 for a, b in zip(starts, starts[1:]))
    assert {r["status"] for r in got if r["service"] == "b" and int(r["id"]) > 41} == {"quota"}
    assert {r["status"] for r in got} == {"ok", "empty", "failed", "quota"}


class Store:
    """State in memory that counts how often it is asked."""

    def __init__(self):
        self.rows, self.asked, self.timers = {}, 0, []

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def getValue(self, key):
        self.asked += 1
        return self.rows[key]

    def updateValue(self, key, row):
        self.asked += 1
        self.rows[key] = row

    def removeKey(self, key):
        self.asked += 1
        del self.rows[key]

    def exists(self):
        return "own" in self.rows

    def get(self):
        return self.rows.get("own")

    def update(self, row):
        self.rows["own"] = row


class Time:
    def __init__(self, at):
        self.at = at

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at


class Memos(Store):
    def exists(self):
        self.asked += 1
        return bool(self.rows)

    def getValue(self, key):
        self.asked += 1
        return self.rows.get(key)


def test_pages_of_a_group_share_calls_and_frames():
    """Three batches of a group of 50 pages: one question whether anything is known, then a look-up of each page, and a write only where it gave something new."""
    memos, names = Memos(), [x.split()[0] for x in pages.EVENT.split(", ")]
    processor = pages.PageMemo(words)
    processor.init(memos)
    rows, asked = [], []
    for batch, mark in enumerate(["f1", "f1", "f2"]):
        part = [(f"h{i % 50}", 100 * batch + i, "u", "A", "t", f"a{batch}", mark) for i in range(100)]
        frames = [pd.DataFrame(x, columns=names) for x in (part[40:], part[:40])]
        before = memos.asked
        (got,) = processor.handleInputRows((7,), iter(frames), None)
        rows += map(tuple, got.itertuples(index=False))
        asked.append(memos.asked - before)
    want = plain([(f"h{i % 50}", 100 * b + i, "u", "A", "t", f"a{b}", m) for b, m in enumerate(["f1", "f1", "f2"]) for i in range(100)])[0]
    assert rows == want
    assert asked == [1 + 50, 1 + 50, 1 + 50 + 50]


@pytest.mark.parametrize("groups", [1, 3])
def test_pages_that_share_a_group_keep_their_own_memos(spark, tmp_path, groups):
    """Failures, a page without a hash, and a restart after each batch."""
    (tmp_path / "in").mkdir()
    rows = [(None if r[0] == "h3" else r[0], *r[1:]) for r in observations(random.Random(5), 90, True)]
    for number in range(3):
        put(tmp_path / "in", number, rows[number * 30 : number * 30 + 30])
        source = spark.readStream.schema(pages.EVENT).json(f"file://{tmp_path}/in")
        with pages.keyed_state(spark):
            run = pages.memoised(source, words, groups=groups).writeStream.format("parquet").option("path", f"file://{tmp_path}/out")
            run.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(pages.EARLY).parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows)[0], key=repr)


def test_a_round_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """A table in four files reaches the stream in four, and the catalogue is that of the batch plan."""
    part = [(i, f"http://c{i % 3}.x/t{i % 2}/{i}", f"<h1>{i}</h1>" if i % 4 else "none") for i in range(40)]
    spark.createDataFrame(part, "page_id bigint, url string, html string").repartition(4).write.parquet(f"file://{tmp_path}/pages.parquet")
    size = spark.conf.get("spark.sql.files.openCostInBytes")
    monkeypatch.setattr(queries, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    spark.conf.set("spark.sql.files.openCostInBytes", "512m")  # a task for each file
    try:
        found = queries.QUERIES["incremental_catalogue"](spark, f"file://{tmp_path}")
        early = pages.recomputed(queries._observed(queries.Tables(spark, f"file://{tmp_path}")), queries._titles)
        last = early.groupBy("city", "topic", "url_hash").agg(F.max_by(F.coalesce(F.get_json_object("records", "$[0].name"), F.lit("")), "seq").alias("name"))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, last.collect()))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", size)
    for number in range(3):
        assert (tmp_path / f"shared/state/sources/0/{number}").read_text().count('"path"') == 4
    assert not list((tmp_path / "shared").glob("in/*/part-*"))  # a round's files go once its run is over


def test_a_gate_asks_its_state_by_entries_not_by_requests(tmp_path):
    """Half of a batch waits for a timer; a quota is spent then, and what comes afterwards doesn't reach the state at all."""
    store = Store()
    processor = gate.Gate(answering(str(tmp_path)), 20, False)
    processor.init(store)
    rows = [("s", f"{i:05}", "quota" if i == 4000 else "none" if i % 3 else "x", 10 * i) for i in range(9000)]
    frame = lambda part: pd.DataFrame(part, columns=["service", "id", "value", "at_ms"])
    got = list(processor.handleInputRows(("s",), iter([frame(rows[3000:5000]), frame(rows[:3000])]), Time(0)))
    assert 2000 < sum(map(len, got)) < 3000 and store.timers
    got += processor.handleExpiredTimer(("s",), Time(70_000), Time(store.timers[-1]))
    assert sum(map(len, got)) == 3501  # the first of the others wait in the midst of an entry
    got += processor.handleExpiredTimer(("s",), Time(100_000), Time(store.timers[-1]))
    got += processor.handleInputRows(("s",), iter([frame(rows[7000:]), frame(rows[5000:7000])]), Time(0))
    found = [tuple(None if x is None or x != x else x for x in r) for part in got for r in part.itertuples(index=False)]
    assert sorted(map(repr, found)) == answered(rows, 20, tmp_path)
    assert store.asked <= 12


def test_a_queue_in_state_equals_a_replay(spark, tmp_path):
    rng = random.Random(7)
    changes = []
    for i in range(40):
        at = rng.randrange(1000)
        for k, status in enumerate(["pending", "running", rng.choice(["done", "error", "running"])][: rng.randint(1, 3)]):
            changes.append((rng.choice("qr") if k < 0 else "q" if i % 3 else "r", f"i{i}", "scrape", f"u{i}", status, at + 10 * k, "e" if status == "error" else None, at + 10 * k))
    changes.sort(key=lambda c: c[5])
    names = "queue string, id string, op string, url string, status string, at bigint, error string, seq bigint"
    seen = []
    for number in range(4):
        part = changes[number * len(changes) // 4 : (number + 1) * len(changes) // 4]
        spark.createDataFrame(part, names).coalesce(1).write.parquet(f"file://{tmp_path}/in/{number}")
        source = spark.readStream.schema(names).parquet(f"file://{tmp_path}/in/*")
        with pages.keyed_state(spark):
            keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={n}")
            run = logs.queue_held(source, 5).writeStream.outputMode("update").foreachBatch(keep)
            run.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        seen += part
        out = spark.read.parquet(f"file://{tmp_path}/out")
        for queue in "qr":
            so_far = spark.createDataFrame([c[1:] for c in seen if c[0] == queue], names.split(", ", 1)[1])
            want = logs.held(logs.queue_state(so_far), 5).select("id", "op", "url", "status", "at", "error")
            own = out.where(F.col("queue") == queue)
            last = own.agg(F.max("batch")).first()[0]
            got = own.where(F.col("batch") == last).select("id", "op", "url", "status", "at", "error")
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_snapshots_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    schema = "k int, a string, b double"
    one = spark.createDataFrame([(1, "x", None), (2, None, 0.5), (3, "z", 1.0)], schema)
    two = spark.createDataFrame([(1, "x", 2.0), (2, "", 0.5), (4, None, None)], schema)
    first, written = merging.snapshot(one, path)
    assert written and merging.snapshot(one.orderBy(F.desc("k")).repartition(3), path) == (first, False)
    files_before = sorted(str(p) for p in (tmp_path / "s").rglob("*"))
    merging.snapshot(one, path)
    assert sorted(str(p) for p in (tmp_path / "s").rglob("*")) == files_before
    second, written = merging.snapshot(two, path)
    assert written and second != first
    assert merging.snapshot(one, path) == (first, True)  # back again: an entry, no new content
    assert [n for n, _ in merging.snapshots(spark, path)] == [1, 2, 3] and len(list((tmp_path / "s").glob("content=*"))) == 2
    got = {r["k"]: (r["change"], [tuple(f) for f in r["fields"]]) for r in merging.between(spark, path, ["k"], 1, 2).collect()}
    assert got == {
        1: ("changed", [("b", None, "2.0")]), 2: ("changed", [("a", None, "")]), 3: ("removed", [("a", "z", None), ("b", "1.0", None)]), 4: ("added", []),
    }
    assert merging.between(spark, path, ["k"], 1, 3).count() == 0
    assert merging.content(one) != merging.content(one.unionByName(one)) and merging.content(one) != merging.content(one.withColumn("b", F.col("b").cast("float")))


def test_a_database_is_read_in_parts(spark, tmp_path):
    """The database that ships with Spark: ranges of a key, filters and columns left to it."""
    url = f"jdbc:derby:{tmp_path}/base;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1000).selectExpr("cast(id AS int) AS K", "concat('v', id % 7) AS V", "id * 2 AS W")
    rows.write.format("jdbc").options(url=url, dbtable="T", driver=driver, createTableColumnTypes="V VARCHAR(20)").save()
    found = files.legacy_table(spark, url, "T", by="K", partitions=5, driver=driver)
    assert found.rdd.getNumPartitions() == 5 and found.count() == 1000
    some = found.where("K >= 990 AND V = 'v3'").select("K")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(K,990)" in plan and "EqualTo(V,v3)" in plan and "ReadSchema: struct<K:int>" in plan
    assert sorted(r["K"] for r in some.collect()) == [k for k in range(990, 1000) if k % 7 == 3]
    parts = files.legacy_table(spark, url, "T", parts=["K < 100", "K >= 100 AND K < 900", "K >= 900"], driver=driver)
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == 1000
    spark.createDataFrame([], "K int").write.format("jdbc").options(url=url, dbtable="E", driver=driver).save()
    assert files.legacy_table(spark, url, "E", by="K", driver=driver).count() == 0
    assert files.legacy_table(spark, url, "T", driver=driver).rdd.getNumPartitions() == 1
