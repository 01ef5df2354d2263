"""The warehouse source, the message log, stored buckets and tensors."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostloom.operators import tensors as T
from hostloom.sources import buckets as K
from hostloom.sources import warehouse as W
from hostloom.streaming import messagelog as L


# The warehouse


class TellingStore(W.FolderStore):
    """Notes in a folder what its reader is asked for."""

    def read(self, table, block, columns, tests):
        with open(f"{self.folder}/_told_{uuid.uuid4().hex}", "w") as f:
            json.dump([block[1], columns, [[c, t] for c, t, _ in tests]], f)
        yield from super().read(table, block, columns, tests)


@pytest.fixture
def folder(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pa.table({"k": list(range(1000)), "name": [f"n{k % 7}" if k % 5 else None for k in range(1000)], "x": [k / 3 for k in range(1000)], "more": ["y"] * 1000})
    (tmp_path / "t.parquet").mkdir()
    pq.write_table(rows.slice(0, 600), tmp_path / "t.parquet" / "a.parquet", row_group_size=200)
    pq.write_table(rows.slice(600), tmp_path / "t.parquet" / "b.parquet", row_group_size=200)
    return tmp_path


def test_columns_and_filters_reach_the_store(spark, folder):
    rows = W.read(spark, "t", ["k", "name"], folder=str(folder), store="test_sources:TellingStore")
    got = rows.filter("k >= 450 and name = 'n3' and length(name) = 2").collect()
    assert sorted((r.k, r.name) for r in got) == [(k, "n3") for k in range(450, 1000) if k % 7 == 3 and k % 5]
    told = sorted(json.loads(p.read_text()) for p in folder.glob("_told_*"))
    assert len(told) == 3 and all(columns == ["k", "name"] for _, columns, _ in told)  # of five blocks, two are ruled out by their statistics
    assert all({("k", ">="), ("name", "=")} <= {tuple(t) for t in tests} for *_, tests in told)


def test_all_kinds_of_filters(spark, folder):
    whole = spark.read.parquet(str(folder / "t.parquet"))
    rows = W.read(spark, "t", folder=f"file://{folder}")
    assert rows.schema == whole.schema and rows.count() == 1000 and rows.rdd.getNumPartitions() == 5
    for test in ("k = 5", "k < 7", "k <= 7", "k > 990", "x >= 333.0", "k in (1, 500, 2000)", "name is null", "name is not null and k < 40", "name like 'n1%'", "not (k > 3)", "k < 0", "k <=> 8", "k > 10 or name = 'n2'"):
        assert sorted(map(tuple, rows.filter(test).collect()), key=lambda r: r[0]) == sorted(map(tuple, whole.filter(test).collect()), key=lambda r: r[0]), test


def test_credentials_go_down_a_ladder(folder, tmp_path, monkeypatch):
    (folder / "_token").write_text("secret")
    own = {"folder": str(folder), "key_variable": "A_KEY_OF_THE_TEST"}
    with pytest.raises(ConnectionError, match="default: another token"):
        W.connect(own)
    assert not W.test_connection(own)
    monkeypatch.setenv("A_KEY_OF_THE_TEST", "secret")
    assert W.info(own) == {"way": "environment", "tables": ["t"]}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"token": "secret"}')
    bad.write_text('{"token": "no"}')
    assert W.connect(own | {"key_file": str(good)})[1] == "key file" and W.connect(own | {"key_file": str(bad)})[1] == "environment"
    monkeypatch.setenv("A_KEY_OF_THE_TEST", str(good))
    assert W.test_connection(own)


# The log


def numbers(spark, start, end, topic="a"):
    return spark.range(start, end).select(F.lit(topic).alias("topic"), F.col("id").cast("string").alias("key"), F.concat(F.lit("v"), "id").alias("value")).repartition(3)


def test_stop_and_restart_loses_and_repeats_nothing(spark, tmp_path):
    log, checkpoint, seen = str(tmp_path / "log"), str(tmp_path / "ck"), []
    L.publish(numbers(spark, 0, 25), log)
    L.publish(numbers(spark, 100, 105, "b"), log)
    take = lambda batch, number: seen.append((number, sorted(r.value for r in batch.collect())))
    stream = lambda: L.subscribe(spark, log, ["a"], messages=10, starting="earliest")
    assert L.consume(stream(), take, checkpoint, idle=2, most=10) >= 10
    first = len(seen)
    L.publish(numbers(spark, 25, 40), log)
    L.consume(stream(), take, checkpoint, idle=2)
    values = [v for _, vs in seen for v in vs]
    assert sorted(values) == sorted(f"v{k}" for k in range(40)) and max(len(vs) for _, vs in seen) <= 10 and first < len(seen)
    told = L.metrics(log)
    assert (told["messages"], told["commits"]) == (45, 3) and told["behind"]["inventory"] <= 10  # the last batch is acknowledged when another begins
    assert L.consume(L.subscribe(spark, log, group="late"), take, str(tmp_path / "ck2"), idle=1) == 0


def test_a_failing_handler_gets_its_batch_again(spark, tmp_path):
    log, checkpoint, seen = str(tmp_path / "log"), str(tmp_path / "ck"), []
    L.publish(numbers(spark, 0, 9), log)

    def fails(batch, number):
        raise RuntimeError("the handler fails")

    with pytest.raises(Exception, match="the handler fails"):
        L.consume(L.subscribe(spark, log, messages=4, starting="earliest"), fails, checkpoint, idle=3)
    L.consume(L.subscribe(spark, log, messages=4, starting="earliest"), lambda b, n: seen.extend(r.value for r in b.collect()), checkpoint, idle=2)
    assert sorted(seen) == [f"v{k}" for k in range(9)]


def test_a_stream_is_forwarded_once(spark, tmp_path):
    log, other = str(tmp_path / "log"), str(tmp_path / "other")
    L.publish(numbers(spark, 0, 30), log)
    for _ in range(2):
        stream = L.subscribe(spark, log, messages=7, starting="earliest", group="forward")
        query = L.forward(stream, other, str(tmp_path / "ck"), "copier")
        query.processAllAvailable()
        query.stop()
    held = spark.read.format("messagelog").option("path", other).load()
    assert sorted(r.value for r in held.collect()) == sorted(f"v{k}" for k in range(30))
    # a batch that is committed again, as after a driver's loss, changes nothing
    store = L.Log(other)
    store.put("messages", "again.jsonl", b'["a", "1", "twice"]\n')
    store.commit([("again.jsonl", 1)], store.commits()[0][2])
    assert L.metrics(other)["messages"] == 30 and store.get("messages", "again.jsonl") is None


def test_a_failing_write_leaves_no_messages(spark, tmp_path):
    log = str(tmp_path / "log")
    L.publish(numbers(spark, 0, 5), log)
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of it
        L.publish(numbers(spark, 0, 50).withColumn("value", F.when(F.col("key") == "40", F.raise_error(F.lit("no"))).otherwise(F.col("value"))), log)
    assert L.metrics(log) == {"messages": 5, "commits": 1, "behind": {}}
    assert spark.read.format("messagelog").options(path=log, topics="none").load().count() == 0


# Buckets


def test_stored_tables_join_without_an_exchange(spark, tmp_path):
    left = K.buckets(spark, "left_t", f"file://{tmp_path}/left", ["k"], 4).write(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("version")))
    right = K.buckets(spark, "right_t", f"file://{tmp_path}/right", ["k"], 4).write(spark.range(50, 150).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")))
    joined = left.read().join(right.read().hint("merge"), "k")
    assert K.without_exchange(joined) and joined.count() == 50
    assert not K.without_exchange(spark.range(100).withColumnRenamed("id", "k").join(right.read().hint("merge"), "k"))


@pytest.mark.parametrize("cut_off", [False, True])
def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path, cut_off):
    name = f"kept_{int(cut_off)}"
    table = K.buckets(spark, name, f"file://{tmp_path}/t", ["k"], 8).write(spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit("old").alias("x"), F.lit(1).alias("version")))
    before = table.files()
    new = spark.createDataFrame([("3", "new", 2), ("3", "newer", 3), ("brand", "new", 1)], "k string, x string, version int")
    touched = table.upsert(new, exchange=not cut_off)
    assert 1 <= len(touched) <= 2
    if cut_off:  # the driver is lost after the journal was written; another handle ends it
        assert table.files() == before
        table = K.buckets(spark, name, f"file://{tmp_path}/t", ["k"], 8)
    rows = {r.k: r.x for r in table.read().collect()}
    assert rows == {**{str(k): "old" for k in range(200)}, "3": "newer", "brand": "new"}
    after = table.files()
    assert {b: after[b] for b in before if b not in touched} == {b: before[b] for b in before if b not in touched} and all(after[b] != before.get(b) for b in touched)
    assert table.upsert(new.filter("false")) == set() and K.without_exchange(table.read().groupBy("k").count())


# Tensors


def test_tensors_are_filled_and_masked(spark):
    texts = spark.createDataFrame([(1, "b a b, c!"), (2, None), (3, ""), (4, "zz B " * 4)], "id int, text string")
    known = T.vocabulary(texts.filter("id < 4"), 2)
    assert {r.word: r.word_id for r in known.collect()} == {"b": 2, "a": 3}
    rows = {r.id: (r.n, list(r.ids), list(r["mask"])) for r in T.encoded(texts, known, 5).collect()}
    assert rows == {1: (4, [2, 3, 2, 1, 0], [1, 1, 1, 1, 0]), 2: (0, [0] * 5, [0] * 5), 3: (0, [0] * 5, [0] * 5), 4: (8, [1, 2, 1, 2, 1], [1] * 5)}
    got = {r.id: np.array(r.vector) for r in T.embedded(T.encoded(texts, known, 5), T.mean_of_hashes(8)).collect()}
    assert got[1].shape == (8,) and np.allclose(got[2], 0) and not np.allclose(got[1], got[4]) and np.abs(got[1]).max() <= 1
