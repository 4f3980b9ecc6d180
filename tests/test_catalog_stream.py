import json

import pytest
from pyspark.sql import functions as F

from keystrata.operators import inverted, kv
from keystrata.plans import importer
from keystrata.plans.catalog import Catalog, CatalogError, kept_builds, new_build_id
from keystrata.plans.metrics import Registry
from keystrata.plans.settings import StreamSource
from keystrata.sources import files, generators
from keystrata.sources.schema import Field, TableSchema, parse_schema
from keystrata.streaming import ingest

SESSION = parse_schema('{"name": "s", "pk": "sid", "fields": [{"name": "sid", "type": "string", "field_id": 1}, {"name": "epoch", "type": "int64", "field_id": 2}]}')
USER = parse_schema('{"name": "u", "pk": "user_id", "fields": [{"name": "user_id", "type": "int64", "field_id": 1}, {"name": "age", "type": "int32", "field_id": 2}, {"name": "clicks", "type": "int64", "is_array": true, "field_id": 3}]}')


def test_create_open_and_errors(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "db"), buckets=4)
    c.create("s", SESSION)
    for bad in ("", "a/b", "a\\b", ".x"):
        with pytest.raises(CatalogError):
            c.create(bad, SESSION)
    with pytest.raises(CatalogError, match="exists"):
        c.create("s", SESSION)
    with pytest.raises(CatalogError, match="unknown"):
        c.open("nope")
    with pytest.raises(CatalogError, match="not inverted"):
        c.open("s", "inverted")
    (tmp_path / "db" / "x~reload").mkdir()
    assert c.tables() == ["s"]
    with pytest.raises(CatalogError):
        c.open("s").acquire()
    with pytest.raises(CatalogError):
        Catalog(spark, "")


def test_commit_swap_and_pinned_reads(spark, tmp_path):
    t = Catalog(spark, str(tmp_path), buckets=4).create("s", SESSION)
    t.commit(spark.createDataFrame([("a", 1), ("b", 2)], SESSION.struct_type()), build_id="1")
    held = t.acquire()
    t.upsert(spark.createDataFrame([("a", 9), ("c", 3)], SESSION.struct_type()))
    assert held.get("a").row.epoch == 1
    now = t.acquire()
    assert now.get("a").row.epoch == 9 and now.meta["record_count"] == 3
    t.delete(spark.createDataFrame([("b",)], "key string"))
    assert not t.acquire().get("b").found
    assert t.acquire().get("").error
    assert spark.sql(f"SELECT sum(epoch) FROM {t.view()}").first()[0] == 12
    with pytest.raises(kv.RejectedBatch):
        t.put_batch(spark.createDataFrame([(None, 1)], SESSION.struct_type()))
    assert len(t.versions()) == 3
    t.switch("1")
    assert t.acquire().get("b").found
    gone = t.prune(1)
    assert t.versions() == ["1"] and len(gone) == 2


def test_lookup_reads_one_bucket(spark, tmp_path):
    t = Catalog(spark, str(tmp_path), buckets=8).create("u", USER)
    t.commit(spark.range(500).select(F.col("id").alias("user_id"), F.lit(1).alias("age"), F.array("id").alias("clicks")))
    s = t.acquire()
    plan = kv.where_key(s.rows, USER, 77, s.buckets)._jdf.queryExecution().toString()
    assert "EqualTo(user_id,77)" in plan and "PartitionFilters: [isnotnull(__pk_bucket" in plan
    assert s.get(77).row.clicks == [77]


def test_second_writer_fails(spark, tmp_path):
    t = Catalog(spark, str(tmp_path)).create("s", SESSION)
    with t.lock(), pytest.raises(CatalogError, match="locked"):
        t.commit(spark.createDataFrame([("a", 1)], SESSION.struct_type()))
    t.commit(spark.createDataFrame([("a", 1)], SESSION.struct_type()))


def test_rename_and_added_field(spark, tmp_path):
    t = Catalog(spark, str(tmp_path)).create("s", SESSION)
    t.commit(spark.createDataFrame([("a", 1)], SESSION.struct_type()))
    t.evolve(TableSchema("s", "sid", (SESSION.fields[0], Field("at", "int64", 2), Field("note", "string", 3))))
    assert t.acquire().get("a").row.asDict() == {"sid": "a", "at": 1, "note": ""}


def test_inverted_tables_keep_postings(spark, tmp_path):
    schema = parse_schema('{"name": "d", "pk": "id", "fields": [{"name": "id", "type": "int64", "field_id": 1}, {"name": "bio", "type": "string", "field_id": 2, "is_index": true}]}')
    t = Catalog(spark, str(tmp_path)).create("d", schema, "inverted")
    t.commit(spark.createDataFrame([(1, "rock music"), (2, "jazz")], schema.struct_type()))
    t.upsert(spark.createDataFrame([(2, "rock")], schema.struct_type()))
    assert sorted(r.key for r in inverted.query(t.acquire().postings, 2, "rock").collect()) == [1, 2]


def test_publish_deploy_prune(spark, tmp_path):
    build, serve = Catalog(spark, str(tmp_path / "b")), Catalog(spark, str(tmp_path / "s"))
    store = str(tmp_path / "store")
    for i in range(3):
        build.build("s", SESSION, spark.createDataFrame([("a", i)], SESSION.struct_type()))
        build.publish("s", store, f"v{i}")
    assert serve.deploy("s", store, "v0") == "v0"
    assert serve.deploy("s", store) == "v2"
    assert serve.open("s").acquire().get("a").row.epoch == 2
    assert serve.open("s").versions() == ["v0", "v2"]
    assert serve.deploy("s", store, "v1", keep=1) == "v1" and serve.open("s").versions() == ["v1"]
    with pytest.raises(CatalogError):
        serve.deploy("s", store, "v9")
    assert serve.command("reload s") == "ok" and serve.command("reload x").startswith("err") and serve.command("stop").startswith("err")


def test_build_ids_and_retention():
    taken = {"20240101000000", "20240101000000-1"}
    import time

    now = time.mktime((2024, 1, 1, 0, 0, 0, 0, 0, -1))
    assert new_build_id(taken.__contains__, now) == "20240101000000-2"
    assert kept_builds(["1", "2", "3"], 2, "1") == {"1", "3"}
    assert kept_builds(["1", "2"], 0, "2") == {"1", "2"}


def test_import_parquet_and_csv(spark, tmp_path):
    schema = TableSchema("p", "id", (Field("id", "int64", 1), Field("title", "string", 2)))
    a = spark.createDataFrame([(1, "old", 0), (2, "two", 0), (None, "x", 0)], "id long, title string, extra int")
    a.coalesce(1).write.parquet(str(tmp_path / "in" / "a.parquet"))
    (tmp_path / "in" / "b.csv").write_text("extra,title,id\n9,new,1\n9,three,3\n")
    t = Catalog(spark, str(tmp_path / "db")).create("p", schema)
    result = importer.run(t, [str(tmp_path / "in") + "/"])
    assert (result.files, result.rows, result.skipped_pk_null) == (2, 4, 1)
    assert {r.id: r.title for r in t.acquire().rows.collect()} == {1: "new", 2: "two", 3: "three"}
    assert json.loads(result.to_json())["rows"] == 4
    assert files.estimate_rows(spark, files.expand(spark, [str(tmp_path / "in") + "/"])) == 5


def test_input_errors(spark, tmp_path):
    (tmp_path / "e").mkdir()
    with pytest.raises(files.InputError, match="no .parquet"):
        files.expand(spark, [str(tmp_path / "e") + "/"])
    with pytest.raises(files.InputError):
        files.expand(spark, ["x.json"])
    spark.range(3).write.parquet(str(tmp_path / "r.parquet"))
    with pytest.raises(files.InputError, match="missing column: sid"):
        files.read(spark, [str(tmp_path / "r.parquet")], SESSION)
    (tmp_path / "bad.csv").write_text("sid,epoch\na,x\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read(spark, [str(tmp_path / "bad.csv")], SESSION).collect()
    (tmp_path / "list").write_text("a.parquet  \n\n b.csv\n")
    assert files.read_list(str(tmp_path / "list")) == ["a.parquet", " b.csv"]
    with pytest.raises(files.InputError, match="array field"):
        files.read_csv(spark, str(tmp_path / "bad.csv"), USER)


def test_key_lists(spark, tmp_path):
    (tmp_path / "k").write_text("a\n\n oss://x/y \nb\n")
    assert [r.key for r in files.read_keys(spark, str(tmp_path / "k")).collect()] == ["a", "b"]
    t = spark.createDataFrame([("a",), (None,), ("",), ("b",)], "sid string")
    assert files.keys_of(t, "sid", 10).count() == 2


def test_product_import(spark, tmp_path):
    generators.products(spark, 1000).write.parquet(str(tmp_path / "p.parquet"))
    t = Catalog(spark, str(tmp_path / "db")).create("product", generators.PRODUCT)
    importer.run(t, [str(tmp_path / "p.parquet")])
    assert t.acquire().get(1).row.asDict() == {"id": 1, "brand_id": 1, "click_num": 0, "title": "pd00000a0", "category_ids": "1"}


def test_stream_batches_and_replays(spark, tmp_path):
    t = Catalog(spark, str(tmp_path / "db")).create("u", USER)
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda o, d: json.dumps({"offset": o, "value": json.dumps(d)}) + "\n"
    (folder / "0.json").write_text(line(0, {"user_id": 1, "clicks": [1]}) + line(1, {"user_id": 2, "age": 5}) + line(2, {"user_id": 3, "age": "x"}))
    metrics = Registry()
    source = StreamSource("topic", 0, "broker:1")
    query = ingest.run(t, ingest.file_messages(spark, str(folder)), str(tmp_path / "cp"), metrics=metrics)
    query.awaitTermination()
    (folder / "1.json").write_text(line(3, {"user_id": 1, "clicks": [2], "age": 7}) + line(4, {"_op": "delete", "user_id": 2}))
    meta = ingest.catch_up(t, ingest.file_messages(spark, str(folder)), str(tmp_path / "cp"), source, 1_700_000_000, 5)
    rows = {r.user_id: (r.age, r.clicks) for r in t.acquire().rows.collect()}
    assert rows == {1: (7, [1, 2])}
    assert meta["last_committed_offset"] == 4 and t.files.read(f"{t.root}/kafka.offset") == "4"
    assert json.loads(t.files.read(f"{t.root}/kafka_meta.json"))["rewind_minutes"] == 5
    again = spark.createDataFrame([(3, json.dumps({"user_id": 1, "clicks": [2]}))], "offset long, value string")
    assert ingest.apply_batch(t, again, batch=1) is None
    assert t.acquire().get(1).row.clicks == [1, 2]
    assert 'keystrata_kafka_parse_errors_total{table="u"} 1' in metrics.render()


def test_offsets_and_seek():
    assert [ingest.seek_ms(*x) for x in ((1_700_000_000, 0), (1_700_000_000, 5), (60, 2), (120, 2), (121, 2))] == [1_700_000_000_000, 1_699_999_700_000, 0, 0, 1000]
    assert [ingest.resume_offset(x) for x in (0, 99, -1, None)] == [1, 100, None, None]
    o = ingest.kafka_options(StreamSource("t", 2, "b:9"), start_ms=5)
    assert o["startingOffsetsByTimestamp"] == '{"t": {"2": 5}}' and o["startingOffsetsByTimestampStrategy"] == "latest"
    assert ingest.kafka_options(StreamSource("t", 2, "b:9"), saved=7)["startingOffsets"] == '{"t": {"2": 8}}'
    assert ingest.kafka_options(StreamSource("t", 2, "b:9"))["startingOffsets"] == "earliest"


def test_a_replayed_batch_is_recognised_after_other_commits(spark, tmp_path):
    t = Catalog(spark, str(tmp_path / "db")).create("u", USER)
    clicks = lambda o, i: spark.createDataFrame([(o, json.dumps({"user_id": 1, "clicks": [i]}))], "offset long, value string")
    assert ingest.apply_batch(t, clicks(0, 1), 0, run="cp")
    t.upsert(spark.createDataFrame([(2, 5, [])], USER.struct_type()))
    t.delete(spark.createDataFrame([(9,)], "key long"))
    assert ingest.apply_batch(t, clicks(0, 1), 0, run="cp") is None
    assert t.acquire().get(1).row.clicks == [1]
    assert ingest.apply_batch(t, clicks(1, 2)) and ingest.apply_batch(t, clicks(0, 1), 0, run="cp") is None
    assert ingest.apply_batch(t, clicks(2, 3), 0, run="another stream")
    assert t.acquire().get(1).row.clicks == [1, 2, 3] and t.acquire().meta["stream"] == {"offset": 2, "batch": 0, "run": "another stream"}


def test_no_commit_is_lost(spark, tmp_path):
    t = Catalog(spark, str(tmp_path)).create("s", SESSION)
    t.commit(spark.createDataFrame([("a", 1)], SESSION.struct_type()))
    other = Catalog(spark, str(tmp_path)).open("s")
    row = lambda k, v: spark.createDataFrame([(k, v)], SESSION.struct_type())

    def slow(base):
        with pytest.raises(CatalogError, match="locked"):
            other.upsert(row("b", 2))
        return kv.upsert(base, row("c", 3), SESSION)

    t.change(slow)
    other.upsert(row("b", 2))
    assert {r.sid for r in t.acquire().rows.collect()} == {"a", "b", "c"}


def test_a_lock_whose_writer_ended_is_taken_over(spark, tmp_path):
    import os
    import socket
    import subprocess
    import time

    t = Catalog(spark, str(tmp_path)).create("s", SESSION)
    rows = spark.createDataFrame([("a", 1)], SESSION.struct_type())
    gone = subprocess.Popen(["true"])
    gone.wait()
    lock = tmp_path / "s" / ".lock"
    for holder in ({"host": socket.gethostname(), "pid": gone.pid, "token": "x", "renewed": time.time()}, {"host": "elsewhere", "pid": 1, "token": "y", "renewed": time.time() - 10_000}):
        t.files.replace(str(lock), json.dumps(holder))
        t.commit(rows)
        assert not lock.exists()
    t.files.replace(str(lock), json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "token": "z", "renewed": time.time()}))
    with pytest.raises(CatalogError, match="locked"):
        t.commit(rows)
    t.files.delete(str(lock))
    with pytest.raises(CatalogError, match="lost"), t.lock() as held:
        t.files.replace(str(lock), json.dumps({"token": "thief"}))
        held()


def test_the_last_row_follows_the_order_of_the_inputs(spark, tmp_path):
    for name, value in (("a", 1), ("b", 2)):
        spark.createDataFrame([("k", value), (name, value)], SESSION.struct_type()).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "c d.csv").write_text("sid,epoch\nk,3\n")
    t = Catalog(spark, str(tmp_path / "db")).create("s", SESSION)
    at = lambda *names: [str(tmp_path / n) for n in names]
    for inputs, want in ((at("a.parquet", "b.parquet"), 2), (at("b.parquet", "a.parquet"), 1), (at("c d.csv", "b.parquet"), 2), (at("b.parquet", "c d.csv", "a.parquet"), 1), (at("b.parquet", "c d.csv"), 3)):
        importer.run(t, inputs)
        assert t.acquire().get("k").row.epoch == want
    (tmp_path / "list").write_text("a.parquet  \n\n b.csv\n")
    assert files.read_list(str(tmp_path / "list"), spark) == ["a.parquet", " b.csv"]


def test_repeated_keys_without_an_order(spark, tmp_path):
    t = Catalog(spark, str(tmp_path)).create("s", SESSION)
    rows = spark.createDataFrame([("a", 1), ("b", 5), ("a", 2)], SESSION.struct_type())
    t.upsert(rows)
    assert {(r.sid, r.epoch) for r in t.acquire().rows.collect()} == {("a", 2), ("b", 5)}
    t.put_batch(spark.createDataFrame([("a", 7), ("a", 8)], SESSION.struct_type()))
    assert t.acquire().get("a").row.epoch == 8 and t.acquire().meta["record_count"] == 2


def test_rebuilding_keeps_the_live_table_until_the_end(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.build("s", SESSION, spark.createDataFrame([("a", 1)], SESSION.struct_type()))
    with pytest.raises(Exception):  # noqa: B017
        c.build("s", SESSION, spark.createDataFrame([("a", 2)], SESSION.struct_type()).withColumn("epoch", F.raise_error(F.lit("no")).cast("long")))
    assert c.open("s").acquire().get("a").row.epoch == 1 and c.tables() == ["s"]
    c.build("s", SESSION, spark.createDataFrame([("a", 3)], SESSION.struct_type()))
    assert c.open("s").acquire().get("a").row.epoch == 3


def test_commits_of_some_keys_write_their_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("keystrata.plans.catalog.MOST_PARTS", 4)
    schema = parse_schema('{"name": "d", "pk": "id", "fields": [{"name": "id", "type": "int64", "field_id": 1}, {"name": "bio", "type": "string", "field_id": 2, "is_index": true}]}')
    t = Catalog(spark, str(tmp_path / "db"), buckets=8).create("d", schema, "inverted")
    want = {i: f"old t{i % 7}" for i in range(400)}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), schema.struct_type())
    first = t.commit(frame(want))
    for i in range(12):
        fresh = {i: f"new t{i}", 1000 + i: "more"}
        build = t.upsert(frame(fresh))
        want |= fresh
        if i % 3 == 2:
            build = t.delete(spark.createDataFrame([(i,), (5000,)], "key long"))
            del want[i]
        meta = t.acquire().meta
        if "parts" in meta:
            assert sum(map(len, meta["parts"].values())) == 8 and len(meta["parts"]) <= 5
            assert {int(p.name.split("=")[1]) for p in (tmp_path / "db" / "d" / build / "data").glob("__pk_bucket=*")} <= set(meta["parts"][build])
    assert any("parts" in t._meta(v) for v in t.versions()) and any("parts" not in t._meta(v) for v in t.versions() if v != first)
    held = t.acquire()
    assert {r.id: r.bio for r in held.rows.collect()} == want and held.meta["record_count"] == len(want)
    assert sorted(r.key for r in inverted.query(held.postings, 2, "new").collect()) == sorted(k for k, v in want.items() if v.startswith("new"))
    t.prune(1)
    assert {r.id: r.bio for r in t.acquire().rows.collect()} == want and set(t.acquire().meta.get("parts", [])) <= set(t.versions())
    t.catalog.publish("d", str(tmp_path / "store"), "r1")
    serve = Catalog(spark, str(tmp_path / "s"), buckets=8)
    serve.deploy("d", str(tmp_path / "store"))
    assert {r.id: r.bio for r in serve.open("d").acquire().rows.collect()} == want and "parts" not in serve.open("d").acquire().meta
    plan = kv.where_key(held.rows, schema, 3, held.buckets)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and held.get(0).row.bio == "new t0"


def test_a_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    """Buckets, fold and metrics read the operations that were parsed, not the messages again; nothing stays cached."""
    table, cached = Catalog(spark, str(tmp_path / "c")).create("user", USER), spark.sparkContext._jsc.getPersistentRDDs().size()
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    parse = ingest.cdc.parse
    monkeypatch.setattr(ingest.cdc, "parse", lambda m, s: parse(m.mapInArrow(count, m.schema), s))
    frame = spark.range(40).select(F.col("id").alias("offset"), F.when(F.col("id") == 39, "{oops").otherwise(F.format_string('{"%s": %d}', F.lit(USER.key), F.col("id"))).alias("value"))
    metrics = Registry()
    for batch in (0, 1):
        ingest.apply_batch(table, frame, batch, metrics)
    assert read.value == 80 and table.acquire().rows.count() == 39
    assert metrics["kafka_parse_errors_total"].values["user",] == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
