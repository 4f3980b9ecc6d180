import pytest
from pyspark.sql import functions as F

from keystrata.operators import kv
from keystrata.sources.schema import parse_schema

USER = parse_schema('{"pk": "user_id", "fields": [{"name": "user_id", "type": "int64", "field_id": 1}, {"name": "age", "type": "int32", "field_id": 2}, {"name": "name", "type": "string", "field_id": 3}, {"name": "clk", "type": "int64", "is_array": true, "field_id": 4}]}')
SESSION = parse_schema('{"pk": "sid", "fields": [{"name": "sid", "type": "string", "field_id": 1}, {"name": "epoch", "type": "int64", "field_id": 2}]}')
DDL = "user_id long, age int, name string, clk array<long>"


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, 25, "Alice", [1, 2]), (2, None, None, None), (3, 30, "Bob", [])], DDL)


def test_get_hit_miss_and_error(users):
    assert kv.lookup(users, USER, 1).row.asDict() == {"user_id": 1, "age": 25, "name": "Alice", "clk": [1, 2]}
    assert kv.lookup(users, USER, 2).row.asDict() == {"user_id": 2, "age": 0, "name": "", "clk": []}
    miss = kv.lookup(users, USER, 9)
    assert (miss.found, miss.error, miss.row) == (False, "", None)
    assert kv.lookup(users, USER, "").error == "missing primary key"
    assert not kv.lookup(users, USER, "01").found


def test_filter_reaches_the_scan(spark, users, tmp_path):
    users.write.parquet(str(tmp_path / "u"))
    plan = kv.get(spark.read.parquet(str(tmp_path / "u")), USER, 1)._jdf.queryExecution().toString()
    assert "EqualTo(user_id,1)" in plan


def test_batch_get(users):
    keys = kv.keys_frame(users, USER, [3, 9, 1, 3, "x"])
    rows = kv.batch_get_positional(users, USER, keys).orderBy("pos").collect()
    assert [(r.pos, r.found, r.user_id, r.name) for r in rows] == [(0, True, 3, "Bob"), (1, False, None, None), (2, True, 1, "Alice"), (3, True, 3, "Bob"), (4, False, None, None)]
    hits = kv.batch_get_hits(users, USER, keys).orderBy("pos").collect()
    assert [r.user_id for r in hits] == [3, 1, 3]


def test_string_keys(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "sid string, epoch long")
    assert kv.lookup(t, SESSION, "b").row.epoch == 2
    assert not kv.lookup(t, SESSION, "c").found


def test_upsert_replaces_whole_rows(spark, users):
    delta = spark.createDataFrame([(1, 26), (7, 1)], "user_id long, age int")
    rows = {r.user_id: r for r in kv.upsert(users, delta, USER).collect()}
    assert (rows[1].age, rows[1].name, rows[1].clk) == (26, None, None)
    assert set(rows) == {1, 2, 3, 7}


def test_batch_upsert_last_duplicate_wins(spark, users):
    delta = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (5, 9, 2), (1, 3, 3)], "user_id long, age int, n int")
    rows = {r.user_id: r.age for r in kv.batch_upsert(users, delta, USER, F.col("n")).collect()}
    assert rows == {1: 3, 2: None, 3: 30, 5: 9}


@pytest.mark.parametrize(
    "rows,ddl,match",
    [([], "user_id long, age int", "empty batch"), ([(None, 1)], "user_id long, age int", "without a primary key"), ([(1, "x")], "user_id long, age string", "field_id 2"), ([(1, 1)], "user_id long, zzz int", "unknown field")],
)
def test_put_batch_rejects_all(spark, users, rows, ddl, match):
    with pytest.raises(kv.RejectedBatch, match=match):
        kv.put_batch(users, spark.createDataFrame(rows, ddl), USER, F.lit(0))


def test_put_batch_applies(spark, users):
    out = kv.put_batch(users, spark.createDataFrame([(8, 1)], "user_id long, age int"), USER, F.lit(0))
    assert out.count() == 4


def test_delete_is_idempotent(spark, users):
    keys = spark.createDataFrame([(1,), (99,)], "key long")
    assert {r.user_id for r in kv.delete(users, keys, USER).collect()} == {2, 3}
    assert {(r.key, r.existed) for r in kv.existed(users, keys, USER).collect()} == {(1, True), (99, False)}


def test_import_counts_and_last_wins(spark):
    t = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), (None, 3, 2), ("", 4, 3), ("b", 5, 4)], "sid string, epoch long, n int")
    assert tuple(kv.import_counts(t, SESSION).first()) == (3, 2)
    kept = kv.last_wins(kv.drop_bad_keys(t, SESSION), "sid", F.col("n"))
    assert {(r.sid, r.epoch) for r in kept.collect()} == {("a", 2), ("b", 5)}


def test_numbers_follow_key_order(spark):
    t = spark.range(1000).select((F.col("id") * 7 % 1000).alias("user_id"))
    rows = kv.numbered(t, USER).orderBy("user_id").collect()
    assert [r.doc_id for r in rows] == list(range(1, 1001))


def test_empty_table(spark):
    empty = spark.createDataFrame([], DDL)
    assert kv.size(empty).first()["size"] == 0
    assert kv.numbered(empty, USER).count() == 0
    assert not kv.lookup(empty, USER, 1).found


def test_numbers_have_no_gap_over_many_unequal_partitions(spark, tmp_path):
    """Over a million rows, wide ones, in unequal files, with adaptive execution on."""
    n = 1_200_000
    rows = spark.range(n).select((F.col("id") * 7 - 3_000_000).alias("user_id"), F.lit(1).alias("age"), F.repeat(F.lit("n"), 40).alias("name"), F.array("id").alias("clk"))
    rows.where("user_id % 5 <> 0").repartition(2).write.parquet(str(tmp_path / "u"))
    rows.where("user_id % 5 = 0").repartition(9).write.mode("append").parquet(str(tmp_path / "u"))
    got = kv.numbered(spark.read.parquet(str(tmp_path / "u")), USER)
    wrong = F.count_if(F.col("doc_id") != (F.col("user_id") + 3_000_000) / 7 + 1)
    assert got.agg(F.count("*"), F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id"), wrong).first()[:] == (n, n, 1, n, 0)
    got.write.parquet(str(tmp_path / "numbered"))
    assert spark.read.parquet(str(tmp_path / "numbered")).agg(F.count_distinct("doc_id")).first()[0] == n


def test_numbers_of_text_keys(spark):
    t = spark.createDataFrame([(w, i) for i, w in enumerate(["b", "ä", "a", "B", "", "aa"])], "sid string, epoch long")
    assert [r.sid for r in kv.numbered(t, SESSION).orderBy("doc_id").collect()] == sorted(["b", "ä", "a", "B", "", "aa"], key=str.encode)


def test_put_and_batch_put(spark, users):
    assert kv.put(users, spark.createDataFrame([(7, 1)], "user_id long, age int"), USER).count() == 4
    delta = spark.createDataFrame([(7, 1), (1, 9), (7, 2)], "user_id long, age int").coalesce(1)
    rows = {r.user_id: r.age for r in kv.batch_put(users, delta, USER).collect()}
    assert rows == {1: 9, 2: None, 3: 30, 7: 2}
