import glob
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.functions import arrays
from keystrata.operators import bitmap, inverted
from keystrata.plans import catalog
from keystrata.sources.schema import Field, TableSchema, parse_schema

USER = parse_schema('{"pk": "user_id", "fields": [{"name": "user_id", "type": "int64", "field_id": 1}, {"name": "age", "type": "int32", "field_id": 2, "is_index": true}, {"name": "bio", "type": "string", "field_id": 3, "is_index": true}]}')
TAGS = parse_schema('{"pk": "id", "fields": [{"name": "id", "type": "int64", "field_id": 1}, {"name": "tags", "type": "string", "is_array": true, "field_id": 2, "is_index": true}]}')


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, 25, "Rock climbing"), (2, 30, "rock music, ROCK!"), (3, 25, "jazz music"), (4, None, None)], "user_id long, age int, bio string")


def found(frame):
    return sorted(r.key for r in frame.collect())


def test_boolean_queries(users):
    ix = inverted.postings(users, USER)
    assert found(inverted.query(ix, 3, "ROCK")) == [1, 2]
    assert found(inverted.query(ix, 3, "rock music")) == []
    assert found(inverted.query(ix, 2, "25")) == [1, 3]
    assert found(inverted.query_and(ix, 3, ["rock", "music"])) == [2]
    assert found(inverted.query_and(ix, 3, ["rock", "absent"])) == []
    assert found(inverted.query_and(ix, 3, [])) == []
    assert found(inverted.query_or(ix, 3, ["climbing", "jazz"])) == [1, 3]
    assert found(inverted.query_or(ix, 3, [])) == []
    assert found(inverted.query(ix, 2, "0")) == [4]


def test_put_reindexes_and_delete_removes(spark, users):
    ix = inverted.postings(users, USER)
    table, ix2 = inverted.put(users, ix, spark.createDataFrame([(1, 40, "blues")], "user_id long, age int, bio string"), USER)
    assert found(inverted.query(ix2, 3, "climbing")) == []
    assert found(inverted.query(ix2, 3, "blues")) == [1]
    table, ix3 = inverted.delete(table, ix2, spark.createDataFrame([(2,)], "key long"), USER)
    assert found(inverted.query(ix3, 3, "music")) == [3]
    assert table.count() == 3
    assert {r.user_id for r in inverted.fetch(inverted.query(ix3, 3, "blues"), table, USER).collect()} == {1}


def test_array_fields_index_each_element(spark):
    t = spark.createDataFrame([(1, ["Red Car", "blue"]), (2, []), (3, None)], "id long, tags array<string>")
    assert sorted((r.term, r.key) for r in inverted.postings(t, TAGS).collect()) == [("blue", 1), ("car", 1), ("red", 1)]


def test_tokens_are_ascii(spark):
    row = spark.createDataFrame([("Élan vital-42 ÜBER a_b",)], "t string").select(arrays.tokens(F.col("t")).alias("x")).first()
    assert row.x == ["lan", "vital", "42", "ber", "a", "b"]


def test_set_operations(spark):
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x long")
    a, b = frame([1, 2, 3, 100000]), frame([3, 4, 5, 100000])
    size = lambda f: f.count()
    assert (size(bitmap.union(a, b)), size(bitmap.intersection(a, b)), size(bitmap.xor(a, b)), size(bitmap.difference(a, b))) == (6, 2, 4, 2)
    assert bitmap.packed_cardinality(bitmap.packed_union(bitmap.pack(a), bitmap.pack(b))).first()[0] == 6
    assert bitmap.packed_cardinality(bitmap.packed_intersection(bitmap.pack(a), bitmap.pack(b))).first()[0] == 2
    assert bitmap.packed_cardinality(bitmap.pack(frame(range(200)))).first()[0] == 200
    assert bitmap.is_empty(frame([])).first()[0] is True
    assert [r.x for r in bitmap.ascending(a).collect()] == [1, 2, 3, 100000]
    assert bitmap.as_set(spark.createDataFrame([(1,), (1,), (None,)], "v int"), "v").count() == 1


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**32 - 1), max_size=50), st.integers(0, 70000))
def test_wire_format_round_trip(values, dense):
    values = values | set(range(1 << 20, (1 << 20) + dense))
    blob = bitmap.serialise(values)
    assert bitmap.deserialise(blob).tolist() == sorted(values)
    assert bitmap.estimated_bytes(values) == len(blob)


def test_wire_format_layout_and_checks():
    x = [1, 2, 2, 3, 65535, 65536, 65536, 70000, 999999]
    blob = bitmap.serialise(x)
    assert blob[:12] == b"RBM1" + bytes([1, 0, 0, 0, 3, 0, 0, 0])
    assert len(bitmap.deserialise(blob)) == 7
    wrong = [b"", b"XXXX" + blob[4:], blob[:4] + b"\2" + blob[5:], blob[:-1], blob + b"\0", blob[:14] + b"\7" + blob[15:]]
    for bad in wrong:
        with pytest.raises(ValueError):
            bitmap.deserialise(bad)
    dense = bytearray(bitmap.serialise(range(5000)))
    dense[-1] ^= 1
    with pytest.raises(ValueError, match="cardinality"):
        bitmap.deserialise(bytes(dense))
    with pytest.raises(ValueError):
        bitmap.serialise([-1])


def test_array_and_text_functions(spark):
    r = spark.createDataFrame([(["a", "b"], None, "hello")], "a array<string>, n array<string>, t string").select(
        arrays.array_get_text(F.col("a"), 9).alias("oob"), arrays.append_all(F.col("n"), F.col("a")).alias("app"), arrays.pop_back(F.col("a")).alias("pop"), arrays.pop_front(F.col("a")).alias("popf"),
        arrays.back(F.col("a")).alias("back"), arrays.find(F.col("t"), "l").alias("find"), arrays.find(F.col("t"), "z").alias("npos"), arrays.at(F.col("t"), 4).alias("at"), arrays.array_size(F.col("n")).alias("size"),
    ).first()
    assert tuple(r) == ("", ["a", "b"], ["a"], ["b"], "b", 2, -1, "o", 0)
    with pytest.raises(Exception, match="past the end"):
        spark.createDataFrame([("abc",)], "t string").select(arrays.substr(F.col("t"), 9, 1)).collect()


def test_random_sets_against_python(spark):
    rng = random.Random(3)
    a, b = ({rng.randrange(1 << 18) for _ in range(3000)} for _ in range(2))
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x long")
    fa, fb = frame(a), frame(b)
    for op, want in ((bitmap.intersection, a & b), (bitmap.xor, a ^ b), (bitmap.difference, a - b)):
        assert {r.x for r in op(fa, fb).collect()} == want
    assert bitmap.packed_cardinality(bitmap.pack(fa)).first()[0] == len(a)
    assert np.array_equal(bitmap.deserialise(bitmap.serialise(a)), sorted(a))


def test_blobs_over_columns(spark):
    """Sets of many shapes, written by expressions and by the plain writer, and read back."""
    rng = random.Random(1)
    sets = {1: {0, 1, 65535, 65536, 2**32 - 1}, 2: set(range(70_000)), 3: set(range(5, 5 + bitmap.ARRAY_MOST)), 4: set(range(1, 2 + bitmap.ARRAY_MOST)), 5: {rng.randrange(2**32) for _ in range(500)}, 6: set(range(40_000, 45_000)) | {2**31}}
    rows = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "owner int, x long")
    blobs = bitmap.serialised(rows.unionByName(rows.where("owner = 1")), "owner")
    got = {r.owner: bytes(r.blob) for r in blobs.collect()}
    assert got == {k: bitmap.serialise(v) for k, v in sets.items()}
    assert {r.owner: r.bytes for r in bitmap.serialised_bytes(rows, "owner").collect()} == {k: len(b) for k, b in got.items()}
    back = bitmap.deserialised(blobs)
    assert back.columns == ["owner", "x"] and back.exceptAll(rows).count() == 0 and back.count() == rows.count()
    one = bitmap.serialised(rows.where("owner = 5").select("x"))
    assert bytes(one.first().blob) == got[5]
    nothing = rows.where("owner = 9").select("x")
    assert bytes(bitmap.serialised(nothing).first().blob) == bitmap.serialise([]) and bitmap.serialised_bytes(nothing).first().bytes == 12
    with pytest.raises(Exception, match="32 bits"):
        bitmap.serialised(spark.createDataFrame([(1 << 32,)], "x long")).collect()


def test_text_verbs(spark):
    row = spark.createDataFrame([("ab", None)], "a string, b string").select(arrays.append_text(F.col("a"), F.lit("c")), arrays.append_text(F.col("b"), F.col("a")), arrays.push_back(F.col("a"), "!"), arrays.assign(F.col("a"), F.col("b")), arrays.clear(F.col("a"))).first()
    assert tuple(row) == ("abc", "ab", "ab!", "", "")


def test_all_fields_in_one_pass(spark, users, tmp_path):
    users.write.parquet(str(tmp_path / "u"))
    index = inverted.postings(spark.read.parquet(str(tmp_path / "u")), USER)
    assert index._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.field_id, r.term) for r in index.where("key = 2").collect()) == [(2, "30"), (3, "music"), (3, "rock")]


def test_stored_postings_stay_where_their_rows_were_read(spark, tmp_path):
    """Made in one pass and not dealt anew: all of a key's are in one file, which is in order of terms."""
    docs = spark.createDataFrame([(i, f"all W{i % 7} w{i} \u212aelvin", [f"t{i % 3}", f"T{i % 3}"]) for i in range(300)], "id long, text string, tags array<string>")
    schema = TableSchema("d", "id", (Field("id", "int64", 1), Field("text", "string", 2, is_index=True), Field("tags", "string", 3, True, is_index=True)))
    table = catalog.Catalog(spark, str(tmp_path / "c")).create("d", schema, "inverted")
    table.commit(docs)
    stored = table.acquire()
    assert sorted(map(tuple, stored.postings.collect())) == sorted({(n, t, i) for i in range(300) for n, t in ((2, "all"), (2, f"w{i % 7}"), (2, f"w{i}"), (2, "elvin"), (3, f"t{i % 3}"))})
    keys = []
    for f in glob.glob(f"{stored.path}/postings/*.parquet"):
        rows = spark.read.parquet(f).coalesce(1).collect()
        assert [r.term for r in rows] == sorted(r.term for r in rows)
        keys += {r.key for r in rows}
    assert sorted(keys) == list(range(300))
