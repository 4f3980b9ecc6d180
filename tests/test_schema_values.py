import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions import values
from keystrata.sources.schema import Field, SchemaError, TableSchema, parse_schema, with_index
from keystrata.sources.sql_query import typed

USER = '{"name": "user", "pk": "user_id", "fields": [{"name": "user_id", "type": "int64", "field_id": 1}, {"name": "age", "data_type": "int32", "field_id": 2}, {"name": "name", "type": "string", "field_id": 3}, {"name": "clk", "type": "int64", "repeated": true, "field_id": 4}]}'


def test_parse_aliases_comments_and_numbers():
    s = parse_schema('{"fields": [ // first\n {"name": "a", "type": "int64", "is_pk": true}, {"name": "b", "type": "float64"}, {"name": "c", "type": "string", "x": 1.5}], "version": 3, "table_format": "spare_row_binary"}')
    assert [f.number for f in s.fields] == [0, 1, 2]
    assert (s.key, s.version, s.table_format, s["b"].kind) == ("a", 3, "sparse_row_binary", "double")
    assert parse_schema(s.to_json()) == s


@pytest.mark.parametrize(
    "text",
    [
        "{",
        '{"fields": []}',
        '{"pk": "x", "fields": [{"name": "a", "type": "int64"}]}',
        '{"fields": [{"name": "a", "type": "int64"}]}',
        '{"pk": "a", "fields": [{"name": "a", "type": "decimal"}]}',
        '{"pk": "a", "fields": [{"name": "a", "type": "bool"}]}',
        '{"pk": "a", "fields": [{"name": "a", "type": "int64", "field_id": 2}, {"name": "a", "type": "int64", "field_id": 3}]}',
        '{"pk": "a", "fields": [{"name": "a", "type": "int64", "field_id": 2}, {"name": "b", "type": "int64", "field_id": 2}]}',
        '{"pk": "a", "fields": [{"name": "a", "type": "int64", "is_array": true}]}',
    ],
)
def test_bad_schemas(text):
    with pytest.raises(SchemaError):
        parse_schema(text)


def test_comment_marks_in_strings_stay():
    assert parse_schema('{"name": "http://x", "pk": "a", "fields": [{"name": "a", "type": "int64"}]}').name == "http://x"


def test_evolution():
    old = parse_schema(USER)
    renamed = TableSchema("user", "user_id", (*old.fields[:2], Field("full_name", "string", 3), Field("new", "double", 9)))
    assert old.evolve(renamed) == {"user_id": "user_id", "age": "age", "full_name": "name", "new": None}
    with pytest.raises(SchemaError):
        old.evolve(TableSchema("user", "user_id", (old.fields[0], Field("age", "string", 2))))
    assert with_index(old, "name")["name"].is_index


def test_struct_type_metadata():
    st = parse_schema(USER).struct_type()
    assert st["clk"].dataType == T.ArrayType(T.LongType(), False)
    assert st["age"].metadata["field_id"] == 2


def test_defaults_of_every_type(spark):
    kinds = ["bool", "int32", "int64", "float", "double", "string", "bytes"]
    schema = TableSchema("t", "id", (Field("id", "int64", 1), *[Field(k, k, 2 + i) for i, k in enumerate(kinds)], Field("arr", "string", 20, True)))
    frame = spark.createDataFrame([(1,)], "id long")
    frame = frame.select("id", *[F.lit(None).cast(f.data_type).alias(f.name) for f in schema.fields[1:]])
    row = values.materialise(frame, schema).first()
    assert (row["bool"], row["int32"], row["double"], row["string"], bytes(row["bytes"]), row["arr"]) == (False, 0, 0.0, "", b"", [])


@pytest.mark.parametrize("key,good", [("7", True), ("007", False), ("+7", False), ("x", False), (str(1 << 63), False), (-5, True)])
def test_key_literals(spark, key, good):
    assert values.key_literal(parse_schema(USER), key)[1] is good


def test_coercions(spark):
    f = lambda kind, array=False: Field("x", kind, 1, array)
    with pytest.raises(values.CoercionError):
        values.coerce(F.lit(1), T.ShortType(), f("int64"))
    with pytest.raises(values.CoercionError):
        values.coerce(F.lit(1), T.FloatType(), f("double"))
    with pytest.raises(values.CoercionError):
        values.coerce(F.lit(1), T.ArrayType(T.IntegerType()), f("int64", True))
    with pytest.raises(values.CoercionError):
        values.coerce(F.lit(1), T.ArrayType(T.BooleanType()), f("bool", True))
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        spark.range(1).select(values.coerce(F.lit(1 << 40), T.LongType(), f("int32"))).collect()
    assert spark.range(1).select(values.coerce(F.from_json(F.lit("[1, null]"), "array<int>"), T.ArrayType(T.IntegerType()), f("int32", True)).alias("x")).first().x == [1]


def test_projection_errors(spark):
    s = parse_schema(USER)
    with pytest.raises(values.CoercionError, match="missing column: age"):
        values.project(spark.createDataFrame([(1,)], "user_id long"), s)
    with pytest.raises(values.CoercionError, match="missing"):
        values.project(spark.createDataFrame([(1, 2)], "USER_ID long, age int"), s)


def test_query_text(spark):
    s = TableSchema("t", "id", (Field("id", "int64", 1), Field("ok", "bool", 2)))
    frame = spark.createDataFrame([("1", "TRUE"), ("2", "0"), ("3", "5"), (None, None)], "ID string, Ok string")
    assert [tuple(r) for r in typed(frame, s).collect()] == [(1, True), (2, False), (3, True), (None, None)]
    for bad in ("", "7 ", "1.5", "x"):
        with pytest.raises(Exception):  # noqa: B017
            typed(spark.createDataFrame([(bad, "1")], "id string, ok string"), s).collect()
    with pytest.raises(values.CoercionError, match="ambiguous"):
        typed(spark.createDataFrame([("1", "1", "1")], "id string, ID string, ok string"), s)


def test_write_violations():
    s = parse_schema(USER)
    st = T.StructType([T.StructField("age", T.StringType()), T.StructField("zzz", T.LongType()), T.StructField("clk", T.LongType())])
    assert values.write_violations(st, s) == ["type mismatch for field_id 2", "unknown field zzz", "type mismatch for field_id 4", "missing primary key user_id"]
    assert "unknown field zzz" not in values.write_violations(st, s, unknown="ignore")


def test_row_as_map():
    assert values.as_map({1: 5, "age": 3, 77: "x"}, parse_schema(USER)) == {"user_id": 5, "age": 3, "field_id_77": "x"}


def test_documents_by_table_name_and_kv_index():
    text = '{"table_name": "user", "pk": "user_id", "fields": [{"name": "user_id", "data_type": "int64", "is_pk": true, "is_index": false, "field_id": 1, "index_type": "kv"}, {"name": "bio", "data_type": "string", "is_pk": false, "is_index": true, "field_id": 2, "index_type": "inverted", "fixed_off": 8}]}'
    s = parse_schema(text)
    assert (s.name, s.key, s["user_id"].index_type, s["bio"].offset) == ("user", "user_id", "kv", 8)
    again = parse_schema(s.to_json())
    assert again == s and again.name == "user"
    assert '"table_name": "user"' in s.to_json()
