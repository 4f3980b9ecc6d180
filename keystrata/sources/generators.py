"""Deterministic tables made from row numbers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.sources.schema import TableSchema, parse_schema

PRODUCT = parse_schema(
    '{"name": "product", "pk": "id", "fields": [{"name": "id", "type": "int64"}, {"name": "brand_id", "type": "int32"},'
    ' {"name": "click_num", "type": "int32"}, {"name": "title", "type": "string"}, {"name": "category_ids", "type": "string"}]}'
)

WIDE: TableSchema = parse_schema(
    '{"name": "kv_all_types", "pk": "id", "fields": ['
    + ", ".join(
        f'{{"name": "{name}", "type": "{kind}", "field_id": {i}, "is_array": {str(name.startswith("arr")).lower()}}}'
        for i, (name, kind) in enumerate(
            [("id", "int64"), ("f_bool", "bool"), ("f_i32", "int32"), ("f_i64", "int64"), ("f_f32", "float"), ("f_f64", "double"), ("f_str", "string"),
             ("f_bytes", "bytes"), ("arr_i32", "int32"), ("arr_i64", "int64"), ("arr_f32", "float"), ("arr_f64", "double")], 1)
    )
    + "]}"
)


def products(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """n rows of the product table."""
    i = F.col("id")
    rows = spark.range(0, n, 1, parts) if parts else spark.range(n)
    title = F.concat(F.lit("pd"), F.lpad((i % 50_000).cast("string"), 5, "0"), F.lit("a"), ((i * 7) % 10_000).cast("string"))
    a, b = (i % 98 + 1).cast("string"), (F.floor(i / 100) % 98 + 1).cast("string")
    return rows.select(
        (i + 1).alias("id"),
        ((i * 17) % 1000 + 1).cast("int").alias("brand_id"),
        ((i * 13) % 1_000_000).cast("int").alias("click_num"),
        F.substring(F.when(F.char_length(title) < 8, F.concat(title, F.lit("xy"))).otherwise(title), 1, 50).alias("title"),
        F.when(i % 3 == 0, a).otherwise(F.concat_ws(",", a, b)).alias("category_ids"),
    )


def wide(spark: SparkSession, n: int, payload: int = 192, lengths: tuple[int, int, int, int] = (48, 32, 32, 24)) -> DataFrame:
    """n rows of every type, with text and bytes of a given length and arrays of given lengths."""
    i = F.col("id")

    def numbers(count: int, kind: str, make):
        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), make).cast(f"array<{kind}>")

    low = i.bitwiseXOR(F.lit(0x5A5A5A5A)).bitwiseAND(F.lit(0xFFFFFFFF))
    return spark.range(1, n + 1).select(
        "id",
        (i % 2 == 1).alias("f_bool"),
        F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int").alias("f_i32"),
        (i * 1_000_003).alias("f_i64"),
        ((i % 10_000) * 0.25).cast("float").alias("f_f32"),
        (i * 0.000015).alias("f_f64"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(payload - 1)), lambda k: F.char(65 + (i + k) % 26)), "").alias("f_str"),
        F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(payload - 1)), lambda k: F.lpad(F.hex((i * 131 + k) % 256), 2, "0")), "")).alias("f_bytes"),
        numbers(lengths[0], "int", lambda k: (i + k) % 1_000_000).alias("arr_i32"),
        numbers(lengths[1], "bigint", lambda k: i * 31 + k).alias("arr_i64"),
        numbers(lengths[2], "float", lambda k: (i + k) % 1000 * 0.5).alias("arr_f32"),
        numbers(lengths[3], "double", lambda k: (i + k) * 0.001).alias("arr_f64"),
    )
