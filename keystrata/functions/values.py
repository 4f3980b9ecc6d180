"""Typed values: defaults of unset fields, key text, and the conversions that inputs may and may not make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.sources.schema import Field, TableSchema


class CoercionError(ValueError):
    """An input column whose type the field does not take."""


def default_of(f: Field) -> Column:
    """What an unset field reads as: zero, false, empty text or bytes, no elements."""
    kind = f.data_type
    if f.is_array:
        return F.array().cast(kind)
    plain = {"bool": F.lit(False), "string": F.lit(""), "bytes": F.lit(b"")}.get(f.kind, F.lit(0))
    return plain.cast(kind)


def materialise(frame: DataFrame, schema: TableSchema) -> DataFrame:
    """All fields in schema order, unset ones with their defaults; nulls are only kept at rest."""
    return frame.select(*[F.coalesce(F.col(f.name), default_of(f)).alias(f.name) for f in schema.fields])


def key_text(key: Column) -> Column:
    """The canonical text of a key."""
    return key.cast("string")


def key_literal(schema: TableSchema, key: object) -> tuple[Column, bool]:
    """A key as a literal of its column's type, and whether it is a canonical text of that type.

    "007" is no key of an integer table: a key has to be the text that the number itself gives.
    """
    f = schema.key_field
    text = str(key)
    if f.kind == "string":
        return F.lit(text), text != ""
    bits = 31 if f.kind == "int32" else 63
    try:
        number = int(text)
    except ValueError:
        return F.lit(None).cast(f.data_type), False
    good = str(number) == text and -(1 << bits) <= number < 1 << bits
    return F.lit(number if good else None).cast(f.data_type), good


#: Input types that each kind takes; wider integers are range-checked by the cast itself.
_TAKES: dict[str, tuple[type[T.DataType], ...]] = {
    "bool": (T.BooleanType,),
    "int32": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType),
    "int64": (T.IntegerType, T.LongType, T.DecimalType),
    "float": (T.FloatType,),
    "double": (T.DoubleType,),
    "string": (T.StringType, T.BinaryType),
    "bytes": (T.BinaryType, T.StringType),
}
#: Kinds of which arrays can be imported.
ARRAYS = ("int32", "int64", "float", "double", "string")


def coerce(column: Column, given: T.DataType, f: Field) -> Column:
    """The column as the field's type; raises for a type that the field does not take.

    A number out of range fails the job, as in ANSI mode; null stays null.
    """
    if f.is_array:
        if not isinstance(given, T.ArrayType):
            raise CoercionError(f"field {f.name}: expected an array, got {given.simpleString()}")
        if f.kind not in ARRAYS:
            raise CoercionError(f"field {f.name}: arrays of {f.kind} can't be imported")
        if type(given.elementType) is not type(f.data_type.elementType):
            raise CoercionError(f"field {f.name}: elements are {given.elementType.simpleString()}, not {f.kind}")
        # Of an array without nulls, compacted says so in its type as well.
        return F.array_compact(column)
    if isinstance(given, T.DecimalType) and given.scale:
        raise CoercionError(f"field {f.name}: {given.simpleString()} has a fraction")
    if not isinstance(given, _TAKES[f.kind]):
        raise CoercionError(f"field {f.name}: {given.simpleString()} can't be read as {f.kind}")
    return column.cast(f.data_type)


def project(frame: DataFrame, schema: TableSchema, *, ignore_case: bool = False) -> DataFrame:
    """The schema's columns of an input, coerced; others are left out, and a missing one is an error."""
    given: dict[str, list[T.StructField]] = {}
    for c in frame.schema.fields:
        given.setdefault(c.name.lower() if ignore_case else c.name, []).append(c)
    out = []
    for f in schema.fields:
        found = given.get(f.name.lower() if ignore_case else f.name, [])
        if not found:
            raise CoercionError(f"missing column: {f.name}")
        if len(found) > 1:
            raise CoercionError(f"ambiguous column: {f.name}")
        out.append(coerce(F.col(f"`{found[0].name}`"), found[0].dataType, f).alias(f.name, metadata=f.spark().metadata))
    return frame.select(*out)


# ---------------------------------------------------------------- text of query results


def parse_bool(text: Column) -> Column:
    """0, 1, true and false in any case, or another whole number that is true unless zero; else an error."""
    low = F.lower(text)
    return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False).otherwise(text.cast("bigint") != 0)


def parse_text(text: Column, f: Field) -> Column:
    """The value of a text cell: the whole text has to be a value of the field's type; null stays null."""
    if f.is_array:
        raise CoercionError(f"field {f.name}: a query result has no arrays")
    if f.kind == "bool":
        return parse_bool(text)
    if f.kind in ("string", "bytes"):
        return text.cast(f.data_type)
    # A cast would trim what stands behind a number; the text may only have space before it.
    bad = text.rlike(r"\s$") | (text == "")
    return F.when(bad, F.raise_error(F.concat(F.lit(f"field {f.name}: not a number: "), text))).otherwise(text).cast(f.data_type)


# ---------------------------------------------------------------- checks of rows written by callers


def write_violations(given: T.StructType, schema: TableSchema, *, unknown: str = "reject") -> list[str]:
    """What is wrong with the columns of rows to write. unknown: "reject" or "ignore" columns that no field has."""
    found = []
    for c in given.fields:
        f = next((f for f in schema.fields if f.name == c.name), None)
        if f is None:
            if unknown == "reject":
                found.append(f"unknown field {c.name}")
        elif f.is_array and f.kind in ("bytes", "bool"):
            found.append(f"type mismatch for field_id {f.number}")
        elif f.is_array != isinstance(c.dataType, T.ArrayType):
            found.append(f"type mismatch for field_id {f.number}")
        elif type(c.dataType) is not type(f.data_type) or f.is_array and type(c.dataType.elementType) is not type(f.data_type.elementType):
            found.append(f"type mismatch for field_id {f.number}")
    if schema.key not in given.names:
        found.append(f"missing primary key {schema.key}")
    return found


def valid_key(key: Column) -> Column:
    """Whether a key can identify a row: neither null nor empty."""
    return key.isNotNull() & (key.cast("string") != "")


def as_map(row, schema: TableSchema) -> dict:
    """A row as a dictionary by field name; a value without a name goes by its number."""
    values = row.asDict() if hasattr(row, "asDict") else dict(row)
    names = {f.number: f.name for f in schema.fields}
    return {names.get(k, f"field_id_{k}") if isinstance(k, int) else k: v for k, v in values.items()}


# ---------------------------------------------------------------- contracts


def contract(frame: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row: rows, distinct_keys, duplicate_keys, and for each rule how many rows break it (null breaks it).

    Keys are aggregated by the cluster; one pass over the input.
    """
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    each = frame.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), *broken)
    return each.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("rows"),
        F.count("__key").alias("distinct_keys"),
        (F.coalesce(F.sum("__n"), F.lit(0)) - F.count("*")).cast("long").alias("duplicate_keys"),
        *[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in rules],
    )


def product_rules() -> dict[str, Column]:
    """What every row of the product fixture keeps to."""
    return {
        "bad_brand": F.col("brand_id") > 0,
        "bad_click": F.col("click_num") >= 0,
        "bad_title": F.char_length("title").between(2, 50),
        "bad_category": F.col("category_ids").rlike("^([1-9][0-9]*)(,[1-9][0-9]*)*$"),
    }
