"""Rows by primary key, as DataFrame operations on a snapshot.

A snapshot holds at most one row a key, with nulls where a field was never set; reads answer with defaults. Writes
return the next snapshot. Lookups ship the keys asked for: Spark broadcasts them while they are small by its own
measure and shuffles both sides by key beyond, so no size of batch breaks them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keystrata.functions.values import default_of, key_literal, materialise, valid_key, write_violations
from keystrata.sources.schema import TableSchema

BUCKET = "__pk_bucket"
#: Bounds of numbered(): ranges of keys, and keys drawn for each of them.
RANGES, SAMPLE_A_RANGE = 2048, 32


class RejectedBatch(ValueError):
    """A batch of which nothing is applied."""


@dataclass(frozen=True)
class Answer:
    """What a point lookup gives: a miss is no error."""

    found: bool
    error: str = ""
    row: Row | None = None


# ---------------------------------------------------------------- reads


def bucket_of(key: Column, buckets: int) -> Column:
    """The part of a bucketed snapshot that a key lies in."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def where_key(snapshot: DataFrame, schema: TableSchema, key: object, buckets: int | None = None) -> DataFrame:
    """No row or one. The literal has the key's type, so that the filter reaches the Parquet scan."""
    value, good = key_literal(schema, key)
    if not good:
        return snapshot.limit(0)
    rows = snapshot.where(F.col(schema.key) == value)
    return rows.where(F.col(BUCKET) == bucket_of(value, buckets)) if buckets else rows


def get(snapshot: DataFrame, schema: TableSchema, key: object) -> DataFrame:
    """The row of a key with defaults for unset fields."""
    return materialise(where_key(snapshot, schema, key), schema)


def lookup(snapshot: DataFrame, schema: TableSchema, key: object) -> Answer:
    """A point lookup that reports instead of raising."""
    if key is None or str(key) == "":
        return Answer(False, "missing primary key")
    rows = get(snapshot, schema, key).take(1)
    return Answer(bool(rows), row=rows[0] if rows else None)


def keys_frame(like: DataFrame, schema: TableSchema, keys: Sequence[object]) -> DataFrame:
    """Rows (pos, key) of keys asked for, in order; one that is no key of the table's type has a null key."""
    f = schema.key_field
    rows = []
    for i, k in enumerate(keys):
        _, good = key_literal(schema, k)
        rows.append((i, (str(k) if f.kind == "string" else int(str(k))) if good else None))
    return like.sparkSession.createDataFrame(rows, T.StructType([T.StructField("pos", T.LongType()), T.StructField("key", f.data_type)]))


def batch_get_positional(snapshot: DataFrame, schema: TableSchema, keys: DataFrame) -> DataFrame:
    """A row for every row (pos, key) of keys: pos, found, and the fields, null on a miss, defaults on a hit."""
    data = snapshot.select(F.lit(True).alias("__hit"), F.col(schema.key).alias("__key"), *[F.col(n) for n in schema.names])
    joined = keys.join(data, keys["key"] == data["__key"], "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    return joined.select("pos", hit.alias("found"), *[F.when(hit, F.coalesce(F.col(f.name), default_of(f))).alias(f.name) for f in schema.fields])


def batch_get_hits(snapshot: DataFrame, schema: TableSchema, keys: DataFrame) -> DataFrame:
    """Only hits, as often as they were asked for: pos and the fields."""
    data = materialise(snapshot, schema)
    return keys.join(data, keys["key"] == data[schema.key]).select("pos", *[data[n] for n in schema.names])


def size(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count("*").alias("size"))


# ---------------------------------------------------------------- imports


def drop_bad_keys(frame: DataFrame, schema: TableSchema) -> DataFrame:
    """Rows whose key is neither null nor empty."""
    return frame.where(valid_key(F.col(schema.key)))


def import_counts(frame: DataFrame, schema: TableSchema) -> DataFrame:
    """One row: rows taken and rows skipped for their key."""
    good = valid_key(F.col(schema.key))
    return frame.agg(F.count_if(good).alias("rows"), F.count_if(~good).alias("skipped_pk_null"))


def last_wins(frame: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key by the order given.

    An aggregate on a struct, not a window: it combines before the shuffle, so a key of many rows is no hot task.
    """
    names = frame.columns
    best = F.max_by(F.struct(*[F.col(f"`{n}`") for n in names]), F.struct(*order))
    return frame.groupBy(F.col(key).alias("__k")).agg(best.alias("__row")).select(*[F.col(f"__row.`{n}`").alias(n) for n in names])


# ---------------------------------------------------------------- writes


def _aligned(frame: DataFrame, schema: TableSchema) -> DataFrame:
    """Every field of the table; those a delta leaves out are unset."""
    have = set(frame.columns)
    return frame.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.data_type).alias(f.name) for f in schema.fields])


def upsert(snapshot: DataFrame, delta: DataFrame, schema: TableSchema) -> DataFrame:
    """Rows of delta (one a key) replace those of their keys whole; fields they leave out are unset."""
    fresh = _aligned(delta, schema)
    rest = snapshot.select(*schema.names).join(fresh.select(schema.key), schema.key, "left_anti").select(*schema.names)
    return rest.unionByName(fresh)


def as_given(delta: DataFrame) -> DataFrame:
    """The rows with __given, their order in the frame: by partition, then by row. Taken before any shuffle."""
    return delta.withColumn("__given", F.monotonically_increasing_id())


def batch_upsert(snapshot: DataFrame, delta: DataFrame, schema: TableSchema, *order: Column) -> DataFrame:
    """upsert() of the last row of each key in delta, by the order given or else by that of the frame."""
    rows = delta if order else as_given(delta)
    return upsert(snapshot, last_wins(rows, schema.key, *(order or (F.col("__given"),))), schema)


def put(snapshot: DataFrame, delta: DataFrame, schema: TableSchema) -> DataFrame:
    """Puts rows (one a key) that callers say are new. A key that is live already answers with the new row from then on."""
    return upsert(snapshot, delta, schema)


def batch_put(snapshot: DataFrame, delta: DataFrame, schema: TableSchema, *order: Column) -> DataFrame:
    """put() of many rows, one after another: of repeated keys the last one stays."""
    return batch_upsert(snapshot, delta, schema, *order)


def put_batch(snapshot: DataFrame, delta: DataFrame, schema: TableSchema, *order: Column) -> DataFrame:
    """All rows of delta or none: raises RejectedBatch for a bad column, a bad key or no rows."""
    given = T.StructType([c for c in delta.schema.fields if not c.name.startswith("__")])
    wrong = write_violations(given, schema)
    if wrong:
        raise RejectedBatch("; ".join(wrong))
    state = delta.agg(F.count("*").alias("rows"), F.count_if(~valid_key(F.col(schema.key))).alias("bad")).first()
    if not state["rows"]:
        raise RejectedBatch("empty batch")
    if state["bad"]:
        raise RejectedBatch(f"{state['bad']} rows without a primary key")
    return batch_upsert(snapshot, delta, schema, *order)


def put_batch_or_keep(snapshot: DataFrame, delta: DataFrame, schema: TableSchema, valid: Column) -> DataFrame:
    """The snapshot with delta (one row a key) if every row of it is valid, else unchanged; one lazy plan."""
    bad = delta.where(~F.coalesce(valid, F.lit(False))).agg(F.count("*")).scalar()
    return upsert(snapshot, delta.where(bad == 0), schema)


def delete(snapshot: DataFrame, keys: DataFrame, schema: TableSchema) -> DataFrame:
    """The snapshot without the keys of a frame (key); absent ones don't matter."""
    return snapshot.join(keys.select(F.col("key").alias(schema.key)), schema.key, "left_anti").select(*snapshot.columns)


def existed(snapshot: DataFrame, keys: DataFrame, schema: TableSchema) -> DataFrame:
    """For each key asked to go, whether it was there."""
    live = snapshot.select(F.col(schema.key).alias("key"), F.lit(True).alias("__live"))
    return keys.join(live, "key", "left").select("key", F.coalesce("__live", F.lit(False)).alias("existed"))


def numbered(snapshot: DataFrame, schema: TableSchema) -> DataFrame:
    """Surrogate numbers from 1 in the order of keys (a null key first); a row's identity stays its key.

    The range of a row comes from its key alone: boundaries are drawn from the keys of least hash, at most
    SAMPLE_A_RANGE for each of RANGES ranges. So rows that are counted and rows that are numbered agree on their range
    whatever partitions they are in, and no task sees more than a range.
    """
    ranges = min(RANGES, int(snapshot.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.col(schema.key)
    drawn = snapshot.where(key.isNotNull()).select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_A_RANGE * ranges)
    sample = sorted({r["k"] for r in drawn.collect()}, key=lambda k: k.encode() if isinstance(k, str) else k)
    cuts = list(dict.fromkeys(sample[i * len(sample) // ranges] for i in range(1, ranges))) if sample else []

    def part(lo: int, hi: int) -> Column:
        """The number of boundaries among lo to hi that the key has reached, by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]).cast(schema.key_field.data_type), part(lo, mid)).otherwise(part(mid + 1, hi))

    spread = snapshot.withColumn("__part", F.when(key.isNull(), -1).otherwise(part(0, len(cuts))))
    counts = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    # As many rows as ranges.
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(schema.key))
    placed = spread.join(F.broadcast(before), "__part", "left")
    number = F.coalesce(F.col("__before"), F.raise_error(F.lit("a row outside all ranges")).cast("long")) + own
    return placed.withColumn("doc_id", number.cast("long")).drop("__part", "__before")
