"""Sets of unsigned 32-bit numbers: as rows (x), as packed buckets, and in the portable wire format."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- rows


def as_set(frame: DataFrame, column: str) -> DataFrame:
    return frame.select(F.col(column).cast("long").alias("x")).where("x IS NOT NULL").distinct()


def add(a: DataFrame, values: DataFrame) -> DataFrame:
    return a.unionByName(values).distinct()


def remove(a: DataFrame, values: DataFrame) -> DataFrame:
    return a.join(values.distinct(), "x", "left_anti")


def contains(values: DataFrame, a: DataFrame) -> DataFrame:
    """For each value whether it is in the set."""
    return values.join(a.select("x", F.lit(True).alias("__in")), "x", "left").select("x", F.coalesce("__in", F.lit(False)).alias("contained"))


def cardinality(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("cardinality"))


def is_empty(a: DataFrame) -> DataFrame:
    return a.agg((F.count("*") == 0).alias("is_empty"))


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each value with the sides it is in: 1, 2, or 3 for both. One shuffle serves every operation."""
    return a.select("x", F.lit(1).alias("s")).unionByName(b.select("x", F.lit(2).alias("s"))).groupBy("x").agg(F.bit_or("s").alias("s"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b).where("s = 3").select("x")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b).where("s <> 3").select("x")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b).where("s = 1").select("x")


def ascending(a: DataFrame) -> DataFrame:
    return a.orderBy("x")


# ---------------------------------------------------------------- packed: (bucket, bits), 32768 values a bucket


def pack(a: DataFrame) -> DataFrame:
    """Positions mean nothing without their bucket, so values are always grouped by it."""
    return a.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))


def packed_cardinality(p: DataFrame) -> DataFrame:
    return p.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("cardinality"))


def packed_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def packed_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).groupBy("bucket").agg(F.count("*").alias("__n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where("__n = 2").select("bucket", "bits").where(F.bitmap_count("bits") > 0)


# ---------------------------------------------------------------- wire format

#: Fixed values of the wire format: little-endian; chunks of 65,536 values, as sorted numbers or as 1,024 words.
MAGIC, VERSION = b"RBM1", 1
WORDS = 1024
ARRAY, BITS = 0, 1
#: A chunk of more values than this is written as words.
ARRAY_MOST = 4096


def serialise(values: Iterable[int]) -> bytes:
    """The set of values in the wire format."""
    x = np.unique(np.fromiter(values, np.int64))
    if len(x) and (x[0] < 0 or x[-1] >= 1 << 32):
        raise ValueError("values have to fit 32 bits")
    high = x >> 16
    firsts = np.flatnonzero(np.diff(high, prepend=-1))
    chunks = []
    for part in np.split(x, firsts[1:]) if len(x) else []:
        low = (part & 0xFFFF).astype("<u2")
        if len(part) > ARRAY_MOST:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            kind, body = BITS, np.packbits(bits, bitorder="little").tobytes()
        else:
            kind, body = ARRAY, low.tobytes()
        chunks.append(struct.pack("<HBxII", int(part[0]) >> 16, kind, len(part), len(body)) + body)
    return MAGIC + struct.pack("<HHI", VERSION, 0, len(chunks)) + b"".join(chunks)


def estimated_bytes(values: Iterable[int]) -> int:
    """How long the wire form of a set is, without making it."""
    _, counts = np.unique(np.unique(np.fromiter(values, np.int64)) >> 16, return_counts=True)
    return 12 + int(np.where(counts > ARRAY_MOST, WORDS * 8, 2 * counts).sum()) + 12 * len(counts)


def deserialise(data: bytes) -> np.ndarray:
    """The values of a wire format blob, ascending. Raises ValueError that says which chunk is out of form, and how."""

    def expect(found: object, wanted: object, what: str) -> None:
        if found != wanted:
            raise ValueError(f"not a bitmap blob: {what} is {found!r} where {wanted!r} is due")

    expect(len(data) >= 12, True, f"a head of 12 bytes in {len(data)}")
    expect(data[:4], MAGIC, "the mark at its start")
    version, _, count = struct.unpack_from("<HHI", data, 4)
    expect(version, VERSION, "its version")
    at, last, out = 12, -1, []
    for k in range(count):
        expect(at + 12 <= len(data), True, f"room for the head of chunk {k} of {count}")
        high, kind, n, long = struct.unpack_from("<HBxII", data, at)
        at += 12
        expect(high > last, True, f"chunk {k} (of {high}) following chunk {last}")
        expect(kind in (ARRAY, BITS), True, f"kind {kind} of chunk {k} being known")
        expect(at + long <= len(data), True, f"room for the {long} bytes of chunk {k}")
        body = np.frombuffer(data, np.uint8, long, at)
        if kind == ARRAY:
            expect(long, 2 * n, f"the length of chunk {k} with {n} numbers")
            low = body.view("<u2").astype(np.int64)
            expect(bool((np.diff(low) > 0).all()), True, f"numbers of chunk {k} ascending")
        else:
            expect(long, WORDS * 8, f"the length of chunk {k} of bits")
            low = np.flatnonzero(np.unpackbits(body, bitorder="little"))
            expect(len(low), n, f"the cardinality of chunk {k}")
        out.append((high << 16) | low)
        at, last = at + long, high
    expect(at, len(data), "the end of the last chunk")
    return np.concatenate(out) if out else np.empty(0, np.int64)


# ---------------------------------------------------------------- wire format over columns


def _chunks(a: DataFrame, *by: str) -> DataFrame:
    """For each set (by) and upper half of its values: how many there are, and the lower halves, ascending."""
    x = F.col("x")
    good = F.when((x >= 0) & (x < 1 << 32), x).otherwise(F.raise_error(F.lit("values have to fit 32 bits")).cast("long"))
    halves = a.select(*by, F.shiftright(good, 16).cast("int").alias("high"), good.bitwiseAND(0xFFFF).cast("int").alias("low")).distinct()
    return halves.groupBy(*by, "high").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("low")).alias("lows"))  # 65,536 at most


def serialised(a: DataFrame, *by: str) -> DataFrame:
    """The blob of each set of rows (by, x), as serialise() writes it, by Spark expressions: by, blob.

    Without by, one row, also for no rows. A chunk is one group, a blob's chunks are joined by its set.
    """

    def little(value: Column, size: int) -> Column:
        """A number as hex digits, lowest byte first."""
        byte = lambda k: F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(255)), 2, "0")
        return F.concat(*[byte(k) for k in range(size)])

    chunks = _chunks(a, *by)
    dense = F.col("n") > ARRAY_MOST
    numbers = F.array_join(F.transform("lows", lambda x: little(x, 2)), "")
    dense_rows = chunks.where(dense).select(*by, "high", F.explode("lows").alias("low"))
    half = lambda k: F.bitmap_construct_agg(F.bitmap_bit_position(F.when(F.shiftright("low", 15) == k, F.col("low").bitwiseAND(0x7FFF).cast("long") + 1)))
    words = dense_rows.groupBy(*by, "high").agg(F.hex(F.concat(half(0), half(1))).alias("words"), F.count("*").alias("n"))
    head = lambda kind, long: F.concat(little(F.col("high"), 2), F.lit(f"{kind:02x}00"), little(F.col("n"), 4), little(long, 4))
    arrays = chunks.where(~dense).select(*by, "high", F.concat(head(ARRAY, F.col("n") * 2), numbers).alias("body"))
    every = arrays.unionByName(words.select(*by, "high", F.concat(head(BITS, F.lit(WORDS * 8)), "words").alias("body")))
    joined = every.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("high", "body"))).alias("chunks"))
    start = F.concat(F.lit(MAGIC.hex()), little(F.lit(VERSION), 2), little(F.lit(0), 2), little(F.size("chunks"), 4))
    return joined.select(*by, F.unhex(F.concat(start, F.array_join(F.transform("chunks", lambda c: c["body"]), ""))).alias("blob"))


def serialised_bytes(a: DataFrame, *by: str) -> DataFrame:
    """How long the blob of each set is, without making it: by, bytes."""
    each = 12 + F.when(F.col("n") > ARRAY_MOST, WORDS * 8).otherwise(2 * F.col("n"))
    return _chunks(a, *by).groupBy(*by).agg((12 + F.coalesce(F.sum(each), F.lit(0))).alias("bytes"))


def deserialised(blobs: DataFrame, blob: str = "blob") -> DataFrame:
    """Rows (x) of the sets of a column of blobs, with the other columns repeated; a blob out of form fails the job."""
    rest = [c for c in blobs.columns if c != blob]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch[blob].to_pylist()):
                values = deserialise(data) if data is not None else np.empty(0, np.int64)
                for i in range(0, len(values), 1 << 16):
                    part = values[i : i + (1 << 16)]
                    own = pa.array(np.full(len(part), k))
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(own) for c in rest), pa.array(part)], [*rest, "x"])

    return blobs.select(*rest, blob).mapInArrow(run, T.StructType([*blobs.select(*rest).schema.fields, T.StructField("x", T.LongType())]))
