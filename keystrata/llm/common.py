"""What the operators of this subpackage share: reading tables, shared storage, blocks and word arrays.

Words are maximal runs of bytes outside space and 0x09-0x0D, as everywhere in this subpackage.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.plans.scratch import shared_folder  # noqa: F401 - used by the modules of this subpackage


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table of the folder, by Spark's own reader."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def crc_rest(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def free_name(names: list[str], base: str) -> str:
    """The name, with underscores in front as long as a column has it already."""
    while base.lower() in {n.lower() for n in names}:
        base = f"_{base}"
    return base


def written(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back: its lineage ends there."""
    frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, on which Spark deletes shuffle files of jobs that are over.

    Between the jobs of one operator nothing else would free them, and disks would hold the shuffles of all jobs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables of the shared folder."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_apart(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join for which both sides are always shuffled anew, also where one has just been aggregated by the keys.

    Spark splits the rows of a hot key over tasks only where a shuffle feeds the join directly. The added key says
    nothing new; it only keeps the aggregate's own partitioning from being used again.
    """
    mark = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)).alias("__mark")
    return left.select("*", mark).join(right.select("*", mark), [*keys, "__mark"], how).drop("__mark")


def block_count(frame: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about block_bytes the texts fill, two to a core at least; one pass over the lengths."""
    total = frame.agg(F.sum(F.octet_length(F.col(text)) + 64)).first()[0] or 0
    return max(2 * frame.sparkSession.sparkContext.defaultParallelism, -(-int(total) // block_bytes))


def occurring(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """For each part that occurs in ascending part numbers: the part, and where it begins and ends. No other is looked at."""
    if not len(parts):
        return []
    begin = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    return list(zip(parts[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(parts)], strict=True))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- bytes and words as arrays

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
#: Multipliers of the two independent polynomial hashes, odd.
ODD = (0x9E3779B97F4A7C15 | 2 | 1, 0xC2B2AE3D27D4EB4B)
#: Bytes of text that are worked on at a time: arrays by byte and word take some thirty times as much.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _hash_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per-byte values, powers of the multiplier and of its inverse, for n positions."""
    size = max(CHUNK, 1 << int(n - 1).bit_length()) if n > CHUNK else CHUNK
    if (which, size) not in _powers:
        for k in [k for k in _powers if k[0] == which and k[1] > CHUNK]:
            del _powers[k]
        r = ODD[which]
        inverse = pow(r, -1, 1 << 64)
        values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15 + which * 2 + 2))
        up = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, r, U)]), dtype=U)
        down = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, inverse, U)]), dtype=U)
        _powers[which, size] = values, up, down
    return _powers[which, size]


@dataclass
class Words:
    """All words of a batch of texts: byte ranges in data, and the range of words of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i + 1]
    hashes: tuple[np.ndarray, ...]
    prefixes: tuple[np.ndarray, ...] = ()

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def room(self) -> np.ndarray:
        """How many words of its text start at or after each word."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.start))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 * CHUNK):
    """The batch in slices of about limit bytes of one binary or string column, at least a row each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64) + 1
    upto, i, n = np.concatenate([[0], np.cumsum(lengths)]), 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words_of(column: pa.Array | pa.ChunkedArray, *, through: np.ndarray | None = None, hashes: int = 1, prefixes: tuple[int, ...] = ()) -> Words:
    """Splits whole texts into words and hashes each word with one or two 64-bit hashes, and its first bytes too.

    Bytes are mapped by the table `through` first, such as LOWER. A null text has no words. Work goes in chunks of
    whole texts, so that arrays stay small.
    """
    data, offsets = binary_parts(column)
    if through is not None:
        data = through[data]
    starts, ends, found, heads, counts = [], [], [[] for _ in range(hashes)], [[] for _ in prefixes], [np.zeros(1, np.int64)]
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        part = data[lo:hi]
        edge = np.zeros(hi - lo + 1, dtype=bool)
        edge[offsets[i : j + 1] - lo] = True
        inside = ~SPACE[part]
        s = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if len(part) else np.empty(0, np.int64)
        e = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(part) else np.empty(0, np.int64)
        for which in range(hashes):
            values, up, down = _hash_tables(which, len(part))
            total = np.concatenate([np.zeros(1, U), np.cumsum(values[part] * up[: len(part)], dtype=U)])
            found[which].append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U)))
            for k, length in enumerate(prefixes if which == 0 else ()):
                to = np.minimum(s + length, e)
                heads[k].append(mix((total[to] - total[s]) * down[s] + U((length << 8) + 77)))
        counts.append(np.diff(np.searchsorted(s, offsets[i : j + 1] - lo)))
        starts.append(s + lo)
        ends.append(e + lo)
        i = j
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    bounds = np.cumsum(np.concatenate(counts))
    return Words(data, join(starts, np.int64), join(ends, np.int64), bounds, tuple(join(f, U) for f in found), tuple(join(f, U) for f in heads))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of length words, by its first word; runs past the end of the array are left out."""
    if len(h) < length:
        return np.empty(0, U)
    odd = U(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        power, part, have, done = odd, h, 1, None
        taken = 0
        rest = length
        power_done = U(1)
        while rest:
            if rest & 1:
                if done is None:
                    done, taken, power_done = part, have, power
                else:
                    m = len(h) - taken - have + 1
                    done = done[:m] + power_done * part[taken : taken + m]
                    taken += have
                    power_done = power_done * power
            rest >>= 1
            if rest:
                m = len(part) - have
                part = part[:m] + power * part[have : have + m]
                power = power * power
                have *= 2
        return mix(done)


def binary_column(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
