"""File inputs: local and remote Parquet and CSV, given one by one, as lists, folders or prefixes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.values import coerce
from keystrata.sources.schema import TableSchema

SUFFIXES = (".parquet", ".csv")
#: Schemes of object stores, and the file systems that read them.
STORES = {"s3": "s3a", "oss": "oss", "cos": "cosn", "obs": "obs", "gs": "gs"}
FILE, ROW, POSITION = "__file", "__row", "__position"


class InputError(ValueError):
    """Inputs that can't be imported."""


def parse_uri(uri: str) -> tuple[str, str, str]:
    """Scheme, bucket and key of an object-store URI."""
    m = re.fullmatch(r"([A-Za-z0-9]+)://([^/]+)/?(.*)", uri.strip())
    if not m or m[1].lower() not in STORES:
        raise InputError(f"not an object-store URI: {uri}")
    return m[1].lower(), m[2], m[3]


def is_store_uri(text: str) -> bool:
    return text.strip().lower().startswith(tuple(f"{s}://" for s in STORES))


def spark_path(uri: str) -> str:
    """The URI by the scheme of the file system that Spark reads it with; local paths stay."""
    if not is_store_uri(uri):
        return uri
    scheme, bucket, key = parse_uri(uri)
    return f"{STORES[scheme]}://{bucket}/{key}"


def _is_data(name: str) -> bool:
    return name.lower().endswith(SUFFIXES)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """All data files below a folder or prefix of any file system, sorted; none is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark_path(folder))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise InputError(f"no such folder: {folder}")
    files, found = system.listFiles(path, True), []
    while files.hasNext():
        name = files.next().getPath().toString()
        if _is_data(name):
            found.append(name)
    if not found:
        raise InputError(f"no .parquet or .csv under {folder}")
    return sorted(found)


def read_list(path: str, spark: SparkSession | None = None) -> list[str]:
    """Inputs of a list file: a line each, blank lines skipped, space at line ends cut.

    With a session, the list may be in any file system that Spark reads.
    """
    if spark is None:
        text = Path(path).read_text(encoding="utf-8")
    else:
        text = spark.read.text(spark_path(path), wholetext=True).first()[0]
    return [line.rstrip() for line in text.splitlines() if line.strip()]


def expand(spark: SparkSession, inputs: Iterable[str]) -> list[str]:
    """Files of explicit inputs; those that end in / are prefixes to list."""
    out: list[str] = []
    for item in inputs:
        if item.endswith("/"):
            out += listed(spark, item)
        elif _is_data(item):
            out.append(spark_path(item))
        else:
            raise InputError(f"not a .parquet or .csv: {item}")
    if not out:
        raise InputError("no inputs")
    return out


def read_parquet(spark: SparkSession, paths: list[str], schema: TableSchema) -> DataFrame:
    """The schema's columns, found by exact name, with where each row came from."""
    frame = spark.read.parquet(*paths)
    missing = [n for n in schema.names if n not in frame.columns]
    if missing:
        raise InputError(f"parquet missing column: {missing[0]}")
    tagged = frame.select(*[F.col(f"`{n}`") for n in schema.names], F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    kinds = {c.name: c.dataType for c in tagged.schema.fields}
    return tagged.select(*[coerce(F.col(f"`{f.name}`"), kinds[f.name], f).alias(f.name) for f in schema.fields], FILE, ROW)


def read_csv(spark: SparkSession, path: str, schema: TableSchema) -> DataFrame:
    """The schema's columns of a file with a header, typed by the schema; a cell that doesn't fit fails the job."""
    arrays = [f.name for f in schema.fields if f.is_array]
    if arrays:
        raise InputError(f"csv can't hold the array field {arrays[0]}")
    header = spark.read.option("header", True).csv(path).columns
    missing = [n for n in schema.names if n not in header]
    if missing:
        raise InputError(f"csv missing column: {missing[0]}")
    # Columns stand where the header says; those that no field has are read as text and dropped.
    kinds = {f.name: T.StringType() if f.kind == "bytes" else f.data_type for f in schema.fields}
    shape = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    frame = spark.read.schema(shape).option("header", True).option("mode", "FAILFAST").csv(path)
    out = [F.col(f"`{f.name}`").cast(f.data_type).alias(f.name) for f in schema.fields]
    return frame.select(*out, F.col("_metadata.file_path").alias(FILE), F.monotonically_increasing_id().alias(ROW))


def _resolved(spark: SparkSession, inputs: list[str]) -> list[str]:
    """The files that inputs stand for, in order: an input that is a folder (as Spark writes) gives its parts, sorted."""
    out = []
    for item in inputs:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(item)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            raise InputError(f"no such input: {item}")
        if not system.getFileStatus(path).isDirectory():
            out.append(system.makeQualified(path).toUri().toString())
            continue
        files, found = system.listFiles(path, True), []
        while files.hasNext():
            one = files.next().getPath()
            if one.getName()[0] not in "._":
                found.append(one.toUri().toString())
        out += sorted(found)
    return out


def _placed(frame: DataFrame, files: list[str]) -> DataFrame:
    """Rows with the place of their file among the inputs, found in a table of as many rows as there are files."""
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/")
    places = frame.sparkSession.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(files))], "__path string, __place int")
    joined = frame.join(places.select(plain("__path").alias("__path"), "__place"), plain(FILE) == F.col("__path"), "left")
    place = F.coalesce("__place", F.raise_error(F.concat(F.lit("a row of no input: "), F.col(FILE))).cast("int"))
    return joined.withColumn(POSITION, place).drop("__path", "__place")


def read(spark: SparkSession, files: list[str], schema: TableSchema) -> DataFrame:
    """All files, of either format, as one frame with __position, __file and __row, which order rows of equal key.

    Positions follow the order in which the inputs are given, not that of their names.
    """
    parquet = [f for f in files if f.lower().endswith(".parquet")]
    frames = [read_parquet(spark, parquet, schema)] if parquet else []
    frames += [read_csv(spark, f, schema) for f in files if f.lower().endswith(".csv")]
    if not frames:
        raise InputError("no inputs")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return _placed(out, _resolved(spark, files))


def estimate_rows(spark: SparkSession, files: list[str]) -> int:
    """Rows of the inputs: Parquet answers from its footers; CSV counts lines but for the header; remote CSV is left out."""
    total = 0
    parquet = [f for f in files if f.lower().endswith(".parquet")]
    if parquet:
        total += spark.read.parquet(*parquet).count()
    for f in files:
        if f.lower().endswith(".csv") and not re.match(r"[a-z0-9]+://", f):
            total += max(0, spark.read.text(f).count() - 1)
    return total


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a text file, a line each; blank lines and lines that are URIs are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("key")).where((F.col("key") != "") & ~F.col("key").rlike("^[a-z0-9]+://"))


def keys_of(snapshot: DataFrame, key: str, limit: int) -> DataFrame:
    """The texts of at most limit keys that are neither null nor empty."""
    text = F.col(key).cast("string")
    return snapshot.where(text.isNotNull() & (text != "")).select(text.alias("key")).limit(limit)
