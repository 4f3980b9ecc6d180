"""Bulk import: inputs to a committed snapshot."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from keystrata.functions.values import valid_key
from keystrata.operators import kv
from keystrata.plans.catalog import Table
from keystrata.sources import files
from keystrata.sources.schema import TableSchema


@dataclass(frozen=True)
class ImportResult:
    """What an import did: rows counts all rows taken, repeats of a key included."""

    files: int
    rows: int
    skipped_pk_null: int
    wall_sec: float
    rows_per_sec: float
    build_id: str

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def rows_of(frame: DataFrame, schema: TableSchema) -> DataFrame:
    """One row a key of an input read by files.read(): the last by the order of the inputs, then by row."""
    good = kv.drop_bad_keys(frame, schema)
    return kv.last_wins(good, schema.key, F.col(files.POSITION), F.col(files.ROW)).select(*schema.names)


def run(table: Table, inputs: list[str]) -> ImportResult:
    """Imports files into a table; the counts come with the write, not by passes of their own."""
    began, schema, spark = time.time(), table.schema(), table.catalog.spark
    paths = files.expand(spark, inputs)
    frame = files.read(spark, paths, schema)
    good = valid_key(F.col(schema.key))
    seen = Observation()
    counted = frame.observe(seen, F.count_if(good).alias("rows"), F.count_if(~good).alias("skipped"))
    build = table.commit(rows_of(counted, schema))
    took, n = time.time() - began, seen.get
    return ImportResult(len(paths), n["rows"], n["skipped"], round(took, 3), round(n["rows"] / took, 1), build)


def run_query(table: Table, result: DataFrame) -> ImportResult:
    """Imports the typed rows of a query; of repeated keys, one with the greatest values stays, as rows have no order."""
    began, schema = time.time(), table.schema()
    good = valid_key(F.col(schema.key))
    seen = Observation()
    counted = result.observe(seen, F.count_if(good).alias("rows"), F.count_if(~good).alias("skipped"))
    scalars = [F.col(f.name) for f in schema.fields if not f.is_array]
    build = table.commit(kv.last_wins(kv.drop_bad_keys(counted, schema), schema.key, *scalars))
    took, n = time.time() - began, seen.get
    return ImportResult(0, n["rows"], n["skipped"], round(took, 3), round(n["rows"] / took, 1), build)
