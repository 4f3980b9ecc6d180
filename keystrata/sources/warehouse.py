"""Warehouse tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.functions.values import project
from keystrata.sources.schema import TableSchema


def read_table(spark: SparkSession, name: str, schema: TableSchema) -> DataFrame:
    """The schema's columns of a table of the session's catalog (Hive's, where the session has it)."""
    return project(spark.table(name), schema, ignore_case=True)


def read_odps(*_: object) -> DataFrame:
    """Not supported: it needs a vendor's reader."""
    raise NotImplementedError("ODPS tables can't be read")
