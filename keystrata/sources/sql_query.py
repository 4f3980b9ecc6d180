"""Rows of a query against a database that speaks MySQL's protocol, through Spark's JDBC reader."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.values import CoercionError, parse_text
from keystrata.sources.schema import TableSchema

FETCH = 4096


@dataclass(frozen=True)
class Slices:
    """A numeric or time column of the query, and into how many ranges between two values reads are split."""

    column: str
    low: str
    high: str
    count: int


def options(connection: Mapping[str, str], query: str, init: list[str] = (), slices: Slices | None = None) -> dict[str, str]:
    """Options of the JDBC reader. Without slices one task reads the whole result; rows outside the range are read too."""
    out = {
        "url": f"jdbc:mysql://{connection['host']}:{connection['port']}/{connection['database']}",
        "user": connection["user"],
        "password": connection.get("password", ""),
        "query": query,
        "fetchsize": str(FETCH),
        "driver": "com.mysql.cj.jdbc.Driver",
    }
    if slices:
        # Spark splits tables only, so the query stands as one.
        out["dbtable"] = f"({out.pop('query').strip().rstrip(';')}) AS result"
        out |= {"partitionColumn": slices.column, "lowerBound": slices.low, "upperBound": slices.high, "numPartitions": str(slices.count)}
    if init:
        out["sessionInitStatement"] = ";".join(s.strip().rstrip(";") for s in init if s.strip())
    return out


def typed(result: DataFrame, schema: TableSchema) -> DataFrame:
    """A query's columns, found in any case, read from their text as the fields' types."""
    out = []
    for f in schema.fields:
        found = [c for c in result.columns if c.lower() == f.name.lower()]
        if len(found) != 1:
            raise CoercionError(f"{'missing' if not found else 'ambiguous'} column: {f.name}")
        out.append(parse_text(F.col(f"`{found[0]}`").cast("string"), f).alias(f.name))
    return result.select(*out)


def read(spark: SparkSession, connection: Mapping[str, str], query: str, schema: TableSchema, init: list[str] = (), slices: Slices | None = None) -> DataFrame:
    """The rows of a query as typed columns; the driver's jar has to be on Spark's class path."""
    return typed(spark.read.format("jdbc").options(**options(connection, query, init, slices)).load(), schema)
