"""Boolean retrieval on postings (field_id, term, key).

Text fields give their tokens, integer fields their decimal text; array fields give those of each element. A query
term is lower-cased (A-Z) but not split, so a phrase matches nothing. Postings name documents by primary key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.arrays import lower_ascii, tokens
from keystrata.functions.values import materialise
from keystrata.operators import kv
from keystrata.sources.schema import Field, TableSchema


def normalise(term: str) -> str:
    """A-Z in lower case, all else as it is."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)


def terms_of(f: Field) -> Column | None:
    """An array of the terms that a field's value is found under; None for kinds that aren't indexed."""
    value = F.col(f.name)
    if f.kind == "string":
        return F.flatten(F.transform(value, tokens)) if f.is_array else tokens(value)
    if f.kind in ("int32", "int64"):
        return F.transform(value, lambda x: x.cast("string")) if f.is_array else F.array(F.coalesce(value, F.lit(0)).cast("string"))
    return None


def postings(snapshot: DataFrame, schema: TableSchema) -> DataFrame:
    """Distinct (field_id, term, key) of all indexed fields, in one pass over the rows.

    Terms are made distinct within a row's array; a key has one row, so no shuffle is needed. A row becomes one row a
    field with its array of terms, and then one a term.
    """
    shape = "array<struct<field_id:int,terms:array<string>>>"
    parts = []
    for f in schema.fields:
        terms = terms_of(f) if f.is_index else None
        if terms is not None:
            parts.append(F.struct(F.lit(f.number).alias("field_id"), F.array_distinct(terms).alias("terms")))
    fields = snapshot.select(F.col(schema.key).alias("key"), F.explode(F.array(*parts).cast(shape)).alias("p"))
    return fields.select(F.col("p.field_id").alias("field_id"), F.explode("p.terms").alias("term"), "key")


def query(index: DataFrame, field_id: int, term: str) -> DataFrame:
    """Keys under one term."""
    return index.where((F.col("field_id") == field_id) & (F.col("term") == normalise(term))).select("key")


def query_and(index: DataFrame, field_id: int, terms: Sequence[str]) -> DataFrame:
    """Keys under all terms; none for no terms. One pass: filtered rows are counted by key."""
    wanted = sorted({normalise(t) for t in terms})
    rows = index.where((F.col("field_id") == field_id) & F.col("term").isin(wanted))
    return rows.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") == len(wanted)).where(F.lit(bool(wanted))).select("key")


def query_or(index: DataFrame, field_id: int, terms: Sequence[str]) -> DataFrame:
    """Keys under any term; none for no terms."""
    wanted = sorted({normalise(t) for t in terms})
    return index.where((F.col("field_id") == field_id) & F.col("term").isin(wanted)).select("key").distinct()


def fetch(keys: DataFrame, snapshot: DataFrame, schema: TableSchema) -> DataFrame:
    """The rows of keys found."""
    return materialise(snapshot.join(keys.select(F.col("key").alias(schema.key)), schema.key, "left_semi"), schema)


def term_stats(index: DataFrame) -> DataFrame:
    """How many documents each term is in."""
    return index.groupBy("field_id", "term").agg(F.count("*").alias("n_docs"))


def without(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Postings without those of the keys given."""
    return index.join(keys.select("key"), "key", "left_anti").select("field_id", "term", "key")


def put(snapshot: DataFrame, index: DataFrame, delta: DataFrame, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """Rows of delta replace those of their keys, in the table and in the postings."""
    fresh = kv._aligned(delta, schema)
    keys = fresh.select(F.col(schema.key).alias("key"))
    return kv.upsert(snapshot, delta, schema), without(index, keys).unionByName(postings(fresh, schema))


def delete(snapshot: DataFrame, index: DataFrame, keys: DataFrame, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """Table and postings without the keys of a frame (key)."""
    return kv.delete(snapshot, keys, schema), without(index, keys)
