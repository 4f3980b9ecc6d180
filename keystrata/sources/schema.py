"""Table schemas: a JSON document naming typed fields, one of which is the primary key."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: Type names of schema documents.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float": T.FloatType(),
    "float32": T.FloatType(),
    "double": T.DoubleType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}
CANONICAL = {"float32": "float", "float64": "double"}
KEY_TYPES = ("int32", "int64", "string")
INDEX_TYPES = ("none", "kv", "inverted", "vector")
FORMATS = ("json", "fixed_row_binary", "sparse_row_binary")
_FORMAT_ALIAS = {"spare_row_binary": "sparse_row_binary"}


class SchemaError(ValueError):
    """A schema document that does not describe a table."""


@dataclass(frozen=True)
class Field:
    """One column: `number` identifies it across renames."""

    name: str
    kind: str
    number: int = 0
    is_array: bool = False
    nullable: bool = True
    is_index: bool = False
    index_type: str = "none"
    offset: int = 0

    @property
    def data_type(self) -> T.DataType:
        one = TYPES[self.kind]
        return T.ArrayType(one, containsNull=False) if self.is_array else one

    def spark(self) -> T.StructField:
        return T.StructField(self.name, self.data_type, True, {"field_id": self.number, "is_index": self.is_index, "index_type": self.index_type})


@dataclass(frozen=True)
class TableSchema:
    """The fields of a table in order, its key, and what its document says besides."""

    name: str
    key: str
    fields: tuple[Field, ...]
    version: int = 1
    table_format: str = "json"
    extra: dict = field(default_factory=dict, compare=False)

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def key_field(self) -> Field:
        return self[self.key]

    def struct_type(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def by_number(self, number: int) -> Field | None:
        return next((f for f in self.fields if f.number == number), None)

    def validate(self) -> TableSchema:
        """Raises where the key is missing or of a type that keys can't have, or names or numbers repeat."""
        if not self.fields:
            raise SchemaError("schema has no fields")
        for what, values in (("name", self.names), ("field_id", [f.number for f in self.fields])):
            twice = {v for v in values if values.count(v) > 1}
            if twice:
                raise SchemaError(f"duplicate {what}: {sorted(twice)[0]}")
        if self.key not in self.names:
            raise SchemaError(f"primary key {self.key!r} is not a field")
        k = self.key_field
        if k.is_array or k.kind not in KEY_TYPES:
            raise SchemaError(f"primary key {self.key!r} must be int32, int64 or string")
        return self

    def to_json(self) -> str:
        """A document that parse_schema() reads back to an equal schema."""
        return json.dumps(
            {
                "table_name": self.name,
                "schema_version": self.version,
                "table_format": self.table_format,
                "pk": self.key,
                "fields": [
                    {
                        "name": f.name,
                        "field_id": f.number,
                        "data_type": f.kind,
                        "is_array": f.is_array,
                        "nullable": f.nullable,
                        "is_pk": f.name == self.key,
                        "is_index": f.is_index,
                        "index_type": f.index_type,
                        "fixed_off": f.offset,
                    }
                    for f in self.fields
                ],
            },
            ensure_ascii=False,
        )

    def evolve(self, new: TableSchema) -> dict[str, str | None]:
        """For each field of the new schema, the name under which this one stores it, or None if it's added.

        Fields may be added, renamed and dropped. A number that changes its type or becomes an array is refused.
        """
        found: dict[str, str | None] = {}
        for f in new.fields:
            old = self.by_number(f.number)
            if old and (old.kind, old.is_array) != (f.kind, f.is_array):
                raise SchemaError(f"field_id {f.number} changes type from {old.kind} to {f.kind}")
            found[f.name] = old.name if old else None
        if self.key_field.number != new.key_field.number:
            raise SchemaError("the primary key can't change")
        return found


def _strip_comments(text: str) -> str:
    """Takes `//` comments out, but leaves those in strings."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*', lambda m: m[1] or "", text)


def _first(record: dict, *names: str, default=None):
    return next((record[n] for n in names if n in record), default)


def parse_schema(text: str) -> TableSchema:
    """Reads a schema document. Keys that it does not know are skipped."""
    try:
        doc = json.loads(_strip_comments(text))
    except json.JSONDecodeError as e:
        raise SchemaError(f"schema is not JSON: {e}") from e
    if not isinstance(doc, dict) or not isinstance(doc.get("fields"), list):
        raise SchemaError("schema needs a list of fields")
    fields: list[Field] = []
    key = doc.get("pk") or doc.get("primary_key")
    for i, raw in enumerate(doc["fields"]):
        kind = _first(raw, "data_type", "type")
        if "name" not in raw or kind not in TYPES:
            raise SchemaError(f"field {i} needs a name and a known type, not {kind!r}")
        number = int(_first(raw, "field_id", default=0))
        if number == 0 and fields:
            number = max(f.number for f in fields) + 1
        index = _first(raw, "index_type", default="none")
        if index not in INDEX_TYPES:
            raise SchemaError(f"unknown index_type {index!r}")
        fields.append(
            Field(
                raw["name"],
                CANONICAL.get(kind, kind),
                number,
                bool(_first(raw, "is_array", "repeated", default=False)),
                bool(raw.get("nullable", True)),
                bool(raw.get("is_index", False)),
                index,
                int(_first(raw, "field_offset", "fixed_off", default=0)),
            )
        )
        if raw.get("is_pk"):
            key = raw["name"]
    if not key:
        raise SchemaError("schema has no primary key")
    shape = doc.get("table_format", "json")
    shape = _FORMAT_ALIAS.get(shape, shape)
    if shape not in FORMATS:
        raise SchemaError(f"unknown table_format {shape!r}")
    return TableSchema(_first(doc, "table_name", "name", default=""), key, tuple(fields), int(_first(doc, "schema_version", "version", default=1)), shape).validate()


def with_index(schema: TableSchema, *names: str) -> TableSchema:
    """The schema with the named fields indexed."""
    return replace(schema, fields=tuple(replace(f, is_index=f.is_index or f.name in names) for f in schema.fields))
