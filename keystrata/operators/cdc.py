"""Folding change messages into a keyed table, as one set-based plan.

A message is a JSON object or an array of them. `_op` is insert, upsert or delete in any case, and upsert where it is
absent or no text. In the order of (offset, item): an insert fails where its key is live; an upsert overwrites the
scalars that it gives (null and absent ones stay) and appends to arrays; a delete removes the row and never fails.

The fold needs no state in Python: only what follows a key's last delete counts; of that, an insert counts only as
the first operation; scalars are the last value given, arrays all elements in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.values import default_of
from keystrata.sources.schema import Field, TableSchema

OPS = ("insert", "upsert", "delete")
INTEGERS = ("int32", "int64")
_BOUND = {"int32": 31, "int64": 63}


# ---------------------------------------------------------------- parsing


def items_of(messages: DataFrame) -> DataFrame:
    """Rows (offset, value) to (offset, item, doc, parse_error): an object is one item, an array one for each element.

    Text that is not JSON is one row with parse_error; whatever else is neither object nor array has doc null.
    """
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(F.col("v"))
    # Text that is no JSON has v null, and is one item as it is.
    elements = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    each = messages.select("offset", v.alias("v")).select("offset", F.col("v").isNull().alias("parse_error"), F.posexplode(elements).alias("item", "doc"))
    return each.select("offset", F.col("item").cast("long").alias("item"), "doc", "parse_error")


def _at(f: Field) -> str:
    name = f.name.replace("'", "\\'")
    return f"$['{name}']"


def _typed(value: Column, f: Field, kind: str) -> Column:
    """The value of one JSON scalar as a field's kind; null where it does not fit."""
    plain = F.try_variant_get(value, "$", {"bytes": "string"}.get(kind, {"int32": "int", "int64": "bigint"}.get(kind, "boolean" if kind == "bool" else kind)))
    return plain.cast("binary") if kind == "bytes" else plain


def _fits(kind_text: Column, kind: str) -> Column:
    """Whether a JSON value's type can become the kind: numbers don't come from text, nor text from numbers."""
    number = kind_text.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|TINYINT|SMALLINT)")
    if kind in (*INTEGERS, "float", "double"):
        # JSON libraries read true as 1.
        return number | (kind_text == "BOOLEAN")
    if kind == "bool":
        return kind_text == "BOOLEAN"
    return kind_text == "STRING"


def parse(messages: DataFrame, schema: TableSchema) -> DataFrame:
    """Rows (offset, value) to operations: offset, item, op, key, each field (null: absent), status and reason.

    status is ok, apply_error (the item is left out) or parse_error. A value whose JSON type its field can't take
    is a parse error, and it ends its message: the items before it count, those after it do not.
    """
    items = items_of(messages)
    raw = items.withColumns({f"__{f.name}": F.try_variant_get("doc", _at(f), "variant") for f in schema.fields} | {"__op": F.try_variant_get("doc", "$._op", "variant")})
    kinds = {f.name: F.coalesce(F.schema_of_variant(F.col(f"__{f.name}")), F.lit("VOID")) for f in schema.fields}
    op_kind = F.coalesce(F.schema_of_variant(F.col("__op")), F.lit("VOID"))
    op = F.when(op_kind == "STRING", F.lower(F.try_variant_get("__op", "$", "string"))).otherwise("upsert")
    object_ = F.coalesce(F.schema_of_variant(F.col("doc")), F.lit("VOID")).startswith("OBJECT")

    poisons, rejects, values = F.lit(False), F.lit(False), {}
    for f in schema.fields:
        kind, value = kinds[f.name], F.col(f"__{f.name}")
        given = kind != "VOID"
        if f.is_array:
            array = kind.startswith("ARRAY")
            rejects = rejects | (given & ~array)
            parts = F.try_variant_get(value, "$", "array<variant>")
            poisons = poisons | (given & array & F.coalesce(_any_misfit(parts, f), F.lit(False)))
            values[f.name] = F.when(given & array, _elements(parts, f))
        else:
            poisons = poisons | (given & ~_fits(kind, f.kind))
            values[f.name] = F.when(given, _typed(value, f, f.kind))
    key = values[schema.key]
    rows = raw.select(
        "offset", "item", "parse_error", object_.alias("__object"), op.alias("op"), *[v.alias(n) for n, v in values.items()],
        poisons.alias("__poison"), rejects.alias("__reject"), key.cast("string").alias("key"),
    )
    # A delete reads nothing but its key.
    poison = F.col("__poison") & (F.col("op") != "delete") & F.col("op").isin(*OPS) & F.col("key").isNotNull()
    first_bad = F.min(F.when(poison, F.col("item"))).over(Window.partitionBy("offset"))
    reason = (
        F.when(F.col("parse_error"), "invalid JSON")
        .when(F.col("item") >= first_bad, "type mismatch in message")
        .when(~F.col("__object"), "not an object")
        .when(~F.col("op").isin(*OPS), "unknown op")
        .when(F.col("key").isNull() | (F.col("key") == ""), "missing primary key")
        .when(F.col("__reject") & (F.col("op") != "delete"), "array expected")
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "ok").when(F.col("reason").isin("invalid JSON", "type mismatch in message"), "parse_error").otherwise("apply_error")
    return rows.withColumn("status", status).drop("parse_error", "__object", "__poison", "__reject")


def _any_misfit(parts: Column, f: Field) -> Column:
    return F.exists(parts, lambda x: ~_fits(F.coalesce(F.schema_of_variant(x), F.lit("VOID")), f.kind))


def _elements(parts: Column, f: Field) -> Column:
    return F.transform(parts, lambda x: _typed(x, f, f.kind))


# ---------------------------------------------------------------- folding


def _with_base(ops: DataFrame, base: DataFrame | None, schema: TableSchema) -> DataFrame:
    ops = ops.select("offset", "item", "op", "key", *schema.names)
    if base is None:
        return ops
    old = base.select(F.lit(-1).cast("long").alias("offset"), F.lit(0).cast("long").alias("item"), F.lit("upsert").alias("op"), F.col(schema.key).cast("string").alias("key"), *schema.names)
    return ops.unionByName(old)


def _segments(ops: DataFrame) -> DataFrame:
    """Each operation with its key's segment (deletes so far), the number of deletes, and its rank in the segment."""
    whole = Window.partitionBy("key")
    order = whole.orderBy("offset", "item")
    deletes = (F.col("op") == "delete").cast("int")
    seg = ops.withColumn("seg", F.sum(deletes).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tot", F.sum(deletes).over(whole))
    live = seg.where("op <> 'delete'")
    return live.withColumn("rn", F.row_number().over(Window.partitionBy("key", "seg").orderBy("offset", "item")))


def fold(ops: DataFrame, schema: TableSchema, base: DataFrame | None = None, *, defaults: bool = False) -> DataFrame:
    """The table after all operations (those of status ok) on the base. defaults: unset fields as defaults, not nulls.

    One shuffle by key: the windows and the aggregate share its partitioning.
    """
    if "status" in ops.columns:
        ops = ops.where("status = 'ok'")
    kept = _segments(_with_base(ops, base, schema)).where("seg = tot AND (op = 'upsert' OR rn = 1)")
    at = F.struct("offset", "item")
    out = []
    for f in schema.fields:
        if f.name == schema.key:
            out.append(F.max_by(f.name, at).alias(f.name))
        elif f.is_array:
            parts = F.array_sort(F.collect_list(F.struct("offset", "item", F.coalesce(F.col(f.name), default_of(f)).alias("a"))))
            out.append(F.flatten(F.transform(parts, lambda x: x["a"])).alias(f.name))
        else:
            last = F.max_by(f.name, F.when(F.col(f.name).isNotNull(), at))
            out.append((F.coalesce(last, default_of(f)) if defaults else last).alias(f.name))
    return kept.groupBy("key").agg(*out).select(*schema.names)


def fold_into(ops: DataFrame, schema: TableSchema, base: DataFrame) -> DataFrame:
    """fold() on a base of which few keys change: only rows of the keys in ops are folded, the others pass by.

    A pair of joins by key; Spark broadcasts the keys of a small batch, and then the base is not shuffled here.
    """
    if "status" in ops.columns:
        ops = ops.where("status = 'ok'")
    touched = ops.select("key").distinct()
    own = F.col(schema.key).cast("string")
    rows = base.select(own.alias("key"), *schema.names)
    changed = rows.join(touched, "key", "left_semi").select(*schema.names)
    rest = rows.join(touched, "key", "left_anti").select(*schema.names)
    return rest.unionByName(fold(ops, schema, changed))


def rejected_inserts(ops: DataFrame, schema: TableSchema, base: DataFrame | None = None) -> DataFrame:
    """Inserts whose key was live, over the whole log and not only after the last delete: offset, item, key."""
    if "status" in ops.columns:
        ops = ops.where("status = 'ok'")
    return _segments(_with_base(ops, base, schema)).where("op = 'insert' AND rn > 1").select("offset", "item", "key")


def op_stats(ops: DataFrame) -> DataFrame:
    """How many operations of each kind."""
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def error_stats(parsed: DataFrame) -> DataFrame:
    """How many items of each status and reason."""
    return parsed.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))
