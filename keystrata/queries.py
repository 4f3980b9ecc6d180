"""The registered queries of the keyed-table engine, each with the SQL that DuckDB runs to the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions import arrays, values
from keystrata.operators import bitmap, cdc, inverted, kv
from keystrata.plans import importer, metrics
from keystrata.plans.catalog import Catalog
from keystrata.plans.scratch import shared_folder
from keystrata.sources import generators
from keystrata.sources.schema import Field, TableSchema
from keystrata.streaming import ingest
from keystrata.streaming.ingest import seek_column

_KIND = {T.BooleanType: "bool", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}


def schema_of(frame: DataFrame, key: str, *indexed: str) -> TableSchema:
    """A table schema with the fields of a frame, numbered from 1."""
    fields = []
    for i, c in enumerate(frame.schema.fields, 1):
        array = isinstance(c.dataType, T.ArrayType)
        kind = _KIND[type(c.dataType.elementType if array else c.dataType)]
        fields.append(Field(c.name, kind, i, array, is_index=c.name in indexed))
    return TableSchema("t", key, tuple(fields)).validate()


def _table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def _orders(spark, sf):
    t = _table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return t, schema_of(t, "o_orderkey")


def _customer(spark, sf):
    t = _table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return t, schema_of(t, "c_custkey")


def _part(spark, sf, *indexed):
    t = _table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return t, schema_of(t, "p_partkey", *indexed)


def _documents(spark, sf):
    t = _table(spark, sf, "documents", "doc_id", "text", "lang")
    return t, schema_of(t, "doc_id", "text")


def _postings(spark, sf):
    return inverted.postings(*_documents(spark, sf))


_STORED: dict[tuple[str, str], str] = {}


def _stored(spark, sf):
    """The active version of an inverted table of all documents, which is built once in a session."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        rows, schema = _documents(spark, sf)
        folder = shared_folder(spark)
        Catalog(spark, folder).create("documents", schema, "inverted").commit(rows)
        _STORED[at] = folder
    return Catalog(spark, _STORED[at]).open("documents", "inverted").acquire()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- reads by key

_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query(f"SELECT {_ORDER_COLUMNS} FROM orders WHERE o_orderkey = 7")
def kv_get_hit(spark, sf):
    return kv.get(*_orders(spark, sf), 7)


@query(f"SELECT {_ORDER_COLUMNS} FROM orders WHERE false")
def kv_get_miss(spark, sf):
    return kv.get(*_orders(spark, sf), "007")


@query(f"""SELECT k.pos, o.o_orderkey IS NOT NULL AS found, {_ORDER_COLUMNS}
FROM (SELECT i AS pos, CASE WHEN i % 7 = 3 THEN -i ELSE i * 3 % 1501 END AS key FROM range(0, 500) r(i)) k LEFT JOIN orders o ON o.o_orderkey = k.key""")
def kv_batch_get_positional(spark, sf):
    keys = spark.range(500).select(F.col("id").alias("pos"), F.when(F.col("id") % 7 == 3, -F.col("id")).otherwise(F.col("id") * 3 % 1501).alias("key"))
    return kv.batch_get_positional(*_orders(spark, sf), keys)


@query("""SELECT k.pos, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM
(VALUES (0, 5), (1, 1), (2, 999999999), (3, 5), (4, 42), (5, -1)) k(pos, key) JOIN customer ON c_custkey = k.key""")
def kv_batch_get_hits_only(spark, sf):
    customers, schema = _customer(spark, sf)
    return kv.batch_get_hits(customers, schema, kv.keys_frame(customers, schema, [5, 1, 999999999, "5", 42, -1]))


@query("SELECT count(*) AS size FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def kv_size(spark, sf):
    lines = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return kv.size(kv.last_wins(lines, "l_orderkey", F.col("l_linenumber")))


# ---------------------------------------------------------------- imports

_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag"
_LINE_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS rn FROM lineitem) WHERE rn = 1"


def _last_lines(lines: DataFrame) -> DataFrame:
    return kv.last_wins(lines, "l_orderkey", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate"))


@query(f"SELECT {_LINE} FROM ({_LINE_LAST})")
def kv_import_last_wins(spark, sf):
    return _last_lines(_table(spark, sf, "lineitem")).select(*_LINE.split(", "))


@query("SELECT count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0) AS rows, count(*) FILTER (event_id % 5 = 0 OR event_id % 7 = 0) AS skipped_pk_null FROM events")
def kv_import_skip_null_pk(spark, sf):
    e = _table(spark, sf, "events", "event_id", "value")
    key = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_id").cast("string"))
    keyed = e.select(key.alias("pk"), "value")
    return kv.import_counts(keyed, schema_of(keyed, "pk"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def project_schema_fields(spark, sf):
    schema = TableSchema("l", "l_orderkey", (Field("l_orderkey", "int64", 1), Field("l_linenumber", "int32", 2), Field("l_quantity", "double", 3)))
    return values.project(_table(spark, sf, "lineitem"), schema)


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey FROM orders")
def coerce_int64_to_int32(spark, sf):
    schema = TableSchema("o", "o_orderkey", (Field("o_orderkey", "int64", 1), Field("o_custkey", "int32", 2)))
    return values.project(_table(spark, sf, "orders"), schema)


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_id % 3 <> 0 AS flag, CAST(user_id AS INTEGER) AS n, CAST(value AS DOUBLE) AS x FROM events""")
def parse_query_text(spark, sf):
    from keystrata.sources.sql_query import typed

    e = _table(spark, sf, "events", "event_id", "user_id", "value")
    flag = F.when(F.col("event_id") % 3 == 0, "FALSE").when(F.col("event_id") % 3 == 1, "true").otherwise("17")
    text = e.select(F.col("event_id").cast("string").alias("ID"), flag.alias("Flag"), F.col("user_id").cast("string").alias("N"), F.col("value").cast("string").alias("X"))
    schema = TableSchema("e", "id", (Field("id", "string", 1), Field("flag", "bool", 2), Field("n", "int32", 3), Field("x", "double", 4)))
    return typed(text, schema)


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END, 0) AS user_id,
coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END, '') AS event_type, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, 0.0) AS value FROM events""")
def row_defaults(spark, sf):
    e = _table(spark, sf, "events")
    hole = lambda c, m: F.when(F.col("event_id") % m != 0, F.col(c)).alias(c)
    rows = e.select("event_id", hole("user_id", 3), hole("event_type", 4), hole("value", 5))
    return values.materialise(rows, schema_of(rows, "event_id"))


@query("""SELECT count(*) AS rows, count(DISTINCT p_size) AS distinct_keys, count(*) - count(DISTINCT p_size) AS duplicate_keys,
count(*) FILTER (p_retailprice <= 1000) AS low_price, count(*) FILTER (length(p_name) > 20) AS long_name FROM part""")
def contract_violations(spark, sf):
    part = _table(spark, sf, "part")
    return values.contract(part, "p_size", {"low_price": F.col("p_retailprice") > 1000, "long_name": F.char_length("p_name") <= 20})


@query("""SELECT i + 1 AS id, CAST(i * 17 % 1000 + 1 AS INTEGER) AS brand_id, CAST(i * 13 % 1000000 AS INTEGER) AS click_num,
'pd' || lpad(CAST(i % 50000 AS VARCHAR), 5, '0') || 'a' || (i * 7 % 10000) AS title,
CASE WHEN i % 3 = 0 THEN CAST(i % 98 + 1 AS VARCHAR) ELSE (i % 98 + 1) || ',' || (i // 100 % 98 + 1) END AS category_ids FROM range(0, 20000) r(i)""")
def product_generator(spark, sf):
    return generators.products(spark, 20_000)


@query("SELECT 20000 AS rows, 20000 AS distinct_keys, 0 AS duplicate_keys, 0 AS bad_brand, 0 AS bad_click, 0 AS bad_title, 0 AS bad_category")
def product_contract(spark, sf):
    return values.contract(generators.products(spark, 20_000), "id", values.product_rules())


@query("""SELECT i AS id, i % 2 = 1 AS f_bool, i * 1000003 AS f_i64, CAST((i % 10000) * 0.25 AS DOUBLE) AS f_f32, CAST(xor(i, 1515870810) AS INTEGER) AS f_i32,
array_to_string(list_transform(range(0, 192), lambda k: chr(CAST(65 + (i + k) % 26 AS INTEGER))), '') AS f_str, upper(array_to_string(list_transform(range(0, 192), lambda k: printf('%02x', (i * 131 + k) % 256)), '')) AS f_bytes,
array_to_string(list_transform(range(0, 48), lambda k: i + k), ',') AS arr_i32, array_to_string(list_transform(range(0, 32), lambda k: i * 31 + k), ',') AS arr_i64 FROM range(1, 5001) r(i)""")
def wide_generator(spark, sf):
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return generators.wide(spark, 5000).select(
        "id", "f_bool", "f_i64", F.col("f_f32").cast("double").alias("f_f32"), "f_i32", "f_str", F.hex("f_bytes").alias("f_bytes"), show("arr_i32"), show("arr_i64")
    )


# ---------------------------------------------------------------- writes

_DELTA = "SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 1"


@query(f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_DELTA}))
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, '' AS o_orderpriority FROM ({_DELTA})""")
def kv_upsert_replace(spark, sf):
    orders, schema = _orders(spark, sf)
    odd = orders.where("o_orderkey % 2 = 1")
    delta = odd.select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return values.materialise(kv.upsert(orders, delta, schema), schema)


@query(f"""WITH d AS (SELECT l_orderkey AS o_orderkey, l_partkey AS o_custkey, l_returnflag AS o_orderstatus, l_quantity AS o_totalprice, l_linestatus AS o_orderpriority FROM ({_LINE_LAST}))
SELECT {_ORDER_COLUMNS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT {_ORDER_COLUMNS} FROM d""")
def kv_batch_upsert_dups(spark, sf):
    orders, schema = _orders(spark, sf)
    lines = _table(spark, sf, "lineitem")
    return kv.batch_upsert(orders, _line_orders(lines), schema, *_line_order())


def _line_order():
    return [F.col(f"__{c}") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]


def _line_orders(lines: DataFrame) -> DataFrame:
    """Lines as rows of orders, many to a key, with what orders them."""
    shown = [F.col(a).alias(b) for a, b in (("l_orderkey", "o_orderkey"), ("l_partkey", "o_custkey"), ("l_returnflag", "o_orderstatus"), ("l_quantity", "o_totalprice"), ("l_linestatus", "o_orderpriority"))]
    return lines.select(*shown, *[F.col(c).alias(f"__{c}") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")])


@query(f"""WITH d AS (SELECT l_orderkey AS o_orderkey, l_partkey AS o_custkey, l_returnflag AS o_orderstatus, l_quantity AS o_totalprice, l_linestatus AS o_orderpriority FROM ({_LINE_LAST}))
SELECT {_ORDER_COLUMNS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT {_ORDER_COLUMNS} FROM d""")
def kv_put_batch(spark, sf):
    """The atomic batch, of which every row is good."""
    orders, schema = _orders(spark, sf)
    return kv.put_batch(orders, _line_orders(_table(spark, sf, "lineitem")), schema, *_line_order())


@query("SELECT 'the batch is refused' AS outcome, count(*) AS rows FROM part")
def kv_put_batch_rejected(spark, sf):
    """The atomic batch with one row without a key: nothing of it is applied."""
    part, schema = _part(spark, sf)
    bad = part.withColumn("p_partkey", F.when(F.col("p_size") < 50, F.col("p_partkey"))).withColumn("p_size", -F.col("p_size"))
    try:
        kv.put_batch(part, bad, schema, F.col("p_name"))
        outcome = "the batch is applied"
    except kv.RejectedBatch:
        outcome = "the batch is refused"
    return kv.size(part).select(F.lit(outcome).alias("outcome"), F.col("size").alias("rows"))


@query(f"""WITH d AS (SELECT l_orderkey AS o_orderkey, l_partkey AS o_custkey, l_returnflag AS o_orderstatus, l_quantity AS o_totalprice, l_linestatus AS o_orderpriority FROM ({_LINE_LAST}))
SELECT {_ORDER_COLUMNS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT {_ORDER_COLUMNS} FROM d""")
def kv_batch_put(spark, sf):
    orders, schema = _orders(spark, sf)
    return kv.batch_put(orders, _line_orders(_table(spark, sf, "lineitem")), schema, *_line_order())


@query("SELECT s_suppkey AS c_custkey, s_name AS c_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def kv_put(spark, sf):
    """Suppliers put among customers: keys that are live answer with the new row."""
    customers = _table(spark, sf, "customer", "c_custkey", "c_name")
    return kv.put(customers, _table(spark, sf, "supplier", F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), schema_of(customers, "c_custkey"))


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def kv_put_batch_atomic_reject(spark, sf):
    part, schema = _part(spark, sf)
    delta = part.where("p_partkey % 3 = 0").withColumn("p_size", -F.col("p_size"))
    return kv.put_batch_or_keep(part, delta, schema, F.col("p_size") > -50)


@query("""SELECT p_partkey, p_name, p_brand, CAST(CASE WHEN p_partkey % 3 = 0 THEN -p_size ELSE p_size END AS INTEGER) AS p_size, p_retailprice FROM part""")
def kv_put_batch_atomic_apply(spark, sf):
    part, schema = _part(spark, sf)
    delta = part.where("p_partkey % 3 = 0").withColumn("p_size", -F.col("p_size"))
    return kv.put_batch_or_keep(part, delta, schema, F.col("p_size") >= -50)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def kv_delete(spark, sf):
    return kv.delete(_customer(spark, sf)[0], _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")), _customer(spark, sf)[1])


@query("SELECT i AS key, i IN (SELECT c_custkey FROM customer) AS existed FROM range(0, 4000, 7) r(i)")
def kv_delete_existed(spark, sf):
    return kv.existed(_customer(spark, sf)[0], spark.range(0, 4000, 7).select(F.col("id").alias("key")), _customer(spark, sf)[1])


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS doc_id FROM customer")
def kv_numbered(spark, sf):
    return kv.numbered(_customer(spark, sf)[0], _customer(spark, sf)[1]).select("c_custkey", "doc_id")


# ---------------------------------------------------------------- boolean retrieval

_TOKENS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_POST = f"(SELECT DISTINCT doc_id AS key, unnest({_TOKENS}) AS term FROM documents)"


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, sha256(array_to_string({_TOKENS}, ' ')) AS tokens_sha256 FROM documents")
def inv_tokenize(spark, sf):
    words = arrays.tokens(F.col("text"))
    return _table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.sha2(F.array_join(words, " "), 256).alias("tokens_sha256"))


@query(f"SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def inv_tokens(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(arrays.tokens(F.col("text"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT 2 AS field_id, term, key FROM {_POST}")
def inv_postings(spark, sf):
    return _postings(spark, sf)


@query(f"SELECT 2 AS field_id, term, count(*) AS n_docs FROM {_POST} GROUP BY term")
def inv_term_df(spark, sf):
    return inverted.term_stats(_stored(spark, sf).postings)


@query(f"SELECT key FROM {_POST} WHERE term = 'the'")
def inv_query_term(spark, sf):
    return inverted.query(_stored(spark, sf).postings, 2, "THE")


@query("SELECT doc_id AS key FROM documents WHERE false")
def inv_query_phrase_empty(spark, sf):
    return inverted.query(_stored(spark, sf).postings, 2, "the of")


@query(f"SELECT key FROM {_POST} WHERE term IN ('the', 'of', 'and') GROUP BY key HAVING count(*) = 3")
def inv_query_and(spark, sf):
    return inverted.query_and(_stored(spark, sf).postings, 2, ["the", "Of", "and", "the"])


@query("SELECT doc_id AS key FROM documents WHERE false")
def inv_query_and_missing(spark, sf):
    return inverted.query_and(_stored(spark, sf).postings, 2, ["the", "zzzzqqqq"])


@query(f"SELECT DISTINCT key FROM {_POST} WHERE term IN ('der', 'la')")
def inv_query_or(spark, sf):
    return inverted.query_or(_stored(spark, sf).postings, 2, ["der", "la", "zzzzqqqq"])


@query("SELECT p_partkey AS key FROM part WHERE p_size = 25")
def inv_int_field(spark, sf):
    return inverted.query(inverted.postings(*_part(spark, sf, "p_size")), 4, "25")


@query(f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Fresh words ' || lang ELSE text END AS text FROM documents),
p AS (SELECT DISTINCT doc_id AS key, unnest({_TOKENS}) AS term FROM n) SELECT term, count(*) AS n_docs FROM p GROUP BY term""")
def inv_update_reindex(spark, sf):
    docs, schema = _documents(spark, sf)
    delta = docs.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("Fresh words "), F.col("lang")))
    _, index = inverted.put(docs, inverted.postings(docs, schema), delta, schema)
    return inverted.term_stats(index).drop("field_id")


@query(f"SELECT key, count(*) AS n_terms FROM {_POST} WHERE key % 4 <> 1 GROUP BY key")
def inv_delete(spark, sf):
    docs, schema = _documents(spark, sf)
    _, index = inverted.delete(docs, inverted.postings(docs, schema), docs.where("doc_id % 4 = 1").select(F.col("doc_id").alias("key")), schema)
    return index.groupBy("key").agg(F.count("*").alias("n_terms"))


@query(f"SELECT doc_id, text, lang FROM documents WHERE doc_id IN (SELECT key FROM {_POST} WHERE term IN ('the', 'is') GROUP BY key HAVING count(*) = 2)")
def inv_fetch_docs(spark, sf):
    held = _stored(spark, sf)
    return inverted.fetch(inverted.query_and(held.postings, 2, ["the", "is"]), held.rows, held.schema)


# ---------------------------------------------------------------- sets


_A = "(SELECT DISTINCT o_custkey AS x FROM orders)"
_B = "(SELECT DISTINCT user_id AS x FROM events)"


def _ab(spark, sf):
    """Customers with orders and users with events: two whole sets that overlap."""
    return bitmap.as_set(_table(spark, sf, "orders"), "o_custkey"), bitmap.as_set(_table(spark, sf, "events"), "user_id")


@query(f"SELECT x FROM {_A} UNION SELECT x FROM {_B}")
def bm_or(spark, sf):
    return bitmap.union(*_ab(spark, sf))


@query(f"SELECT x FROM {_A} INTERSECT SELECT x FROM {_B}")
def bm_and(spark, sf):
    return bitmap.intersection(*_ab(spark, sf))


@query(f"(SELECT x FROM {_A} EXCEPT SELECT x FROM {_B}) UNION (SELECT x FROM {_B} EXCEPT SELECT x FROM {_A})")
def bm_xor(spark, sf):
    return bitmap.xor(*_ab(spark, sf))


@query(f"SELECT x FROM {_A} EXCEPT SELECT x FROM {_B}")
def bm_andnot(spark, sf):
    return bitmap.difference(*_ab(spark, sf))


@query(f"SELECT count(*) AS cardinality FROM {_A}")
def bm_cardinality(spark, sf):
    return bitmap.packed_cardinality(bitmap.pack(_ab(spark, sf)[0]))


@query(f"SELECT count(*) AS cardinality FROM (SELECT x FROM {_A} INTERSECT SELECT x FROM {_B})")
def bm_packed_and(spark, sf):
    a, b = _ab(spark, sf)
    return bitmap.packed_cardinality(bitmap.packed_intersection(bitmap.pack(a), bitmap.pack(b)))


@query(f"SELECT count(*) AS cardinality FROM (SELECT x FROM {_A} UNION SELECT x FROM {_B})")
def bm_packed_or(spark, sf):
    a, b = _ab(spark, sf)
    return bitmap.packed_cardinality(bitmap.packed_union(bitmap.pack(a), bitmap.pack(b)))


@query(f"SELECT i AS x, i IN (SELECT x FROM {_A}) AS contained FROM range(0, 200) r(i)")
def bm_contains(spark, sf):
    return bitmap.contains(spark.range(200).select(F.col("id").alias("x")), _ab(spark, sf)[0])


@query("SELECT DISTINCT event_type, user_id AS x FROM events")
def bm_wire_round_trip(spark, sf):
    """Users of each type, as blobs and back."""
    users = _table(spark, sf, "events", "event_type", F.col("user_id").alias("x"))
    return bitmap.deserialised(bitmap.serialised(users, "event_type"))


@query("""SELECT event_type, CAST(12 + sum(12 + CASE WHEN n > 4096 THEN 8192 ELSE 2 * n END) AS BIGINT) AS bytes
FROM (SELECT event_type, user_id >> 16 AS high, count(DISTINCT user_id) AS n FROM events GROUP BY ALL) GROUP BY event_type""")
def bm_wire_bytes(spark, sf):
    users = _table(spark, sf, "events", "event_type", F.col("user_id").alias("x"))
    blobs = bitmap.serialised(users, "event_type").select("event_type", F.octet_length("blob").cast("long").alias("made"))
    return bitmap.serialised_bytes(users, "event_type").join(blobs, "event_type").select("event_type", F.when(F.col("bytes") == F.col("made"), F.col("bytes")).alias("bytes"))


@query(f"SELECT x FROM {_A} ORDER BY x")
def bm_ascending(spark, sf):
    return bitmap.ascending(_ab(spark, sf)[0])


@query(f"SELECT x FROM {_A} UNION SELECT i FROM range(0, 50) r(i)")
def bm_add(spark, sf):
    return bitmap.add(_ab(spark, sf)[0], spark.range(50).select(F.col("id").alias("x")))


@query(f"SELECT x FROM {_A} WHERE x >= 50")
def bm_remove(spark, sf):
    return bitmap.remove(_ab(spark, sf)[0], spark.range(50).select(F.col("id").alias("x")))


# ---------------------------------------------------------------- change folding

_CDC = TableSchema("user", "user_id", (Field("user_id", "int64", 1), Field("value", "double", 2), Field("kind", "string", 3), Field("clicks", "int64", 4, True)))


def _ops(spark, sf) -> DataFrame:
    """events as operations: signup inserts, error deletes, the rest upserts; some fields are left out."""
    e = _table(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return e.select(
        F.col("event_id").alias("offset"), F.lit(0).cast("long").alias("item"), op.alias("op"), F.col("user_id").cast("string").alias("key"), "user_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 5 != 0, F.array("event_id")).alias("clicks"),
    )


_OPS_SQL = """o AS (SELECT event_id AS off, user_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op,
  CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 <> 0 THEN [event_id] END AS clicks FROM events)"""
_SEG_SQL = """s AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY off ROWS UNBOUNDED PRECEDING) AS seg,
  sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS tot FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY off) AS rn FROM s WHERE op <> 'delete'),
k AS (SELECT * FROM r WHERE seg = tot AND (op = 'upsert' OR rn = 1))"""
_FOLD_SQL = f"WITH {_OPS_SQL}, {_SEG_SQL}"
_SCALARS = "coalesce(max_by(value, off) FILTER (value IS NOT NULL), 0.0) AS value, coalesce(max_by(kind, off) FILTER (kind IS NOT NULL), '') AS kind"
_CLICKS = "array_to_string(flatten(list(coalesce(clicks, []) ORDER BY off)), ',') AS clicks"


def _shown(frame: DataFrame) -> DataFrame:
    return frame.withColumn("clicks", F.array_join(F.transform("clicks", lambda x: x.cast("string")), ","))


@query(f"{_FOLD_SQL} SELECT user_id, {_SCALARS} FROM k GROUP BY user_id")
def cdc_fold_scalar(spark, sf):
    return cdc.fold(_ops(spark, sf), _CDC, defaults=True).select("user_id", "value", "kind")


@query(f"{_FOLD_SQL} SELECT user_id, {_CLICKS} FROM k GROUP BY user_id")
def cdc_fold_array(spark, sf):
    return _shown(cdc.fold(_ops(spark, sf), _CDC)).select("user_id", "clicks")


@query(f"{_FOLD_SQL} SELECT user_id, {_SCALARS}, {_CLICKS} FROM k GROUP BY user_id")
def cdc_fold_full(spark, sf):
    return _shown(cdc.fold(_ops(spark, sf), _CDC, defaults=True))


@query(f"{_FOLD_SQL} SELECT off AS \"offset\", 0 AS item, CAST(user_id AS VARCHAR) AS key FROM r WHERE op = 'insert' AND rn > 1")
def cdc_rejected_inserts(spark, sf):
    return cdc.rejected_inserts(_ops(spark, sf), _CDC)


@query(f"{_FOLD_SQL} SELECT user_id, {_SCALARS}, {_CLICKS} FROM k GROUP BY user_id")
def stream_fold(spark, sf):
    """All operations as messages of a stream that is started twice on one checkpoint, folded into a stored table."""
    folder = shared_folder(spark)
    ops = _ops(spark, sf)
    body = F.to_json(F.struct(F.col("op").alias("_op"), "user_id", "value", "kind", "clicks"))
    messages = ops.select("offset", body.alias("value"))
    half = ops.agg((F.max("offset") / 2).cast("long")).first()[0] or 0
    table = Catalog(spark, f"{folder}/tables").create("user", _CDC)
    for part in (messages.where(F.col("offset") <= half), messages.where(F.col("offset") > half)):
        part.write.mode("append").json(f"{folder}/messages")
        stream = ingest.run(table, ingest.file_messages(spark, f"{folder}/messages"), f"{folder}/checkpoint")
        stream.awaitTermination()
    return _shown(values.materialise(table.acquire().rows, _CDC))


@query("SELECT CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op, count(*) AS n FROM events GROUP BY 1")
def cdc_op_stats(spark, sf):
    return cdc.op_stats(_ops(spark, sf))


@query("""SELECT user_id, coalesce(max_by(CASE WHEN event_id % 3 <> 0 THEN value END, event_id) FILTER (event_id % 3 <> 0), 0.0) AS value FROM events GROUP BY user_id""")
def cdc_merge_null_keeps(spark, sf):
    return cdc.fold(_ops(spark, sf).withColumn("op", F.lit("upsert")), _CDC, defaults=True).select("user_id", "value")


@query(f"""WITH e AS ({_OPS_SQL[6:-1]}), o AS (SELECT * FROM e UNION ALL SELECT -1, c_custkey, 'upsert', c_acctbal, c_mktsegment, [c_custkey, -1] FROM customer), {_SEG_SQL}
SELECT user_id, {_SCALARS}, {_CLICKS} FROM k GROUP BY user_id""")
def cdc_on_base_snapshot(spark, sf):
    base = _table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("kind"), F.array(F.col("c_custkey"), F.lit(-1).cast("long")).alias("clicks"))
    return _shown(cdc.fold(_ops(spark, sf), _CDC, base, defaults=True))


@query("""SELECT user_id, max_by(CAST(json_extract(props, '$.k') AS BIGINT), event_id) FILTER (json_extract(props, '$.k') IS NOT NULL) AS k,
array_to_string(list(CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY event_id) FILTER (json_extract(props, '$.k') IS NOT NULL), ',') AS seen FROM events GROUP BY user_id""")
def cdc_json_props(spark, sf):
    schema = TableSchema("u", "user_id", (Field("user_id", "int64", 1), Field("k", "int64", 2), Field("seen", "int64", 3, True)))
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"_op": "Upsert", "user_id": '), F.col("user_id").cast("string"), F.lit(', "k": '), F.coalesce(k, F.lit("null")), F.lit(', "seen": ['), F.coalesce(k, F.lit("")), F.lit("]}"))
    messages = _table(spark, sf, "events").select(F.col("event_id").alias("offset"), body.alias("value"))
    out = cdc.fold(cdc.parse(messages, schema), schema)
    return out.select("user_id", "k", F.array_join(F.transform("seen", lambda x: x.cast("string")), ",").alias("seen"))


@query("""SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'parse_error' WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'apply_error' ELSE 'ok' END AS status,
CASE WHEN event_id % 11 = 0 THEN 'invalid JSON' WHEN event_id % 13 = 0 THEN 'type mismatch in message' WHEN event_id % 5 = 0 THEN 'unknown op' WHEN event_id % 7 = 0 THEN 'missing primary key' ELSE '' END AS reason,
count(*) AS n FROM events GROUP BY 1, 2""")
def cdc_error_stats(spark, sf):
    schema = TableSchema("u", "user_id", (Field("user_id", "int64", 1), Field("age", "int32", 2)))
    i = F.col("event_id")
    key = F.concat(F.lit('"user_id": '), F.col("user_id").cast("string"))
    body = (
        F.when(i % 11 == 0, F.lit("{oops"))
        .when(i % 13 == 0, F.concat(F.lit("{"), key, F.lit(', "age": "x"}')))
        .when(i % 5 == 0, F.concat(F.lit('{"_op": "replace", '), key, F.lit("}")))
        .when(i % 7 == 0, F.lit('{"age": 3}'))
        .otherwise(F.concat(F.lit("{"), key, F.lit(', "age": 3}')))
    )
    return cdc.error_stats(cdc.parse(_table(spark, sf, "events").select(i.alias("offset"), body.alias("value")), schema))


@query("SELECT event_id, greatest(0, (CAST(floor(epoch(ts)) AS BIGINT) - (event_id % 5) * 60) * 1000) AS start_ms FROM events")
def catchup_seek(spark, sf):
    return _table(spark, sf, "events").select("event_id", seek_column(F.col("ts"), F.col("event_id") % 5).alias("start_ms"))


# ---------------------------------------------------------------- arrays, text and metrics


@query("SELECT vec_id, len(embedding) AS n, CAST(coalesce(embedding[1], 0) AS DOUBLE) AS first, embedding[1000] IS NULL AS oob FROM embeddings")
def array_get_oob(spark, sf):
    e = _table(spark, sf, "embeddings")
    a = F.col("embedding")
    return e.select("vec_id", arrays.array_size(a).alias("n"), arrays.front(a).cast("double").alias("first"), arrays.array_get(a, 999).isNull().alias("oob"))


@query("""SELECT event_id, array_to_string([event_id, user_id, 7, 8, 9], ',') AS appended, array_to_string([5, event_id, user_id], ',') AS pushed,
array_to_string([event_id, 6, user_id], ',') AS inserted, array_to_string([user_id], ',') AS erased, array_to_string([event_id, user_id, 0, 0], ',') AS resized FROM events""")
def array_append_batch(spark, sf):
    e = _table(spark, sf, "events")
    a = F.array("event_id", "user_id")
    n = lambda *x: F.array(*[F.lit(i).cast("long") for i in x])
    show = lambda x, name: F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(name)
    return e.select(
        "event_id", show(arrays.append_all(arrays.append_one(a, F.lit(7).cast("long")), n(8, 9)), "appended"), show(arrays.push_front(a, F.lit(5).cast("long")), "pushed"),
        show(arrays.insert_at(a, 1, F.lit(6).cast("long")), "inserted"), show(arrays.erase_at(a, 0), "erased"), show(arrays.resize(a, 4, F.lit(0).cast("long")), "resized"),
    )


@query("""SELECT p_partkey, instr(p_name, 'a') - 1 AS at, substring(p_name, 3, 4) AS sub, starts_with(p_name, 'Part') AS starts, ends_with(p_name, '1') AS ends,
CASE WHEN p_name < p_brand THEN -1 WHEN p_name > p_brand THEN 1 ELSE 0 END AS cmp FROM part""")
def text_functions(spark, sf):
    p = _table(spark, sf, "part")
    name = F.col("p_name")
    return p.select(
        "p_partkey", arrays.find(name, "a").alias("at"), arrays.substr(name, 2, 4).alias("sub"), arrays.starts_with(name, F.lit("Part")).alias("starts"),
        arrays.ends_with(name, F.lit("1")).alias("ends"), arrays.compare(name, F.col("p_brand")).alias("cmp"),
    )


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
q AS (SELECT unnest([0.5, 0.9, 0.99, 0.999]) AS quantile)
SELECT event_type, CAST(quantile AS DOUBLE) AS quantile, value FROM r, q WHERE i = greatest(1, CAST(ceil(CAST(quantile AS DOUBLE) * n) AS BIGINT))""")
def latency_nearest_rank(spark, sf):
    return metrics.nearest_rank(_table(spark, sf, "events"), "value", metrics.QUANTILES, "event_type")


@query("SELECT event_type, user_id, count(*) AS value FROM events GROUP BY event_type, user_id")
def metric_counters(spark, sf):
    return metrics.counters(_table(spark, sf, "events"), "event_type", "user_id")


@query("SELECT event_type, max_by(value, event_id) AS value FROM events GROUP BY event_type")
def metric_gauges(spark, sf):
    return metrics.gauges(_table(spark, sf, "events"), "value", F.col("event_id"), "event_type")


@query("""SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p99_9
FROM events GROUP BY event_type""")
def metric_summaries(spark, sf):
    return metrics.summaries(_table(spark, sf, "events"), "value", "event_type").withColumn("sum", F.round("sum", 4))


# ---------------------------------------------------------------- inputs and stored tables


@query("""SELECT event_id, event_id % 2 = 0 AS as_bool, CAST(event_id AS BIGINT) AS as_int64, CAST(CAST(value AS FLOAT) AS DOUBLE) AS as_float, CAST(value AS DOUBLE) AS as_double,
event_type AS as_string, strlen(event_type) AS bytes_length FROM events""")
def coerce_scalars(spark, sf):
    """Inputs of every scalar type as the fields that take them: integers of other widths, text from bytes and back."""
    e = _table(spark, sf, "events")
    given = e.select("event_id", (F.col("event_id") % 2 == 0).alias("as_bool"), F.col("event_id").cast("decimal(18,0)").alias("as_int64"), F.col("value").cast("float").alias("as_float"), F.col("value").cast("double").alias("as_double"), F.col("event_type").cast("binary").alias("as_string"), F.col("event_type").alias("as_bytes"))
    kinds = (("event_id", "int64"), ("as_bool", "bool"), ("as_int64", "int64"), ("as_float", "float"), ("as_double", "double"), ("as_string", "string"), ("as_bytes", "bytes"))
    out = values.project(given, TableSchema("e", "event_id", tuple(Field(n, k, i) for i, (n, k) in enumerate(kinds, 1))))
    return out.withColumn("as_float", F.col("as_float").cast("double")).withColumn("bytes_length", F.octet_length("as_bytes").cast("long")).drop("as_bytes")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x IS NOT NULL)) AS n, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def coerce_lists(spark, sf):
    kind = {T.FloatType: "float", T.DoubleType: "double"}[type(_table(spark, sf, "embeddings").schema["embedding"].dataType.elementType)]
    schema = TableSchema("v", "vec_id", (Field("vec_id", "int64", 1), Field("embedding", kind, 2, True)))
    a = F.col("embedding")
    return values.project(_table(spark, sf, "embeddings"), schema).select("vec_id", arrays.array_size(a).alias("n"), arrays.front(a).cast("double").alias("first"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'csv ' || p_brand ELSE p_name END AS p_name, p_size FROM part""")
def import_mixed(spark, sf):
    """All parts as Parquet, then some again as CSV: a bulk import into a stored table, in the order of the inputs."""
    folder = shared_folder(spark)
    part = _table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    part.write.parquet(f"{folder}/z.parquet")
    later = part.where("p_size > 25").select("p_partkey", F.concat(F.lit("csv "), "p_brand").alias("p_name"), "p_brand", "p_size")
    later.write.option("header", True).csv(f"{folder}/a")
    schema = TableSchema("part", "p_partkey", (Field("p_partkey", "int64", 1), Field("p_name", "string", 2), Field("p_size", "int32", 3)))
    table = Catalog(spark, f"{folder}/tables").create("part", schema)
    importer.run(table, [f"{folder}/z.parquet", f"{folder}/a/"])
    return table.acquire().rows.select(*schema.names)


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN -1.0 ELSE c_acctbal END AS c_acctbal, 'served' AS state
FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)""")
def catalog_release(spark, sf):
    """A stored table is committed, changed, published, deployed elsewhere and served from there."""
    folder = shared_folder(spark)
    rows = _table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal")
    schema = schema_of(rows, "c_custkey")
    table = Catalog(spark, f"{folder}/build").create("customer", schema)
    table.commit(rows)
    table.upsert(rows.join(_table(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left_semi").withColumn("c_acctbal", F.lit(-1.0)))
    table.delete(_table(spark, sf, "nation", F.col("n_nationkey").cast("long").alias("key")))
    table.catalog.publish("customer", f"{folder}/store")
    serve = Catalog(spark, f"{folder}/serve")
    serve.deploy("customer", f"{folder}/store")
    snapshot = serve.open("customer", "kv").acquire()
    state = "served" if snapshot.meta["record_count"] == snapshot.rows.count() and len(table.versions()) == 3 else "wrong"
    return values.materialise(snapshot.rows, schema).withColumn("state", F.lit(state))


@query("SELECT n_nationkey, n_name FROM nation")
def catalog_versions(spark, sf):
    """A version that is switched back to, after which later ones are pruned."""
    rows = _table(spark, sf, "nation", F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    table = Catalog(spark, shared_folder(spark)).create("nation", schema_of(rows, "n_nationkey"))
    first = table.commit(rows)
    table.commit(rows.where("n_nationkey > 5"))
    table.switch(first)
    table.prune(1)
    return table.acquire().rows.select("n_nationkey", "n_name").where(F.lit(table.versions() == [first]))
