import json
import random

import pytest

from keystrata.operators import cdc
from keystrata.sources.schema import parse_schema

USER = parse_schema('{"pk": "user_id", "fields": [{"name": "user_id", "type": "int64", "field_id": 1}, {"name": "age", "type": "int32", "field_id": 2}, {"name": "name", "type": "string", "field_id": 3}, {"name": "tags", "type": "string", "is_array": true, "field_id": 4}, {"name": "clicks", "type": "int64", "is_array": true, "field_id": 5}, {"name": "score", "type": "float64", "field_id": 6}]}')


def messages(spark, docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "offset long, value string")


def folded(spark, docs, base=None):
    parsed = cdc.parse(messages(spark, docs), USER)
    rows = cdc.fold(parsed, USER, base, defaults=True).collect()
    errors = sorted((r.offset, r.item, r.reason) for r in parsed.where("status <> 'ok'").collect())
    return {r.user_id: r for r in rows}, errors


def test_missing_fields_and_nulls_keep(spark):
    rows, errors = folded(spark, [{"user_id": 42, "age": 25, "name": "Bob", "score": 7.0}, {"user_id": 42, "age": 26}, {"user_id": 42}, {"user_id": 42, "age": None, "name": None}])
    assert (rows[42].age, rows[42].name, rows[42].score) == (26, "Bob", 7.0)
    assert not errors


def test_arrays_append(spark):
    rows, _ = folded(spark, [{"user_id": 1, "clicks": [100, 200], "tags": ["a"]}, {"user_id": 1, "clicks": []}, {"user_id": 1, "clicks": None}, {"user_id": 1, "clicks": [300]}])
    assert rows[1].clicks == [100, 200, 300]
    assert rows[1].tags == ["a"]


def test_unknown_and_reserved_keys_are_ignored(spark):
    rows, errors = folded(spark, [{"user_id": 1, "_irrelevant": 3, "not_a_column": {"x": [1]}, "_ts": 5, "age": 9}])
    assert rows[1].age == 9 and not errors


@pytest.mark.parametrize("op", ["UPSERT", "upsert", "Upsert", 7, None])
def test_op_case_and_types(spark, op):
    rows, errors = folded(spark, [{"_op": op, "user_id": 1, "age": 2}])
    assert rows[1].age == 2 and not errors


def test_delete_and_reinsert(spark):
    rows, errors = folded(spark, [{"user_id": 1, "age": 2, "name": "x"}, {"_op": "DELETE", "user_id": 1, "age": "ignored"}, {"_op": "delete", "user_id": 77}, {"_op": "insert", "user_id": 1, "age": 5}])
    assert (rows[1].age, rows[1].name) == (5, "") and list(rows) == [1] and not errors


def test_duplicate_insert_is_rejected(spark):
    docs = [{"_op": "insert", "user_id": 1, "age": 2}, {"_op": "insert", "user_id": 1, "age": 3}]
    rows, _ = folded(spark, docs)
    assert rows[1].age == 2
    assert [tuple(r) for r in cdc.rejected_inserts(cdc.parse(messages(spark, docs), USER), USER).collect()] == [(1, 0, "1")]


def test_errors(spark):
    rows, errors = folded(
        spark,
        ["{broken", "5", {"_op": "REPLACE", "user_id": 1}, {"age": 4}, {"user_id": None}, {"user_id": 2, "clicks": 5}, {"user_id": 3, "age": "x"}, [{"user_id": 4, "age": 1}, 7, {"user_id": 5}], []],
    )
    assert set(rows) == {4, 5}
    assert errors == [
        (0, 0, "invalid JSON"), (1, 0, "not an object"), (2, 0, "unknown op"), (3, 0, "missing primary key"), (4, 0, "missing primary key"),
        (5, 0, "array expected"), (6, 0, "type mismatch in message"), (7, 1, "not an object"),
    ]


def test_type_mismatch_ends_its_message(spark):
    rows, errors = folded(spark, [[{"user_id": 1, "age": 1}, {"user_id": 2, "age": "bad"}, {"user_id": 3, "age": 3}], {"user_id": 4}])
    assert set(rows) == {1, 4}
    assert [e[:2] for e in errors] == [(0, 1), (0, 2)]


def test_large_integers_survive(spark):
    rows, _ = folded(spark, [{"user_id": 2**53 + 1, "clicks": [2**62 + 1]}])
    assert rows[2**53 + 1].clicks == [2**62 + 1]


def test_empty_log(spark):
    assert folded(spark, []) == ({}, [])


def python_fold(log, base):
    """The messages one after another."""
    table = {k: dict(v) for k, v in base.items()}
    for message in log:
        for m in message if isinstance(message, list) else [message]:
            k, op = m["user_id"], m.get("_op", "upsert")
            if op == "delete":
                table.pop(k, None)
                continue
            if op == "insert" and k in table:
                continue
            row = table.setdefault(k, {"age": None, "clicks": []})
            if m.get("age") is not None:
                row["age"] = m["age"]
            row["clicks"] = row["clicks"] + (m.get("clicks") or [])
    return table


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_logs_against_a_sequential_fold(spark, seed):
    rng = random.Random(seed)

    def item():
        m = {"user_id": rng.randrange(25), "_op": rng.choice(["insert", "upsert", "upsert", "delete"])}
        if rng.random() < 0.6:
            m["age"] = rng.choice([None, rng.randrange(99)])
        if rng.random() < 0.5:
            m["clicks"] = rng.choice([None, [], [rng.randrange(9)], [1, 2, 3]])
        return m

    log = [[item() for _ in range(3)] if rng.random() < 0.3 else item() for _ in range(300)]
    base = {k: {"age": k, "clicks": [k]} for k in range(0, 30, 3)}
    frame = spark.createDataFrame([(k, v["age"], None, None, v["clicks"], None) for k, v in base.items()], USER.struct_type())
    rows = cdc.fold(cdc.parse(messages(spark, log), USER), USER, frame).collect()
    assert {r.user_id: {"age": r.age, "clicks": r.clicks} for r in rows} == python_fold(log, base)
