import socket

import pytest

from keystrata.functions import values
from keystrata.plans import report
from keystrata.plans.admin import AdminSocket
from keystrata.plans.catalog import Catalog
from keystrata.plans.service import Service
from keystrata.sources import generators, warehouse
from keystrata.sources.schema import parse_schema

USER = parse_schema('{"name": "user", "pk": "user_id", "fields": [{"name": "user_id", "type": "int64", "field_id": 1}, {"name": "age", "type": "int32", "field_id": 2}, {"name": "name", "type": "string", "field_id": 3}]}')


@pytest.fixture()
def service(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path), buckets=2)
    catalog.create("user", USER)
    return Service(catalog)


def test_put_replaces_and_get_answers(service):
    assert service.put("user", {"user_id": 1, "age": 25, "name": "Bob"}) == ""
    assert service.put("user", {"user_id": 1, "age": 26}) == ""
    assert service.get("user", 1).row.asDict() == {"user_id": 1, "age": 26, "name": ""}
    miss = service.get("user", 9)
    assert (miss.found, miss.error) == (False, "")
    assert service.get("user", "").error == "missing primary key"
    assert service.get("", 1).error == "empty table name"
    assert "unknown table" in service.get("nope", 1).error


def test_batches_are_atomic(service):
    assert service.put_batch("user", []) == "empty batch"
    for bad in ([{"user_id": 1}, None], [{"user_id": 1}, {"age": 2}], [{"user_id": 1, "x": 2}], [{"user_id": 1, "age": "no"}]):
        assert service.put_batch("user", bad)
    assert service.get("user", 1).error
    assert service.put_batch("user", [{"user_id": 1, "age": 1}, {"user_id": 2, "age": 2}, {"user_id": 1, "age": 3}]) == ""
    got = service.batch_get("user", [2, 7, 1, 2])
    assert [r and (r.user_id, r.age) for r in got.rows] == [(2, 2), None, (1, 3), (2, 2)]
    assert service.batch_get("nope", [1]).error
    text = service.scrape()
    assert 'keystrata_rpc_requests_total{method="put_batch",status="error"} 5' in text and 'keystrata_snapshot_rows{table="user"} 2' in text
    assert service.admin("reload user") == "ok" and service.admin("bye").startswith("err")


def test_admin_socket(service, tmp_path):
    service.put("user", {"user_id": 1})
    path = str(tmp_path / "admin.sock")
    with AdminSocket(service, path), socket.socket(socket.AF_UNIX) as s:
        s.connect(path)
        f = s.makefile("rw")
        answers = []
        for line in ("reload user", "reload nope", "x"):
            f.write(line + "\n")
            f.flush()
            answers.append(f.readline().strip())
    assert answers[0] == "ok" and answers[1].startswith("err: unknown table") and answers[2].startswith("err")


def test_report(spark):
    rows = generators.products(spark, 100)
    good, text = report.markdown("products", rows, generators.PRODUCT, values.product_rules())
    assert good and "| rows | 100 |" in text and "Result: PASS" in text
    good, text = report.markdown("products", rows.unionByName(rows.limit(1).withColumn("brand_id", -rows.brand_id)), generators.PRODUCT, values.product_rules())
    assert not good and "| bad_brand | 1 |" in text and "| duplicate_keys | 1 |" in text
    assert not report.markdown("products", rows.drop("title"), generators.PRODUCT, {})[0]


def test_warehouse(spark):
    spark.createDataFrame([(1, 2, "x", 5)], "USER_ID long, age int, name string, more int").createOrReplaceTempView("people")
    assert warehouse.read_table(spark, "people", USER).first().asDict() == {"user_id": 1, "age": 2, "name": "x"}
    with pytest.raises(NotImplementedError):
        warehouse.read_odps()


def test_pruning_build_and_turns(service):
    from keystrata.plans.service import RoundRobin

    for i in range(3):
        service.put("user", {"user_id": i})
    gone = service.prune("user", 1)  # but for builds that hold buckets of the active version
    text = service.scrape()
    assert 1 <= len(gone) <= 2 and f'keystrata_snapshot_pruned_total{{table="user"}} {len(gone)}' in text and 'keystrata_build_info{version="' in text

    class Down:
        def get(self, *_):
            raise ConnectionError("down")

    client = RoundRobin([Down(), service])
    assert [client.call("get", "user", 2).found for _ in range(3)] == [True] * 3
    with pytest.raises(ConnectionError):
        RoundRobin([Down()]).call("get", "user", 1)


def test_summaries_keep_recent_values():
    from keystrata.plans import metrics

    f = metrics.Family("m", "summary", "h", ("a",))
    for i in range(metrics.RECENT + 10):
        f.observe("x", value=float(i))
    text = metrics.render(f)
    assert len(f.samples["x",]) == metrics.RECENT and f'm_count{{a="x"}} {metrics.RECENT + 10}' in text


def test_query_reads_in_slices():
    from keystrata.sources import sql_query

    o = sql_query.options({"host": "h", "port": "1", "database": "d", "user": "u"}, "SELECT 1 AS id;", slices=sql_query.Slices("id", "0", "100", 8))
    assert "query" not in o and o["dbtable"] == "(SELECT 1 AS id) AS result" and (o["partitionColumn"], o["numPartitions"]) == ("id", "8")
