import json

import pytest
from pyspark.sql import functions as F

from keystrata.plans import metrics, settings
from keystrata.sources import files, sql_query, stores


def test_uris():
    assert files.parse_uri("S3://b/k/x.parquet") == ("s3", "b", "k/x.parquet")
    assert files.spark_path("s3://b/k") == "s3a://b/k" and files.spark_path("/a/b") == "/a/b"
    with pytest.raises(files.InputError):
        files.parse_uri("http://x/y")


def test_store_settings():
    s3 = stores.store_settings("s3", {"AWS_ACCESS_KEY_ID": " a ", "AWS_SECRET_ACCESS_KEY": "b", "AWS_ENDPOINT_URL": "http://h:9", "AWS_DEFAULT_REGION": "r"})
    assert s3["spark.hadoop.fs.s3a.endpoint"] == "h:9" and s3["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false" and s3["spark.hadoop.fs.s3a.access.key"] == "a"
    assert stores.store_settings("s3", {}) == {}
    cos = stores.store_settings("cos", {"COS_ENDPOINT": "https://cos.ap-x.example.com", "COS_SECRET_ID": "i", "COS_SECRET_KEY": "k"})
    assert cos["spark.hadoop.fs.cosn.bucket.region"] == "ap-x"
    for scheme, env in (("oss", {}), ("cos", {}), ("obs", {"OBS_ENDPOINT": "e"}), ("ftp", {})):
        with pytest.raises(files.InputError):
            stores.store_settings(scheme, env)
    assert "spark.hadoop.fs.gs.impl" in stores.store_settings("gs", {})
    assert stores.store_settings("oss", {"OSS_ENDPOINT": "https://e/", "OSS_ACCESS_KEY_ID": "a", "OSS_ACCESS_KEY_SECRET": "b"})["spark.hadoop.fs.oss.endpoint"] == "e"


def test_query_settings():
    env = {"MYSQL_HOST": "h", "KEYSTRATA_MYSQL_USER": "u", "MYSQL_DATABASE": "d"}
    got = stores.query_settings({"host": "given", "port": None}, env)
    assert got == {"host": "given", "port": "3306", "user": "u", "password": "", "database": "d"}
    with pytest.raises(files.InputError):
        stores.query_settings({}, {"MYSQL_HOST": "h"})
    o = sql_query.options(got, "SELECT 1", ["SET a=1;", " ", "SET b=2"])
    assert o["url"] == "jdbc:mysql://given:3306/d" and o["fetchsize"] == "4096" and o["sessionInitStatement"] == "SET a=1;SET b=2"


def test_stream_and_server_settings():
    assert settings.stream_source("{}") is None
    assert settings.stream_source('{"kafka": {"topic": "t"}}', "b:1") == settings.StreamSource("t", 0, "b:1")
    assert settings.stream_source('{"kafka": {"topic": "t", "partition": 3, "brokers": "x"}}', "b:1").brokers == "x"
    with pytest.raises(settings.SettingError):
        settings.stream_source('{"kafka": {}}')
    s = settings.server_settings('{"db_path": "/data/db", "admin_unix_socket": "  "}')
    assert (s.listen, s.exclusive_lock, s.admin_socket) == ("0.0.0.0:9000", True, "/data/admin.sock")
    for bad in ("{", "{}", '{"db_path": ""}', '{"db_path": "x", "arena_seg_gb": 0}', '{"db_path": "x", "arena_seg_gb": 9, "arena_max_gb": 1}'):
        with pytest.raises(settings.SettingError):
            settings.server_settings(bad)


def test_build_inputs(tmp_path):
    f = tmp_path / "a.parquet"
    f.write_text("")
    assert settings.build_inputs(str(f)) == [str(f)]
    assert settings.build_inputs(str(tmp_path)) == [f"{tmp_path}/"]
    assert settings.build_inputs(data_dir=str(tmp_path)) == [f"{tmp_path}/"]
    assert settings.build_inputs(["s3://a/b.parquet", "s3://a/c/"]) == ["s3://a/b.parquet", "s3://a/c/"]
    for bad in ((None, None), (str(f), str(tmp_path)), ([], None), (["", str(f)], None), (["/nope"], None), (["s3://a/b", str(f)], None), ("/nope", None), (None, "/nope")):
        with pytest.raises(settings.SettingError):
            settings.build_inputs(*bad)


@pytest.mark.parametrize(
    "wrong",
    [{}, {"table": "t"}, {"table": "t", "inputs": ("a",), "query": "q"}, {"table": "t", "query": "q", "query_file": "f"}, {"table": "t", "inputs": ("a",), "create": True}, {"table": "t", "inputs": ("a",), "catch_up": True}],
)
def test_import_requests(wrong):
    with pytest.raises(settings.SettingError):
        settings.ImportRequest(**({"table": ""} | wrong)).checked()
    assert settings.ImportRequest("t", ("a",)).checked().table == "t"


def test_render():
    r = metrics.Registry()
    r["rpc_requests_total"].add("get", "ok")
    r["rpc_requests_total"].add("get", "ok", by=2)
    r["table_count"].set(to=4)
    r["table_reload_total"].add('a"b\\c\n', "ok")
    for v in (1, 2, 3, 4):
        r["rpc_latency_us"].observe("get", value=v)
    text = r.render()
    assert 'keystrata_rpc_requests_total{method="get",status="ok"} 3\n' in text
    assert "keystrata_table_count 4\n" in text
    assert '{table="a\\"b\\\\c\\n",result="ok"} 1' in text
    assert 'keystrata_rpc_latency_us{method="get",quantile="0.5"} 2\n' in text and 'keystrata_rpc_latency_us_count{method="get"} 4' in text and 'keystrata_rpc_latency_us_sum{method="get"} 10' in text
    assert text.count("# TYPE keystrata_rpc_requests_total counter") == 1
    assert len(r.families) == 15


def test_percentiles(spark):
    assert [metrics.percentile([3, 1, 2], p) for p in (0.5, 0.9, 0.01)] == [2, 3, 1] and metrics.percentile([], 0.5) == 0
    t = spark.range(1, 1001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    got = {(r.g, r.quantile): r.value for r in metrics.nearest_rank(t, "v", (0.5, 0.999), "g").collect()}
    assert got == {(0, 0.5): 500.0, (1, 0.5): 499.0, (0, 0.999): 1000.0, (1, 0.999): 999.0}
    assert json.dumps(metrics.load_report(9, 1, 7, 2.0, [1.0, 3.0])).startswith('{"ok": 9, "errors": 1, "found": 7, "not_found": 2, "qps": 5.0')


def test_summaries_are_exact(spark):
    """Quantiles of a group with more distinct values than a sketch keeps, and ranks that doubles would round up."""
    t = spark.range(30_000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 30_000).cast("double").alias("v"))
    t = t.unionByName(spark.createDataFrame([(None, None), (0, None)], "g long, v double"))
    got = {r.g: r for r in metrics.summaries(t, "v", "g").collect()}
    # The values of a group are every second number, in order.
    for g in (0, 1):
        assert tuple(got[g])[1:] == (15_000, float(sum(range(g, 30_000, 2))), *[float(g + 2 * (-(-15_000 * k // 1000) - 1)) for k in (500, 900, 990, 999)])
    assert tuple(got[None]) == (None, 0, None, None, None, None, None)
    assert metrics.summaries(t.where("false"), "v").first()["count"] == 0
