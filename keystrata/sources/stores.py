"""Settings of object stores and of the query source, from environment variables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from keystrata.sources.files import InputError


def _text(env: Mapping[str, str], *names: str) -> str:
    return next((env[n].strip() for n in names if env.get(n, "").strip()), "")


def _host(endpoint: str) -> str:
    return re.sub(r"^[a-z]+://", "", endpoint).rstrip("/")


def _need(value: str, what: str) -> str:
    if not value:
        raise InputError(what)
    return value


def store_settings(scheme: str, env: Mapping[str, str]) -> dict[str, str]:
    """Spark settings for a scheme; raises InputError where a needed variable is not set."""
    if scheme == "s3":
        conf = {}
        if _text(env, "AWS_ACCESS_KEY_ID"):
            conf |= {"fs.s3a.access.key": _text(env, "AWS_ACCESS_KEY_ID"), "fs.s3a.secret.key": _text(env, "AWS_SECRET_ACCESS_KEY")}
        endpoint = _text(env, "AWS_ENDPOINT_URL_S3", "AWS_ENDPOINT_URL")
        if endpoint:
            conf |= {"fs.s3a.endpoint": _host(endpoint), "fs.s3a.connection.ssl.enabled": str(endpoint.startswith("https://")).lower(), "fs.s3a.path.style.access": "true"}
        region = _text(env, "AWS_REGION", "AWS_DEFAULT_REGION")
        if region:
            conf["fs.s3a.endpoint.region"] = region
    elif scheme == "oss":
        conf = {
            "fs.oss.endpoint": _need(_host(_text(env, "OSS_ENDPOINT")), "OSS_ENDPOINT is not set"),
            "fs.oss.accessKeyId": _need(_text(env, "OSS_ACCESS_KEY_ID"), "OSS_ACCESS_KEY_ID is not set"),
            "fs.oss.accessKeySecret": _need(_text(env, "OSS_ACCESS_KEY_SECRET"), "OSS_ACCESS_KEY_SECRET is not set"),
            "fs.oss.impl": "org.apache.hadoop.fs.aliyun.oss.AliyunOSSFileSystem",
        }
    elif scheme == "cos":
        region, endpoint = _text(env, "COS_REGION"), _host(_text(env, "COS_ENDPOINT"))
        if not region and (m := re.fullmatch(r"cos\.([a-z0-9-]+)\..*", endpoint)):
            region = m[1]
        conf = {
            "fs.cosn.bucket.region": _need(region or ("ap-beijing" if endpoint else ""), "COS_ENDPOINT or COS_REGION is not set"),
            "fs.cosn.userinfo.secretId": _need(_text(env, "COS_SECRET_ID"), "COS_SECRET_ID is not set"),
            "fs.cosn.userinfo.secretKey": _need(_text(env, "COS_SECRET_KEY"), "COS_SECRET_KEY is not set"),
            "fs.cosn.impl": "org.apache.hadoop.fs.CosFileSystem",
        }
    elif scheme == "obs":
        conf = {
            "fs.obs.endpoint": _need(_host(_text(env, "OBS_ENDPOINT")), "OBS_ENDPOINT is not set"),
            "fs.obs.access.key": _need(_text(env, "OBS_ACCESS_KEY_ID"), "OBS_ACCESS_KEY_ID is not set"),
            "fs.obs.secret.key": _need(_text(env, "OBS_SECRET_ACCESS_KEY"), "OBS_SECRET_ACCESS_KEY is not set"),
            "fs.obs.impl": "org.apache.hadoop.fs.obs.OBSFileSystem",
        }
    elif scheme == "gs":
        conf = {"fs.gs.impl": "com.google.cloud.hadoop.fs.gcs.GoogleHadoopFileSystem"}
        if _text(env, "GOOGLE_APPLICATION_CREDENTIALS"):
            conf["google.cloud.auth.service.account.json.keyfile"] = _text(env, "GOOGLE_APPLICATION_CREDENTIALS")
    else:
        raise InputError(f"unknown scheme {scheme}")
    return {f"spark.hadoop.{k}": v for k, v in conf.items()}


def query_settings(given: Mapping[str, str | int | None], env: Mapping[str, str]) -> dict[str, str]:
    """Connection of the query source: what the caller gives, else MYSQL_*, else KEYSTRATA_MYSQL_*."""
    names = {"host": "HOST", "port": "PORT", "user": "USER", "password": "PASSWORD", "database": "DATABASE"}
    out = {k: str(given[k]) if given.get(k) not in (None, "") else _text(env, f"MYSQL_{n}", f"KEYSTRATA_MYSQL_{n}") for k, n in names.items()}
    out["port"] = out["port"] or "3306"
    for k in ("host", "user", "database"):
        _need(out[k], f"the query source needs {k}")
    return out
