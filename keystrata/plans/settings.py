"""Settings of a service and of an import, and what they have to satisfy."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from keystrata.sources.files import is_store_uri


class SettingError(ValueError):
    """Settings that contradict one another or miss something."""


@dataclass(frozen=True)
class StreamSource:
    """Where a table's change messages come from."""

    topic: str
    partition: int
    brokers: str


def stream_source(table_json: str, default_brokers: str = "") -> StreamSource | None:
    """The kafka part of a table's sidecar; None if it has none."""
    doc = json.loads(table_json).get("kafka")
    if doc is None:
        return None
    if not doc.get("topic"):
        raise SettingError("kafka.topic is missing")
    return StreamSource(doc["topic"], int(doc.get("partition", 0)), doc.get("brokers") or default_brokers)


@dataclass(frozen=True)
class ServerSettings:
    """What the service reads from its configuration."""

    db_path: str
    listen: str = "0.0.0.0:9000"
    exclusive_lock: bool = True
    default_brokers: str = ""
    admin_socket: str = ""
    segment_gb: int = 1
    most_gb: int = 512


def server_settings(text: str) -> ServerSettings:
    """Reads a configuration document."""
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise SettingError(f"configuration is not JSON: {e}") from e
    if not doc.get("db_path"):
        raise SettingError("db_path is missing")
    segment, most = int(doc.get("arena_seg_gb", 1)), int(doc.get("arena_max_gb", 512))
    if segment <= 0 or most < segment:
        raise SettingError("storage bounds have to be positive and in order")
    socket = str(doc.get("admin_unix_socket", "")).strip() or str(Path(doc["db_path"]).parent / "admin.sock")
    return ServerSettings(doc["db_path"], doc.get("listen", "0.0.0.0:9000"), bool(doc.get("exclusive_arena_lock", True)), doc.get("kafka", {}).get("default_brokers", ""), socket, segment, most)


def build_inputs(input: str | list[str] | None = None, data_dir: str | None = None) -> list[str]:  # noqa: A002
    """The inputs of a build request: exactly one of the two, and a list holds files or URIs of one sort."""
    has_dir = bool(data_dir and data_dir.strip())
    has_input = bool(input.strip()) if isinstance(input, str) else bool(input)
    if has_dir == has_input:
        raise SettingError("set exactly one of input and data_dir")
    if has_dir:
        if not Path(data_dir).is_dir():
            raise SettingError(f"data_dir is no folder: {data_dir}")
        return [data_dir.rstrip("/") + "/"]
    if isinstance(input, str):
        item = input.strip()
        if is_store_uri(item) or Path(item).is_file():
            return [item]
        if Path(item).is_dir():
            return [item.rstrip("/") + "/"]
        raise SettingError(f"no such input: {item}")
    items = [str(x).strip() for x in input]
    for i, item in enumerate(items):
        if not item:
            raise SettingError(f"input[{i}] is empty")
        if not is_store_uri(item) and not Path(item).is_file():
            raise SettingError(f"input[{i}] is no file: {item}")
    if len({is_store_uri(x) for x in items}) > 1:
        raise SettingError("local files and object-store URIs can't be mixed")
    return items


@dataclass(frozen=True)
class ImportRequest:
    """An import: from files or from a query, into an existing table or a new one."""

    table: str
    inputs: tuple[str, ...] = ()
    query: str = ""
    query_file: str = ""
    create: bool = False
    schema_json: str = ""
    catch_up: bool = False
    watermark_sec: int | None = None
    rewind_minutes: int = 0

    def checked(self) -> ImportRequest:
        if not self.table:
            raise SettingError("an import needs a table")
        if self.query and self.query_file:
            raise SettingError("give the query as text or as a file, not both")
        if bool(self.query or self.query_file) == bool(self.inputs):
            raise SettingError("an import needs either file inputs or a query")
        if self.create and not self.schema_json:
            raise SettingError("creating a table needs its schema")
        if self.catch_up and self.watermark_sec is None:
            raise SettingError("catching up needs the watermark of the inputs")
        return self
