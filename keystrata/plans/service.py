"""The service's four calls over a catalog, and its admin command. Errors are answered as text, not raised."""

from __future__ import annotations

import time
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators import kv
from keystrata.plans.catalog import Catalog, CatalogError
from keystrata.plans.metrics import Registry


VERSION = "0.2"


@dataclass(frozen=True)
class Rows:
    """Rows of a batch lookup by position; None where a key was not found."""

    rows: list[Row | None] = field(default_factory=list)
    error: str = ""


class RoundRobin:
    """Calls of a client that go to several services in turn; one that raises is passed over for the next."""

    def __init__(self, services: Sequence[Service]) -> None:
        if not services:
            raise ValueError("no services")
        self.services, self.at = list(services), 0

    def call(self, method: str, *args: object):
        failed: Exception | None = None
        for _ in self.services:
            service = self.services[self.at % len(self.services)]
            self.at += 1
            try:
                return getattr(service, method)(*args)
            except OSError as e:
                failed = e
        raise failed


class Service:
    """Reads answer from the version that is active when they begin; writes commit a new one."""

    def __init__(self, catalog: Catalog, metrics: Registry | None = None) -> None:
        self.catalog, self.metrics = catalog, metrics or Registry()
        self.metrics["build_info"].set(VERSION, to=1)

    @contextmanager
    def _measured(self, method: str):
        began, state = time.perf_counter(), {"status": "ok"}
        try:
            yield state
        finally:
            self.metrics["rpc_requests_total"].add(method, state["status"])
            self.metrics["rpc_latency_us"].observe(method, value=(time.perf_counter() - began) * 1e6)

    def _table(self, name: str):
        if not name:
            raise CatalogError("empty table name")
        return self.catalog.open(name)

    def get(self, table: str, key: object) -> kv.Answer:
        """A miss has no error and no row."""
        with self._measured("get") as m:
            try:
                answer = self._table(table).acquire().get(key)
            except CatalogError as e:
                answer = kv.Answer(False, str(e))
            m["status"] = "error" if answer.error else "ok"
            return answer

    def batch_get(self, table: str, keys: Sequence[object]) -> Rows:
        """As many answers as keys, in their order; one job for all keys."""
        with self._measured("batch_get") as m:
            try:
                snapshot = self._table(table).acquire()
            except CatalogError as e:
                m["status"] = "error"
                return Rows(error=str(e))
            asked = kv.keys_frame(snapshot.rows, snapshot.schema, keys)
            found: list[Row | None] = [None] * len(keys)
            for r in kv.batch_get_hits(snapshot.rows, snapshot.schema, asked).collect():
                values = r.asDict()
                found[values.pop("pos")] = Row(**values)
            return Rows(found)

    def put(self, table: str, row: dict) -> str:
        """Replaces the row of a key whole; an empty text is success."""
        return self._put("put", table, [row])

    def put_batch(self, table: str, rows: Sequence[dict | None]) -> str:
        """All rows or none; of repeated keys the last one."""
        return self._put("put_batch", table, rows)

    def _put(self, method: str, table: str, rows: Sequence[dict | None]) -> str:
        with self._measured(method) as m:
            m["status"] = "error"
            try:
                t = self._table(table)
                schema = t.schema()
                if not rows:
                    return "empty batch"
                names = {f.name: f for f in schema.fields}
                for i, row in enumerate(rows):
                    if row is None:
                        return f"row {i} is null"
                    unknown = [n for n in row if n not in names]
                    if unknown:
                        return f"row {i}: unknown field {unknown[0]}"
                    if row.get(schema.key) in (None, ""):
                        return f"row {i}: missing primary key"
                shape = T.StructType([*schema.struct_type().fields, T.StructField("__n", T.LongType())])
                try:
                    delta = self.catalog.spark.createDataFrame([(*[row.get(n) for n in names], i) for i, row in enumerate(rows)], shape)
                except Exception as e:
                    return f"type mismatch: {str(e).splitlines()[0]}"
                t.upsert(delta, F.col("__n"))
            except CatalogError as e:
                return str(e)
            m["status"] = "ok"
            return ""

    def prune(self, table: str, keep: int) -> list[str]:
        """Removes old versions of a table, and counts them."""
        gone = self._table(table).prune(keep)
        self.metrics["snapshot_pruned_total"].add(table, by=len(gone))
        return gone

    def admin(self, line: str) -> str:
        """One line of the admin protocol."""
        answer = self.catalog.command(line)
        word = (line.split() or [""])[0]
        self.metrics["admin_commands_total"].add(word, "ok" if answer == "ok" else "error")
        if word == "reload" and len(line.split()) == 2:
            self.metrics["table_reload_total"].add(line.split()[1], "ok" if answer == "ok" else "error")
        return answer

    def scrape(self) -> str:
        """All metrics as text, with the state of the tables as it is."""
        names = self.catalog.tables()
        self.metrics["table_count"].set(to=len(names))
        for n in names:
            table = self.catalog.open(n)
            if table.active():
                meta = table.acquire().meta
                self.metrics["snapshot_bytes"].set(n, to=meta["bytes"])
                self.metrics["snapshot_rows"].set(n, to=meta["record_count"])
                self.metrics["snapshot_versions"].set(n, to=len(table.versions()))
        return self.metrics.render()
