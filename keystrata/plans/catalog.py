"""Tables on disk: immutable snapshots, a pointer to the active one, builds, releases and their clean-up.

    <root>/<table>/schema.json       the table's schema
    <root>/<table>/<build_id>/data   a snapshot in Parquet, with meta.json beside it
    <root>/<table>/active            the name of the snapshot that readers get

A snapshot never changes once it is written. A commit writes a new one and then replaces the pointer, so a reader
sees one or the other, and what it has planned keeps reading the files it was planned on. A commit of some keys writes
the buckets of these keys only; for the others its meta.json names the builds that hold them (`parts`), which are kept
as long as a version needs them. After MOST_PARTS such builds a commit writes all buckets. The root may be in any file
system that Spark reads; releases are copied by Spark's tasks, not by the driver.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators import inverted, kv
from keystrata.plans.storage import Storage
from keystrata.sources.schema import TableSchema, parse_schema

KINDS = ("kv", "inverted")
SKIPPED_SUFFIX = "~reload"
#: A writer renews its lock three times in LEASE_SEC; one that hasn't for so long has ended, and the lock is taken over.
LEASE_SEC = 600
#: Builds that a version may be put together from.
MOST_PARTS = 8
SIDES = ("schema.json", "table.json")


class CatalogError(RuntimeError):
    """A table that is missing, locked, of the other kind, or can't be created."""


def check_name(name: str) -> str:
    if not name or "/" in name or "\\" in name or name[0] in "._":
        raise CatalogError(f"bad table name: {name!r}")
    return name


def new_build_id(taken: Callable[[str], bool], now: float | None = None) -> str:
    """A local time stamp; -1, -2 and so on follow while it is taken."""
    base = time.strftime("%Y%m%d%H%M%S", time.localtime(now))
    n = 0
    while taken(build := base if n == 0 else f"{base}-{n}"):
        n += 1
    return build


def kept_builds(builds: list[str], keep: int, must_keep: str) -> set[str]:
    """The newest builds, keep of them, must_keep being one; all for keep 0."""
    if keep <= 0:
        return set(builds)
    others = sorted((b for b in set(builds) if b != must_keep), reverse=True)
    return {must_keep, *others[: keep - 1]}


@dataclass(frozen=True)
class Snapshot:
    """One version of a table, as readers hold it."""

    schema: TableSchema
    kind: str
    build_id: str
    path: str
    buckets: int
    meta: dict
    spark: SparkSession

    def stored(self) -> T.StructType:
        """The columns that the files have of the schema's fields, which are found by their number."""
        names = self.meta["columns"]
        held = [T.StructField(names[str(f.number)], f.data_type) for f in self.schema.fields if str(f.number) in names]
        return T.StructType([*held, T.StructField(kv.BUCKET, T.IntegerType())])

    def _read(self, what: str, shape: T.StructType, bucket: Column) -> DataFrame:
        """The data or postings of all builds that this version is put together from, each for its buckets.

        A build may have no file, so the shape is said and not found.
        """
        root, out = self.path.rsplit("/", 1)[0], None
        for build, buckets in self.meta.get("parts", {self.build_id: None}).items():
            frame = self.spark.read.schema(shape).parquet(f"{root}/{build}/{what}")
            frame = frame if buckets is None else frame.where(bucket.isin(buckets))
            out = frame if out is None else out.unionByName(frame)
        return out

    @property
    def rows(self) -> DataFrame:
        frame, names = self._read("data", self.stored(), F.col(kv.BUCKET)), self.meta["columns"]
        # A schema may have renamed or added fields since.
        shown = [F.col(f"`{names[str(f.number)]}`") if str(f.number) in names else F.lit(None).cast(f.data_type) for f in self.schema.fields]
        return frame.select(*[c.alias(f.name) for c, f in zip(shown, self.schema.fields, strict=True)], kv.BUCKET)

    @property
    def postings(self) -> DataFrame:
        if self.kind != "inverted":
            raise CatalogError(f"{self.schema.name} has no postings")
        shape = T.StructType([T.StructField("field_id", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("key", self.schema.key_field.data_type)])
        return self._read("postings", shape, kv.bucket_of(F.col("key"), self.buckets))

    def get(self, key: object) -> kv.Answer:
        if key is None or str(key) == "":
            return kv.Answer(False, "missing primary key")
        rows = kv.materialise(kv.where_key(self.rows, self.schema, key, self.buckets), self.schema).take(1)
        return kv.Answer(bool(rows), row=rows[0] if rows else None)


def write_data(rows: DataFrame, path: str, key: str) -> None:
    """Rows with their bucket as Parquet: a folder for each bucket, sorted by key, with a Bloom filter on it.

    Rows are dealt by bucket and range of key, so a large bucket is written by several tasks to several files.
    """
    out = rows.repartitionByRange(kv.BUCKET, key).sortWithinPartitions(kv.BUCKET, key)
    out.write.mode("overwrite").partitionBy(kv.BUCKET).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def write_postings(index: DataFrame, path: str) -> None:
    """Postings as Parquet, each task's sorted by term in a file of its own, so a lookup skips by statistics in all files.

    They stay where their rows were read: a shuffle would move many times the text, and ranges of terms would need a pass
    of their own over it. The term comes first, as its first bytes tell rows apart and a field's number does not.
    """
    index.sortWithinPartitions("term", "field_id", "key").write.mode("overwrite").parquet(path)


class Table:
    """A table of a catalog."""

    def __init__(self, catalog: Catalog, name: str) -> None:
        self.catalog, self.name, self.root, self.files = catalog, name, f"{catalog.root}/{name}", catalog.files

    # ------------------------------------------------ versions

    def versions(self) -> list[str]:
        return self.files.folders(self.root)

    def active(self) -> str | None:
        pointer = f"{self.root}/active"
        return self.files.read(pointer).strip() if self.files.exists(pointer) else None

    def switch(self, build_id: str | None = None) -> str:
        """Makes a version the active one; the latest by name if none is given."""
        versions = self.versions()
        build_id = build_id or max(versions, default=None)
        if build_id not in versions:
            raise CatalogError(f"{self.name} has no version {build_id}")
        self.files.replace(f"{self.root}/active", build_id)
        return build_id

    def prune(self, keep: int) -> list[str]:
        """Removes old versions but for the newest `keep` and the active one."""
        current = self.active() or max(self.versions(), default="")
        stay = kept_builds(self.versions(), keep, current)
        # Versions that stay need the builds that hold some of their buckets.
        stay |= {part for v in stay if v for part in self._meta(v).get("parts", {})}
        gone = [v for v in self.versions() if v not in stay]
        for v in gone:
            self.files.delete(f"{self.root}/{v}")
        return gone

    # ------------------------------------------------ reading

    def schema(self) -> TableSchema:
        return parse_schema(self.files.read(f"{self.root}/schema.json"))

    def acquire(self, build_id: str | None = None) -> Snapshot:
        """The active version, which the caller keeps whatever is committed later."""
        build_id = build_id or self.active()
        if build_id is None:
            raise CatalogError(f"{self.name} has no version yet")
        path = f"{self.root}/{build_id}"
        meta = json.loads(self.files.read(f"{path}/meta.json"))
        return Snapshot(self.schema(), meta["kind"], build_id, path, meta["buckets"], meta, self.catalog.spark)

    def view(self) -> str:
        """Registers the active version as a view of its name for Spark SQL."""
        snapshot = self.acquire()
        kv.materialise(snapshot.rows, snapshot.schema).createOrReplaceTempView(self.name)
        return self.name

    # ------------------------------------------------ writing

    @contextmanager
    def lock(self) -> Iterator[Callable[[], None]]:
        """One writer at a time; a second one fails at once. Yields a check that the lock is still held.

        A lock whose writer has ended, a process of this host that is gone or one that let its lease run out, is
        taken over.
        """
        if not self.catalog.exclusive:
            yield lambda: None
            return
        path, own = f"{self.root}/.lock", {"host": socket.gethostname(), "pid": os.getpid(), "token": uuid.uuid4().hex}
        stamp = lambda: json.dumps({**own, "renewed": time.time()})
        if not self.files.create(path, stamp(), False):
            if not self._ended(path):
                raise CatalogError(f"{self.name} is locked by another writer")
            # Of several that see the same stale lock one moves it away, and one makes the new one.
            stale = f"{path}-{own['token']}"
            self.files.move(path, stale)
            self.files.delete(stale)
            if not self.files.create(path, stamp(), False):
                raise CatalogError(f"{self.name} is locked by another writer")

        def held() -> None:
            if self._lock_of(path).get("token") != own["token"]:
                raise CatalogError(f"{self.name}: the lock was lost, nothing is committed")

        over = threading.Event()

        def renew() -> None:
            while not over.wait(LEASE_SEC / 3):
                if self._lock_of(path).get("token") == own["token"]:
                    self.files.replace(path, stamp())

        renewing = threading.Thread(target=renew, daemon=True)
        renewing.start()
        try:
            yield held
        finally:
            over.set()
            renewing.join()
            if self._lock_of(path).get("token") == own["token"]:
                self.files.delete(path)

    def _lock_of(self, path: str) -> dict:
        try:
            return json.loads(self.files.read(path))
        except Exception:  # gone, or being replaced just now
            return {}

    def _ended(self, path: str) -> bool:
        holder = self._lock_of(path)
        if time.time() - holder.get("renewed", time.time()) > LEASE_SEC:
            return True
        if holder.get("host") != socket.gethostname():
            return False
        try:
            os.kill(holder["pid"], 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
        return False

    def commit(self, rows: DataFrame, *, activate: bool = True, build_id: str | None = None, extra: dict | None = None) -> str:
        """Writes rows (one a key) as a new version and makes it the active one.

        Rows are dealt to buckets by key and sorted by key inside, so a lookup reads one bucket and skips row groups.
        What is known of the table's stream (its last batch and offset) is carried on, whoever commits.
        """
        return self.change(lambda _: rows, activate=activate, build_id=build_id, extra=extra)

    def change(self, following: Callable[[DataFrame], DataFrame | None], *, keys: DataFrame | None = None, activate: bool = True, build_id: str | None = None, extra: dict | None = None) -> str | None:
        """Reads the active rows, computes those that follow and commits them, all under the lock: no commit is lost.

        following may answer None, and then nothing is committed. With keys, a frame (key) of all keys that change,
        it gets and gives the rows of their buckets only, and no other bucket is written.
        """
        with self.lock() as held:
            before = self.active()
            base, touched = self._base(), None
            if keys is not None and before is not None:
                touched = self._touched(self.acquire(), keys)
            if touched is not None:
                base = self.acquire().rows.where(F.col(kv.BUCKET).isin(touched)).select(*self.schema().names)
            rows = following(base)
            if rows is None:
                return None
            known = {**(extra or {})}
            stream = {**(self._meta(before).get("stream", {}) if before else {}), **known.pop("stream", {})}
            build_id = self._write(rows, build_id, {**({"stream": stream} if stream else {}), **known}, held, before, touched)
            if activate:
                held()
                if self.active() != before:
                    raise CatalogError(f"{self.name}: another version became active meanwhile, {build_id} is kept aside")
                self.files.replace(f"{self.root}/active", build_id)
            return build_id

    def _touched(self, current: Snapshot, keys: DataFrame) -> list[int] | None:
        """The buckets of the keys; None where all buckets have to be written anyway."""
        same = current.meta["columns"] == self._columns() and current.buckets == self.catalog.buckets and "bucket_rows" in current.meta
        if not same or len(current.meta.get("parts", [])) >= MOST_PARTS:
            return None
        found = keys.select(kv.bucket_of(F.col("key"), self.catalog.buckets).alias("b")).distinct().collect()  # as many as buckets
        return sorted(r["b"] for r in found) if len(found) < self.catalog.buckets else None

    def _columns(self) -> dict[str, str]:
        return {str(f.number): f.name for f in self.schema().fields}

    def _meta(self, build_id: str) -> dict:
        return json.loads(self.files.read(f"{self.root}/{build_id}/meta.json"))

    def _write(self, rows: DataFrame, build_id: str | None, extra: dict, held: Callable[[], None], before: str | None, touched: list[int] | None) -> str:
        schema, kind, buckets = self.schema(), self._kind(), self.catalog.buckets
        build_id = build_id or new_build_id(lambda b: self.files.exists(f"{self.root}/{b}"))
        draft = f"{self.root}/.{build_id}"
        write_data(rows.select(*schema.names).withColumn(kv.BUCKET, kv.bucket_of(F.col(schema.key), buckets)), f"{draft}/data", schema.key)
        written = self.catalog.spark.read.schema(schema.struct_type().add(kv.BUCKET, T.IntegerType())).parquet(f"{draft}/data")
        if kind == "inverted":
            write_postings(inverted.postings(written, schema), f"{draft}/postings")
        # The counts come from the footers that were just written.
        count = {str(r[kv.BUCKET]): r["count"] for r in written.groupBy(kv.BUCKET).count().collect()}
        parts: dict[str, list[int]] = {}
        if touched is not None:
            old = self._meta(before)
            parts = {b: [k for k in (range(buckets) if own is None else own) if k not in touched] for b, own in old.get("parts", {before: None}).items()}
            parts = {b: own for b, own in parts.items() if own} | {build_id: touched}
            count = {k: n for k, n in old["bucket_rows"].items() if int(k) not in touched} | count
        meta = {
            "kind": kind, "build_id": build_id, "buckets": buckets, "record_count": sum(count.values()), "bytes": self.files.bytes(draft), "columns": self._columns(),
            "bucket_rows": count, **({"parts": parts} if parts else {}), **extra,
        }
        self.files.replace(f"{draft}/meta.json", json.dumps(meta, indent=2))
        held()
        self.files.move(draft, f"{self.root}/{build_id}")
        return build_id

    def _kind(self) -> str:
        return json.loads(self.files.read(f"{self.root}/table.json"))["kind"]

    def _base(self) -> DataFrame:
        if self.active() is None:
            return self.catalog.spark.createDataFrame([], self.schema().struct_type())
        return self.acquire().rows.select(*self.schema().names)

    def upsert(self, delta: DataFrame, *order) -> str:
        """Commits delta's rows in place of those of their keys; of repeated keys the last by order, or of the frame."""
        return self.change(lambda base: kv.batch_upsert(base, delta, self.schema(), *order), keys=self._keys(delta))

    def put_batch(self, delta: DataFrame, *order) -> str:
        """Commits all of delta or raises and commits nothing; of repeated keys the last by order, or of the frame."""
        return self.change(lambda base: kv.put_batch(base, delta, self.schema(), *order), keys=self._keys(delta))

    def delete(self, keys: DataFrame) -> str:
        """Commits the table without the keys of a frame (key)."""
        return self.change(lambda base: kv.delete(base, keys, self.schema()), keys=keys)

    def _keys(self, delta: DataFrame) -> DataFrame | None:
        """The keys of delta; None where it has none, and what it is applied to will say so."""
        key = self.schema().key
        return delta.select(F.col(key).alias("key")) if key in delta.columns else None

    def evolve(self, schema: TableSchema) -> None:
        """Replaces the schema by one that adds, renames or drops fields."""
        self.schema().evolve(schema)
        self.files.replace(f"{self.root}/schema.json", schema.to_json())


class Catalog:
    """All tables below a root folder."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 16, exclusive: bool = True) -> None:
        if not root:
            raise CatalogError("a catalog needs a path")
        self.spark, self.root, self.buckets, self.exclusive = spark, str(root).rstrip("/"), buckets, exclusive
        self.files = Storage(spark)
        self.files.make(self.root)

    def tables(self) -> list[str]:
        """Names of tables; folders of unfinished reloads and hidden ones are none."""
        return [n for n in self.files.folders(self.root) if not n.endswith(SKIPPED_SUFFIX) and self.files.exists(f"{self.root}/{n}/schema.json")]

    def create(self, name: str, schema: TableSchema, kind: str = "kv") -> Table:
        check_name(name)
        if kind not in KINDS:
            raise CatalogError(f"unknown kind {kind}")
        folder = f"{self.root}/{name}"
        if self.files.exists(folder):
            raise CatalogError(f"{name} exists")
        schema.validate()
        self.files.make(folder)
        self.files.replace(f"{folder}/table.json", json.dumps({"kind": kind}))
        self.files.replace(f"{folder}/schema.json", schema.to_json())
        return Table(self, name)

    def open(self, name: str, kind: str | None = None) -> Table:
        if check_name(name) not in self.tables():
            raise CatalogError(f"unknown table {name}")
        table = Table(self, name)
        if kind and table._kind() != kind:
            raise CatalogError(f"{name} is {table._kind()}, not {kind}")
        return table

    # ------------------------------------------------ builds, releases, deployment

    def build(self, name: str, schema: TableSchema, rows: DataFrame, kind: str = "kv") -> Table:
        """Rebuilds a table from nothing, beside the live one, which gives way when the new one is complete."""
        folder, fresh = f"{self.root}/{check_name(name)}", f"{self.root}/{name}{SKIPPED_SUFFIX}"
        self.files.delete(fresh)
        self.create(f"{name}{SKIPPED_SUFFIX}", schema, kind).commit(rows)
        old = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        if self.files.exists(folder):
            self.files.move(folder, old)
        self.files.move(fresh, folder)
        self.files.delete(old)
        return Table(self, name)

    def _copy(self, source: Snapshot, target: str) -> None:
        """A version to another place, whole: data and postings by Spark, then the small files, then its name."""
        folder, name = target.rsplit("/", 1)
        draft = f"{folder}/.{name}"
        self.files.delete(draft)
        write_data(source._read("data", source.stored(), F.col(kv.BUCKET)), f"{draft}/data", source.meta["columns"].get(str(source.schema.key_field.number), source.schema.key))
        if source.kind == "inverted":
            write_postings(source.postings, f"{draft}/postings")
        meta = {k: v for k, v in source.meta.items() if k != "parts"} | {"bytes": self.files.bytes(draft), "build_id": name}
        self.files.replace(f"{draft}/meta.json", json.dumps(meta, indent=2))
        for side in SIDES:
            at = f"{source.path}/{side}" if self.files.exists(f"{source.path}/{side}") else f"{source.path.rsplit('/', 1)[0]}/{side}"
            self.files.replace(f"{draft}/{side}", self.files.read(at))
        self.files.delete(target)
        self.files.move(draft, target)

    def publish(self, name: str, store: str, build_id: str | None = None) -> str:
        """Copies the active version of a table to a release store and names the release."""
        source = self.open(name).acquire()
        target = f"{store.rstrip('/')}/{name}"
        self.files.make(target)
        build_id = build_id or new_build_id(lambda b: self.files.exists(f"{target}/{b}"))
        self._copy(source, f"{target}/{build_id}")
        return build_id

    def deploy(self, name: str, store: str, build_id: str | None = None, keep: int = 2, refresh: bool = False) -> str:
        """Takes a release (the latest if none is named) into this catalog, prunes and switches to it."""
        source = f"{store.rstrip('/')}/{check_name(name)}"
        found = self.files.folders(source)
        build_id = build_id or max(found, default=None)
        if build_id not in found:
            raise CatalogError(f"no release {build_id} of {name}")
        folder = f"{self.root}/{name}"
        self.files.make(folder)
        schema = parse_schema(self.files.read(f"{source}/{build_id}/schema.json"))
        if refresh or not self.files.exists(f"{folder}/{build_id}"):
            meta = json.loads(self.files.read(f"{source}/{build_id}/meta.json"))
            self._copy(Snapshot(schema, meta["kind"], build_id, f"{source}/{build_id}", meta["buckets"], meta, self.spark), f"{folder}/{build_id}")
        for side in SIDES:
            self.files.replace(f"{folder}/{side}", self.files.read(f"{folder}/{build_id}/{side}"))
        table = Table(self, name)
        table.switch(build_id)
        if keep:
            table.prune(keep)
        return build_id

    def command(self, line: str) -> str:
        """The admin protocol: `reload <table>` answers ok or err."""
        words = line.split()
        if len(words) != 2 or words[0] != "reload":
            return "err: unknown command"
        try:
            self.open(words[1]).switch()
        except CatalogError as e:
            return f"err: {e}"
        return "ok"
