"""Embedding near-duplicates by sorted projection passes.

Vectors are compared when their labels are equal and not null, by cosine in double precision. Each pass draws random
hyperplanes; a vector's key is the concatenation of their sides, and vectors are ordered by label and key. Within a
pass, each vector is compared with its WINDOW neighbours on either side, and verified pairs join groups that are
united across passes. Windows bound a pass, not the result: the distinct vectors of a label are then settled in full,
in pairs of blocks of about LIMIT, which counts every link and unites groups that no pass has brought together. So
no link is missed, however crowded a label is; the settling is quadratic in the distinct vectors of a label.

Passes run AT_ONCE in a job and write the pairs that connect their groups, so the disks hold the shuffle of so many
passes at a time; vectors travel in the width that they came in (a float is the same number as a double).

Equal vectors of a label become one representative with a number of copies first. Edge cases: a vector that is null,
zero or has null or non-finite parts links with nothing, as does one of null label or null vec_id; vectors of
different lengths do not link; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import join_apart, release, remove, shared_folder, table, written
from keystrata.llm.graph import components

COSINE = 0.98
PASSES = 12
AT_ONCE = 4
PLANES = 24
WINDOW = 24
LIMIT = 4096


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector as bytes of its numbers (null where it can't link) and dim of each row."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    wide = pa.float32() if kind is np.float32 else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["embedding"]
            long = np.asarray(pc.fill_null(pc.list_value_length(rows), 0)).astype(np.int64)
            flat = pc.list_flatten(rows)
            # Zero plus zero: a negative zero is a zero.
            x = np.asarray(pc.fill_null(flat, np.nan).cast(wide)).astype(kind) + kind(0)
            upto = np.concatenate([[0], np.cumsum(long)])
            sums = lambda y: np.diff(np.concatenate([[0], np.cumsum(y)])[upto])
            good = (long > 0) & (sums(~np.isfinite(x)) == 0) & (sums(x != 0) > 0)
            size = np.dtype(kind).itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(long), [None, pa.py_buffer((upto * size).astype(np.int32)), pa.py_buffer(x.tobytes())])
            vector = pc.if_else(pa.array(good), blobs, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], vector, pa.array(long.astype(np.int32))], ["vec_id", "label", "vector", "dim"])

    embedding = F.col("embedding") if kind is np.float32 else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), embedding.alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label long, vector binary, dim int")


def _unit(blobs: list[bytes], dim: int) -> np.ndarray:
    """Vectors of length one in doubles, from bytes of floats or doubles."""
    data = b"".join(blobs)
    x = np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(blobs) else np.float64).astype(np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(reps: DataFrame, numbers: list[int], planes: int) -> DataFrame:
    """The vectors with their key in each of these passes, whose planes depend on its number and the dimension alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                dims = np.asarray(batch["dim"])
                for dim in np.unique(dims).tolist():
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    if dim not in drawn:
                        drawn[dim] = np.concatenate([np.random.default_rng((dim, k)).standard_normal((dim, planes)) for k in numbers], 1)
                    side = _unit(part["vector"].to_pylist(), dim) @ drawn[dim] > 0
                    for at, k in enumerate(numbers):
                        code = side[:, at * planes : (at + 1) * planes] @ (1 << np.arange(planes - 1, -1, -1, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), part["label"], part["dim"], pa.array(code), part["vec_id"], part["vector"]], ["pass", "label", "dim", "key", "vec_id", "vector"])

    return reps.select("vec_id", "label", "dim", "vector").mapInArrow(run, "pass int, label long, dim int, key long, vec_id long, vector binary")


def _neighbours(keyed: DataFrame, window: int, cosine: float) -> DataFrame:
    """Verified pairs of neighbours, reduced to edges that connect the same vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for whole in batches:
            for i in range(0, whole.num_rows, 4000):
                batch = whole.slice(i, 4000)
                group = np.stack([np.asarray(batch[c]).astype(np.int64) for c in ("pass", "label", "dim")], 1)
                ids, blobs = np.asarray(batch["vec_id"]), np.array(batch["vector"].to_pylist(), object)
                fresh = np.zeros(len(ids), bool)
                if kept is not None:
                    fresh = np.concatenate([np.ones(len(kept["ids"]), bool), fresh])
                    group, ids, blobs = np.concatenate([kept["group"], group]), np.concatenate([kept["ids"], ids]), np.concatenate([kept["blobs"], blobs])
                edges = []
                cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1), [True]]))
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    x = _unit(blobs[lo:hi].tolist(), int(group[lo, 2]))
                    for step in range(1, min(window, hi - lo - 1) + 1):
                        a = np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= cosine)
                        a = a[~fresh[lo + a + step]]
                        edges.append(np.stack([ids[lo + a], ids[lo + a + step]], 1))
                kept = {"group": group[-window:], "ids": ids[-window:], "blobs": blobs[-window:]}
                pairs = _forest(np.concatenate(edges)) if edges else np.empty((0, 2), np.int64)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    ordered = keyed.repartitionByRange("pass", "label", "dim", "key", "vec_id").sortWithinPartitions("pass", "label", "dim", "key", "vec_id")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Each vector of the pairs with the smallest that they connect it to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([(x, find(x)) for x in parent if find(x) != x], np.int64).reshape(-1, 2)


def _settled(tasks: DataFrame, cosine: float) -> DataFrame:
    """Links of each vector in its task, a task being rows of equal (label, dim, i, j), one after another.

    Rows with another component, other, say that it has a link with the component vec_id; they have no links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            if not rows:
                return
            ids, component, copies, block = (np.array([r[k] for r in rows]) for k in range(4))
            x = _unit([r[4] for r in rows], key[1])
            left = np.ones(len(rows), bool) if key[2] == key[3] else block == key[2]
            right = left if key[2] == key[3] else ~left
            links, apart = np.zeros(len(rows), np.int64), []
            r = np.flatnonzero(right)
            for at in np.array_split(np.flatnonzero(left), max(1, left.sum() // 512)):
                near = x[at] @ x[r].T >= cosine
                near[at[:, None] == r[None, :]] = False
                links[at] += near @ copies[r]
                if key[2] != key[3]:
                    links[r] += copies[at] @ near
                near &= component[at][:, None] != component[r][None, :]
                a, b = np.nonzero(near)
                apart.append(_forest(np.unique(np.stack([component[at[a]], component[r[b]]], 1), axis=0)))
            out.extend((i, n, None) for i, n in zip(ids.tolist(), links.tolist(), strict=True) if n)
            out.extend((a, None, b) for a, b in _forest(np.concatenate(apart)).tolist())

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["vec_id", "links", "other"])
            out.clear()
            return batch

        for whole in batches:
            for *own, vec, component, copies, block, blob in zip(*(whole[c].to_pylist() for c in ("label", "dim", "i", "j", "vec_id", "component", "copies", "block", "vector")), strict=True):
                if tuple(own) != key:
                    close()
                    key, rows = tuple(own), []
                    if len(out) > 20_000:
                        yield flush()
                rows.append((vec, component, copies, block, blob))
        close()
        if out:
            yield flush()

    dealt = tasks.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "vec_id")
    return dealt.mapInArrow(run, "vec_id long, links long, other long")


def near(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, planes: int = PLANES, window: int = WINDOW) -> DataFrame:
    """Rows (vec_id, embedding, label) to vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = written(_clean(vectors), folder, "rows")
    able = rows.where("vector IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    rep = able.groupBy("label", "vector").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("copies"), F.min("dim").alias("dim"))
    reps = written(rep.select(F.col("rep_id").alias("vec_id"), "label", "vector", "dim", "copies"), folder, "reps")
    for first in range(0, passes, AT_ONCE):
        numbers = list(range(first, min(passes, first + AT_ONCE)))
        written(_neighbours(_keys(reps, numbers, planes), window, cosine), folder, f"edges/first={first}")
        release(spark)
    edges = spark.read.schema("u long, v long").parquet(f"{folder}/edges").select("u", "v").distinct()
    found = components(edges, folder, "vectors").withColumnRenamed("node", "vec_id")
    count = reps.groupBy("label", "dim").agg(F.count("*").alias("members"))
    inside = join_apart(reps, count, "label", "dim").join(found, "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    inside = inside.withColumn("parts", F.ceil(F.col("members") / LIMIT).cast("int")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    tasks = inside.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "label", "dim", "vec_id", "component", "copies", "block", "vector", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")
    )
    settled = written(_settled(tasks, cosine), folder, "settled")
    links = settled.where("other IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep_id")
    apart = settled.where("other IS NOT NULL").select(F.col("vec_id").alias("u"), F.col("other").alias("v"))
    group = found.withColumnRenamed("vec_id", "rep_id")
    if not apart.isEmpty():
        united = components(edges.unionByName(apart), folder, "united")
        group = united.withColumnRenamed("node", "rep_id")
    known = group.join(links, "rep_id", "left")
    members = reps.withColumnRenamed("vec_id", "rep_id").join(known, "rep_id", "left").select("label", "vector", F.coalesce("component", "rep_id").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0)
    result = join_apart(rows, members, "label", "vector", how="left").select(
        "vec_id", links.cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept")
    )
    result = written(result, folder, "result")
    remove(spark, *(f"{folder}/{name}" for name in ("rows", "reps", "edges", "settled")))
    return result


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal vectors."""
    return near(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


#: All pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM c a JOIN c b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = v.vec_id), vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = v.vec_id), vec_id) AS kept FROM v
"""
