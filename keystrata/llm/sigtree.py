"""N-gram Jaccard join by signature trees.

A document's set is its distinct five-word shingles (lower-cased A-Z); of fewer words, the whole sequence as one. Two
documents link when 100 * intersection >= 80 * union. The join is exact:

1. Documents of equal sets become one representative with a number of copies, by partial aggregation on a digest.
2. Shingles are counted over all representatives (blocks send sorted counts to range buckets and get back those above
   one). A set's rarest shingles, the 0.2 n + 1 first of the common order, are its keys; linked sets share a key.
3. Sets that share keys, directly or through others, form a candidate cluster, which only says where sets meet: each
   is sent to its cluster once, and small clusters fill tasks of up to LIMIT sets or SHINGLES shingles. A larger one is
   dealt in the cheaper of two ways, by the rows that they send: its sets in blocks, a task for each pair of blocks
   (many copies of one text), or a task for each distinct group of sets with a common key, where a pair counts at its
   smallest common group only (long chains of texts that each share something with the next).
4. In a task, a tree holds all its sets, whatever cluster they are of: leaves of LEAF sets, nodes of FAN children, with
   OR-combined token bitmaps and ranges of sizes. The tree is walked against itself or another one, and a pair of nodes
   is dropped when its sizes or its largest possible overlap rule every pair of sets out. What the walk leaves is
   settled on exact sets. Tasks return counts of links and the smallest partner reached, never pairs.

Edge cases: null or empty texts have no shingle and link with nothing, each being a component of its own; repeated
rows count as copies; a null doc_id is returned with a null component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import LOWER, U, block_count, join_apart, occurring, pieces, release, remove, shared_folder, shuffle_partitions, table, window_hashes, words_of, written
from keystrata.llm.graph import components

WORDS = 5
PERCENT = 80
BLOCK_BYTES = 8 << 20
LIMIT = 1000
#: Clusters of more than MANY times LIMIT sets have blocks three times as large, which are sent a third as often.
MANY = 20
SHINGLES = 2 << 20
LEAF = 4
FAN = 4


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = words_of(texts, through=LOWER)
    h = w.hashes[0]
    full = window_hashes(h, words)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.empty(0, U))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            sets = shingle_sets(batch["text"], words)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "n_shingles", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sig binary")


def _members(signatures: DataFrame) -> DataFrame:
    """Each row with the smallest doc_id of its set and the number of rows of that set."""
    some = signatures.where("n_shingles > 0 AND doc_id IS NOT NULL")
    rep = some.groupBy("sig").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"))
    own = join_apart(some, rep, "sig").select("doc_id", "n_shingles", "rep_id", "copies")
    rest = signatures.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("rep_id"), F.lit(1).cast("long").alias("copies"))
    return own.unionByName(rest)


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers (one at least) as the first one and gaps, in the least width that holds every gap."""
    gaps = np.diff(values)
    most = int(gaps.max()) if len(gaps) else 0
    width = 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + values[:1].tobytes() + gaps.astype(f"<u{width}").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, f"<u{blob[0]}", -1, 9).astype(U)
    return np.concatenate([np.frombuffer(blob, U, 1, 1), gaps]).cumsum(dtype=U)


def _candidates(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Representatives with the keys that another one has too: doc_id, n, keys, shingles."""
    spark = docs.sparkSession
    blocks = block_count(docs, "text", BLOCK_BYTES)
    buckets = max(shuffle_partitions(spark), blocks // 2)
    pid = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("pid")
    texts = docs.where("doc_id IS NOT NULL").select(pid, "doc_id", "text")
    chosen = members.where("n_shingles > 0 AND doc_id = rep_id").select(pid, F.col("doc_id").alias("rep_id")).distinct()
    # Counting needs the top bits of hashes only: 32 times as many numbers as there are shingles, so that few share one.
    shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(60, max(32, int(shingles).bit_length() + 5))
    short = lambda s: s >> U(64 - bits)
    step = (1 << bits) / buckets

    def own_sets(texts: pa.Table, reps: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        wanted = set(reps.to_pylist())
        for batch in texts.to_batches():
            for part in pieces(batch, "text"):
                ids = part["doc_id"].to_pylist()
                take = [i for i, d in enumerate(ids) if d in wanted]
                if take:
                    wanted.difference_update(ids[i] for i in take)
                    seen: set[int] = set()
                    for i, s in zip(take, shingle_sets(part["text"].take(pa.array(take)), words), strict=True):
                        if ids[i] not in seen:
                            seen.add(ids[i])
                            yield ids[i], s

    empty = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("vals", pa.binary()), ("times", pa.binary())])

    def ask(texts: pa.Table, reps: pa.Table) -> pa.Table:
        if not texts.num_rows or not reps.num_rows:
            return empty.empty_table()
        sets = [short(s) for _, s in own_sets(texts, reps["rep_id"])]
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        rows = occurring((values / step).astype(np.int64))
        p = texts["pid"][0].as_py()
        return pa.table([pa.array([b for b, _, _ in rows], pa.int32()), pa.array([p] * len(rows), pa.int32()), pa.array([_packed(values[i:j]) for _, i, j in rows], pa.binary()), pa.array([np.minimum(times[i:j], 255).astype(np.uint8).tobytes() for _, i, j in rows], pa.binary())], schema=empty)

    answer = pa.schema([("pid", pa.int32()), ("rep_id", pa.int64()), ("vals", pa.binary()), ("times", pa.binary())])

    def count(asked: pa.Table) -> pa.Table:
        values = [_unpacked(v.as_py()) for v in asked["vals"]]
        times = [np.frombuffer(t.as_py(), np.uint8) for t in asked["times"]]
        whole = np.concatenate(values)
        distinct, place = np.unique(whole, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(times), minlength=len(distinct)).astype(np.int64)
        vals, often = [], []
        for v in values:
            t = total[np.searchsorted(distinct, v)]
            keep = t > 1
            vals.append(v[keep].tobytes())
            often.append(np.minimum(t[keep], 65535).astype(np.uint16).tobytes())
        return pa.table([asked["pid"].combine_chunks().cast(pa.int32()), pa.nulls(len(vals), pa.int64()), pa.array(vals, pa.binary()), pa.array(often, pa.binary())], schema=answer)

    result = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary())])

    def choose(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows or not told.num_rows:
            return result.empty_table()
        blobs = [(v, t) for v, t in zip(told["vals"].to_pylist(), told["times"].to_pylist(), strict=True) if v]
        values = np.concatenate([np.frombuffer(v, U) for v, _ in blobs] or [np.empty(0, U)])
        times = np.concatenate([np.frombuffer(t, np.uint16) for _, t in blobs] or [np.empty(0, np.uint16)])
        order = np.argsort(values)
        values, times = values[order], times[order]
        rows: list[tuple] = []
        if len(values):
            for doc, s in own_sets(texts, told["rep_id"].drop_null()):
                top = short(s)
                at = np.minimum(np.searchsorted(values, top), len(values) - 1)
                df = np.where(values[at] == top, times[at], 1)
                if df.max() < 2:
                    continue
                first = np.lexsort((s, df))[: prefix_length(len(s), percent)]
                keys = s[first][df[first] > 1]
                if len(keys):
                    rows.append((doc, len(s), keys.view(np.int64), s.tobytes()))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.binary())], schema=result)

    asked = texts.groupBy("pid").cogroup(chosen.groupBy("pid")).applyInArrow(ask, "bucket int, pid int, vals binary, times binary")
    told = asked.groupBy("bucket").applyInArrow(count, "pid int, rep_id long, vals binary, times binary")
    none = F.lit(None).cast("binary")
    told = told.unionByName(chosen.select("pid", "rep_id", none.alias("vals"), none.alias("times")))
    return texts.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(choose, "doc_id long, n long, keys array<long>, shingles binary")


class Tree:
    """Sets in leaves of LEAF, FAN nodes to a parent. Per node: OR of bitmaps, sizes, slack of sizes over bits."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        self.levels = []
        ones = np.bitwise_count(bits).sum(1).astype(np.int64)
        low, high, slack = sizes, sizes, sizes - ones
        width = LEAF
        while True:
            cut = np.arange(0, len(low), width)
            bits = np.bitwise_or.reduceat(bits, cut, axis=0)
            low, high, slack = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)
            self.levels.append((bits, low, high, slack))
            if len(low) == 1:
                break
            width = FAN

    def pairs(self, other: Tree, percent: int, tally: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that may hold a linked pair, a level of both trees at a time; of one tree, x <= y.

        tally counts the pairs of nodes looked at and those dropped.
        """
        depth = max(len(self.levels), len(other.levels)) - 1
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(depth, -1, -1):
            la, lb = min(level, len(self.levels) - 1), min(level, len(other.levels) - 1)
            if self is other:
                a, b = a[a <= b], b[a <= b]
            keep = self._may(self.levels[la], other.levels[lb], a, b, percent)
            if tally is not None:
                tally["seen"] = tally.get("seen", 0) + len(a)
                tally["dropped"] = tally.get("dropped", 0) + int(len(a) - keep.sum())
            a, b = a[keep], b[keep]
            if level == 0:
                break
            a, b = self._open(a, b, len(self.levels[la - 1][1]) if la == level else 0, len(other.levels[lb - 1][1]) if lb == level else 0)
        yield from ((a[i : i + 512], b[i : i + 512]) for i in range(0, len(a), 512))

    @staticmethod
    def _open(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
        """Children of each pair; a count of 0 keeps that side as it is."""
        if na:
            a, b = (a[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(b, FAN)
            a, b = a[a < na], b[a < na]
        if nb:
            a, b = np.repeat(a, FAN), (b[:, None] * FAN + np.arange(FAN)).ravel()
            a, b = a[b < nb], b[b < nb]
        return a, b

    @staticmethod
    def _may(x: tuple, y: tuple, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        keep = (100 * x[2][a] >= percent * y[1][b]) & (100 * y[2][b] >= percent * x[1][a])
        left = np.flatnonzero(keep)
        for i in range(0, len(left), 4096):
            some = left[i : i + 4096]
            p, q = a[some], b[some]
            shared = np.bitwise_count(x[0][p] & y[0][q]).sum(1).astype(np.int64)
            most = np.minimum(x[3][p], y[3][q]) + shared
            keep[some] = (100 + percent) * most >= percent * (x[1][p] + y[1][q])
        return keep


def _bitmap(places: np.ndarray, width: int) -> np.ndarray:
    """A row of width bits (a multiple of 64) with those at the places set."""
    bits = np.zeros(width, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").view(U)


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT, hint: np.ndarray | None = None, tally: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j): within left where right is None (i < j), else across. Sets are sorted and not empty.

    hint orders the sets of left before all else; sets that are alike should lie together.
    """
    sides = [left] if right is None else [left, right]
    if any(not side for side in sides):
        return
    everything = np.concatenate([s for side in sides for s in side])
    distinct, times = np.unique(everything, return_counts=True)
    common = distinct[times > 1]
    # Shingles that two sets here share, numbered: with few of them, bitmaps of numbers are exact sets.
    exact = 0 < len(common) * sum(map(len, sides)) <= 8 * (32 << 20)
    width = 1 << max(8, math.ceil(math.log2(8 * np.quantile([len(s) for side in sides for s in side], 0.75) + 1)))
    prepared = []
    for side in sides:
        sizes = np.array([len(s) for s in side], np.int64)
        least = np.array([s[0] for s in side], U)
        # Sets of like size lie together, and of these such as share their smallest hash.
        band = np.floor(np.log(sizes) / math.log(100 / percent))
        order = np.lexsort((sizes, least, band, hint if hint is not None and side is left else band))
        ordered = [side[i] for i in order]
        bits = np.stack([_bitmap((s & U(width - 1)).astype(np.int64), width) for s in ordered])
        full = None
        if exact:
            full = np.zeros((len(side), -(-len(common) // 64)), U)
            for i, s in enumerate(ordered):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                full[i] = _bitmap(at[common[at] == s], 64 * full.shape[1])
        prepared.append((order, ordered, sizes[order], Tree(bits, sizes[order]), full))
    if not len(common):
        return
    (oa, sa, na, ta, fa), (ob, sb, nb, tb, fb) = prepared[0], prepared[-1]
    inside = np.arange(LEAF)
    most = max(64, (16 << 20) // (8 * fa.shape[1])) if exact else 1 << 14
    for p, q in ta.pairs(tb, percent, tally):
        i = np.broadcast_to(p[:, None, None] * LEAF + inside[None, :, None], (len(p), LEAF, LEAF)).ravel()
        j = np.broadcast_to(q[:, None, None] * LEAF + inside[None, None, :], (len(p), LEAF, LEAF)).ravel()
        fits = (i < len(sa)) & (j < len(sb))
        if right is None:
            fits &= i < j
        i, j = i[fits], j[fits]
        fits = (100 * na[i] >= percent * nb[j]) & (100 * nb[j] >= percent * na[i])
        i, j = i[fits], j[fits]
        for k in range(0, len(i), most):
            u, v = i[k : k + most], j[k : k + most]
            if exact:
                overlap = np.bitwise_count(fa[u] & fb[v]).sum(1).astype(np.int64)
            else:
                overlap = np.array([len(np.intersect1d(sa[x], sb[y], assume_unique=True)) for x, y in zip(u, v, strict=True)], np.int64)
            linked = 100 * overlap >= percent * (na[u] + nb[v] - overlap)
            if linked.any():
                yield oa[u[linked]], ob[v[linked]]


def settle(ids: list[int], copies: list[int], sets: list[np.ndarray], other: list[bool] | None, percent: int, hint: list[int] | None = None, groups: list[np.ndarray] | None = None, group: int | None = None) -> tuple[list[int], list[int]]:
    """For each set of a task: the smallest id that its links reach here, and its number of linked rows.

    With groups, those that each set is in, a link counts where `group` is the smallest that both sets are in.
    """
    n = len(ids)
    parent, links = list(range(n)), np.zeros(n, np.int64)
    weight = np.array(copies, np.int64)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if other is None:
        left, right = np.arange(n), None
    else:
        left, right = np.flatnonzero(~np.array(other)), np.flatnonzero(other)
    for i, j in tree_join([sets[k] for k in left], None if right is None else [sets[k] for k in right], percent, None if hint is None else np.array(hint, U)):
        a = left[i]
        b = (left if right is None else right)[j]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                if ids[x] > ids[y]:
                    x, y = y, x
                parent[y] = x
        if groups is not None:
            here = np.array([np.intersect1d(groups[x], groups[y], assume_unique=True)[0] == group for x, y in zip(a, b, strict=True)], bool)
            a, b = a[here], b[here]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
    return [ids[find(i)] for i in range(n)], links.tolist()


def _settled(tasks: DataFrame, percent: int) -> DataFrame:
    """Streams tasks, each being rows of equal (unit, i, j), through the tree join; whole clusters (i = -1) share trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held, out = None, [], 0, []

        def close() -> None:
            nonlocal rows, held
            if rows:
                unit, i, j = key
                whole, other = i == -1, None if i == j else [r[2] == j for r in rows]
                groups = [r[4] for r in rows] if rows[0][4] is not None else None
                root, links = settle([r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows], other, percent, [r[5] for r in rows] if whole else None, groups, unit)
                out.extend((r[0], m, k, not whole) for r, m, k in zip(rows, root, links, strict=True))
            rows, held = [], 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "root", "links", "split"])
            out.clear()
            return batch

        number = 0
        for batch in batches:
            for unit, i, j, doc, copies, block, groups, blob in zip(*(batch[c].to_pylist() for c in ("unit", "i", "j", "doc_id", "copies", "block", "groups", "shingles")), strict=True):
                if (unit, i, j) != key:
                    if key is None or not (key[1] == i == -1) or len(rows) >= LIMIT or held >= SHINGLES:
                        close()
                        if len(out) > 20_000:
                            yield flush()
                    key, number = (unit, i, j), number + 1
                rows.append((doc, copies, block, np.frombuffer(blob, U), None if groups is None else np.sort(np.array(groups, np.int64)), number))
                held += len(blob) >> 3
        close()
        if out:
            yield flush()

    # Whole clusters come together by -1, split ones one by one.
    dealt = tasks.repartition("unit", "i", "j").sortWithinPartitions("i", "j", "unit", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, root long, links long, split boolean")


def _parts(members: Column, shingles: Column) -> Column:
    """Blocks of a unit, so that a pair of them has about LIMIT sets, and SHINGLES shingles, at most."""
    limit = F.when(members > MANY * LIMIT, 3 * LIMIT).otherwise(LIMIT)
    need = F.greatest(members / limit, shingles / F.lit(SHINGLES))
    return F.when(need > 1, F.ceil(2 * need)).otherwise(1).cast("int")


def _units(found: DataFrame, keys: DataFrame, clusters: DataFrame) -> DataFrame:
    """Where each set is sent: doc_id, unit, parts, whole, and the groups of sets of sparse clusters."""
    sizes = found.select("doc_id", "n")
    known = clusters.join(sizes, "doc_id")
    count = known.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("total")).withColumn("parts", _parts(F.col("members"), F.col("total")))
    none = F.lit(None).cast("array<long>").alias("groups")
    placed = join_apart(clusters, count, "cluster").select("doc_id", F.col("cluster").alias("unit"), "parts", (F.col("parts") == 1).alias("whole"), none)
    large = count.where("parts > 1").select("cluster", (F.col("members") * F.col("parts")).alias("cost"))
    if large.isEmpty():
        return placed
    # Groups of sets with a common key inside large clusters; keys of the same sets are one group.
    held = keys.join(join_apart(known, large, "cluster").select("doc_id", "n", "cluster"), "doc_id")
    group = held.groupBy("cluster", "key").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("same")).where("members > 1")
    group = group.groupBy("cluster", "members", "total", "same").agg(F.min("key").alias("key")).withColumn("parts", _parts(F.col("members"), F.col("total")))
    sparse = group.groupBy("cluster").agg(F.sum(F.col("members") * F.col("parts")).alias("by_group")).join(large, "cluster").where("by_group < cost").select("cluster")
    member = join_apart(held.select("doc_id", "key", "cluster"), group.select("cluster", "key", "parts").join(sparse, "cluster"), "cluster", "key")
    groups = member.groupBy("doc_id").agg(F.collect_list("key").alias("groups"))  # at most the keys of a set
    apart = member.join(groups, "doc_id").select("doc_id", F.col("key").alias("unit"), "parts", F.lit(False).alias("whole"), "groups")
    return placed.join(sparse.withColumnRenamed("cluster", "unit"), "unit", "left_anti").select(*apart.columns).unionByName(apart)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, n_links."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    members = written(_members(written(_signatures(docs, words), folder, "signatures")), folder, "members")
    remove(spark, f"{folder}/signatures")
    found = written(_candidates(docs, members, words, percent), folder, "candidates")
    release(spark)
    keys = found.select("doc_id", F.explode("keys").alias("key"))
    center = keys.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1")
    edges = join_apart(keys, center, "key").select(F.col("doc_id").alias("u"), F.col("center").alias("v"))
    clusters = written(components(edges, folder, "near").withColumnsRenamed({"node": "doc_id", "component": "cluster"}), folder, "clusters")
    copies = members.where("doc_id = rep_id").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    # The sets are the large side; they are shuffled once, to what is known of each document, and once to their tasks.
    placed = _units(found, keys, clusters).join(copies, "doc_id")
    rows = found.select("doc_id", "shingles").join(placed, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.col("block"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    end = lambda f: F.when(F.col("whole"), -1).otherwise(f("block", "with"))
    tasks = rows.withColumn("with", other).select("unit", "doc_id", "copies", "block", "groups", "shingles", end(F.least).alias("i"), end(F.greatest).alias("j"))
    settled = written(_settled(tasks, percent), folder, "settled")
    remove(spark, f"{folder}/candidates", f"{folder}/clusters")
    release(spark)
    links = settled.groupBy("doc_id").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("split").alias("split"))
    if settled.where("split").limit(1).count():
        # Blocks or groups of one cluster were settled apart: their links meet here.
        across = components(settled.where("split AND doc_id <> root").select(F.col("doc_id").alias("u"), F.col("root").alias("v")), folder, "across")
        links = links.join(across.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("component", "root"))
    # As a table its size is known, and a set with many copies is no hot key of a shuffle while it is short.
    links = written(links.select(F.col("doc_id").alias("rep_id"), "root", "links"), folder, "links")
    remove(spark, f"{folder}/settled")
    return members.join(links, "rep_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "rep_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return join(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id,
  (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links FROM d LEFT JOIN n USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keeps the document of smallest doc_id of each component; rows without doc_id stay."""
    drop = join(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    # As a table its size is known: Spark broadcasts it while it is short, and shuffles the texts only beyond.
    drop = written(drop, shared_folder(spark), "copies")
    release(spark)
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
