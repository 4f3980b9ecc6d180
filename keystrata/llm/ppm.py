"""Scoring by prediction by partial matching, with a trie of byte contexts learned from the whole corpus.

The model is a trie of byte contexts up to ORDER bytes, with the count of each next byte in the training texts. A
byte's probability comes from the longest context seen, (2 c - 1) / 2 n for a byte of count c among counts of n; a byte
that is new there escapes to the next shorter one with probability d / 2 n (d: distinct bytes), and bytes of the longer
context are excluded from the shorter one's n and d. Below order 0 all bytes left are equally likely. A text is its bytes, A-Z lower-cased, then
an end mark; contexts before the first byte are filled with that mark. Its score is the log10 probability.

The trie is never in one place. Documents are dealt into blocks; a block sends each distinct run of ORDER + 1 bytes
once, with its count, to the bucket of its hash. Buckets add up, and hand the distinct runs to model partitions by
the last three bytes of context, where all orders above two are complete; counts of order two go to the partitions
that have a context with that end (256 at most), those of orders zero and one, 65,536 at most, to all. Probabilities return the same way, bucket by bucket, so
traffic is bounded by the distinct runs of a block and grows with the input. A run that is in every document costs
its bucket one row a block.

The word baseline takes the same road: distinct words of a block (96-bit hashes) with their counts.

Edge cases: a null text is empty and has the end mark only; repeated rows count and are scored each; a byte 0xFF,
which no valid text holds, counts as 0xFE; without training texts all bytes are equally likely; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import CHUNK, LOWER, U, binary_parts, block_count, crc_rest, mix, occurring, pieces, shuffle_partitions, table, words_of

ORDER = 5
BLOCK_BYTES = 12 << 20
#: Model partitions at most; ten thousand million distinct runs are two and a half million to each.
MODELS = 4096
END = 255
END_KEY = (U(0x0123456789ABCDEF), np.uint32(0x89ABCDEF))

_BYTE = LOWER.copy()
_BYTE[255] = 254


def runs_of(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All runs of order + 1 bytes as numbers, last byte lowest, and the text of each."""
    data, offsets = binary_parts(texts)
    long = np.diff(offsets)
    n = len(long)
    buf = np.full(len(data) + n * (order + 1), END, np.uint8)
    begin = offsets[:-1] + np.arange(n) * (order + 1)
    if len(data):
        buf[np.arange(len(data)) + np.repeat((np.arange(n)) * (order + 1) + order, long)] = _BYTE[data]
    total = len(buf) - order
    if total <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    runs = np.zeros(total, U)
    for k in range(order + 1):
        runs <<= U(8)
        runs |= buf[k : k + total]
    inside = np.ones(len(buf), bool)
    for k in range(1, order + 1):
        inside[begin + long + k] = False
    owner = np.repeat(np.arange(n), long + 1)
    return runs[inside[:total]], owner


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that groups keys by the part of their hash, and the parts that occur with where they begin and end in it."""
    part = (mix(keys) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, occurring(part[order])


class Model:
    """Tables of one model partition: for each order, contexts with their counts, kinds, and what they exclude."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """tables[k]: sorted keys (context of k bytes, then the byte) with counts above zero."""
        self.tables = tables
        self.contexts = []
        for k, (keys, counts) in enumerate(tables):
            own = keys >> U(8)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
            below = self._counts(k - 1, keys & U((1 << (8 * k)) - 1)) if k else np.zeros(len(keys), np.int64)
            add = lambda x, first=first: np.add.reduceat(x, first) if len(first) else np.empty(0, np.int64)
            self.contexts.append((own[first], add(counts), np.diff(np.append(first, len(keys))), add(below)))

    def _counts(self, k: int, keys: np.ndarray) -> np.ndarray:
        own, counts = self.tables[k]
        if not len(own):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, counts[at], 0)

    def _context(self, k: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, *columns = self.contexts[k]
        if not len(own):
            return tuple(np.zeros(len(contexts), np.int64) for _ in columns)
        at = np.minimum(np.searchsorted(own, contexts), len(own) - 1)
        seen = own[at] == contexts
        return tuple(np.where(seen, c[at], 0) for c in columns)

    def log10(self, runs: np.ndarray) -> np.ndarray:
        """Log10 probability of each run's last byte after the bytes before it."""
        out = np.zeros(len(runs))
        open_ = np.arange(len(runs))
        cut_n, cut_d = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            q = runs[open_]
            n, d, below = self._context(k, (q >> U(8)) & U((1 << (8 * k)) - 1))
            left, kinds = n - cut_n[open_], d - cut_d[open_]
            # A context without anything left is passed at no cost.
            live = left > 0
            count = self._counts(k, q & U((1 << (8 * (k + 1))) - 1))
            hit = live & (count > 0)
            total = np.where(live, 2 * left, 1)
            out[open_] += np.where(hit, np.log10(np.maximum(2 * count - 1, 1) / total), np.where(live, np.log10(np.maximum(kinds, 1) / total), 0.0))
            seen = n > 0
            cut_n[open_] = np.where(seen, below, cut_n[open_] * 0)
            cut_d[open_] = np.where(seen, d, 0)
            open_ = open_[~hit]
        if len(open_):
            kinds = len(self.tables[0][0])
            out[open_] -= np.log10(max(1, 256 - kinds))
        return out


def partition_model(runs: np.ndarray, counts: np.ndarray, low: np.ndarray, low_counts: np.ndarray, order: int = ORDER, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """The model of a partition: all runs of its contexts, and the counts of three-byte runs of what these end with.

    pairs: the counts of all two-byte runs; left out, they come from the three-byte runs, which have to be all then.
    """
    known = counts > 0
    runs, counts = runs[known], counts[known]
    tables = []
    for k in range(order + 1):
        source, weight = (pairs or (low, low_counts)) if k <= 1 else (low, low_counts) if k == 2 else (runs, counts)
        tables.append(_added(source & U((1 << (8 * (k + 1))) - 1), weight))
    return Model(tables)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows (doc_id, text, train) to doc_id, n_tokens, n_known, log_sum, train_tokens, train_words, score, n_bytes.

    train says which rows the model learns from; all rows are scored. log_sum is the sum of log10(count + 1) of the
    tokens. Texts of one block are together in one task, once to send their runs and once to be scored.
    """
    blocks = block_count(docs, "text", BLOCK_BYTES)
    buckets = max(shuffle_partitions(docs.sparkSession), blocks)
    # The distinct runs grow far slower than the corpus, and each model partition gets the counts of short runs.
    models = max(4, min(buckets // 4, MODELS))
    own = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    texts = docs.select(F.pmod(F.xxhash64(own), F.lit(blocks)).cast("int").alias("pid"), "doc_id", "train", F.col("text").cast("binary").alias("text"))

    def block_runs(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [(np.empty(0, U), np.empty(0, np.int64))]
        for batch in block.to_batches():
            for part in pieces(batch, "text", CHUNK):
                train = np.asarray(part["train"]).astype(bool)
                r, owner = runs_of(part["text"], order)
                key = (r << U(1)) | train[owner]
                key.sort()
                first = np.flatnonzero(np.concatenate([[True], (key[1:] >> U(1)) != (key[:-1] >> U(1))])) if len(key) else np.empty(0, np.int64)
                parts.append((key[first] >> U(1), np.add.reduceat((key & U(1)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)))
                parts = merged(parts, _added)
        return _added(*map(np.concatenate, zip(*parts, strict=True)))

    def block_words(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        end = np.asarray(block["train"]).astype(bool).sum()
        parts = [(np.array([END_KEY[0]], U), np.array([END_KEY[1]], np.uint32), np.array([end], np.int64))]
        for batch in block.to_batches():
            for part in pieces(batch, "text", CHUNK):
                w = words_of(part["text"], through=LOWER, hashes=2)
                train = np.asarray(part["train"]).astype(bool)[w.owner()]
                parts.append(added_words(w.hashes[0], (w.hashes[1] >> U(32)).astype(np.uint32), train.astype(np.int64)))
                parts = merged(parts, added_words)
        return added_words(*map(np.concatenate, zip(*parts, strict=True)))

    def merged(parts: list[tuple[np.ndarray, ...]], add: Callable[..., tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        """Sums of pieces are merged when they outweigh what is merged already, so no more than that lies about twice."""
        loose = sum(len(x[0]) for x in parts[1:])
        return [add(*map(np.concatenate, zip(*parts, strict=True)))] if loose > max(1 << 19, len(parts[0][0])) else parts

    def added_words(k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(k1):
            return k1, k2, n
        o = np.argsort(k1, kind="stable")
        k1, k2, n = k1[o], k2[o], n[o]
        first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        return k1[first], k2[first], np.add.reduceat(n, first)

    asked = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("runs", pa.binary()), ("counts", pa.binary()), ("k1", pa.binary()), ("k2", pa.binary()), ("words", pa.binary())])

    def ask(key: tuple, block: pa.Table) -> pa.Table:
        runs, counts = block_runs(block)
        o, cut = _dealt(runs, buckets)
        runs, counts = runs[o], counts[o]
        k1, k2, n = block_words(block)
        wo, wcut = _dealt(k1, buckets)
        k1, k2, n = k1[wo], k2[wo], n[wo]
        s, t = ({b: slice(i, j) for b, i, j in found} for found in (cut, wcut))
        some, none = sorted(s.keys() | t.keys()), slice(0, 0)
        s, t = [s.get(b, none) for b in some], [t.get(b, none) for b in some]
        blobs = [[runs[x].tobytes() for x in s], [counts[x].astype(np.uint32).tobytes() for x in s], [k1[x].tobytes() for x in t], [k2[x].tobytes() for x in t], [n[x].astype(np.uint32).tobytes() for x in t]]
        return pa.table([pa.array(some, pa.int32()), pa.array([key[0].as_py()] * len(some), pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], schema=asked)

    def joined(rows: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        blobs = rows[name].to_pylist()
        bounds = np.cumsum([0] + [len(b) // np.dtype(kind).itemsize for b in blobs])
        return np.frombuffer(b"".join(blobs), kind), bounds

    def bucket_runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs with their sums, in the order of model partitions, and where those begin."""
        runs, counts = _added(joined(rows, "runs", U)[0], joined(rows, "counts", np.uint32)[0])
        o, cut = _dealt((runs >> U(8)) & U(0xFFFFFF), models)
        return runs, counts, o, cut

    moved = pa.schema([("model", pa.int32()), ("bucket", pa.int32()), ("runs", pa.binary()), ("counts", pa.binary())])

    def to_models(key: tuple, rows: pa.Table) -> pa.Table:
        runs, counts, o, cut = bucket_runs(rows)
        runs, counts = runs[o], counts[o]
        return pa.table([pa.array([m for m, _, _ in cut], pa.int32()), pa.array([key[0].as_py()] * len(cut), pa.int32()), pa.array([runs[a:b].tobytes() for _, a, b in cut], pa.binary()), pa.array([counts[a:b].tobytes() for _, a, b in cut], pa.binary())], schema=moved)

    shards = 16
    # What a model needs besides its own runs: all counts of two bytes (shard -1), and those of three bytes in the
    # contexts that its own contexts end with. Both are sums over buckets, added up by the shard of the last two bytes
    # of context, where `kind` tells counts (0) from contexts that occur (1), a byte longer.
    lows = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("runs", pa.binary()), ("counts", pa.binary())])

    def to_low(rows: pa.Table) -> pa.Table:
        runs, counts = joined(rows, "runs", U)[0], joined(rows, "counts", np.uint32)[0].astype(np.int64)
        # Contexts of all runs, as those that only occur in texts to be scored need their ends too.
        contexts = np.unique((runs >> U(8)) & U(0xFFFFFF))
        three, times = _added(runs[counts > 0] & U(0xFFFFFF), counts[counts > 0])
        out = [(-1, 0, *_added(three & U(0xFFFF), times))]
        for kind, keys, sums, pair in ((0, three, times, three >> U(8)), (1, contexts, np.ones(len(contexts), np.int64), contexts & U(0xFFFF))):
            o, cut = _dealt(pair, shards)
            out += [(b, kind, keys[o[i:j]], sums[o[i:j]]) for b, i, j in cut]
        return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2].tobytes() for r in out], pa.binary()), pa.array([r[3].tobytes() for r in out], pa.binary())], schema=lows)

    # To models; of all models at -1.
    low_moved = pa.schema([("model", pa.int32()), ("bytes", pa.int32()), ("runs", pa.binary()), ("counts", pa.binary())])

    def add_low(key: tuple, rows: pa.Table) -> pa.Table:
        side = lambda k: rows.filter(pc.equal(rows["kind"], k))
        runs, counts = _added(*(joined(side(0), c, t)[0] for c, t in (("runs", U), ("counts", np.int64))))
        if key[0].as_py() == -1:
            return pa.table([pa.array([-1], pa.int32()), pa.array([2], pa.int32()), pa.array([runs.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=low_moved)
        contexts = np.unique(joined(side(1), "runs", U)[0])
        model = (mix(contexts) % U(models)).astype(np.int64)
        # Each pair of context bytes to the models in which it ends a context: at most 256 of them.
        pair = np.unique((contexts & U(0xFFFF)).astype(np.int64) * models + model)
        own = (runs >> U(8)).astype(np.int64)
        order = np.argsort(pair % models, kind="stable")
        out = []
        for m, i, j in occurring((pair % models)[order]):
            pairs = pair[order[i:j]] // models
            lo, hi = np.searchsorted(own, pairs), np.searchsorted(own, pairs, "right")
            at = np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo)
            out.append((m, 3, runs[at].tobytes(), counts[at].tobytes()))
        return pa.table([pa.array([r[k] for r in out], low_moved.types[k]) for k in range(4)], schema=low_moved)

    priced = pa.schema([("bucket", pa.int32()), ("model", pa.int32()), ("logs", pa.binary())])

    def price(rows: pa.Table, low: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return priced.empty_table()
        runs, bounds = joined(rows, "runs", U)
        counts = joined(rows, "counts", np.int64)[0]
        own, sums = _added(runs, counts)
        short = [_added(*(joined(low.filter(pc.equal(low["bytes"], n)), c, t)[0] for c, t in (("runs", U), ("counts", np.int64)))) for n in (2, 3)]
        logs = partition_model(own, sums, *short[1], order, short[0]).log10(own)[np.searchsorted(own, runs)].astype(np.float32)
        return pa.table([rows["bucket"].combine_chunks(), rows["model"].combine_chunks(), pa.array([logs[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], schema=priced)

    answer = pa.schema([("pid", pa.int32()), ("bucket", pa.int32()), ("logs", pa.binary()), ("words", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
    answers = "pid int, bucket int, logs binary, words binary, n long, v long"

    def give_back(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return answer.empty_table()
        runs, _, o, cut = bucket_runs(rows)
        logs, at = np.zeros(len(runs), np.float32), {m: slice(i, j) for m, i, j in cut}
        for m, blob in zip(told["model"].to_pylist(), told["logs"].to_pylist(), strict=True):
            logs[o[at[m]]] = np.frombuffer(blob, np.float32)
        asked_runs, bounds = joined(rows, "runs", U)
        logs = logs[np.searchsorted(runs, asked_runs)]
        k = len(bounds) - 1
        return pa.table([rows["pid"].combine_chunks(), rows["bucket"].combine_chunks(), pa.array([logs[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=answer)

    def word_sums(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word asked about its sum; the distinct words' sums; bounds of the blocks."""
        k1, bounds = joined(rows, "k1", U)
        k2, n = joined(rows, "k2", np.uint32)[0], joined(rows, "words", np.uint32)[0].astype(np.int64)
        o = np.lexsort((k2, k1))
        a, b = k1[o], k2[o]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(o) else np.empty(0, bool)
        sums = np.add.reduceat(n[o], np.flatnonzero(first)) if len(o) else n
        each = np.empty(len(o), np.int64)
        each[o] = sums[np.cumsum(first) - 1] if len(o) else sums
        return each, sums, bounds

    def give_words(rows: pa.Table) -> pa.Table:
        each, _, bounds = word_sums(rows)
        k = len(bounds) - 1
        return pa.table([rows["pid"].combine_chunks(), rows["bucket"].combine_chunks(), pa.nulls(k, pa.binary()), pa.array([each[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=answer)

    def total_words(rows: pa.Table) -> pa.Table:
        _, sums, _ = word_sums(rows)
        return pa.table([pa.array([sums.sum()], pa.int64()), pa.array([(sums > 0).sum()], pa.int64())], names=["n", "v"])

    result = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_sum", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def settle(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows:
            return result.empty_table()
        runs, _ = block_runs(block)
        o, cut = _dealt(runs, buckets)
        k1, k2, _ = block_words(block)
        wo, wcut = _dealt(k1, buckets)
        logs, counts = np.zeros(len(runs), np.float32), np.zeros(len(k1), np.int64)
        s, t = ({b: slice(i, j) for b, i, j in found} for found in (cut, wcut))
        for b, x, y in zip(told["bucket"].to_pylist(), told["logs"].to_pylist(), told["words"].to_pylist(), strict=True):
            if x:
                logs[o[s[b]]] = np.frombuffer(x, np.float32)
            if y:
                counts[wo[t[b]]] = np.frombuffer(y, np.int64)
        end = int(counts[np.flatnonzero((k1 == END_KEY[0]) & (k2 == END_KEY[1]))[0]])
        out = []
        for batch in block.to_batches():
            for part in pieces(batch, "text", CHUNK):
                n = part.num_rows
                r, owner = runs_of(part["text"], order)
                if len(r) and int(r.max()) < 1 << (63 - int(n).bit_length()):
                    # One sort of (run, text) puts equal runs together and keeps their texts.
                    shift = U(int(n).bit_length())
                    key = (r << shift) | owner.astype(U)
                    key.sort()
                    r, owner = key >> shift, (key & ((U(1) << shift) - U(1))).astype(np.int64)
                    fresh = np.concatenate([[True], r[1:] != r[:-1]])
                    value = logs[np.searchsorted(runs, r[fresh])][np.cumsum(fresh) - 1]
                else:
                    value = logs[np.searchsorted(runs, r)]
                score = np.bincount(owner, weights=value, minlength=n)
                w = words_of(part["text"], through=LOWER, hashes=2)
                h1, h2 = w.hashes[0], (w.hashes[1] >> U(32)).astype(np.uint32)
                so = np.argsort(h1)
                at = np.searchsorted(k1, h1[so])
                # Words of equal first hash lie side by side: step on to the one of equal second hash.
                while len(at):
                    off = (k2[at] != h2[so]) & (at + 1 < len(k1))
                    off &= k1[np.minimum(at + 1, len(k1) - 1)] == h1[so]
                    if not off.any():
                        break
                    at = at + off
                c = counts[at]
                who = w.owner()[so]
                out.append(pa.table([
                    part["doc_id"], part["train"], pa.array(np.diff(w.bounds) + 1), pa.array((np.bincount(who, weights=c > 0, minlength=n) + (end > 0)).astype(np.int64)),
                    pa.array(np.bincount(who, weights=np.log10(c + 1.0), minlength=n) + np.log10(end + 1.0)), pa.array(score), pa.array(np.diff(binary_parts(part["text"])[1]) + 1),
                ], schema=result))
        return pa.concat_tables(out)

    requests = texts.groupBy("pid").applyInArrow(ask, "bucket int, pid int, runs binary, counts binary, k1 binary, k2 binary, words binary")
    by_bucket = requests.groupBy("bucket")
    runs = by_bucket.applyInArrow(to_models, "model int, bucket int, runs binary, counts binary")
    low = by_bucket.applyInArrow(to_low, "shard int, kind int, runs binary, counts binary").groupBy("shard").applyInArrow(add_low, "model int, bytes int, runs binary, counts binary")
    of = F.explode(F.when(F.col("model") == -1, F.sequence(F.lit(0), F.lit(models - 1))).otherwise(F.array("model")))
    needed = low.select(of.alias("model"), "bytes", "runs", "counts")
    logs = runs.groupBy("model").cogroup(needed.groupBy("model")).applyInArrow(price, "bucket int, model int, logs binary")
    told = requests.groupBy("bucket").cogroup(logs.groupBy("bucket")).applyInArrow(give_back, answers).unionByName(by_bucket.applyInArrow(give_words, answers))
    scored = texts.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(settle, "doc_id long, train boolean, n_tokens long, n_known long, log_sum double, score double, n_bytes long")
    totals = by_bucket.applyInArrow(total_words, "n long, v long")
    whole = lambda c: F.coalesce(totals.agg(F.sum(c)).scalar(), F.lit(0)).cast("long")
    return scored.withColumn("train_tokens", whole("n")).withColumn("train_words", whole("v"))


def base_score(log_sum: Column, n_tokens: Column, tokens: Column, words: Column) -> Column:
    """Log10 probability of a text by counts of words with one added to each."""
    return log_sum - n_tokens * F.log10(tokens + words + 1)


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; learns from those outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("train", crc_rest(F.col("doc_id"), 7) != 2)
    return score(docs).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        base_score(F.col("log_sum"), F.col("n_tokens"), F.col("train_tokens"), F.col("train_words")).alias("base_score"), "score", "n_bytes",
    )
