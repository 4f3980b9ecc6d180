"""Substring deduplication by relative Lempel-Ziv parsing.

Every window of WINDOW words whose word sequence also starts earlier (smaller doc_id, or the same document earlier)
is a copy; the words it covers go. The corpus itself is the reference, indexed in blocks that are dealt by hash:

1. A window's anchor is the smallest hash among its KEY-word runs. Equal windows have equal anchors, and anchors are
   a seventh of all positions, so counting them first leaves out every window whose anchor occurs once.
2. The windows left are looked up in an index dealt by their hash, which answers with the reference block, row and
   place where each starts first. A place where the answers begin or turn elsewhere is a seed.
3. Reference blocks, which are the blocks of documents themselves, hand out the words that follow the seeds' places.
   Each document is then parsed greedily from left to right: a factor starts at a seed and is extended word by word
   as long as document and reference agree. A seed that lies in the last factor is passed over; one that starts in it
   but runs past its end is where the boundary is checked, and starts the next factor. Factors of at least WINDOW
   words are the duplicate spans, and nothing else is removed.

A seed is compared as far as its run of answers and as much again, AHEAD words at least; where the agreement goes on
beyond that, the next seed takes over. Window keys have 96 bits, compared words 64. Within a block a repeated window is
asked about once, and so is a place of a reference: a passage that a third of all documents share costs its index part
and its reference block one row a block. The texts are shuffled once; all passes read that.

Edge cases: null and empty texts, and texts shorter than a window, keep all their words; a null doc_id comes after
all others (among those: by block, then by text); repeated rows are ordered by text and then equal, and the later
one counts as a copy; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import U, block_count, occurring, pieces, shuffle_partitions, table, window_hashes, words_of

WINDOW = 20
KEY = 8
BLOCK_BYTES = 8 << 20
AHEAD = 64
LAST = (1 << 63) - 1
TOP = np.iinfo(np.uint64).max


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of width values."""
    f = np.minimum if least else np.maximum
    have = 1
    while have * 2 <= width:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def _anchors(h: np.ndarray, room: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the run at each word, the anchor of each window, and which words start a window."""
    n = len(h)
    starts = room >= window
    g, m = np.full(n, TOP, U), np.zeros(n, U)
    if n >= window:
        runs = window_hashes(h, KEY)
        g[: len(runs)] = np.minimum(runs, TOP - U(1))
        low = _sliding(g, window - KEY + 1, True)
        m[: len(low)] = np.where(starts[: len(low)], np.maximum(low, U(1)), U(0))
    return g, m, starts


def _in_order(texts: pa.Table) -> pa.Table:
    """A block's rows in the order of documents."""
    ids = pc.fill_null(texts["doc_id"], LAST)
    body = pc.fill_null(texts["text"].cast(pa.binary()), b"")
    texts = pa.table({"doc_id": texts["doc_id"], "key": ids, "text": body}).combine_chunks()
    order = np.argsort(np.asarray(texts["key"]), kind="stable")
    key = np.asarray(texts["key"])[order]
    ties = np.flatnonzero(key[1:] == key[:-1])
    if len(ties):
        own = texts["text"]
        order = np.array(sorted(order.tolist(), key=lambda i: (texts["key"][i].as_py(), own[i].as_py())))
    return texts.take(pa.array(order))


def _windows(texts: pa.Table, known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, row and place of the windows whose anchor is known to occur more than once, in order."""
    k1, k2, rows, places, base = [], [], [], [], 0
    for batch in texts.to_batches():
        for part in pieces(batch, "text"):
            w = words_of(part["text"], hashes=2)
            if len(w) >= window and len(known):
                _, m, starts = _anchors(w.hashes[0], w.room(), window)
                p = np.flatnonzero(starts)
                at = np.minimum(np.searchsorted(known, m[p]), len(known) - 1)
                p = p[known[at] == m[p]]
                k1.append(window_hashes(w.hashes[0], window)[p])
                k2.append((window_hashes(w.hashes[1], window)[p] >> U(32)).astype(np.uint32))
                owner = w.owner()[p]
                rows.append(owner + base)
                places.append(p - w.bounds[owner])
            base += part.num_rows
    if not k1:
        return np.empty(0, U), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in (k1, k2, rows, places))


def _grouped(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and where each key begins in it."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)


def _parts(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """The buckets that occur among sorted hashes, with where they begin and end."""
    return occurring(((sorted_hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64))


def _joined(blobs: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


SEED = np.dtype([("row", np.uint32), ("place", np.uint32), ("run", np.uint32), ("block", np.int32), ("request", np.uint32), ("at", np.uint32), ("doc", np.int64)])


class Seeds:
    """Where factors may start in a block of documents: arrays by seed, in the order of rows and places.

    row, place and run (windows whose answers follow one another) of the document; block, home and at (row and place)
    of the reference with its doc_id; want, how many words to compare.
    """

    def __init__(self, row: np.ndarray, place: np.ndarray, ref: dict[str, np.ndarray], window: int) -> None:
        follows = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1)
        on = follows & (ref["block"][1:] == ref["block"][:-1]) & (ref["home"][1:] == ref["home"][:-1]) & (ref["at"][1:] == ref["at"][:-1] + 1)
        fresh = np.flatnonzero(np.concatenate([[True], ~on])) if len(row) else np.empty(0, np.int64)
        last = np.append(fresh[1:], len(row)) - 1
        stop = np.append(np.flatnonzero(~follows), len(row) - 1)  # the last window of each stretch of copied ones
        until = stop[np.searchsorted(stop, fresh)] if len(row) else fresh
        self.row, self.place, self.run = row[fresh], place[fresh], last[: len(fresh)] - fresh + 1
        self.block, self.home, self.at, self.doc = (ref[c][fresh] for c in ("block", "home", "at", "doc"))
        self.want = np.minimum(place[until] - self.place + window, 2 * (self.run + window) + AHEAD)

    def packed(self, request: np.ndarray) -> bytes:
        """What the parse needs of them; request: the number of each seed's request among those to its block."""
        out = np.zeros(len(self.row), SEED)
        for c, x in (("row", self.row), ("place", self.place), ("run", self.run), ("block", self.block), ("request", request), ("at", self.at), ("doc", self.doc)):
            out[c] = x
        return out.tobytes()

    def requests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct places to read, by block, row and place, with the most words wanted, and the request of each seed."""
        order = np.lexsort((self.at, self.home, self.block))
        b, h, a = self.block[order], self.home[order], self.at[order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (h[1:] != h[:-1]) | (a[1:] != a[:-1])]) if len(order) else np.empty(0, bool)
        first = np.flatnonzero(new)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return b[first], h[first], a[first], np.maximum.reduceat(self.want[order], first) if len(first) else first, of


def _stretches(begin: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Indexes of stretches, one after another."""
    upto = np.cumsum(long)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - upto + long, long)


def factored(words: np.ndarray, seeds: list[tuple[int, int, np.ndarray]], window: int) -> list[tuple[int, int, int]]:
    """The greedy parse of one document: factors (start, words, number of the seed).

    words: its words' hashes; seeds: place, run, and the reference's words from there, in the order of places.
    """
    out, end = [], 0
    for k, (place, run, ref) in enumerate(seeds):
        if place + run + window - 1 <= end:
            continue
        mine = words[place : place + len(ref)]
        differ = np.flatnonzero(mine != ref[: len(mine)])
        long = int(differ[0]) if len(differ) else len(mine)
        if long >= window:
            out.append((place, long, k))
            end = max(end, place + long)
    return out


def parse(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text) to doc_id, n_words, n_removed, kept (the text left) and factors.

    A factor is (start, words, ref_doc, ref_start): words of the document that copy the reference text.
    """
    blocks = block_count(texts, "text", BLOCK_BYTES)
    buckets = max(shuffle_partitions(texts.sparkSession), blocks // 2)
    own = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    texts = texts.select(F.pmod(F.xxhash64(own), F.lit(blocks)).cast("int").alias("pid"), "doc_id", F.col("text").cast("binary").alias("text"))

    asked = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("hashes", pa.binary()), ("often", pa.binary())])

    def ask(key: tuple, block: pa.Table) -> pa.Table:
        found = []
        for batch in block.to_batches():
            for part in pieces(batch, "text"):
                w = words_of(part["text"])
                if len(w) >= window:
                    g, m, _ = _anchors(w.hashes[0], w.room(), window)
                    span = window - KEY + 1
                    most = _sliding(np.concatenate([np.zeros(span - 1, U), m]), span, False)
                    found.append(g[(most == np.maximum(g, U(1))) & (g < TOP)])
        values, times = np.unique(np.maximum(np.concatenate(found), U(1)) if found else np.empty(0, U), return_counts=True)
        rows = [(b, values[i:j].tobytes(), (times[i:j] > 1).astype(np.uint8).tobytes()) for b, i, j in _parts(values, buckets)]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=asked)

    # Answers to blocks, by bucket: at -1 anchors that occur more than once (hashes); from 0 on where windows start
    # first (numbers of those asked about, doc_ids, places, blocks and rows).
    answers = "pid int, bucket int, hashes binary, docs binary, places binary, blocks binary, homes binary"
    answer = pa.schema([("pid", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "docs", "places", "blocks", "homes"))])

    def count(rows: pa.Table) -> pa.Table:
        values = [np.frombuffer(v, U) for v in rows["hashes"].to_pylist()]
        often = _joined(rows["often"].to_pylist(), np.uint8)
        distinct, place, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        more = (times + np.bincount(place, weights=often, minlength=len(distinct))) > 1
        told = [v[more[np.searchsorted(distinct, v)]].tobytes() for v in values]
        keep = [i for i, v in enumerate(told) if v]
        pids, none = rows["pid"].to_pylist(), pa.nulls(len(keep), pa.binary())
        return pa.table([pa.array([pids[i] for i in keep], pa.int32()), pa.array([-1] * len(keep), pa.int32()), pa.array([told[i] for i in keep], pa.binary()), none, none, none, none], schema=answer)

    sent = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), *((c, pa.binary()) for c in ("k1", "k2", "docs", "places", "homes"))])

    def known_anchors(told: pa.Table) -> np.ndarray:
        return np.sort(_joined([v for b, v in zip(told["bucket"].to_pylist(), told["hashes"].to_pylist(), strict=True) if b == -1], U))

    def look_up(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows or not told.num_rows:
            return sent.empty_table()
        pid = block["pid"][0].as_py()
        block = _in_order(block)
        k1, k2, rows, places = _windows(block, known_anchors(told), window)
        order, first = _grouped(k1, k2)
        one = order[first]
        docs = np.asarray(block["key"])[rows[one]]
        parts = (k1[one], k2[one], docs, places[one].astype(np.uint32), rows[one].astype(np.uint32))
        out = _parts(parts[0], buckets)
        return pa.table([pa.array([b for b, _, _ in out], pa.int32()), pa.array([pid] * len(out), pa.int32()), *(pa.array([x[i:j].tobytes() for _, i, j in out], pa.binary()) for x in parts)], schema=sent)

    def earliest(rows: pa.Table) -> pa.Table:
        blobs = {c: rows[c].to_pylist() for c in ("k1", "k2", "docs", "places", "homes", "pid")}
        long = np.array([len(b) // 8 for b in blobs["k1"]])
        k1, k2, docs, places, homes = (_joined(blobs[c], t) for c, t in (("k1", U), ("k2", np.uint32), ("docs", np.int64), ("places", np.uint32), ("homes", np.uint32)))
        pid = np.repeat(np.array(blobs["pid"], np.int32), long)
        order = np.lexsort((places, homes, pid, docs, k2, k1))
        a, b = k1[order], k2[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        source = np.empty(len(order), np.int64)
        source[order] = head
        bounds = np.concatenate([[0], np.cumsum(long)])
        out = []
        bucket = rows["bucket"][0].as_py()
        for p, lo, hi in zip(blobs["pid"], bounds[:-1], bounds[1:], strict=True):
            own = np.arange(lo, hi)
            copy = own[source[lo:hi] != own]
            if len(copy):
                out.append((p, bucket, (copy - lo).astype(np.uint32).tobytes(), *(x[source[copy]].tobytes() for x in (docs, places, pid, homes))))
        return pa.table([pa.array([r[k] for r in out], answer.types[k]) for k in range(7)], schema=answer)

    def seeds_of(pid: int, block: pa.Table, told: pa.Table) -> Seeds:
        """Seeds of a block, in order."""
        k1, k2, rows, places = _windows(block, known_anchors(told), window)
        order, first = _grouped(k1, k2)
        one = order[first]
        ref = {"block": np.full(len(one), pid, np.int64), "home": rows[one].copy(), "at": places[one].copy(), "doc": np.asarray(block["key"])[rows[one]].copy()}
        copied = np.zeros(len(one), bool)
        begin = {b: i for b, i, _ in _parts(k1[one], buckets)}
        for b, at, *found in zip(*(told[c].to_pylist() for c in ("bucket", "hashes", "blocks", "homes", "places", "docs")), strict=True):
            if b >= 0:
                index = begin[b] + np.frombuffer(at, np.uint32)
                copied[index] = True
                for c, blob, kind in zip(ref, found, (np.int32, np.uint32, np.uint32, np.int64), strict=True):
                    ref[c][index] = np.frombuffer(blob, kind)
        which, copy = np.empty(len(order), np.int64), np.ones(len(order), bool)
        which[order] = np.repeat(np.arange(len(one)), np.diff(np.append(first, len(order))))
        copy[one] = copied
        return Seeds(rows[copy], places[copy], {c: x[which[copy]] for c, x in ref.items()}, window)

    # To reference blocks what others want of them; to a block itself (asker -1) its seeds.
    wanted = pa.schema([("pid", pa.int32()), ("asker", pa.int32()), *((c, pa.binary()) for c in ("homes", "places", "wants", "seeds"))])

    def want(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows or not told.num_rows:
            return wanted.empty_table()
        pid = block["pid"][0].as_py()
        seeds = seeds_of(pid, _in_order(block), told)
        if not len(seeds.row):
            return wanted.empty_table()
        at, homes, places, wants, request = seeds.requests()
        out = occurring(at)
        rows = [(b, pid, *(x[i:j].astype(np.uint32).tobytes() for x in (homes, places, wants)), None) for b, i, j in out]
        begin = np.repeat([i for _, i, _ in out], [j - i for _, i, j in out])
        rows.append((pid, -1, None, None, None, seeds.packed(request - begin[request])))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), wanted.types, strict=True)], schema=wanted)

    # To blocks: their seeds (block -1), and the words that a reference block hands out.
    handed = pa.schema([("pid", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("words", "longs", "seeds"))])

    def hand_out(block: pa.Table, asked: pa.Table) -> pa.Table:
        """The words of a reference block that others, or it itself, want; fewer where a text ends. Seeds pass by."""
        own, asked = asked.filter(pc.equal(asked["asker"], -1)), asked.filter(pc.greater(asked["asker"], -1))
        none = pa.nulls(own.num_rows, pa.binary())
        kept = pa.table([own["pid"], own["asker"], none, none, own["seeds"]], schema=handed)
        if not asked.num_rows:
            return kept
        homes, places, wants = (_joined(asked[c].to_pylist(), np.uint32).astype(np.int64) for c in ("homes", "places", "wants"))
        rows, home = np.unique(homes, return_inverse=True)
        h, counts = [], [np.zeros(1, np.int64)]
        for batch in _in_order(block).select(["text"]).take(pa.array(rows)).to_batches():
            for part in pieces(batch, "text"):
                w = words_of(part["text"])
                h.append(w.hashes[0])
                counts.append(np.diff(w.bounds))
        h, bounds = np.concatenate(h), np.cumsum(np.concatenate(counts))
        begin = bounds[home] + places
        wants = np.minimum(wants, bounds[home + 1] - begin)
        words, upto = h[_stretches(begin, wants)], np.concatenate([[0], np.cumsum(wants)])
        cut = np.cumsum([0, *(len(b) >> 2 for b in asked["homes"].to_pylist())])
        out = [words[upto[i] : upto[j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        longs = [wants[i:j].astype(np.uint32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        found = pa.table([asked["asker"], asked["pid"], pa.array(out, pa.binary()), pa.array(longs, pa.binary()), pa.nulls(asked.num_rows, pa.binary())], schema=handed)
        return pa.concat_tables([kept, found])

    factor = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())]))
    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("factors", factor)])

    def cut_out(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows:
            return result.empty_table()
        block = _in_order(block)
        seeds = np.frombuffer(b"".join([x for x in told["seeds"].to_pylist() if x]), SEED)
        refs = {b: np.split(np.frombuffer(x, U), np.cumsum(np.frombuffer(n, np.uint32))[:-1]) for b, x, n in zip(told["block"].to_pylist(), told["words"].to_pylist(), told["longs"].to_pylist(), strict=True) if b >= 0}
        cuts = np.searchsorted(seeds["row"], np.arange(block.num_rows + 1))
        out, i = [], 0
        for batch in block.to_batches():
            for part in pieces(batch, "text"):
                w = words_of(part["text"])
                for k, (d, text) in enumerate(zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)):
                    words, lo, hi = text.split(), cuts[i], cuts[i + 1]
                    mine = seeds[lo:hi]
                    own = [(p, r, refs[b][q]) for p, r, b, q in zip(*(mine[c].tolist() for c in ("place", "run", "block", "request")), strict=True)]
                    factors = factored(w.hashes[0][w.bounds[k] : w.bounds[k + 1]], own, window)
                    kept = words
                    if factors:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for p, n, _ in factors:
                            gone[p] += 1
                            gone[p + n] -= 1
                        kept = list(compress(words, (np.cumsum(gone[:-1]) == 0).tolist()))
                    named = [{"start": p, "words": n, "ref_doc": None if mine["doc"][s] == LAST else int(mine["doc"][s]), "ref_start": int(mine["at"][s])} for p, n, s in factors]
                    out.append((d, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), named))
                    i += 1
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), result.types, strict=True)], schema=result)

    anchors = texts.groupBy("pid").applyInArrow(ask, "bucket int, pid int, hashes binary, often binary")
    known = anchors.groupBy("bucket").applyInArrow(count, answers)
    windows = texts.groupBy("pid").cogroup(known.groupBy("pid")).applyInArrow(look_up, "bucket int, pid int, k1 binary, k2 binary, docs binary, places binary, homes binary")
    told = known.unionByName(windows.groupBy("bucket").applyInArrow(earliest, answers))
    requests = texts.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(want, "pid int, asker int, homes binary, places binary, wants binary, seeds binary")
    words = texts.groupBy("pid").cogroup(requests.groupBy("pid")).applyInArrow(hand_out, "pid int, block int, words binary, longs binary, seeds binary")
    return texts.groupBy("pid").cogroup(words.groupBy("pid")).applyInArrow(
        cut_out, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:long,words:long,ref_doc:long,ref_start:long>>"
    )


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the copies of windows that start earlier."""
    parsed = parse(table(spark, sf_dir, "documents", "doc_id", "text"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM k) WHERE rn > 1),
g AS (SELECT doc_id, list(p) AS ps FROM (SELECT DISTINCT doc_id, i + j AS p FROM c, range(0, 20) r(j)) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
