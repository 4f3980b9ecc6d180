"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: ones are hashed, zeros may be anything, so a substituted word spoils
few seeds. Test items and training documents are hashed under the same masks and joined on the hash; around each hit
the two word sequences are compared place by place, and the best stretch (a match counts 1, a mismatch MISMATCH)
is the overlap. A document leaks an item when the stretch matches LEAST words and SHARE of the item, or LONG words.

Words are runs of letters and digits of the lower-cased text in Unicode's form NFKC. Before the join, documents keep the places whose hash is in a
bitmap of the items' hashes: its size follows the number of hashes up to MOST_BITS and is fixed beyond, where the
join gets more to do and stays right. Hits that lie close make a region, with the words around it; so a text travels
only where it may leak. Items of equal words are one item (the smallest item_id) with a count.

Items below LEAST words have no room for a substitution: with short_items they are looked for as whole exact runs of
words, by a join on the run's hash, and reported as such (matched_words is all of item_words). The query reports them;
the pipeline's stage does not, as a phrase of a few ordinary words makes no document a leak.

Edge cases: null and empty texts leak nothing; items without a word are not looked for; of the masks SHORT one at
least lies in the matches of every stretch that leaks an item of up to LONG words (shown over all patterns in the tests;
for longer items recall is measured there, with up to 30 percent of the words substituted); repeated rows are each answered as one doc_id; a null
doc_id is not reported; without items or documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import U, mix, pieces, release, remove, shared_folder, table, window_hashes, words_of, written

#: The seeds.
MASKS = ("1101100110101", "1011001101011", "1110010100111")
SHORT = ("11010011", "1100000001011", "1100010011", "10101000011", "111011")
LEAST = 8
SHARE = 0.4
LONG = 20
MISMATCH = -1.5
AROUND = 96
GAP = 64
LEAST_BITS, MOST_BITS = 20, 27

_WORD = np.full(256, 32, np.uint8)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[48:58] = np.arange(48, 58)
_WORD[128:] = np.arange(128, 256)


def seed_hashes(h: np.ndarray, mask: str, which: int) -> np.ndarray:
    """Hash of the words under the mask, laid at each word."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U)
    total = np.full(n, (which + 1) * 0x9E37 + len(mask), U)
    factor = U(0x9E3779B97F4A7C15)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = (total + h[k : k + n]) * factor
    return mix(total)


#: All seeds, numbered; the short ones from 100.
ALL_MASKS = [*enumerate(MASKS), *enumerate(SHORT, 100)]


def _plain(texts: pa.Array) -> pa.Array:
    """Texts in one spelling: composed characters, lower case."""
    return pc.utf8_lower(pc.utf8_normalize(texts, "NFKC"))


def item_table(items: DataFrame) -> DataFrame:
    """Items with a word, equal ones once: item_id, n_items, n_words, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            w = words_of(_plain(batch["text"]), through=_WORD)
            rows = [w.hashes[0][a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["item_id", "n_words", "words"])

    each = items.select("item_id", "text").mapInArrow(run, "item_id long, n_words long, words binary").where("n_words > 0")
    return each.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.first("n_words").alias("n_words"))


def _item_seeds(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, hashes = [], [], []
            for item, blob in zip(batch["item_id"].to_pylist(), batch["words"].to_pylist(), strict=True):
                h = np.frombuffer(blob, U)
                for which, mask in ALL_MASKS:
                    s = seed_hashes(h, mask, which)
                    ids.append(np.full(len(s), item, np.int64))
                    places.append(np.arange(len(s), dtype=np.int32))
                    hashes.append(s.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, places, hashes)], ["item_id", "place", "hash"])

    return items.select("item_id", "words").mapInArrow(run, "item_id long, place int, hash long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Two bits for each hash. What comes to the driver is the map itself, at most 2 ** MOST_BITS bits."""
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(1024 * max(1, n)).bit_length()))
    h = F.col("hash")
    probe = F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND((1 << bits) - 1)))
    cells = seeds.select(probe.alias("bit")).select(F.shiftright("bit", 5).alias("cell"), F.expr("shiftleft(1L, cast(bit & 31 as int))").alias("mask"))
    rows = cells.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["cell"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).astype(np.uint32)
    return out


def _regions(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Stretches of documents around places whose hash is in the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    bits = len(bitmap).bit_length() - 1 + 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        has = lambda i: (bitmap[i >> 5] >> (i & 31).astype(np.uint32)) & 1 == 1
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            w = words_of(_plain(batch["text"]), through=_WORD)
            h, room = w.hashes[0], w.room()
            places, hashes = [], []
            for which, mask in ALL_MASKS:
                s = seed_hashes(h, mask, which)
                hit = np.flatnonzero(has((s >> U(64 - bits)).astype(np.int64)))
                hit = hit[has((s[hit] & U((1 << bits) - 1)).astype(np.int64))]
                hit = hit[room[hit] >= len(mask)]
                places.append(hit)
                hashes.append(s[hit].view(np.int64))
            place, value = np.concatenate(places), np.concatenate(hashes)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
            owner = w.owner()[place]
            cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + GAP)]))
            ids = batch["doc_id"].to_pylist()
            out = []
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True):
                lo, hi = w.bounds[owner[a]], w.bounds[owner[a] + 1]
                first, last = max(lo, place[a] - AROUND), min(hi, place[b - 1] + len(MASKS[0]) + AROUND)
                if ids[owner[a]] is not None:
                    out.append((ids[owner[a]], int(first - lo), _short(h[first:last]), (place[a:b] - lo).tolist(), value[a:b].tolist()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "region", "words", "places", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, region long, words binary, places array<long>, hashes array<long>")


def _short(h: np.ndarray) -> bytes:
    """Half of each word's hash, which is enough to compare words place by place."""
    return (h >> U(32)).astype(np.uint32).tobytes()


def overlap(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Best stretch of a against b, b's word 0 lying at a's word shift: start in a, length, matches."""
    lo, hi = max(0, shift), min(len(a), shift + len(b))
    if hi <= lo:
        return 0, 0, 0
    same = a[lo:hi] == b[lo - shift : hi - shift]
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, MISMATCH))])
    floor = np.minimum.accumulate(total)
    end = int(np.argmax(total - floor))
    start = int(np.flatnonzero(total[: end + 1] == floor[end])[-1])
    return lo + start, end - start, int(same[start:end].sum())


def _exact(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with whole exact runs of short items: as leaks()."""
    lengths = sorted(r["n_words"] for r in items.select("n_words").distinct().collect())  # LEAST - 1 at most

    def item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [int(window_hashes(np.frombuffer(b, U), len(b) >> 3).view(np.int64)[0]) for b in batch["words"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item_id"], batch["n_items"], batch["n_words"], pa.array(hashes, pa.int64())], ["item_id", "n_items", "n_words", "hash"])

    known = items.mapInArrow(item_runs, "item_id long, n_items long, n_words long, hash long")

    def doc_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct run of a text once, with its first place."""
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            w = words_of(_plain(batch["text"]), through=_WORD)
            room, owner, first = w.room(), w.owner(), w.bounds[:-1]
            for n in lengths:
                h = window_hashes(w.hashes[0], n)
                at = np.flatnonzero(room[: len(h)] >= n)
                order = at[np.lexsort((at, h[at], owner[at]))]
                fresh = np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1])]) if len(order) else np.empty(0, bool)
                one = order[fresh]
                own = owner[one]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(own)), pa.array(np.full(len(one), n, np.int64)), pa.array(h[one].view(np.int64)), pa.array(one - first[own])], ["doc_id", "n_words", "hash", "start"])

    runs = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(doc_runs, "doc_id long, n_words long, hash long, start long")
    found = runs.join(known, ["n_words", "hash"]).groupBy("doc_id", "item_id").agg(F.min("n_items").alias("n_items"), F.min("n_words").alias("item_words"), F.min("start").alias("start_word"))
    return found.select("doc_id", "item_id", "n_items", "item_words", F.col("item_words").alias("matched_words"), F.col("item_words").alias("span_words"), "start_word")


def leaks(docs: DataFrame, items: DataFrame, short_items: bool = False) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, text) that overlap, with the best stretch of each.

    short_items: also items below LEAST words, where a document holds them whole.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    every = written(item_table(items), folder, "items")
    known, short = every.where(f"n_words >= {LEAST}"), every.where(f"n_words < {LEAST}")
    seeds = written(_item_seeds(known), folder, "seeds")
    regions = written(_regions(docs, _bitmap(seeds)), folder, "regions")
    hits = regions.select("doc_id", "region", F.explode(F.arrays_zip("places", "hashes")).alias("hit")).select("doc_id", "region", F.col("hit.places").alias("at"), F.col("hit.hashes").alias("hash"))
    shifts = hits.join(seeds, "hash").select("doc_id", "region", "item_id", (F.col("at") - F.col("place") - F.col("region")).alias("shift")).distinct()
    # Regions of repeated rows are compared twice; the aggregate below makes one row of them.
    pairs = shifts.join(regions.select("doc_id", "region", "words"), ["doc_id", "region"]).join(known.withColumnRenamed("words", "item"), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, region, item, n, copies, shift, a, b in zip(*(batch[c].to_pylist() for c in ("doc_id", "region", "item_id", "n_words", "n_items", "shift", "words", "item")), strict=True):
                start, long, same = overlap(np.frombuffer(a, np.uint32), np.frombuffer(_short(np.frombuffer(b, U)), np.uint32), shift)
                if same >= LEAST and (same >= SHARE * n or same >= LONG):
                    out.append((doc, item, copies, n, same, long, region + start))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "n_items", "item_words", "matched", "span", "start"])

    stretches = pairs.mapInArrow(verify, "doc_id long, item_id long, n_items long, item_words long, matched long, span long, start long")
    best = F.max(F.struct("matched", (-F.col("span")).alias("span"), (-F.col("start")).alias("start"), "n_items", "item_words")).alias("b")
    found = stretches.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_items", "b.item_words", F.col("b.matched").alias("matched_words"), (-F.col("b.span")).alias("span_words"), (-F.col("b.start")).alias("start_word"))
    found = written(found.unionByName(_exact(docs, short)) if short_items and not short.isEmpty() else found, folder, "leaks")
    remove(spark, *(f"{folder}/{name}" for name in ("items", "seeds", "regions")))
    return found


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, those of a few words included."""
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), short_items=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go."""
    bad = leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id").distinct()
    # As a table its size is known, and Spark need not shuffle the texts to join a short list.
    bad = written(bad, shared_folder(spark), "leaking")
    release(spark)
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
