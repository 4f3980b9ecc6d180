"""Toxicity by multiple-instance learning: sentences score, documents answer for them by noisy-or.

A sentence is a stretch up to `.`, `!`, `?` or a line end; its features are the words it has (runs of letters and
digits, lower-cased, hashed) and the words' first PREFIXES bytes, which hold inflected and compound forms together. A sentence's score is a logistic function of the sum of its words' weights, and a
document's score is 1 - prod(1 - sentence score). Weights are fitted to document labels alone; the sentence scores
then tell which sentences are to blame.

Training reads at most POSITIVES and NEGATIVES labelled rows of either kind (documented bounds; taken by a hash of
doc_id at a rate found from the counts of all labels); rows left out are made up for by weights. Scores see the text
alone. Edge cases: null and empty texts, and texts without a word, score 0; repeated rows are each answered; null
labels are not learned from; without labels of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import U, Words, binary_parts, crc_rest, pieces, table, words_of

POSITIVES, NEGATIVES = 2000, 3000
BITS = 18
ROUNDS = 120
DECISION = 0.3
LEAST_DOCUMENTS = 4
PENALTY = 0.2
FLOOR = 0.3
PREFIXES = (4, 6)

_WORD = np.full(256, 32, np.uint8)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[48:58] = np.arange(48, 58)
_WORD[128:] = np.arange(128, 256)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sentences(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, the slots of each (a row for the word and each prefix), and its sentence, numbered through the batch."""
    w = words_of(texts, through=_WORD, prefixes=PREFIXES)
    data, _ = binary_parts(texts)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    fresh = np.ones(len(w), bool)
    if len(w):
        fresh[1:] = stops[w.start[1:]] > stops[w.end[:-1]]
        firsts = w.bounds[:-1][np.diff(w.bounds) > 0]
        fresh[firsts] = True
    return w, np.stack([(h >> U(64 - BITS)).astype(np.int64) for h in (w.hashes[0], *w.prefixes)]), np.cumsum(fresh) - 1


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray) -> Model:
    """docs: for each, its (sentence, slot) pairs without repeats.

    Adam on the weighted likelihood of the labels; weights stay at zero or above, as words only add to the blame, and
    a constant pull of PENALTY keeps those at zero that chance would raise.
    """
    zero = Model(np.zeros(1 << BITS, np.float32), -30.0)
    if not len(docs) or labels.min() == labels.max():
        return zero
    slot = np.concatenate([s for _, s in docs])
    counts = np.bincount(np.concatenate([np.unique(s) for _, s in docs]), minlength=1 << BITS)
    known = np.flatnonzero(counts >= LEAST_DOCUMENTS)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    base = np.cumsum([0] + [int(s.max()) + 1 if len(s) else 1 for s, _ in docs])
    owner = np.repeat(np.arange(len(docs)), np.diff(base))
    base = base.astype(np.int32)
    sentence = np.concatenate([s + b for (s, _), b in zip(docs, base, strict=False)])
    column = place[slot]
    keep = column >= 0
    sentence, column = sentence[keep], column[keep]
    del slot, keep
    w, b = np.zeros(len(known)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(sentence, weights=w[column], minlength=base[-1])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(docs)))
        some = np.maximum(1 - none, 1e-9)
        pull = np.where(labels == 1, -none / some, 1.0) * weight
        gz = pull[owner] * p
        g = np.bincount(column, weights=gz[sentence], minlength=len(known)) + PENALTY
        gb = gz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.15 * min(1.0, 2 * (1 - t / (ROUNDS + 1)))
        # The floor under the root keeps words with next to no gradient near zero.
        w = np.maximum(0.0, w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + FLOOR))
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + FLOOR)
    zero.weights[known] = w
    return Model(zero.weights, float(b))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """Fits the model on bounded samples of the labelled rows; labels has doc_id and toxic."""
    labels = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bound = {1: positives, 0: negatives}
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    rate = {k: min(1.0, 0.95 * bound[k] / n) if n > bound[k] else 1.0 for k, n in counts.items()}
    pick = F.when(F.col("toxic") == 1, share < rate.get(1, 0.0)).otherwise(share < rate.get(0, 0.0))
    rows = labels.where(pick).select("doc_id", "toxic").take(positives + negatives)
    if not rows:
        return fit([], np.zeros(0), np.zeros(0))
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in rows], "doc_id long, toxic int")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "text")):
            w, slots, number = sentences(batch["text"])
            out = []
            for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                local = number[a:b] - (number[a] if b > a else 0)
                out.append(np.unique(((local.astype(np.int64) << BITS) | slots[:, a:b]).ravel()).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(out, pa.binary())], ["doc_id", "toxic", "pairs"])

    # At most positives + negatives ids, whatever the size of the tables.
    got = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").mapInArrow(vectors, "doc_id long, toxic int, pairs binary")
    found = []
    for r in got.toLocalIterator():
        x = np.frombuffer(r["pairs"], np.int64)
        found.append((r["doc_id"], r["toxic"], (x >> BITS).astype(np.int32), (x & ((1 << BITS) - 1)).astype(np.int32)))
    found.sort(key=lambda r: r[0])
    sets, y = [(s, slot) for _, _, s, slot in found], np.array([r[1] for r in found])
    del found
    weight = np.where(y == 1, counts.get(1, 0) / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y == 0).sum()))
    return fit(sets, y, weight)


def score_batch(model: Model, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """Each document's score, and its sentences from DECISION on, in code points."""
    n = len(texts)
    w, slots, number = sentences(texts)
    score, blamed = np.zeros(n), [[] for _ in range(n)]
    if not len(w):
        return score, blamed
    key = np.unique(((number << BITS) | slots).ravel())
    count = int(number[-1]) + 1
    z = model.bias + np.bincount(key >> BITS, weights=model.weights[key & ((1 << BITS) - 1)], minlength=count)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    last = np.append(first[1:], len(w)) - 1
    owner = w.owner()[first]
    score = -np.expm1(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
    hit = np.flatnonzero(p >= DECISION)
    if len(hit):
        data, offsets = binary_parts(texts)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for s in hit:
            at = points[offsets[owner[s]]]
            blamed[owner[s]].append({"start": int(points[w.start[first[s]]] - at), "end": int(points[w.end[last[s]]] - at), "score": float(p[s])})
    return np.clip(score, 0, 1), blamed


def score(frame: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and the offending sentences, in place of columns of these names.

    The model has a fixed size and goes with the tasks.
    """
    frame = frame.drop("score", "offending")
    sent = frame.sparkSession.sparkContext.broadcast(model)
    names = frame.columns
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, text)):
            found, blamed = score_batch(sent.value, batch[text])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array(blamed, arrow)], [*names, "score", "offending"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", spans)]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; learns from labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(crc_rest(F.col("doc_id"), 4) != 2)
    held = docs.select("doc_id", (crc_rest(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    scored = score(held, train(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), "offending")
