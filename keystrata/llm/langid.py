"""Language identification: the family first, then one-versus-one linear support vector machines inside it.

Features are shares of hashed byte trigrams of the text, lower-cased, with every run of non-letters as one space.
Families come from FAMILY (a language not listed is a family of its own). Pairs of families vote first; only the
languages of the winning family are then told apart, pair by pair. All machines are linear in shares of trigrams, so
a whole text costs one lookup per byte and machine.

Training reads at most PER_LANGUAGE rows of each language (a documented bound: rows are taken by a hash of doc_id at
a rate found from the counts of all rows). Machines are told apart for the LANGUAGES languages of most rows (another
documented bound: at most LANGUAGES squared over two machines, which fit the driver and a task; ties go to the smaller
name). Predictions see the text alone and cover all rows.

Edge cases: a text that is null, empty or without a letter is `und` with score 0; ties of votes go to the smaller
name; repeated rows are each answered; with one training language that one is always predicted, with none `und`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import CHUNK, binary_parts, crc_rest, free_name, pieces, table

PER_LANGUAGE = 800
LANGUAGES = 48
BITS = 14
EPOCHS = 6
#: Families of common languages.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic",
}
UND = "und"


@dataclass
class Model:
    """Languages, pairs of classes with the columns of their weights, and the weights."""

    languages: list[str] = field(default_factory=list)
    family_pairs: list[tuple[str, str]] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))


# Lower-case letters stay, bytes of other scripts stay, everything else becomes a space.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_LETTER = _CLASS != 32


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts i to j: slots of their trigrams, the text of each, and whether texts have letters."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        part = _CLASS[data[offsets[i] : offsets[j]]]
        own = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
        letters = np.bincount(own, weights=part != 32, minlength=j - i) > 0
        # One space between words, one at either end of a text.
        keep = (part != 32) | np.concatenate([[False], part[:-1] != 32])
        part, own = part[keep], own[keep]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, int)
        part = np.insert(part, first, 32)
        own = np.insert(own, first, own[first])
        if len(part) >= 3:
            p = part.astype(np.uint32)
            code = (p[:-2] << 16) | (p[1:-1] << 8) | p[2:]
            inside = own[:-2] == own[2:]
            code, who = code[inside], own[:-2][inside]
        else:
            code, who = np.empty(0, np.uint32), np.empty(0, int)
        slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
        yield i, j, slot, who, letters
        i = j


def _has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and shares of each text."""
    data, offsets = binary_parts(texts.cast(pa.binary()))
    out = []
    for i, j, slot, who, _ in _trigrams(data, offsets):
        cut = np.searchsorted(who, np.arange(j - i + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s, c = np.unique(slot[a:b], return_counts=True)
            out.append((s, c / max(1, b - a)))
    return out


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent on rows of length one."""
    w, b = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    scaled = [(s, v / (np.linalg.norm(v) or 1.0)) for s, v in rows]
    weight = np.where(sign > 0, len(sign) / max(1, 2 * (sign > 0).sum()), len(sign) / max(1, 2 * (sign < 0).sum()))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            s, v = scaled[k]
            g = sign[k] * (w[s] @ v + b) - 1
            new = min(max(alpha[k] - g / 2.0, 0.0), 4.0 * weight[k])
            if new != alpha[k]:
                w[s] += (new - alpha[k]) * sign[k] * v
                b += (new - alpha[k]) * sign[k]
                alpha[k] = new
    return w, b


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits all machines on at most per_language rows (doc_id, text, lang) of each language."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return Model()
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, 0.9 * per_language / n) if n > per_language else 1.0)) for k, n in counts.items()))
    picked = labelled.where(share < F.coalesce(rate[F.col("lang")], F.lit(0.0)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([s.astype(np.uint16).tobytes() for s, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())], ["lang", "slots", "shares"])

    by: dict[str, list] = {k: [] for k in sorted(counts)}
    for r in picked.select("doc_id", "text", "lang").mapInArrow(vectors, "lang string, slots binary, shares binary").toLocalIterator():
        if len(r["slots"]) and len(by[r["lang"]]) < per_language:
            by[r["lang"]].append((np.frombuffer(r["slots"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32).astype(np.float64)))
    languages = [k for k, rows in by.items() if rows]
    family = {k: FAMILY.get(k, k) for k in languages}
    model = Model(languages)
    columns, bias = [], []

    def add(left: list, right: list) -> None:
        # Rows of a stable order, whatever order the tasks ended in.
        left, right = (sorted(x, key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes())) for x in (left, right))
        w, b = _machine(left + right, np.array([1.0] * len(left) + [-1.0] * len(right)))
        columns.append(w)
        bias.append(b)

    for a, b in itertools.combinations(sorted(set(family.values())), 2):
        model.family_pairs.append((a, b))
        add([r for k in languages if family[k] == a for r in by[k]], [r for k in languages if family[k] == b for r in by[k]])
    for a, b in itertools.combinations(languages, 2):
        if family[a] == family[b]:
            model.pairs.append((a, b))
            add(by[a], by[b])
    if columns:
        model.weights = np.stack(columns, 1).astype(np.float32)
        model.bias = np.array(bias)
    return model


def _margins(model: Model, texts: pa.Array) -> np.ndarray:
    """Every machine's margin on every text."""
    data, offsets = binary_parts(texts.cast(pa.binary()))
    k = model.weights.shape[1]
    out = np.tile(model.bias, (len(offsets) - 1, 1)).astype(np.float64)
    for i, j, slot, who, _ in _trigrams(data, offsets):
        if not len(slot):
            continue
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        ids = who[first]
        # The length of the vector of counts: rows are of length one in training.
        key = who * (1 << BITS) + slot
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(edge, len(key)))
        norm = np.sqrt(np.bincount(key[edge] >> BITS, weights=counts.astype(np.float64) ** 2, minlength=j - i))
        uslot, uwho = key[edge] & ((1 << BITS) - 1), key[edge] >> BITS
        ufirst = np.flatnonzero(np.concatenate([[True], uwho[1:] != uwho[:-1]]))
        for m in range(k):
            out[i + ids, m] += np.add.reduceat(model.weights[uslot, m] * counts, ufirst) / norm[ids]
    return out


def _votes(pairs: list[tuple[str, str]], margins: np.ndarray, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class with most votes and then most margin, and how sure its weakest duel against the others is."""
    votes, sure = np.zeros((len(margins), len(classes))), np.full((len(margins), len(classes)), np.inf)
    at = {c: i for i, c in enumerate(classes)}
    for m, (a, b) in enumerate(pairs):
        win = margins[:, m] > 0
        votes[:, at[a]] += win
        votes[:, at[b]] += ~win
        sure[:, at[a]] = np.minimum(sure[:, at[a]], margins[:, m])
        sure[:, at[b]] = np.minimum(sure[:, at[b]], -margins[:, m])
    best = np.argmax(votes + 1e-6 * np.tanh(np.where(np.isinf(sure), 0, sure)), 1)
    return best, 1 / (1 + np.exp(-2 * np.clip(sure[np.arange(len(best)), best], -30, 30)))


def predict_batch(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    if not model.languages:
        return [UND] * n, np.zeros(n)
    letters, margins = _has_letter(texts), _margins(model, texts)
    families = sorted({FAMILY.get(k, k) for k in model.languages})
    fam, sure = _votes(model.family_pairs, margins[:, : len(model.family_pairs)], families)
    names, score = np.empty(n, object), sure.copy()
    for f, family in enumerate(families):
        rows = np.flatnonzero(fam == f)
        members = [k for k in model.languages if FAMILY.get(k, k) == family]
        mine = [(m, p) for m, p in enumerate(model.pairs) if p[0] in members]
        best, inner = _votes([p for _, p in mine], margins[rows][:, [len(model.family_pairs) + m for m, _ in mine]], members)
        for r, b, s in zip(rows, best, inner, strict=True):
            names[r] = members[b]
            score[r] *= s
    names[~letters] = UND
    score[~letters] = 0.0
    return names.tolist(), np.round(score, 6)


def predict(frame: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score, in place of columns of these names.

    The model is a table of fixed size, sent with the task.
    """
    frame = frame.drop(lang, score)
    sent = frame.sparkSession.sparkContext.broadcast(model)
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, text)):
            found, sure = predict_batch(sent.value, batch[text])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())], [*names, lang, score])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document; learns from those outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.where(crc_rest(F.col("doc_id"), 4) != 2))
    held = docs.select("doc_id", (crc_rest(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return predict(held, model).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents whose text is in no language, those without a letter; the others get the
    language predicted as their lang."""
    model = train(docs.select("doc_id", "text", "lang").where(crc_rest(F.col("doc_id"), 4) != 2))
    names = docs.columns
    lang, sure = free_name(names, "lang_pred"), free_name(names, "sure")
    kept = predict(docs, model, lang=lang, score=sure).where(F.col(lang) != UND)
    return kept.select(*[F.col(lang).alias("lang") if n == "lang" else F.col(f"`{n}`") for n in names])
