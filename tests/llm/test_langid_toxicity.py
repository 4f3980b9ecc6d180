import random

import pytest
from pyspark.sql import functions as F

from keystrata.llm import langid, toxicity
from keystrata.llm.common import crc_rest
from tests.llm.conftest import DDL, corpus, rows_of


def test_languages(spark, documents):
    rows = rows_of(corpus(400, 9))
    frame = spark.createDataFrame(rows, DDL)
    model = langid.train(frame.where(crc_rest(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[2] and r[1] and len(r[1]) > 40 and r[0] < 9000]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.9
    for odd in (9001, 9002, 9003, 9005):
        assert (got[odd].lang_pred, got[odd].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_predictions_read_the_text_alone(spark):
    frame = spark.createDataFrame(rows_of(corpus(150, 2)), DDL)
    model = langid.train(frame)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame.withColumn("lang", F.lit("fr")).withColumn("source", F.lit(None).cast("string")), model).collect()}
    assert a == b


def test_without_labels(nothing, repeated):
    model = langid.train(nothing)
    assert {(r.lang_pred, r.score) for r in langid.predict(repeated, model).collect()} == {("und", 0.0)}
    assert langid.predict(nothing, langid.train(repeated)).count() == 0
    assert {r.lang_pred for r in langid.predict(repeated, langid.train(repeated)).where("text IS NOT NULL").collect()} == {"en"}


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(1)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so") for b in ("ta", "pi", "du", "re", "vo")]
    docs, labels = [], []
    for i in range(900):
        sentences = [" ".join(rng.choices(words, k=8)).capitalize() + "." for _ in range(rng.randint(2, 9))]
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at][:-1] + " " + rng.choice(["vilest", "viler", "rotten"]) + "!"
        docs.append((i, " ".join(sentences)))
        labels.append((i, int(bad)))
    docs += [(5000, None), (5001, ""), (5002, "...!!"), (5003, "rotten"), (5003, "rotten")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")


def test_documents_and_sentences(toxic):
    docs, labels = toxic
    learn = labels.where(crc_rest(F.col("doc_id"), 4) != 2)
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, learn)).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    assert sum((rows[i].score >= toxicity.DECISION) == bool(t) for i, t in truth.items()) / len(truth) > 0.97
    hits = 0
    for i, t in truth.items():
        if t and rows[i].offending:
            found = [rows[i].text[s.start : s.end] for s in rows[i].offending]
            assert all(any(w in s for w in ("vile", "rotten")) for s in found)
            hits += 1
    assert hits > 0.9 * sum(truth.values())
    assert [rows[i].score for i in (5000, 5001, 5002)] == [0.0, 0.0, 0.0]
    assert rows[5003].score > toxicity.DECISION


def test_one_class_or_nothing(toxic, nothing):
    docs, labels = toxic
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0


def test_languages_against_plain_votes(spark):
    """The same prediction with the fitted weights, a trigram and a duel at a time."""
    import math
    import re
    from collections import Counter

    rows = rows_of(corpus(150, 4))
    frame = spark.createDataFrame(rows, DDL)
    model = langid.train(frame.where("doc_id < 400"))
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    family = {k: langid.FAMILY.get(k, k) for k in model.languages}

    def duel(pairs, columns, margin, classes):
        votes, sure = Counter(), dict.fromkeys(classes, math.inf)
        for (a, b), m in zip(pairs, columns, strict=True):
            votes[a if margin[m] > 0 else b] += 1
            sure[a], sure[b] = min(sure[a], margin[m]), min(sure[b], -margin[m])
        return max(classes, key=lambda c: votes[c] + 1e-6 * math.tanh(0 if math.isinf(sure[c]) else sure[c])), sure

    seen = 0
    for doc, text, *_ in rows:
        if not text or not re.search(r"[^\W\d_]", text) or len(text) > 20_000:
            continue
        letters = bytes(c for c in re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) + b" "))
        counts = Counter(((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> (32 - langid.BITS) for a, b, c in zip(letters, letters[1:], letters[2:], strict=False))
        norm = math.sqrt(sum(n * n for n in counts.values())) or 1.0
        margin = [model.bias[m] + sum(n * float(model.weights[s, m]) for s, n in counts.items()) / norm for m in range(model.weights.shape[1])]
        families = sorted(set(family.values()))
        best, _ = duel(model.family_pairs, range(len(model.family_pairs)), margin, families)
        members = [k for k in model.languages if family[k] == best]
        own = [(m, p) for m, p in enumerate(model.pairs) if p[0] in members]
        lang, _ = duel([p for _, p in own], [len(model.family_pairs) + m for m, _ in own], margin, members)
        assert got[doc].lang_pred == lang, doc
        seen += 1
    assert seen > 120


def test_many_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    texts = corpus(200, 3)
    rows = [(i, t, lang if i % 5 else f"rare{i}") for i, (t, lang) in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame)
    assert len(model.languages) == 3 and not any(k.startswith("rare") for k in model.languages)
    assert langid.predict(frame, model).count() == len(rows)


def test_the_stage_sets_the_language_and_keeps_clashing_columns(spark):
    rows = rows_of(corpus(150, 2))
    frame = spark.createDataFrame([(*r[:5], "mine", "own", "user") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, sure string, __lang string")
    got = {r.doc_id: r for r in langid.stage(spark, frame.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), "").collect()}
    assert all((r.lang_pred, r.sure, r["__lang"]) == ("mine", "own", "user") for r in got.values())
    truth = {r[0]: r[2] for r in rows}
    known = [i for i in got if truth[i] and i < 9000]
    assert len(known) > 100 and sum(got[i].lang == truth[i] for i in known) / len(known) > 0.85


def test_toxicity_against_plain_noisy_or(spark, toxic):
    """The same scores with the fitted weights, a sentence and a word at a time; long texts and clashing names too."""
    import math
    import re

    import numpy as np
    import pyarrow as pa

    docs, labels = toxic
    model = toxicity.train(docs, labels)
    texts = [r.text for r in docs.limit(60).collect()] + ["Rotten é! viler.\nend", "a. b! c?d", "word " * 60_000 + "rotten!", None, ""]
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string, offending string")
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    slots = {}

    def slots_of(word):
        if word not in slots:
            slots[word] = set(toxicity.sentences(pa.array([word]))[1].ravel().tolist())
        return slots[word]

    for i, text in enumerate(texts):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            found = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), sentence))
            if found:
                z = model.bias + sum(float(model.weights[s]) for s in set().union(*map(slots_of, set(found))))
                clean *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert math.isclose(got[i], 1 - clean, rel_tol=1e-5, abs_tol=1e-7), i
    assert np.count_nonzero(model.weights) and max(got.values()) > 0.9
