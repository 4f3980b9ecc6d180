import itertools
import random
import re

import numpy as np
import pytest

from keystrata.llm import decontam, pii

# ---------------------------------------------------------------- decontamination


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["ba", "ko", "lu", "mi", "re", "sha", "ti"], k=rng.randint(2, 4)))
    text = lambda n: [word() for _ in range(n)]
    items = {i: text(rng.randint(16, 50)) for i in range(30)}
    items[30], items[31], items[32] = items[0], text(10), text(4)
    docs, want = [], set()
    for d in range(200):
        body = text(rng.randint(5, 120))
        if d % 4 == 0:
            i = rng.randrange(30)
            passage = list(items[i])
            if d % 8 == 0:
                for k in range(3, len(passage), 9):
                    passage[k] = word()
            if d % 12 == 0:
                passage = [w.upper() + "," for w in passage]
            at = rng.randrange(len(body))
            body[at:at] = passage
            want.add((d, min(i, 30) if i else 0))
        docs.append((d, " ".join(body), "clash"))
    docs += [(900, None, None), (901, "", None), (902, " ".join(items[31]), None), (903, " ".join(items[32] * 5), None), (904, " ".join(items[5][:6]), None), (None, " ".join(items[5]), None)]
    want.add((902, 31))
    frame = spark.createDataFrame(docs, "doc_id long, text string, region string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, "")], "item_id long, text string")
    return frame, table, want


def test_leaks(leaky):
    frame, table, want = leaky
    rows = decontam.leaks(frame, table).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(r.matched_words <= r.span_words and r.item_words >= 8 for r in rows)
    assert {r.n_items for r in rows if r.item_id == 0} <= {2}


def test_repeated_documents_and_empty_tables(spark, leaky):
    frame, table, want = leaky
    assert decontam.leaks(frame.limit(0), table).count() == 0
    assert decontam.leaks(frame, table.limit(0)).count() == 0
    again = decontam.leaks(frame.unionByName(frame), table)
    assert {(r.doc_id, r.item_id) for r in again.collect()} == want and again.count() == len(want)


def test_short_items_with_substituted_words(spark):
    """Every pattern of one or two substituted words that overlap() accepts is found, and no other."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(8, 21)}
    docs, want = [], set()
    for n, item in items.items():
        for spoilt in [(), *itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            passage = ["other" if k in spoilt else w for k, w in enumerate(item)]
            docs.append((len(docs), " ".join(["before", *passage, "after"])))
            same = decontam.overlap(np.array([k in spoilt for k in range(n)]), np.zeros(n, bool), 0)[2]
            if same >= decontam.LEAST:
                want.add((len(docs) - 1, n))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(frame, table).collect()} == want
    assert len(want) > 1000


def test_short_masks_miss_no_pattern():
    """All patterns of matches of LONG words; those of shorter items are among them, as mismatches at the ends."""
    n = decontam.LONG
    assert decontam.SHARE * n <= decontam.LEAST
    rng, every = random.Random(2), np.arange(1 << n)
    total, floor, best = np.zeros(1 << n), np.zeros(1 << n), np.zeros(1 << n)
    seen, skipped, same = (np.zeros(1 << n, int) for _ in range(3))
    for k in range(n):
        hit = every >> k & 1
        total, seen = total + np.where(hit, 1, decontam.MISMATCH), seen + hit
        low = total <= floor
        floor, skipped = np.where(low, total, floor), np.where(low, seen, skipped)
        more = total - floor > best
        best, same = np.where(more, total - floor, best), np.where(more, seen - skipped, same)
    for p in rng.sample(range(1 << n), 2000):
        assert decontam.overlap(np.array([p >> k & 1 for k in range(n)]), np.ones(n, int), 0)[2] == same[p]
    covered = np.zeros(1 << n, bool)
    for mask in decontam.SHORT:
        bits = sum(1 << k for k, b in enumerate(mask) if b == "1")
        for at in range(n - len(mask) + 1):
            covered |= every >> at & bits == bits
    assert covered[same >= decontam.LEAST].all()


# ---------------------------------------------------------------- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return True


def base_spans(text):
    found = [(m.start(), r, m.end(), k) for r, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def random_texts(n=400):
    rng = random.Random(6)
    parts = ["a@b.co", "x.y%z@mail-1.example.com", "@@", "a@b", "a@b.c_d@e.f", "192.168.0.1", "1.2.3.4.5.6.7.8", "999.1.1.1", "000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "98079157628044900", "378282246310005",
             "+1 (017) 555-7713", "+49 30 123456", "+1", "++44 20 7946 0958-", "é", "日本", "😀", "12", ".", " ", "-", "\n", "card", "7" * 25, "+" + "1" * 16]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_base_spans_against_python(spark):
    texts = [*random_texts(), None, "", "a" * 60_000 + "@", "1" * 60_000, "9 " * 30_000, "x" * 30_000 + "@y.z"]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    rows = {r.doc_id: r.pii for r in pii.detect(frame).select("doc_id", "pii").collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in rows[i] if s.kind in BASE] == base_spans(t), t


def test_added_kinds_and_context(spark):
    texts = ["pay to iban GB82 WEST 1234 5698 7654 32 please", "code GB82WEST12345698765433", "ssn 123-45-6789", "part 123-45-6789", "visa card 4111111111111111", "order 4111111111111111"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: [(s.kind, s.score) for s in r.pii] for r in pii.detect(frame).collect()}
    assert rows[0] == [("iban", 1.0)] and rows[1] == []
    assert rows[2] == [("ssn", 0.6)] and rows[3] == []
    assert rows[4] == [("card", 1.0)] and rows[5] == [("card", 0.6)]


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "to a@b.co or +1 (017) 555-7713 é"), (2, None), (3, "clean"), (4, "+4111111111111111")], "doc_id int, text string")
    rows = {r.doc_id: r.text for r in pii.redact(pii.detect(frame)).collect()}
    assert rows == {1: "to <EMAIL> or <PHONE> é", 2: None, 3: "clean", 4: "+<CARD>"}
    assert pii.detect(frame.limit(0)).count() == 0


def test_plan_is_native(spark):
    frame = pii.detect(spark.createDataFrame([(1, "x")], "doc_id int, text string"))
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_secrets(spark):
    value = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = [f'x token = "{value}" y', f"API_KEY: {value.upper()},", "password = aaaaaaaaaaaaaaaa1", "token = ABCDEFGHIJKLMNOPQRST", f"dummy token={value}", f"é secret:'{value}' secret:{value}", f"broken {value}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.pii] for r in pii.detect(frame).collect()}
    assert rows == {0: [("secret", value)], 1: [("secret", value.upper())], 2: [], 3: [], 4: [], 5: [("secret", value)] * 2, 6: []}


def test_iban_and_context_in_the_query(spark, tmp_path):
    """Planted rows that reach mod-97 and the score of the context, through the registered query."""
    texts = ["pay to iban GB82 WEST 1234 5698 7654 32 please", "code GB82WEST12345698765433", "ssn 123-45-6789", "part 123-45-6789"]
    spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.spans for r in pii.op7_pii(spark, str(tmp_path)).collect()}
    assert rows == {0: "iban:12:39", 1: "", 2: "ssn:4:15", 3: "", 9: ""}


def test_many_matches_take_linear_time(spark):
    """Texts of 20,000 and 80,000 numbers, and of as many addresses, found and redacted."""
    import time

    took = {}
    for n in (20_000, 80_000):
        for kind, word in (("numbers", "4111 x "), ("addresses", "a@b.co, ")):
            frame = spark.createDataFrame([(1, word * n)], "doc_id int, text string")
            began = time.time()
            row = pii.redact(pii.detect(frame)).first()
            took[kind, n] = time.time() - began
            assert len(row.pii) == (n if kind == "addresses" else 0)
            assert kind == "numbers" or row.text == "<EMAIL>, " * n
            assert [s.start for s in row.pii[:3]] == ([0, 8, 16] if row.pii else [])
    for kind in ("numbers", "addresses"):
        assert took[kind, 80_000] < 8 * took[kind, 20_000] + 2 and took[kind, 80_000] < 20


def test_redaction_of_overlaps_and_stretches(spark, monkeypatch):
    texts = [t for t in random_texts(120) if t]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {r.doc_id: [(s.start, s.end, s.kind) for s in r.pii] for r in pii.detect(frame).collect()}
    for stretch in (256, 2):
        monkeypatch.setattr(pii, "STRETCH", stretch)
        got = {r.doc_id: r.text for r in pii.redact(pii.detect(frame)).collect()}
        for i, t in enumerate(texts):
            at, out = 0, ""
            for start, end, kind in spans[i]:
                if start >= at:
                    out += t[at:start] + f"<{kind.upper()}>"
                at = max(at, end)
            assert got[i] == out + t[at:]


def brute(docs, items):
    """Every alignment of every document with every item, compared place by place."""
    number = {}
    ids = lambda words: np.array([number.setdefault(w, len(number)) for w in words])
    items = {i: ids(w) for i, w in items.items()}
    want = set()
    for d, text in docs:
        a = ids(text.split())
        for i, b in items.items():
            for shift in range(1 - len(b), len(a)):
                same = decontam.overlap(a, b, shift)[2]
                if same >= decontam.LEAST and (same >= decontam.SHARE * len(b) or same >= decontam.LONG):
                    want.add((d, i))
                    break
    return want


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.1, 1.0), (0.2, 0.98), (0.3, 0.95)])
def test_overlaps_against_all_alignments(spark, rate, least):
    """Recall against a comparison of every place with every place, by share of substituted words; nothing else is found.

    Passages are whole items, parts of items, and items in two parts with other words between.
    """
    rng = random.Random(int(rate * 100))
    word = lambda: "".join(rng.choices(["ba", "ko", "lu", "mi", "re", "sha", "ti"], k=3))
    items = {i: [word() for _ in range(rng.randint(8, 70))] for i in range(25)}
    docs = []
    for d in range(120):
        passage = list(items[rng.randrange(25)])
        if d % 3 == 1:
            passage = passage[: max(8, len(passage) * 2 // 3)]
        if d % 3 == 2:
            cut = len(passage) // 2
            passage[cut:cut] = [word() for _ in range(80)]
        passage = [word() if rng.random() < rate else w for w in passage]
        docs.append((d, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame, table).collect()}
    want = brute(docs, items)
    assert got <= want and len(got) >= least * len(want) and len(want) > 60


def test_short_items_as_whole_runs(spark, leaky):
    frame, table, want = leaky
    items = [(100, "Ko lu-mi"), (101, "ko LU mi!"), (102, "zzz"), (103, ""), (104, None), (105, "one two three four five six seven")]
    docs = [(1, "x ko, lu mi ko lu mi", "r"), (2, "ko lu x mi", "r"), (3, "zzzz zz z", "r"), (4, "ZZZ", "r"), (4, "a ZZZ", "r"), (5, "one two three four five six seven eight", "r"), (6, "one two three four five six eight seven", "r"), (None, "zzz", "r"), (7, None, "r")]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string, region string"), spark.createDataFrame(items, "item_id long, text string"), short_items=True).collect()
    assert sorted((r.doc_id, r.item_id, r.n_items, r.matched_words, r.start_word) for r in found) == [(1, 100, 2, 3, 1), (4, 102, 1, 1, 0), (5, 105, 1, 7, 0)]
    both = {(r.doc_id, r.item_id) for r in decontam.leaks(frame, table, short_items=True).collect()}
    assert both == want | {(903, 32)} | {p for p in both if p[1] == 32}


def test_leaks_in_long_texts(spark):
    rng = random.Random(3)
    item = [f"q{i}" for i in range(40)]
    body = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    body[120_000:120_000] = item
    frame = spark.createDataFrame([(1, " ".join(body)), (2, "x" * 500_000)], "doc_id long, text string")
    rows = decontam.leaks(frame, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.matched_words, r.start_word) for r in rows] == [(1, 40, 120_000)]
