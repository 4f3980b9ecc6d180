import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import rlz, sigtree, vectors
from tests.llm.conftest import DDL


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- n-gram Jaccard join


def jaccard(rows):
    sets = {}
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    near, links = {i: i for i in ids}, defaultdict(int)

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                near[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


@pytest.mark.parametrize("limit", [3000, 4])
def test_jaccard_against_all_pairs(documents, monkeypatch, limit):
    frame, rows = documents
    monkeypatch.setattr(sigtree, "LIMIT", limit)
    monkeypatch.setattr(sigtree, "BLOCK_BYTES", 20_000)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in sigtree.join(frame).collect()}
    assert got == jaccard(rows)
    assert sum(n > 0 for *_, n in got.values()) > 20


def test_tree_finds_every_pair():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (6, 40, 200, 900)]
    sets = []
    for b in base:
        for cut in (0, 0.02, 0.08, 0.15, 0.3):
            keep = b[rng.random(len(b)) >= cut]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(cut * len(b) / 2)).astype(np.uint64)])) if len(keep) else b)
    sets = [s for s in sets for _ in range(8)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - o)}
    got = {tuple(sorted(p)) for a, b in sigtree.tree_join(sets, None) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == want
    left, right = sets[::2], sets[1::2]
    across = {(int(i), int(j)) for a, b in sigtree.tree_join(left, right) for i, j in zip(a, b, strict=True)}
    assert across == {(i, j) for i in range(len(left)) for j in range(len(right)) if 100 * (o := len(np.intersect1d(left[i], right[j]))) >= 80 * (len(left[i]) + len(right[j]) - o)}


def test_jaccard_odd_tables(nothing, repeated):
    assert sigtree.join(nothing).count() == 0
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.n_links) for r in sigtree.join(repeated).collect())
    assert rows == [(-1, 4, None, 0)] * 2 + [(7, 4, 7, 2)] * 3 + [(8, 0, 8, 0)] * 2


# ---------------------------------------------------------------- substrings


def substrings(rows):
    seen, out = set(), {}
    for doc, text in sorted((r[0], r[1]) for r in rows):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_against_a_dictionary(documents, monkeypatch):
    frame, rows = documents
    monkeypatch.setattr(rlz, "BLOCK_BYTES", 15_000)
    parsed = rlz.parse(frame).collect()
    want = substrings(rows)
    text = {r[0]: words(r[1]) for r in rows}
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in parsed} == want
    factors = [(r.doc_id, f) for r in parsed for f in r.factors]
    assert len(factors) > 20
    for doc, f in factors:
        assert f.words >= 20 and (f.ref_doc, f.ref_start) < (doc, f.start)
        assert text[doc][f.start : f.start + f.words] == text[f.ref_doc][f.ref_start : f.ref_start + f.words]
    for r in parsed:
        assert r.n_removed == len({i for f in r.factors for i in range(f.start, f.start + f.words)})


def test_copies_within_a_document(spark):
    base = " ".join(f"x{i}" for i in range(25))
    rows = [(1, f"{base} mid {base}"), (2, " ".join(["a"] * 50)), (3, f"head {base} tail")]
    frame = spark.createDataFrame([(d, t, *[None] * 7) for d, t in rows], DDL)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rlz.parse(frame).collect()}
    assert got == substrings(rows)
    assert got[1][1] == 25 and got[2][1] == 49 and got[3][1] == 25


def test_substring_odd_tables(spark, nothing, repeated):
    assert rlz.parse(nothing).count() == 0
    assert {r.n_removed for r in rlz.parse(repeated).collect()} == {0}
    text = " ".join(f"y{i}" for i in range(30))
    rows = rlz.parse(spark.createDataFrame([(None, text), (5, text), (5, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 30), (0, 30), (5, 0), (5, 30)]


# ---------------------------------------------------------------- vectors


def vector_rows(seed=3, groups=12, near=9, single=200):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(groups):
        center = rng.standard_normal(16)
        for _ in range(near):
            rows.append((i, (center + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12])).astype(np.float32).tolist(), g % 3))
            i += 1
    for _ in range(single):
        rows.append((i, rng.standard_normal(16).astype(np.float32).tolist(), i % 3))
        i += 1
    return rows


def cosine_links(rows):
    ok = {i: np.array(v, float) for i, v, label in rows if label is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    label = {i: x for i, _, x in rows}
    return {(i, j) for i in ok for j in ok if i < j and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.98}


@pytest.mark.parametrize("limit", [2048, 3])
def test_vectors_against_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(vectors, "LIMIT", limit)
    rows = vector_rows()
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [], 0), (n + 6, rows[0][1][:8], 0)]
    got = {r.vec_id: r for r in vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = cosine_links(rows)
    links = defaultdict(int)
    for i, j in want:
        links[i] += 1
        links[j] += 1
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows)
    assert found >= 0.9 * 2 * len(want) and all(got[i].n_links <= links[i] for i in got)
    assert len(want) > 100
    for i in range(n, n + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


@pytest.mark.parametrize("mean", [0.7, 0.9])
def test_vectors_of_a_crowded_label(spark, monkeypatch, mean):
    """Vectors of one direction, crowded without linking, that share keys; every pair and no other is found."""
    monkeypatch.setattr(vectors, "LIMIT", 1500)
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(mean) * unit(rng.standard_normal((1, 64))) + np.sqrt(1 - mean) * unit(rng.standard_normal((4000, 64)))
    x[3000:3400] = unit(x[:400]) + 0.17 * unit(rng.standard_normal((400, 64)))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    near = unit(x) @ unit(x).T >= 0.98
    np.fill_diagonal(near, False)
    assert near.sum() > 600
    got = {r.vec_id: r for r in vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    assert [got[i].n_links for i in range(4000)] == near.sum(1).tolist()
    assert all(got[i].component_id == got[j].component_id for i, j in np.argwhere(near).tolist())
    assert sum(r.kept for r in got.values()) == 4000 - len(vectors._forest(np.argwhere(near)))


def test_vector_odd_tables(spark):
    ddl = "vec_id long, embedding array<float>, label int, links string"
    assert vectors.near(spark.createDataFrame([], ddl)).count() == 0
    rows = vectors.near(spark.createDataFrame([(4, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "x"), (9, [2.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x")], ddl)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in rows) == [(-1, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)]


def test_trees_drop_pairs_of_nodes_on_real_tables():
    """On the documents of the largest table, all in one tree, as many as a task holds."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].combine_chunks()
    sets = [s for s in sigtree.shingle_sets(texts) if len(s)]
    sets = list({s.tobytes(): s for s in sets}.values())[:3000]
    tally = {}
    got = {tuple(sorted(p)) for a, b in sigtree.tree_join(sets, None, tally=tally) for p in zip(a.tolist(), b.tolist(), strict=True)}
    holders, want = defaultdict(list), set()
    for i, s in enumerate(sets):
        for h in s.tolist():
            holders[h].append(i)
    for i, j in {(i, j) for ids in holders.values() if 1 < len(ids) < 400 for k, i in enumerate(ids) for j in ids[k + 1 :]}:
        o = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
            want.add((i, j))
    assert got == want and len(want) > 5
    leaves = -(-len(sets) // sigtree.LEAF)
    assert tally["dropped"] > 20_000 and tally["seen"] - tally["dropped"] < 0.15 * leaves * leaves / 2


@pytest.mark.parametrize("dense", [False, True])
def test_jaccard_in_large_clusters(spark, monkeypatch, dense):
    """A chain, in which each text shares half its passages with the next, and many near copies of one text."""
    monkeypatch.setattr(sigtree, "LIMIT", 20)
    passage = lambda k: [f"p{k}w{i}" for i in range(12)]
    rows = [(i, " ".join(passage(i) + ["join"] * 5 + passage(i + 1)), "x") for i in range(150)]
    rows += [(1000 + i, " ".join(passage(i) + ["join"] * 5 + passage(i + 1)[:-1] + ["other"]), "x") for i in range(0, 150, 7)]
    if dense:
        rows = [(i, " ".join([*(f"d{k}" if k != 3 * (i % 60) else f"e{i}" for k in range(200)), "end"]), "x") for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, unit string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in sigtree.join(frame).collect()}
    assert got == jaccard(rows)


def test_a_chain_sends_rows_in_proportion(spark, monkeypatch):
    """Sets that all share some rare shingle with others: what is sent to tasks is linear in their number."""
    monkeypatch.setattr(sigtree, "LIMIT", 20)
    sent = {}
    for n in (200, 800):
        rows = [(i, i * 1, [i, i + 1], b"") for i in range(n)]
        found = spark.createDataFrame(rows, "doc_id long, n long, keys array<long>, shingles binary").withColumn("n", F.lit(30).cast("long"))
        keys = found.select("doc_id", F.explode("keys").alias("key"))
        clusters = found.select("doc_id", F.lit(0).cast("long").alias("cluster"))
        units = sigtree._units(found, keys, clusters)
        sent[n] = units.agg(F.sum("parts")).first()[0]
        assert units.agg(F.max("parts")).first()[0] == 1
    assert sent[800] < 4.2 * sent[200]


def test_factors_run_as_far_as_the_reference_agrees(documents, monkeypatch):
    """A factor ends where the next words differ, a text ends, or the next factor takes over; short agreements are none."""
    frame, rows = documents
    monkeypatch.setattr(rlz, "BLOCK_BYTES", 15_000)
    text = {r[0]: words(r[1]) for r in rows}
    ended = 0
    for r in rlz.parse(frame).collect():
        for f, after in itertools.zip_longest(r.factors, r.factors[1:]):
            mine, ref = text[r.doc_id][f.start + f.words :], text[f.ref_doc][f.ref_start + f.words :]
            ended += bool(mine and ref)
            assert not mine or not ref or mine[0] != ref[0] or (after and after.start < f.start + f.words < after.start + after.words)
    assert ended > 5


def test_the_greedy_parse_at_boundaries():
    w = np.arange(100, dtype=np.uint64)
    ref = lambda a, n: np.concatenate([w[a : a + n], [np.uint64(999)]])
    # One after another, one inside the first, one that straddles its end, and one whose words don't agree.
    assert rlz.factored(w, [(0, 11, ref(0, 30)), (5, 2, ref(5, 21)), (15, 3, ref(15, 40)), (60, 1, ref(61, 20))], 20) == [(0, 30, 0), (15, 40, 2)]
    assert rlz.factored(w, [(0, 1, ref(0, 19))], 20) == []
    assert rlz.factored(w[:25], [(2, 4, ref(2, 60))], 20) == [(2, 23, 0)]


def test_a_text_that_repeats_itself(spark):
    """Every window of a long run of one word copies the first: the parse stays linear."""
    rows = [(1, "a " * 60_000), (2, "b " + "a b " * 3000)]
    frame = spark.createDataFrame([(d, t, *[None] * 7) for d, t in rows], DDL)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rlz.parse(frame).collect()}
    assert got == substrings(rows)


def test_work_on_a_block_does_not_follow_the_number_of_parts():
    """A million parts: those that occur in a block are all that is looked at."""
    import time

    from keystrata.llm import common, ppm

    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64) * np.uint64(2))
    for parts in (16, 10**6, 10**9):
        began = time.process_time()
        cuts = rlz._parts(h, parts)
        _, dealt = ppm._dealt(h, parts)
        assert time.process_time() - began < 1.0
        for found in (cuts, dealt):
            assert sum(j - i for _, i, j in found) == len(h) and len(found) <= min(parts, len(h)) and found[-1][2] == len(h)
    assert common.occurring(np.array([2, 2, 7])) == [(2, 0, 2), (7, 2, 3)] and common.occurring(np.empty(0)) == []
