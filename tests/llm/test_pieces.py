import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.llm import pieces

V = pieces.vocabulary(pieces.MODEL)
ODD = ["", " ", "  a", "a ", "a▁b  c", "\0x", "\0▁x ▁", "é\n\n", "日本語 text", "▁", "😀 a\tb", "<s></s><0x0A>", "▁", "x" * 300]


def applied(ids, edits):
    out = list(ids)
    for start, length, new in sorted(edits, reverse=True):
        out[start : start + length] = new
    return out


def all_paths(text):
    """Scores of all segmentations, spelled out."""
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    out = []

    def go(i, total):
        if i == len(s):
            out.append(total)
            return
        for j in range(i + 1, min(len(s), i + 20) + 1):
            if s[i:j] in V.score:
                go(j, total + V.score[s[i:j]])
        if s[i] not in V.score:
            go(i + 1, total + V.fallback * len(s[i].encode()))

    go(0, 0.0)
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_read_back(text):
    _, ids, more = V.encode(text, 4)
    assert V.decode(ids.tolist()) == text
    for _, edits in more:
        assert V.decode(applied(ids.tolist(), edits)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_reads_back(text):
    assert V.decode(V.encode(text, 2)[1].tolist()) == text


@pytest.mark.parametrize("text", ["the cat", "hello", "a b a b", "on the", "x  y", "é\nz", "of, the"])
def test_nbest_against_all_segmentations(text):
    score, ids, more = V.encode(text, 6)
    got = [score, *[s for s, _ in more]]
    assert got == pytest.approx(all_paths(text)[: len(got)])
    assert len(got) == min(6, len(all_paths(text)))
    texts = {tuple(ids.tolist()), *[tuple(applied(ids.tolist(), e)) for _, e in more]}
    assert len(texts) == len(got)


def test_words_solved_together_equal_words_solved_alone():
    rng = random.Random(4)
    words = sorted({pieces.MARK * rng.randint(0, 2) + "".join(rng.choices("abcdeé\n\t.,ñ", k=rng.randint(1, 12))) for _ in range(500)}, key=len)
    V._learn(set(words))
    for w in words:
        want, (score, ids, loss) = V.best_of(w), V.entry(w)
        assert (score, ids) == want[:2] and loss == pytest.approx(want[2])


def test_frames(documents, nothing, repeated):
    frame, rows = documents
    got = pieces.decode(pieces.encode(frame, nbest=2)).collect()
    want = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    assert all(r.decoded == want[r.doc_id] for r in got)
    assert next(r for r in got if r.doc_id == 9001).pieces is None
    assert next(r for r in got if r.doc_id == 9002).pieces == []
    assert pieces.encode(nothing).count() == 0
    assert pieces.encode(repeated).where(F.col("pieces").isNotNull()).count() == 5


def test_the_query_decodes_every_segmentation(spark, documents, tmp_path):
    frame, rows = documents
    odd = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    frame.select("doc_id", "text").unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = pieces.op4_pieces(spark, str(tmp_path)).collect()
    want = {r[0]: r[1] for r in rows} | {20_000 + i: t for i, t in enumerate(ODD)}
    assert {r.doc_id: r.decoded for r in got} == want
    assert all(r.read_back == (None if want[r.doc_id] is None else 1 + len(r.alternatives)) for r in got)
    assert sum(len(r.alternatives or []) for r in got) > 100
    some = next(r for r in got if r.alternatives)
    edits = [(e.start, e.length, e.pieces) for e in some.alternatives[0].edits]
    assert V.same(some.pieces, edits) and not V.same(some.pieces, [(s, n, [*new, new[0]]) for s, n, new in edits])


def test_results_don_t_depend_on_what_is_remembered():
    texts = ["the cat sat on the mat", "on the mat, the cat"]
    a = [V.encode(t, 3)[1].tolist() for t in texts]
    V.forget()
    assert [V.encode(t, 3)[1].tolist() for t in reversed(texts)][::-1] == a


def test_long_words_take_memory_in_proportion():
    """100,000 characters without a space: one letter, chance, a script without spaces; N-best included."""
    import tracemalloc

    rng = random.Random(9)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=100_000))
    cjk = "".join(rng.choices([*"日本語文章中国人民大学生活東京都道府県", "the"], k=95_000))
    for text in ("a" * 100_000, base64, cjk):
        V.forget()
        tracemalloc.start()
        score, ids, more = V.encode(text, 4)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 500 << 20
        assert V.decode(ids.tolist()) == text and len(more) == 3
        assert all(V.decode(applied(ids.tolist(), edits)) == text and s <= score for s, edits in more)


def test_bounded_search_gives_the_paths_of_the_full_one():
    for word in ("▁hello", "▁the", "▁aaaaaaa", "▁entertainment"):
        full = [s for s, _ in itertools.islice(V.paths(word), 6)]
        got = list(V.paths(word, None, 6))
        assert [s for s, _ in got][:6] == pytest.approx(full) and len({ids for _, ids in got}) == len(got)
