import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.llm import chat

DDL = "conv_id long, turn long, role string, text string, extra string"
HARD = st.lists(st.sampled_from([*"<>|/\\s[]INST SY\n", *chat.CONTROL]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_format_reads_back(turns):
    transcript = "".join(chat.format_turn(r, t) for r, t in turns)
    assert list(chat.parse(transcript)) == turns


@settings(max_examples=200, deadline=None)
@given(HARD)
def test_escaped_texts_hold_no_control_string(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_examples(spark):
    rows = [(1, 2, "user", "q2"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1</s>"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3"), (2, 0, "user", "only"), (None, 0, None, None), (3, 0, "assistant", "")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], DDL)
    examples = chat.expand(turns)
    full = {(r.conv_id, r.example): r for r in chat.materialise(examples).collect()}
    assert set(full) == {(1, 0), (1, 1), (3, 0)}
    e = full[1, 1]
    assert list(chat.parse(e.text)) == [("user", "q1"), ("assistant", "a1</s>"), ("user", "q2"), ("assistant", "a2")]
    assert chat.unescape(e.text[e.loss_start : e.loss_end]) == "a2"
    assert chat.unescape(full[1, 0].text[full[1, 0].loss_start : full[1, 0].loss_end]) == "a1</s>"
    got = {r.conv_id: r for r in chat.digests(chat.expand(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (5, sha("user\nq1\nassistant\na1</s>\nuser\nq2\nassistant\na2\nuser\nq3\n"), 8, sha("a1</s>a2"))
    assert got[1].formatted_chars == sum(len(r.text) for k, r in full.items() if k[0] == 1)
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (1, 0, sha(""))
    assert (got[None].n_turns, got[None].turns_sha256) == (1, sha("\n\n"))
    assert got[3].n_turns == 1


def test_ties_and_empty_table(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "assistant", "c", "x")], DDL)
    assert "".join(r.delta for r in chat.expand(turns).orderBy("example").collect()) == chat.format_turn("assistant", "c") + chat.format_turn("user", "a") + chat.format_turn("user", "b")
    assert chat.digests(chat.expand(spark.createDataFrame([], DDL))).count() == 0


def test_a_long_conversation_stays_linear(spark):
    n = 3000
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}", "x") for i in range(n)], DDL)
    examples = chat.expand(turns)
    assert examples.count() == n // 2
    assert chat.digests(examples).first().n_turns == n


def test_long_turns_and_long_runs_without_a_reply(spark, monkeypatch):
    """Turns wait for a reply up to a bound; what is read back does not depend on it."""
    rows = [(1, i, "user", f"u{i} " * 40, "x") for i in range(60)] + [(1, 60, "assistant", "a", "x"), (1, 61, "user", "z" * 3000, "x")] + [(2, 0, "user", "q" * 2_000_000, "x"), (2, 1, "assistant", "r" * 1_500_000, "x")]
    turns = spark.createDataFrame(rows, DDL)
    whole = {r.conv_id: r for r in chat.digests(chat.expand(turns)).collect()}
    monkeypatch.setattr(chat, "WAITING", 500)
    examples = chat.expand(turns)
    assert examples.where("conv_id = 1").count() > 10
    assert {r.conv_id: r for r in chat.digests(examples).collect()} == whole
    full = {r.conv_id: r for r in chat.materialise(examples).collect()}
    assert list(chat.parse(full[1].text)) == [(r[2], r[3]) for r in rows if r[0] == 1 and r[1] <= 60] and full[1].text[full[1].loss_start : full[1].loss_end] == "a"
    assert len(full[2].text) == whole[2].formatted_chars


def test_examples_are_spelled_out_and_read_back(spark, monkeypatch):
    """Each example has its whole prefix and its target, and the digests come from them."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} </s>\\", "x") for i in range(9)] + [(2, 0, "user", "q", "x"), (2, 1, "assistant", "a", "x")]
    turns = spark.createDataFrame(rows, DDL)
    examples = chat.expand(turns).cache()
    got = {(r.conv_id, r.example): r for r in examples.collect()}
    for k in range(4):
        said = "".join(chat.format_turn(r[2], r[3]) for r in rows[: 2 * k + 1])
        assert (got[1, k].prefix, got[1, k].target) == (f"{said}<|assistant|>", chat.escape(rows[2 * k + 1][3]))
    assert (got[1, 4].prefix, got[1, 4].target) == (None, None)
    plain = {r.conv_id: r for r in chat.digests(examples).collect()}
    more = examples.where("conv_id = 2").withColumn("prefix", F.concat(F.lit("<|user|>more</s>"), "prefix"))
    assert chat.digests(more).first().n_turns == plain[2].n_turns + 1
    with pytest.raises(Exception, match="does not begin with the one before it"):
        chat.digests(examples.withColumn("prefix", F.when(F.col("example") == 2, F.lit("<|user|>else</s><|assistant|>")).otherwise(F.col("prefix")))).collect()
    # Small batches give the same rows.
    monkeypatch.setattr(chat, "BATCH", 10)
    assert {r.conv_id: r for r in chat.digests(chat.expand(turns)).collect()} == plain
