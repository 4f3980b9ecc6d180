"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its prefix, only its text, the target, is
trained on. `expand` spells out both for every example; an example's text is prefix, target and the end of its turn,
and `delta` is the piece of transcript that it adds to those before it.

Template: a turn is `<|role|>`, the text, `</s>`. Control strings inside roles and texts get a backslash after
their first character, and backslashes are doubled, so no text can open or close a turn and reading back is exact.

The texts of a conversation's examples grow with the square of its replies, as each repeats what came before; that is
the method's output. Rows are read in order of conversation and turn, in one pass that holds the transcript so far of
one conversation, which is as long as its longest example, and some BATCH characters of examples. Edge cases: null role
or text is empty; ties of a turn number are ordered by role and text; a null conv_id is a conversation of its own;
trailing turns without a reply make a last row with no target (prefix, target and target_start null); a conversation
without a reply has that row only; an empty table no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import table

#: The strings that control a model's input; longer ones first where one starts another.
CONTROL = ("[/INST]", "[INST]", "<<SYS>>", "<</SYS>>", "</s>", "<s>", "<|", "|>")
OPEN, SHUT, END = "<|", "|>", "</s>"
# One character where a control string starts; strings that overlap are found one by one.
_control = re.compile("(?=" + "|".join(re.escape(c) for c in CONTROL) + ")(.)", re.S)

#: Characters of turns without a reply that wait for one; beyond, they go ahead of the example in a row without a target.
WAITING = 1_000_000
#: Characters of examples that make a batch of rows; one example may be longer.
BATCH = 4_000_000
EXAMPLES = "conv_id long, example long, first_turn long, delta string, context_chars long, target_start long, target_chars long, prefix string, target string"


def escape(text: str) -> str:
    """Makes every control string harmless; `unescape` undoes it exactly."""
    text = text.replace("\\", "\\\\") if "\\" in text else text
    return _control.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{SHUT}{escape(text)}{END}"


def parse(transcript: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted transcript, or of a piece that starts and ends with a turn."""
    at = 0
    while at < len(transcript):
        shut = transcript.index(SHUT, at + len(OPEN))
        end = transcript.index(END, shut + len(SHUT))
        yield unescape(transcript[at + len(OPEN) : shut]), unescape(transcript[shut + len(SHUT) : end])
        at = end + len(END)


def ordered(frame: DataFrame, *columns: str) -> DataFrame:
    """All rows of a conversation in one partition, one after another, in order.

    Turns of a conversation have to follow one another in one task, as the digest of a transcript and the running
    context are sequential; the task streams them and holds one conversation's transcript.
    """
    return frame.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *columns)


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    """The rows as a batch, and none of them in the list."""
    fields = [f.split() for f in shape.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[kind] for _, kind in fields]
    out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [name for name, _ in fields])
    rows.clear()
    return out


def _expanded(batches: Iterator[pa.RecordBatch], most_waiting: int, most_held: int) -> Iterator[pa.RecordBatch]:
    """Turns in order to examples, batch by batch."""
    rows: list[tuple] = []
    # upto: the transcript up to the last row; pending: the turns since.
    started, conv, example, upto, first, place, pending, waiting, held = False, None, 0, "", 0, 0, [], 0, 0
    for batch in batches:
        for c, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if not started or c != conv:
                if pending:
                    rows.append((conv, example, first, "".join(pending), len(upto), None, None, None, None))
                started, conv, example, upto, first, place, pending, waiting = True, c, 0, "", 0, 0, [], 0
            role, text = role or "", text or ""
            place += 1
            if role == "assistant":
                opened, target = "".join(pending) + f"{OPEN}{escape(role)}{SHUT}", escape(text)
                prefix, delta = upto + opened, opened + target + END
                rows.append((conv, example, first, delta, len(prefix), len(prefix), len(target), prefix, target))
                held += len(prefix) + len(delta) + len(target)
                upto += delta
                example, first, pending, waiting = example + 1, place, [], 0
            else:
                piece = format_turn(role, text)
                pending.append(piece)
                held += len(piece)
                waiting += len(piece)
                if waiting > most_waiting:
                    delta = "".join(pending)
                    rows.append((conv, example, first, delta, len(upto), None, None, None, None))
                    upto += delta
                    first, pending, waiting = place, [], 0
            if held > most_held and rows:
                yield _batch(rows, EXAMPLES)
                held = 0
    if pending:
        rows.append((conv, example, first, "".join(pending), len(upto), None, None, None, None))
    if rows:
        yield _batch(rows, EXAMPLES)


def _turns(turns: DataFrame) -> DataFrame:
    return ordered(turns.select("conv_id", "turn", "role", "text"), "turn", "role", "text")


def expand(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn, with its whole prefix and its target, plus one without a target for turns that
    follow the last reply.

    A run of more than WAITING characters without a reply comes in several rows, all but the last without a target.
    """
    bounds = WAITING, BATCH
    return _turns(turns).mapInArrow(lambda batches: _expanded(batches, *bounds), EXAMPLES)


def materialise(examples: DataFrame) -> DataFrame:
    """The examples with targets, each as one text: prefix, target and the end of its turn; and where its loss lies."""
    text = F.concat("prefix", "target", F.lit(END)).alias("text")
    return examples.where("target IS NOT NULL").select("conv_id", "example", text, F.col("target_start").alias("loss_start"), (F.col("target_start") + F.col("target_chars")).alias("loss_end"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples in order to a row for each conversation.

    Every example is read as it is spelled out: its prefix has to begin with all that was read before, and what follows
    is parsed; its loss is what the mask covers of its text.
    """
    rows: list[tuple] = []
    state: list = []
    upto = ""

    def close() -> None:
        conv, n, turns, loss_chars, loss, total, n_examples = state
        rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), total, n_examples))

    for batch in batches:
        for conv, delta, start, long, prefix, target in zip(*(batch[c].to_pylist() for c in ("conv_id", "delta", "target_start", "target_chars", "prefix", "target")), strict=True):
            if not state or state[0] != conv:
                if state:
                    close()
                state, upto = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], ""
            if target is None:
                whole = upto + delta
            else:
                whole = prefix + target + END
                if not whole.startswith(upto):
                    raise ValueError(f"conversation {conv}: an example does not begin with the one before it")
                loss = unescape(whole[start : start + long])
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(whole)
                state[6] += 1
            for role, text in parse(whole[len(upto) :]):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            upto = whole
        if len(rows) > 20_000:
            yield _batch(rows, DIGESTS)
    if state:
        close()
    if rows:
        yield _batch(rows, DIGESTS)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what the examples of expand() say when they are read back."""
    # expand() has left each conversation's rows together and in order, in the same partitions.
    return examples.mapInArrow(_read_back, DIGESTS)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the examples of every conversation and of one of control strings only.

    formatted_chars is the length of all its examples, each with its whole prefix. Examples are spelled out and read
    back in one task, batch by batch, so their texts need not pass through the JVM in between.
    """
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    bounds = WAITING, BATCH
    return _turns(turns.unionByName(extra)).mapInArrow(lambda batches: _read_back(_expanded(batches, *bounds)), DIGESTS)


#: formatted_chars and n_examples follow from the template; both are spelled out here independently.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, CASE WHEN regexp_matches(role || text, '[\\<\[|]') THEN
    length(text) + len(regexp_extract_all(text, '\[/INST\]|\[INST\]|<<SYS>>|<</SYS>>|</s>|<s>|<\||\|>|\\')) ELSE length(text) END AS tl,
  length(role) + len(regexp_extract_all(role, '\[/INST\]|\[INST\]|<<SYS>>|<</SYS>>|</s>|<s>|<\||\|>|\\')) AS rl FROM t),
f AS (SELECT *, sum(tl + rl + 8) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM f GROUP BY conv_id
"""
