import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from keystrata.llm import ppm
from keystrata.llm.common import crc_rest


def plain(texts, train):
    """The same model, a byte at a time."""
    trie, words = defaultdict(Counter), Counter()
    for t, learn in zip(texts, train, strict=True):
        if learn:
            s = b"\xff" * ppm.ORDER + t + b"\xff"
            for p in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    trie[s[p - k : p]][s[p]] += 1
            words.update(t.split())
            words[None] += 1

    def step(context, byte):
        gone, total = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            node = {b: n for b, n in trie.get(context[ppm.ORDER - k :], {}).items() if b not in gone}
            n = sum(node.values())
            if not n:
                continue
            if byte in node:
                return total + math.log10((2 * node[byte] - 1) / (2 * n))
            total += math.log10(len(node) / (2 * n))
            gone |= set(node)
        return total - math.log10(256 - len(gone))

    out = []
    for t in texts:
        s = b"\xff" * ppm.ORDER + t + b"\xff"
        tokens = t.split() + [None]
        out.append((len(tokens), sum(words[w] > 0 for w in tokens), sum(math.log10((words[w] + 1) / (sum(words.values()) + len(words) + 1)) for w in tokens), sum(step(s[p - ppm.ORDER : p], s[p]) for p in range(ppm.ORDER, len(s)))))
    return out, sum(words.values())


def test_against_a_plain_model(documents, monkeypatch):
    frame, rows = documents
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 20_000)
    frame = frame.where("doc_id <> 9004 AND doc_id <> 9006").withColumn("train", crc_rest(F.col("doc_id"), 7) != 2)
    got = {r.doc_id: r for r in ppm.score(frame).collect()}
    rows = [r for r in rows if r[0] not in (9004, 9006)]
    want, total = plain([(r[1] or "").encode().lower() for r in rows], [zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows])
    assert len(got) == len(rows)
    for r, (n, known, base, score) in zip(rows, want, strict=True):
        g = got[r[0]]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total)
        assert math.isclose(g.log_sum - n * math.log10(total + g.train_words + 1), base, rel_tol=1e-9)
        assert math.isclose(g.score, score, rel_tol=1e-5, abs_tol=1e-5)


def test_probabilities_sum_to_one():
    import numpy as np
    import pyarrow as pa

    runs, _ = ppm.runs_of(pa.array([b"abracadabra alakazam", b"banana"]), 3)
    keys, counts = ppm._added(runs, np.ones(len(runs)))
    low, low_counts = ppm._added(runs & np.uint64(0xFFFFFF), np.ones(len(runs)))
    model = ppm.partition_model(keys, counts, low, low_counts, 3)
    for context in (b"abr", b"zzz", b"ana", b"\xff\xff\xff"):
        base = int.from_bytes(context, "big") << 8
        assert math.isclose((10 ** model.log10(np.arange(base, base + 256, dtype=np.uint64))).sum(), 1.0, rel_tol=1e-9)


def test_odd_tables(nothing, repeated):
    assert ppm.score(nothing.withColumn("train", F.lit(True))).count() == 0
    rows = ppm.score(repeated.withColumn("train", F.col("doc_id").isNotNull())).collect()
    assert len(rows) == 7
    assert len({round(r.score, 6) for r in rows if r.doc_id == 7}) == 1
    assert all(r.n_tokens == 1 for r in rows if r.doc_id == 8)
    none = ppm.score(repeated.withColumn("train", F.lit(False))).where("doc_id = 8").first()
    assert math.isclose(none.score, -math.log10(256), rel_tol=1e-6) and none.train_tokens == 0
