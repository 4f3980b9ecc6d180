"""The pipeline against its stages spelled out, and on odd tables."""

import pytest

import corpus_pipeline
from keystrata.llm import decontam, pieces, pii, sigtree
from tests.llm.conftest import DDL, corpus, rows_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [r[:5] for r in rows_of(corpus())]
    item = " ".join(f"bench{i}" for i in range(30))
    rows += [(9100, f"Some words before {item} and after", "en", "s", 1), (9101, "write to someone@example.org today friend", "en", "s", 2)]
    docs = spark.createDataFrame(rows, ", ".join(DDL.split(", ")[:5]))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_run(spark, folder):
    path, rows = folder
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    text = {r[0]: r[1] for r in rows}
    lettered = {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
    frame = spark.read.parquet(f"{path}/documents.parquet").where("doc_id IN ({})".format(",".join(map(str, lettered))))
    first = {r.doc_id for r in sigtree.join(frame).where("doc_id = component_id").collect()}
    leaks = {r.doc_id for r in decontam.leaks(frame, spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
    assert leaks == {9100}
    assert set(got) == (lettered & first) - leaks
    v = pieces.vocabulary(pieces.MODEL)
    redacted = {r.doc_id: r.text for r in pii.redact(pii.detect(frame)).collect()}
    for i, r in got.items():
        assert v.decode(r.pieces) == redacted[i]
    assert "<EMAIL>" in redacted[9101]


def test_last_stage_keeps_the_alternatives(spark, folder):
    path, rows = folder
    docs = spark.createDataFrame([r for r in rows if r[0] in (1, 4, 7, 9100, 9101)], ", ".join(DDL.split(", ")[:5]))
    v = pieces.vocabulary(pieces.MODEL)
    got = {r.doc_id: r for r in pieces.stage(spark, docs, path).collect()}
    for i, text, *_ in docs.collect():
        _, _, more = v.encode(text, pieces.NBEST)
        assert [(a.score, [(e.start, e.length, e.pieces) for e in a.edits]) for a in got[i].alternatives] == more
    assert len(got[9100].alternatives) == pieces.NBEST - 1


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "personal_data", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == COLUMNS


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
