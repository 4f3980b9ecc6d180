"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from keystrata import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)]
    return sorted((tuple(map(repr, r)) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numeric = lambda f: f.astype({c: "float64" for c in f.columns if f[c].dtype.kind in "iuf"})
    assert plain(numeric(got)) == plain(numeric(want))


def test_every_token_is_returned(spark):
    """inv_tokens has every token in order; inv_tokenize counts and digests the same ones."""
    import hashlib

    rows = queries.QUERIES["inv_tokens"](spark, SF).toPandas().sort_values(["doc_id", "pos"])
    whole = queries.QUERIES["inv_tokenize"](spark, SF).toPandas().set_index("doc_id")
    assert len(rows) == whole["n_tokens"].sum() > 20 * len(whole)
    digests = rows.groupby("doc_id")["token"].agg(lambda t: hashlib.sha256(" ".join(t).encode()).hexdigest())
    empty = hashlib.sha256(b"").hexdigest()
    assert digests.to_dict() == {k: v for k, v in whole["tokens_sha256"].to_dict().items() if v != empty}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_operators(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("keystrata.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "keystrata.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(__spark_entry__)
    assert set(bare.queries()) == set(queries.QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
