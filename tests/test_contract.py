import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_core_does_not_need_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "folioweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+.*\bllm\b", p.read_text(), re.M), p


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from folioweave.plans import catalogue

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    for name in ("child_to_parent", "bm25_by_language", "hybrid_fusion", "ranking_metrics", "exact_split", "token_f1"):
        a = catalogue.queries()[name](spark, DATA).toPandas()
        b = c.sql(catalogue.oracle_sql()[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        key = lambda df: sorted(tuple(round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))
        assert key(a) == key(b), name


def test_plain_sentences_match_sql(spark, tmp_path):
    from folioweave.plans import catalogue

    many = " ".join(f"The words of part {i} say so." for i in range(9, 14))
    texts = ["Art.-No. Soltam 99 | No. 5 in Fig. 3 of it.", "So it is. " * 12 + "It takes 12 of the 12 runs here.", many, "   ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["plain_sentences"](spark, str(tmp_path)).collect())
    # held abbreviations count as one character, numbers as they stand
    assert got == [(0, 1, len(texts[0]) - 2 - 2 - 3), (1, 13, 32), (2, 5, 28)]
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.sql(catalogue.oracle_sql()["plain_sentences"]).fetchall())
