"""The registry: with and without the training-data subpackage, and against SQL on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'source_quality' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_flagship(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", ["source_quality", "t4_clean_legal_guidance", "c1_document_type", "r1_r2_r4_r5_references", "a4_redundancy", "a5_merge_small", "j1_cross_references", "j10_note_check", "k2_knn", "s8_list_documents"])
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    rows = lambda cols, data: sorted(repr([None if v is None else round(float(v), 4) if isinstance(v, (int, float)) else str(v) for _, v in sorted(zip(cols, r))]) for r in data)
    got = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())
