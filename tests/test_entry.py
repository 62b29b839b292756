"""The driver's contract, and the native plans that the operators promise."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from docjson import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["pointer_codec", "node_table", "search_limit_truncated", "patch_add_replace", "schema_composition", "chunk_merge_small", "trim_messages", "extract_counts", "truncate_flat_string", "progress_fold", "strict_remove_required", "guard_shrinkage", "search_fuzzy"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(own.QUERIES) > 50


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall())


@pytest.mark.parametrize("name", [f"guard_{k}" for k in own._GUARDED])
def test_guards_bear_customers_without_orders(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"copy (select * from (values (1, 'a', 'X'), (2, 'b', 'Y')) c(c_custkey, c_name, c_mktsegment)) to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (select * from (values (7, 2, 'F', '5-LOW')) o(o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) to '{tmp_path}/orders.parquet'")
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    got = sorted(tuple(r) for r in own.QUERIES[name](spark, str(tmp_path)).select("doc_id", "ok", "marker").collect())
    assert got == con.execute(f"select doc_id, ok, marker from ({own.ORACLES[name]}) order by doc_id").fetchall()


def test_scans_are_pruned_and_native(spark, sf):
    def plan(name):
        return own.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    for name in ("trim_messages", "chunk_merge_small", "dedup_appends", "pointer_codec", "format_email", "leaf_count"):
        assert "Python" not in plan(name) and "Arrow" not in plan(name)
    assert "lang" not in plan("extract_flagship")


def test_the_rest_stands_alone(tmp_path):
    """In a copy without the training-data folders and the pipeline, the entry point has its other queries; without the pipeline's file, or with it alone, too."""
    code = (
        "import sys, __spark_entry__ as e\n"
        "q, o = e.queries(), e.oracle_sql()\n"
        "training = [k for k in q if k.startswith('op') or k == 'pipeline']\n"
        "assert len(q) > 50 and set(o) <= set(q) and bool(training) == bool(int(sys.argv[1])) and ('pipeline' in q) == bool(int(sys.argv[2])), training\n"
    )
    root = Path(__file__).resolve().parent.parent
    has = (root / "docjson/llm").exists() and (root / "corpus_pipeline.py").exists()
    for folders, pipeline in ((True, True), (False, False)) if not has else ((True, True), (True, False), (False, True), (False, False)):
        copy = tmp_path / f"copy-{folders}-{pipeline}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache", ".hypothesis"))
        if not folders:
            shutil.rmtree(copy / "docjson/llm", ignore_errors=True)
            shutil.rmtree(copy / "tests/llm", ignore_errors=True)
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code, str(int(folders and has)), str(int(folders and pipeline and has))], cwd=copy, env=env, check=True, timeout=120)
