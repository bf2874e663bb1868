from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from posespark.plans import queries as q

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", q.ORACLES)
def test_query_equals_its_sql(name, same_rows):
    same_rows(q.QUERIES[name], q.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.ORACLES])
def test_query_without_sql_runs(name, spark, sf_dir):
    df = q.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_works_without_the_training_data_operators(tmp_path):
    """The entry module imports where neither the subpackage nor the pipeline is there."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
sys.modules["posespark.llm"] = sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert "valid_segments" in e.queries() and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


def test_scans_read_only_the_columns_they_need(spark, sf_dir, capsys):
    q.QUERIES["video_mean_widths"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    q.QUERIES["video_selection"](spark, sf_dir).explain("formatted")
    assert "PushedFilters: [In(o_orderpriority" in capsys.readouterr().out
