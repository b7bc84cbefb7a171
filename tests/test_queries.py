"""Registered queries next to their SQL on the smallest data. RANKFLOW_ALL=1 runs every one of them."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
FAST = [
    "a1_parse_review_records", "a3_attach_summary", "a9_build_impressions", "b3_time_split", "b6_dataset_statistics", "c3_rich_catalog",
    "c6_ngram_queries", "c10_cluster_entropy", "d3_fit_tfidf", "d4_text_retrieval", "d5_user_history_retrieval", "e3_exact_topk_inner_product",
    "e5_ivf_topk", "f2_hard_negatives", "g2_user_vectors", "h7_baseline_vs_reranked", "o1_exposure", "o4_explore_exploit_epsilon0",
    "p6_all_metrics", "p11_user_evaluation", "r4_arm_summary", "r5_ab_result",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("RANKFLOW_ALL") else FAST

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_operator_is_registered():
    rows = {"A": 11, "B": 7, "C": 11, "D": 7, "E": 7, "F": 3, "G": 8, "H": 9, "O": 8, "P": 16, "R": 6}
    have = {m[0] for n in entry.queries() if (m := re.match(r"[a-z]\d+(?=_)", n))}
    assert {f"{g.lower()}{i}" for g, n in rows.items() for i in range(1, n + 1)} <= have
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "metric", "value"] and df.count() > 0


def test_python_stages_run_without_the_package_on_the_workers(tmp_path):
    """Executors may not have the package: run the Python stages from another folder."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(entry.__file__).parent)!r})
import __spark_entry__ as e
from rankflow.session import local_session
from rankflow.functions.text import unaccent
from pyspark.sql import functions as F
s = local_session("2", 2)
for n in ("e2_pluggable_encoder", "e3_exact_topk_inner_product", "o4_explore_exploit"):
    assert e.queries()[n](s, {SF!r}).count() > 0
assert s.range(1).select(unaccent(F.lit("é"), full=True)).collect()[0][0] == "e"
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "done" in out.stdout, out.stderr[-2000:]
