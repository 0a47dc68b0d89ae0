"""What the plans look like: pruned scans, pushed filters, no Cartesian products."""

import pytest

from sievewright.operators import diffs, history
from sievewright.plans import registry

from .conftest import DATA


def plan(df):
    return df._jdf.queryExecution().toString()


def test_history_scan_is_pruned_and_filtered(spark):
    commits = spark.read.parquet(f"{DATA}/sf0.001/commits.parquet")
    p = plan(history.clean_commits(commits, registry.NOW, 180))
    assert "GreaterThanOrEqual(ts" in p and "message" not in p.split("ReadSchema")[-1]
    changes = spark.read.parquet(f"{DATA}/sf0.001/file_changes.parquet")
    p = plan(history.clean_changes(changes))
    assert "IsNotNull(commit_id)" in p and "renamed_from" not in p.split("ReadSchema")[-1]


def test_risk_reads_hunks_once(spark):
    files = diffs.clean_files(spark.read.parquet(f"{DATA}/sf0.001/diff_files.parquet"))
    hunks = diffs.clean_hunks(spark.read.parquet(f"{DATA}/sf0.001/diff_hunks.parquet"))
    p = plan(diffs.file_risk(files, hunks)).split("== Physical Plan ==")[-1]
    assert p.count("diff_hunks.parquet") == 1 and "Python" not in p


@pytest.mark.parametrize("name", ["hotspots_topk", "coupling_pairs", "ownership_summary", "risk_report", "skip_cascade", "bm25_topk", "finding_filter", "rule_tagging", "comment_json", "redact_tokens", "keyed_upsert", "directory_pack"])
def test_no_cartesian_products_and_no_python(name, spark):
    p = plan(registry.queries()[name](spark, f"{DATA}/sf0.001")).split("== Physical Plan ==")[-1]
    assert "CartesianProduct" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
