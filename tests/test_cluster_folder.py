"""Queries that write tables between their steps, in a session of a cluster whose folder has no scheme and lies below /tmp."""

import os

import pytest

import __spark_entry__  # noqa: F401  (finds the package)
import check_oracle
from cohortspark.functions import storage as S

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
NAMES = """agreement_block_curve agreement_strata agreement_summary align_genes arm_overlap association_run average_recovery backoff_base
    binned_error_boxes block_recovery block_runs block_file block_metrics bootstrap_inclusion bootstrap_counts collapse_groups box_stats
    collapse_groups_by_draw covariance_genes call_status direction_bulk difficulty_rho""".split()


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_on_a_cluster(spark, con, monkeypatch, name):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(S, "_TRIED", set(), raising=False)
    assert ":" not in spark.conf.get("spark.checkpoint.dir")
    ok, note = check_oracle.compare(spark, con, SF, name)
    assert ok, note
