"""Operators that write tables between their steps, in a session of a cluster whose folder has no scheme and lies below /tmp."""

import pytest

from cohortspark.functions import storage as S
from cohortspark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, frame, planted, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    frame(planted).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in planted], "doc_id bigint, quality int").write.parquet(f"{top}/labels.parquet")
    return top


@pytest.mark.parametrize("name", ["op1_automaton_dedup", "op3_kneser_ney", "op4_shingle_join", "op7_suffix_dedup", "op8_backoff_automaton",
                                  "op9_template_dedup", "op11_token_alignment", "op12_run_merge"])
def test_same_rows_on_a_cluster(spark, folder, rows, monkeypatch, name):
    alone = rows(QUERIES[name](spark, folder))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(S, "_TRIED", set(), raising=False)
    assert ":" not in spark.conf.get("spark.checkpoint.dir")
    assert alone and rows(QUERIES[name](spark, folder)) == alone
