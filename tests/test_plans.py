"""Shape of physical plans that must hold at any size."""

import re

import pytest

import __spark_entry__ as entry
from cohortspark.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["block_assignment", "cis_window_join", "aligned_tables", "multiple_testing", "agreement_block_curve",
                                  "survival_curve", "gene_recovery", "score_genotypes", "match_arms", "variant_edits", "fill_with_mean"])
def test_no_keyless_join(spark, name):
    text = plan(REGISTRY[name].run(spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    text = plan(REGISTRY["pearson_by_gene"].run(spark, SF))
    assert "l_shipdate" not in text and "l_tax" not in text


def test_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(p_size)" in REGISTRY["restricted_rows"].run(spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(REGISTRY["top_genes"].run(spark, SF))
    assert text.count("WindowGroupLimit") == 2


def test_correlation_combines_before_the_shuffle(spark):
    text = plan(REGISTRY["pearson_by_gene"].run(spark, SF))
    assert "partial_covar_pop" in text or "covarpopulation" in text.lower()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_states_what_it_covers():
    assert all(q.covers for q in REGISTRY.values())


def test_large_groups_are_sliced(spark):
    from pyspark.sql import functions as F

    from cohortspark.functions import ordered as O
    from cohortspark.operators import pooling as P

    df = spark.range(500).select(F.lit("hot").alias("k"), F.col("id").alias("gene"), (F.col("id") / 500.0).alias("pvalue"))
    for out in (O.average_ranks(df, ["k"], "pvalue", limit=0), O.row_numbers(df, [], ["pvalue", "gene"], limit=0),
                P.annotate_significance(df, ["k"], limit=0)):
        text = plan(out)
        windows = [line for line in text.splitlines() if "Window [" in line]
        # Windows over rows stay inside a slice; the others see one total per slice and group.
        over_rows = [line for line in windows if "pvalue" in line]
        assert over_rows and all("__slice" in line for line in over_rows)


def test_plain_scans_are_not_copied(spark):
    from cohortspark.functions import storage as S

    df = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_quantity > 3")
    assert S.settled(df, 0) == (df, False)
    grown = df.selectExpr("explode(sequence(1, 5)) AS i")
    assert S.heavy(grown) and S.settled(grown)[0] is not grown


def test_keys_are_dealt_by_counted_rows(spark, tmp_path, monkeypatch):
    from cohortspark.functions import storage as S
    from cohortspark.plans.registry import REGISTRY

    rows = [(i % 700 if i % 13 else None, i % 9 if i % 17 else None, i % 3, "ANR"[i % 3], 100.0 + i, float(i % 50), 0.01 * (i % 7), 0.02) for i in range(500)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_extendedprice double, l_quantity double, "
                                "l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    small = REGISTRY["key_index"].run(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" not in small._jdf.queryExecution().toString()
    monkeypatch.setattr(S, "TASK_ROWS", 20)
    large = REGISTRY["key_index"].run(spark, str(tmp_path))
    # both groupings and the comparison go to 500 / 20 parts, which are not merged by their shuffled size
    assert re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", large._jdf.queryExecution().executedPlan().toString()) == ["25"] * 3
    got = [tuple(r) for r in large.collect()]
    want = {(p if p is None else p % 300, s) for p, s, *_ in rows} | {(p, s) for p, s, *_ in rows}
    assert len(got) == len(want) and set(got) == want == {tuple(r) for r in small.collect()}
