import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import distributions as D, exprs as X, ordered as O, storage as S


def test_normal_tail_matches_erfc(spark):
    xs = [random.Random(1).uniform(-6, 37) for _ in range(500)] + [0.0, 0.3, -0.3, 5.656, 5.657, 38.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", D.norm_sf(F.col("x")).alias("s")).collect()
    for r in got:
        want = 0.5 * math.erfc(r.x / math.sqrt(2))
        assert abs(r.s - want) <= 1e-11 * want


def test_normal_tail_edges(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(D.norm_sf(F.col("x"))).collect()] == [0.0, 1.0, None]


def test_normal_quantile(spark):
    ps = [random.Random(2).random() for _ in range(500)] + [1e-300, 1e-20, 0.5]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", D.norm_ppf(F.col("p")).alias("q")).collect()
    assert max(abs(r.q - NormalDist().inv_cdf(r.p)) for r in got) < 1e-12
    ends = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(D.norm_ppf(F.col("p"))).collect()
    assert [r[0] for r in ends] == [None, None, None]


def test_t_tail(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 3.0), (1.0, 1.0), (None, 3.0)], "t double, n double")
    got = [r[0] for r in df.select(D.t_two_sided("t", "n")).collect()]
    assert got[0] == pytest.approx(0.0733880347707, rel=1e-9)
    assert got[1] == 1.0 and got[2] == pytest.approx(0.5, rel=1e-12) and got[3] is None


def test_acat_cases(spark):
    data = [("a", 0.0), ("a", 0.5), ("b", 1.0), ("b", 1.0), ("c", None), ("c", None), ("d", 0.3), ("e", 1e-20)]
    got = dict(spark.createDataFrame(data, "k string, p double").groupBy("k").agg(X.acat(F.col("p"))).collect())
    assert got["a"] == 0.0 and got["b"] == 1.0 and got["c"] is None
    assert got["d"] == pytest.approx(0.3, rel=1e-12) and got["e"] == pytest.approx(1e-20, rel=1e-9)


def test_acat_rejects_outside(spark):
    with pytest.raises(Exception, match="ACAT"):
        spark.createDataFrame([(1.5,)], "p double").agg(X.acat(F.col("p"))).collect()


def test_identifier_expressions(spark):
    df = spark.createDataFrame([("ensg01.7", "CD4 T-cell (Human)", "chrX", "a_12", "chr6:1,000-2,000", "gene_id \"E1.2\"; gene_name \"AB\";")],
                               "g string, l string, c string, d string, r string, t string")
    row = df.select(X.gene_key(F.col("g")).alias("g"), X.canonical_label(F.col("l")).alias("l"), X.chrom_key(F.col("c")).alias("c"),
                    X.prefixed_donor(F.col("d"), "P").alias("d"), X.parse_region(F.col("r")).alias("r"),
                    X.gtf_attribute(F.col("t"), "gene_name").alias("n"), X.chrom_order(F.col("c")).alias("o")).first()
    assert (row.g, row.l, row.c, row.d, row.n, row.o) == ("ENSG01", "cd4tcell", "X", "P_12", "AB", 99)
    assert tuple(row.r) == ("6", 1000, 2000)


def test_parse_list_keeps_zeros(spark):
    df = spark.createDataFrame([("10; 20;;100 ",)], "v string")
    assert df.select(X.parse_list(F.col("v"))).first()[0] == ["10", "20", "100"]


def test_bool_and_donor_errors(spark):
    df = spark.createDataFrame([("maybe",)], "v string")
    with pytest.raises(Exception, match="not a boolean"):
        df.select(X.parse_bool(F.col("v"))).collect()
    with pytest.raises(Exception, match="trailing number"):
        df.select(X.prefixed_donor(F.col("v"), "P")).collect()


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(X.safe_corr(F.col("x"), F.col("y"))).first()[0] is None


# ---- the sliced path gives what the single-task path gives ---------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds two thirds of the rows; a third of its values tie."""
    i = F.col("id")
    group = F.when(i % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), i % 17))
    value = F.when(i % 11 == 0, None).when(i % 3 == 1, 7.0).otherwise((F.xxhash64(i) % 400).cast("double"))
    return spark.range(6000).select(group.alias("k"), value.alias("v"), i.alias("id"))


@pytest.mark.parametrize("call", [
    lambda d, l: O.average_ranks(d, ["k"], "v", n="n", limit=l),
    lambda d, l: O.row_numbers(d.filter("v is not null"), ["k"], ["v", "id"], total="t", limit=l),
    lambda d, l: O.equal_count_bins(d.filter("v is not null"), ["k"], ["v", "id"], 7, limit=l),
    lambda d, l: O.quantiles(d, ["k"], "v", {"a": 0.13, "b": 0.5, "c": 1.0}, limit=l),
    lambda d, l: O.quantiles(d, [], "v", {"b": 0.5}, limit=l),
    lambda d, l: O.previous(d.filter("v is not null"), ["k"], ["v", "id"], {"before": "id"}, limit=l),
    lambda d, l: O.medians(d, ["k"], {"m": "v", "i": "id"}, limit=l).select("k", "m", F.col("i").cast("double")),
    lambda d, l: O.running(d.filter("v is not null"), ["k"], ["v", "id"], sums={"s": F.lit(1)}, suffix_mins={"m": F.col("id")},
                           prefix_maxs={"x": F.col("id")}, totals={"t": F.lit(1)}, limit=l),
])
def test_sliced_path_agrees(skewed, rows, call):
    assert rows(call(skewed, 0)) == rows(call(skewed, None))


def test_array_split_sizes(spark):
    df = spark.range(11).select(F.lit(1).alias("k"), "id")
    got = O.equal_count_bins(df, ["k"], ["id"], 4).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 2]


def test_average_percentiles(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 5.0), (1, None)], "k int, v double")
    got = sorted((r.rank / r.n if r.rank else 9) for r in O.average_ranks(df, ["k"], "v", n="n").collect())
    assert got == [0.25, 0.625, 0.625, 1.0, 9]


def test_sizes_are_measured(spark, tmp_path):
    label = F.lit("x" * 41)
    spark.range(2_000_000).select(label.alias("label"), "id").write.parquet(f"{tmp_path}/labels")
    packed = spark.read.parquet(f"{tmp_path}/labels")
    assert S.measured_bytes(packed) >= 41 * 2_000_000 and not S.fits_task(packed)
    wide = spark.range(200).select(F.repeat(F.lit("y"), 100_000).alias("text"), *[F.lit(i).alias(f"c{i}") for i in range(30)])
    assert S.measured_bytes(wide.select("text")) >= 20_000_000
    grown = spark.range(10).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("i"))
    assert S.measured_bytes(grown) >= 16 * 10_000
    nested = spark.range(10).select(F.array_repeat(F.lit("z" * 50), 1000).alias("a"))
    assert S.measured_bytes(nested) >= 10 * 50_000
    assert S.fits_task(spark.range(100)) and not S.fits_task(spark.range(100), limit=0)
    assert S.measured_bytes(spark.range(0)) == 0


def test_grid_has_no_limit(spark):
    many = spark.range(20_000).withColumnRenamed("id", "k")
    pairs = S.grid(spark.range(3), many)
    assert pairs.count() == 60_000 and pairs.distinct().count() == 60_000
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert S.grid(spark.range(3), many.limit(0)).count() == 0


def test_tables_of_a_run_go_with_it(spark):
    import os

    with S.run_scope(spark):
        path = S.materialize(spark.range(5)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_digit_runs_of_any_length_sort_as_numbers(spark):
    names = ["x1234567890124", "x1234567890123", "x9", "x10", "x0010", "x123456789012345"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", X.natural_key(F.col("n")))
    assert [r.n for r in df.orderBy("k", "n").collect()] == ["x9", "x0010", "x10", "x1234567890123", "x1234567890124", "x123456789012345"]
    assert df.select("k").distinct().count() == 5


@pytest.mark.parametrize("n_right", [0, 1, 3, 100])
def test_grid_repeats_rows_no_more_than_needed(spark, n_right):
    left, right = spark.range(50).withColumnRenamed("id", "a"), spark.range(n_right).withColumnRenamed("id", "b")
    pairs = S.grid(left, right)
    assert sorted(tuple(r) for r in pairs.collect()) == [(a, b) for a in range(50) for b in range(n_right)]
    plan = pairs._jdf.queryExecution().analyzed().toString()
    salts = max(1, min(32, n_right))
    assert f"sequence(0, {salts - 1}," in plan and f"sequence(0, {-(-32 // salts) - 1}," in plan


def test_folder_of_a_cluster_is_judged_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(S, "_TRIED", set())
    named = spark.conf.get("spark.checkpoint.dir")
    assert ":" not in named and S.shared_dir(spark) == named
    assert sorted(r.id for r in S.materialize(spark.range(20)).collect()) == list(range(20))
    monkeypatch.setattr(S, "_TRIED", set())
    monkeypatch.setattr(S, "_reached", lambda spark, folder: False)
    with pytest.raises(RuntimeError, match="are lost"):
        S.materialize(spark.range(20))


def test_folder_without_the_setting(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: str(tmp_path) if key == "spark.sql.warehouse.dir" else None)
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: made[-1] if made else None)
    monkeypatch.setattr(spark.sparkContext, "setCheckpointDir", made.append)
    private = S.shared_dir(spark)
    assert [private] == made == [S.shared_dir(spark)]
    made.clear()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert S.shared_dir(spark) == f"{tmp_path}/cohortspark"
