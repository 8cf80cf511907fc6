"""Writers. Every one is a partitioned Spark write; ``_SUCCESS`` marks completeness."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

from ..operators.expression import split_by_list
from ..streaming.incremental import ordered_hash


def replace_partitions(df: DataFrame, keys: Sequence[str]) -> DataFrameWriter:
    """Writer that replaces only the partitions that ``df`` has; finished ones of earlier runs stay."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)


def write_wide(df: DataFrame, path: str, donors: Sequence, *, index: Sequence[str] = ("gene", "chrom", "tss"),
               partition: str = "cell_type", drop_empty: bool = True) -> None:
    """Gene-by-donor CSV tables, one folder per cell type."""
    source = df
    if drop_empty:
        live = df.groupBy(partition, *index).agg(F.count("value").alias("__n")).filter("__n > 0").drop("__n")
        source = df.join(live, [partition, *index], "left_semi")
    wide = source.groupBy(partition, *index).pivot("donor", list(donors)).agg(F.first("value"))
    replace_partitions(wide, [partition]).option("header", True).csv(path)


def write_targets(df: DataFrame, path: str, *, keys: Sequence[str] = ("cell_type", "gene")) -> None:
    """Long target table; duplicated genes are averaged, genes and cell types without values dropped."""
    means = df.groupBy(*keys).agg(F.avg("value").alias("value")).filter("value is not null")
    replace_partitions(means, ["cell_type"]).parquet(path)


def write_population(sums: DataFrame, groups: DataFrame, path: str) -> None:
    """Counts per cell for each (donor, cell type); a group without cells is an error."""
    n = F.when(F.col("n_cells") > 0, F.col("n_cells")).otherwise(F.raise_error(F.lit("group without cells")).cast("bigint"))
    per_cell = sums.join(groups, ["donor", "cell_type"]).select(
        "donor", "cell_type", "gene", (F.col("sum_count") / n).alias("value"), "n_cells")
    replace_partitions(per_cell, ["cell_type"]).parquet(path)


COVARIANCE_TABLES = ("pairs", "snps", "meta")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """(number, version, value) of all finished writes, or None before the first."""
    try:
        return spark.read.schema("number bigint, version string, value string").parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def live_versions(commits: DataFrame) -> DataFrame:
    """(value, version): the newest finished write of every partition value."""
    newest = F.max(F.struct("number", "version"))
    return commits.groupBy("value").agg(newest.alias("n")).select("value", F.col("n.version").alias("version"))


def write_covariance(pairs: DataFrame, snps: DataFrame, path: str, *, partition: str | None = None, order: Sequence[str] = ("snp",),
                     **info) -> str:
    """Pairs, SNP sidecar and meta table (content hash, SNP count and ``info``) as one version; returns its name.

    All tables go to folders of a new version, and one commit record, written last, makes them count: a reader
    (:func:`read_covariance`) sees the earlier set or the new one, whole. With ``partition`` each of its values has its own
    newest version. The hash depends on the order of a gene's SNPs, which ``order`` gives.
    """
    spark, version = pairs.sparkSession, uuid.uuid4().hex
    keys = [partition] if partition else []
    meta = ordered_hash(snps, ["gene"], order, ["snp"], keys).withColumnsRenamed({"n_rows": "n_snps"})
    meta = meta.select("*", *[F.lit(v).alias(k) for k, v in info.items()])
    for name, table in zip(COVARIANCE_TABLES, (pairs, snps, meta)):
        table.write.partitionBy(*keys).parquet(f"{path}/{name}/version={version}")
    done = _commits(spark, path)
    number = 1 if done is None else (done.agg(F.max("number")).first()[0] or 0) + 1
    value = F.col(partition).cast("string") if partition else F.lit("")
    written = spark.read.parquet(f"{path}/meta/version={version}").select(
        F.lit(number).cast("bigint").alias("number"), F.lit(version).alias("version"), value.alias("value"))
    # One row a partition value, in one file, so that the record appears as a whole.
    written.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def read_covariance(spark: SparkSession, path: str, name: str, *, partition: str | None = None) -> DataFrame:
    """One of COVARIANCE_TABLES as its newest finished versions hold it; an error before the first finished write."""
    commits = _commits(spark, path)
    if commits is None:
        raise ValueError(f"no finished covariance in {path}")
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    value = F.col(partition).cast("string") if partition else F.lit("")
    live = live_versions(commits).withColumnsRenamed({"value": "__value", "version": "__version"})
    return rows.join(live, (F.col("version") == F.col("__version")) & (value == F.col("__value"))).drop("version", "__version", "__value")


def remove_old_versions(spark: SparkSession, path: str) -> list[str]:
    """Delete versions that finished and have been replaced for all their values; returns their names.

    A version without a commit record is left alone: its write may be running. Run it when no reader holds an older set.
    """
    commits = _commits(spark, path)
    if commits is None:
        return []
    old = commits.select("version").distinct().join(live_versions(commits), "version", "left_anti").collect()
    for name in COVARIANCE_TABLES:
        for row in old:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/version={row.version}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return sorted(r.version for r in old)


def write_results(df: DataFrame, path: str, *, keys: Sequence[str] = ("cell_type", "arm")) -> None:
    replace_partitions(df, keys).parquet(path)


def overview(results: DataFrame) -> DataFrame:
    """Hits per cell type and arm, most first."""
    return results.groupBy("cell_type", "arm").agg(
        F.count_if("significant_fdr").alias("n_significant_fdr"), F.count(F.lit(1)).alias("n_genes")).orderBy(
        F.col("n_significant_fdr").desc(), "cell_type", "arm")


def write_split(df: DataFrame, test_donors: DataFrame, path: str) -> DataFrame:
    """Train and test rows; returns the listed donors that are missing."""
    train, test, missing = split_by_list(df, test_donors)
    train.write.mode("overwrite").parquet(f"{path}/train")
    test.write.mode("overwrite").parquet(f"{path}/test")
    return missing


def write_top(df: DataFrame, path: str, order, n: int) -> None:
    """Ranked top rows as TSV; the row limit is the report."""
    df.orderBy(*order).limit(n).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_predictions(scores: DataFrame, path: str, samples: Sequence, *, partition: str = "cell_type") -> None:
    """Gene by sample prediction matrix per cell type."""
    wide = scores.groupBy(partition, "gene").pivot("donor", list(samples)).agg(F.first("value"))
    replace_partitions(wide, [partition]).option("header", True).csv(path)


DONOR_BUCKETS = 256


def written_donors(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of finished batches, or None before the first."""
    try:
        done = spark.read.parquet(f"{path}/done").select("batch").distinct()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return spark.read.parquet(f"{path}/rows").join(done, "batch", "left_semi").drop("bucket")


def write_new_donors(features: DataFrame, path: str) -> DataFrame:
    """Write feature rows of donors not finished before; returns those rows.

    Rows go to a batch of their own, split into hash buckets of donors; the batch's list of donors comes after them. Rows
    of a lost job are in no finished batch, so they neither count as done nor are read.
    """
    spark, batch = features.sparkSession, uuid.uuid4().hex
    before = written_donors(spark, path)
    kind = dict(features.dtypes)["donor"]
    fresh = features if before is None else features.join(
        before.select(F.col("donor").cast(kind).alias("donor")).distinct(), "donor", "left_anti")
    bucket = F.pmod(F.xxhash64("donor"), F.lit(DONOR_BUCKETS)).cast("int")
    fresh.withColumns({"batch": F.lit(batch), "bucket": bucket}).write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("batch") == batch).drop("batch", "bucket")
    rows.select("donor").distinct().withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/done")
    return rows.select(*features.columns)
