"""Resumable batches, running statistics, content hashes and finished-work checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as X
from ..functions.ordered import row_numbers


# ---- running sufficient statistics ---------------------------------------------------------

def running_sums(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Sums from which a correlation follows; works on batch and streaming input alike.

    State is one row per key, so no watermark is needed.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    return df.groupBy(*keys).agg(
        F.count(a).alias("n"), F.sum(a).alias("sum_x"), F.sum(b).alias("sum_y"), F.sum(a * a).alias("sum_x2"),
        F.sum(b * b).alias("sum_y2"), F.sum(a * b).alias("sum_xy"))


def merge_sums(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sum_x", "sum_y", "sum_x2", "sum_y2", "sum_xy")])


def correlation_from_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.col("n")
    cov = F.col("sum_xy") - F.col("sum_x") * F.col("sum_y") / n
    vx = F.col("sum_x2") - F.col("sum_x") * F.col("sum_x") / n
    vy = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / n
    scale = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    r = F.try_divide(cov, F.when(scale > 1e-12, scale))
    return sums.select(*keys, "n", X.clip(r, -1.0, 1.0).alias("r"))


def stream_sums(spark: SparkSession, source: str, schema, keys: Sequence[str], x: str, y: str, *, output: str,
                checkpoint: str, bytes_per_batch: int = 4 << 30) -> StreamingQuery:
    """Consume every available file; each batch leaves the sums of the keys that it touches, and no others.

    A repeated batch replaces its own sums. :func:`compact_sums` folds them into a base from time to time, so what is
    written follows the keys touched; :func:`latest_sums` reads base and later batches.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source)

    def publish(batch: DataFrame, number: int) -> None:
        running_sums(batch, keys, x, y).write.mode("overwrite").parquet(f"{output}/deltas/batch={number}")
        compact_sums(spark, output, keys)

    return (stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _finished_bases(spark: SparkSession, output: str) -> list[int]:
    """Last batches of the bases that have a commit record, newest first."""
    commits = _table(spark, f"{output}/commits")
    return [] if commits is None else [r[0] for r in commits.select("upto").distinct().orderBy(F.col("upto").desc()).limit(2).collect()]


def _live(spark: SparkSession, output: str) -> tuple[DataFrame | None, DataFrame | None, list[int]]:
    """Newest finished base, the batches after it, and the last batches of the newest bases."""
    bases = _finished_bases(spark, output)
    base = spark.read.parquet(f"{output}/bases/upto={bases[0]}") if bases else None
    deltas = _table(spark, f"{output}/deltas")
    if deltas is not None and bases:
        deltas = deltas.filter(F.col("batch") > bases[0])
    return base, deltas, bases


def latest_sums(spark: SparkSession, output: str, keys: Sequence[str]) -> DataFrame:
    """Sums of all batches so far."""
    base, deltas, _ = _live(spark, output)
    if deltas is None:
        if base is None:
            raise ValueError(f"no sums in {output}")
        return base
    late = deltas.drop("batch")
    return merge_sums(late if base is None else base.unionByName(late), keys)


def compact_sums(spark: SparkSession, output: str, keys: Sequence[str], *, ratio: float = 1.0) -> bool:
    """Fold the batches into a new base once they hold as many rows as the base, times ``ratio``; whether it was done.

    Each row is then rewritten a number of times that grows with the logarithm of the total. A base counts by its commit
    record, written last. Batches and bases that the base before it had replaced are deleted; those that this one replaces
    stay until the next, for readers at work.
    """
    base, deltas, bases = _live(spark, output)
    if deltas is None:
        return False
    size = deltas.agg(F.count(F.lit(1)), F.max("batch")).first()
    if not size[0] or (base is not None and size[0] < ratio * base.count()):
        return False
    folded = deltas.drop("batch") if base is None else base.unionByName(deltas.drop("batch"))
    merge_sums(folded, keys).write.mode("overwrite").parquet(f"{output}/bases/upto={size[1]}")
    spark.range(1).select(F.lit(size[1]).cast("bigint").alias("upto")).coalesce(1).write.mode("append").parquet(f"{output}/commits")
    if bases:
        gone = [f"{output}/deltas/batch={r.batch}" for r in spark.read.parquet(f"{output}/deltas").filter(F.col("batch") <= bases[0]).select("batch").distinct().collect()]
        for path in [*gone, *(f"{output}/bases/upto={b}" for b in bases[1:])]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return True


# ---- resumable work ------------------------------------------------------------------------

def resume_batches(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], *, output: str,
                   checkpoint: str, bytes_per_batch: int = 4 << 30) -> StreamingQuery:
    """Process new input files once and keep every row; a repeated batch overwrites its own partition, so a restart adds
    nothing twice, and the result does not depend on how rows are split into files."""
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source)

    def publish(batch: DataFrame, number: int) -> None:
        (step(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(output))

    return (stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def unfinished(wanted: DataFrame, manifest: DataFrame, required: Sequence[str], *, key: str = "cell_type") -> DataFrame:
    """Work items without a completion marker or without one of the required tables.

    ``manifest(key, item)``; the marker is the item ``summary``.
    """
    needed = {"summary", *required}
    done = (manifest.filter(F.col("item").isin(*needed)).groupBy(key)
            .agg(F.count_distinct("item").alias("__n")).filter(F.col("__n") == len(needed)).select(key))
    return wanted.join(done, key, "left_anti")


# ---- content hashes ------------------------------------------------------------------------

def content_hash(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of a row set: count and summed slices of each row's SHA-256.

    A sum combines anywhere, so no list of rows is ever gathered. See :func:`ordered_hash` where order matters.
    """
    digest = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)

    def part(start: int):
        return F.sum(F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")

    parts = [F.hex(part(s).cast("string")) for s in (1, 13, 25, 37)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *parts), 256).alias("content_hash"))


def ordered_hash(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], keys: Sequence[str] = (), *,
                 limit: int | None = None) -> DataFrame:
    """Fingerprint of ordered lists: one per ``keys``, of the lists that ``group`` names, each in ``order``.

    A row's term takes in its place in its list, so the sum still combines anywhere, and two rows that trade places change it.
    """
    placed = row_numbers(df, [*keys, *group], list(order), rn="__place", limit=limit)
    return content_hash(placed, [*group, "__place", *columns], keys)


def consistent_metadata(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per field of two one-row tables, with whether they agree (nulls agree with nulls)."""
    def long(df, out):
        return df.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], list(fields), "field", out)

    return long(left, "left_value").join(long(right, "right_value"), "field").withColumn(
        "same", F.col("left_value").eqNullSafe(F.col("right_value")))


def require_same_hash(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` unchanged; an error when the two content hashes differ."""
    other = right.select("content_hash").scalar()
    return left.withColumn("content_hash", F.when(F.col("content_hash") == other, F.col("content_hash")).otherwise(
        F.raise_error(F.lit("model and covariance were built for different SNP sets"))))
