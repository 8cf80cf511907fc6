"""Ranks, running totals, exact quantiles and equal-count bins that survive a hot group.

A plain window puts a whole group into one task. That is fine while the input
is small, so each helper first asks the planner for the input size. Beyond the
limit rows are range-partitioned on (group, order), so that a group of any size
spreads over many tasks; each task works on its slice and only slice totals
(at most one row per slice for the groups that span slices) are carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .storage import materialize, settled

_PID, _ONE = "__slice", "__one"


def _slices(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
            sums: dict[str, Column] | None = None,
            suffix_mins: dict[str, Column] | None = None,
            prefix_maxs: dict[str, Column] | None = None,
            totals: dict[str, Column] | None = None,
            limit: int | None = None) -> DataFrame:
    """Add inclusive running sums, prefix maxima, suffix minima and group totals in ``order``.

    ``order`` must be unique inside a group. Columns are ascending; negate a
    number to run downwards.
    """
    keys, order = list(keys), list(order)
    sums, suffix_mins, totals = sums or {}, suffix_mins or {}, totals or {}
    prefix_maxs = prefix_maxs or {}
    df, fits = settled(df, limit)
    if fits:
        whole = W.partitionBy(*keys)
        up = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        down = whole.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
        out = {n: F.sum(c).over(up) for n, c in sums.items()}
        out.update({n: F.min(c).over(down) for n, c in suffix_mins.items()})
        out.update({n: F.max(c).over(up) for n, c in prefix_maxs.items()})
        out.update({n: F.sum(c).over(whole) for n, c in totals.items()})
        return df.select("*", *[c.alias(n) for n, c in out.items()])

    sliced = materialize(df.repartitionByRange(_slices(df), *keys, *order)
                         .withColumn(_PID, F.spark_partition_id()))
    per_slice = sliced.groupBy(*keys, _PID).agg(
        *[F.sum(c).alias(f"s_{n}") for n, c in sums.items()],
        *[F.min(c).alias(f"m_{n}") for n, c in suffix_mins.items()],
        *[F.max(c).alias(f"x_{n}") for n, c in prefix_maxs.items()],
        *[F.sum(c).alias(f"t_{n}") for n, c in totals.items()],
        F.count(F.lit(1)).alias("n_rows"))
    by_group = W.partitionBy(*keys)
    before = by_group.orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    after = by_group.orderBy(_PID).rowsBetween(1, W.unboundedFollowing)
    # A slice holds at most one group that began earlier and one that goes on,
    # so the groups kept here number at most two per slice.
    carried = (per_slice
               .withColumn("n_slices", F.count(F.lit(1)).over(by_group))
               .filter("n_slices > 1")
               .select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col(_PID).alias("k_slice"),
                       *[F.sum(f"s_{n}").over(before).alias(f"s_{n}") for n in sums],
                       *[F.min(f"m_{n}").over(after).alias(f"m_{n}") for n in suffix_mins],
                       *[F.max(f"x_{n}").over(before).alias(f"x_{n}") for n in prefix_maxs],
                       *[F.sum(f"t_{n}").over(by_group).alias(f"t_{n}") for n in totals]))
    on = F.col(_PID) == F.col("k_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    local = W.partitionBy(*keys, _PID)
    up = local.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    down = local.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    joined = sliced.join(F.broadcast(carried), on, "left")
    out = {n: F.sum(c).over(up) + F.coalesce(F.col(f"s_{n}"), F.lit(0)) for n, c in sums.items()}
    out.update({n: F.least(F.min(c).over(down), F.col(f"m_{n}")) for n, c in suffix_mins.items()})
    out.update({n: F.greatest(F.max(c).over(up), F.col(f"x_{n}")) for n, c in prefix_maxs.items()})
    out.update({n: F.coalesce(F.col(f"t_{n}"), F.sum(c).over(local)) for n, c in totals.items()})
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                rn: str = "rn", total: str | None = None, limit: int | None = None) -> DataFrame:
    """1-based position in ``order`` (unique per group) and, on request, the group size."""
    one = F.lit(1).cast("bigint")
    return running(df, keys, order, sums={rn: one},
                   totals={total: one} if total else None, limit=limit)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, *,
                 limit: int | None = None) -> DataFrame:
    """One row per (group, distinct value): ties, values up to and including it, group size.

    Ties collapse before any ordering, so a value shared by a third of all rows
    is one row from here on.
    """
    counted = (df.filter(F.col(value).isNotNull())
               .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_ties")))
    return running(counted, keys, [value], sums={"n_upto": F.col("n_ties")},
                   totals={"n_valid": F.col("n_ties")}, limit=limit)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, *, out: str = "rank",
                  n: str | None = None, limit: int | None = None) -> DataFrame:
    """Average rank of every row among its group's non-null values (null stays null)."""
    keys = list(keys)
    df, fits = settled(df, limit)
    if fits:
        part = W.partitionBy(*keys)
        tie = W.partitionBy(*keys, value)
        low = F.rank().over(part.orderBy(F.col(value).asc_nulls_last()))
        ranked = F.when(F.col(value).isNotNull(),
                        low + (F.count(value).over(tie) - 1) / 2.0)
        extra = [F.when(F.col(value).isNotNull(), F.count(value).over(part)).alias(n)] if n else []
        return df.select("*", ranked.alias(out), *extra)
    table = value_counts(df, keys, value, limit=limit).select(
        *[F.col(k).alias(f"v_{k}") for k in keys], F.col(value).alias("v_value"),
        (F.col("n_upto") - (F.col("n_ties") - 1) / 2.0).alias(out),
        *([F.col("n_valid").alias(n)] if n else []))
    on = F.col(value) == F.col("v_value")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"v_{k}"))
    return df.join(table, on, "left").select(*df.columns, out, *([n] if n else []))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *,
              limit: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group, one column per entry."""
    keys = list(keys)
    df, fits = settled(df, limit)
    if fits:
        return df.groupBy(*keys).agg(*[F.percentile(F.col(value), F.lit(p)).alias(n)
                                       for n, p in probs.items()])
    counted = value_counts(df, keys, value, limit=limit)
    start = F.col("n_upto") - F.col("n_ties")

    def at(index: Column) -> Column:
        return F.max(F.when((start <= index) & (index < F.col("n_upto")), F.col(value)))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("n_valid") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"lo_{name}"), at(F.ceil(pos)).alias(f"hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"w_{name}")]
    out = [(F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * F.col(f"w_{n}")).alias(n)
           for n in probs]
    return counted.groupBy(*keys).agg(*aggs).select(*keys, *out)


def equal_count_bins(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, *,
                     out: str = "bin", size: str = "n_valid", limit: int | None = None) -> DataFrame:
    """0-based bin of ``k`` nearly equal runs; earlier bins take the remainder."""
    ranked = row_numbers(df, keys, order, rn="__rn", total=size, limit=limit)
    base, extra = F.floor(F.col(size) / k), F.col(size) % k
    cut = extra * (base + 1)
    at = F.col("__rn") - 1
    bin_ = F.when(at < cut, F.floor(at / (base + 1))).otherwise(
        extra + F.floor(F.try_divide(at - cut, base)))
    return ranked.withColumn(out, bin_.cast("int")).drop("__rn")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key. A min over structs combines before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return chosen.select(*keys, "__row.*").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, *,
          rn: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark trims each map task to ``k`` before the shuffle."""
    ranked = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rn, ranked).filter(F.col(rn) <= k)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], *,
             limit: int | None = None) -> DataFrame:
    """Add the preceding row's values; ``columns`` maps new name -> source column.

    Beyond one task's size the neighbour is found by an equality join on
    (group, position), which spreads any group.
    """
    keys = list(keys)
    df, fits = settled(df, limit)
    if fits:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(n) for n, c in columns.items()])
    placed = materialize(row_numbers(df, keys, order, rn="__rn", limit=limit))
    before = placed.select(*[F.col(k).alias(f"p_{k}") for k in keys],
                           (F.col("__rn") + 1).alias("p_rn"),
                           *[F.col(c).alias(n) for n, c in columns.items()])
    on = F.col("__rn") == F.col("p_rn")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    return placed.join(before, on, "left").select(*df.columns, *columns)


def medians(df: DataFrame, keys: Sequence[str], columns: dict[str, str], *,
            limit: int | None = None) -> DataFrame:
    """Exact medians of several columns, one row per group."""
    keys = list(keys)
    df, fits = settled(df, limit)
    if fits:
        return df.groupBy(*keys).agg(*[F.median(c).alias(n) for n, c in columns.items()])
    stacked = df.unpivot(keys, list(dict.fromkeys(columns.values())), "__name", "__value")
    table = quantiles(stacked, [*keys, "__name"], "__value", {"m": 0.5}, limit=limit)
    return table.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == c, F.col("m"))).alias(n)
                                      for n, c in columns.items()])
