"""Size checks and reliable lineage cuts.

Nothing here keeps data on a machine that may be lost: intermediate tables are
written below the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Measured bytes that one task may be asked to hold.
TASK_BYTES = 64 * 1024 * 1024
#: Rows that a task groups at most where most of their keys differ.
TASK_ROWS = 1_000_000
#: Bytes of one Arrow batch where Python makes several times as much of it.
BATCH_BYTES = 8 * 1024 * 1024


def _reached(spark: SparkSession, folder: str) -> bool:
    """Whether the driver finds every row that the executors write below ``folder``."""
    path, n = f"{folder}/probe/{uuid.uuid4().hex}", max(1, spark.sparkContext.defaultParallelism)
    rows = spark.range(0, n, 1, n)
    rows.write.parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).count()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return found == n


#: Folders that were tried, by application.
_TRIED: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which executors share; without one, a private folder of a local session or the warehouse of a cluster.

    A path without a scheme is one of the default file system, as everywhere in Spark. Whether a folder is shared does not
    show in its name, so on a cluster a small table is written there and read back, once for an application.
    """
    context = spark.sparkContext
    local = context.master.startswith("local")
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and local:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortspark-"))
        named = context.getCheckpointDir()
    named = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/cohortspark"
    tried = (context.applicationId, named)
    if not local and tried not in _TRIED:
        if not _reached(spark, named):
            raise RuntimeError(f"rows that executors write below {named!r} are lost; name a folder that all reach in spark.checkpoint.dir")
        _TRIED.add(tried)
    return named


_SCOPES: list[list[str]] = []


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that the block writes between its steps go when it ends; write its results before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage. See ``run_scope`` for removal."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of a left and a right row, where the full grid is the asked-for result.

    An equality join on two salts: left rows are repeated once per salt of the right side, of which there are no more than it
    has rows, and right rows once per part of the left side, so that together they make about four tasks a partition. No row
    is repeated more often than its pairs ask for, and neither side is gathered.
    """
    most = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = reusable(right)
    salts = max(1, min(most, right.limit(most).count()))
    parts = -(-most // salts)

    def number(df: DataFrame, count: int) -> Column:
        return F.pmod(F.xxhash64(*df.columns), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    spread = left.withColumns({"__part": number(left, parts), "__salt": every(salts)})
    salted = right.withColumns({"__salt": number(right, salts), "__part": every(parts)})
    return spread.join(salted, ["__salt", "__part"]).drop("__salt", "__part")


def heavy(df: DataFrame) -> bool:
    """Whether ``df`` is more than a scan with projections and filters."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = ("Aggregate", "Join", "Window", "Repartition", "Generate", "Expand", "MapInPandas", "MapInArrow", "FlatMapGroupsIn")
    return any(step in plan for step in steps)


def parts_for(df: DataFrame) -> int | None:
    """In how many parts the rows of ``df`` are to be grouped, counted; None where one task may hold them all."""
    rows = df.count()
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)) if rows > TASK_ROWS else None


def dealt(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """``df`` in ``parts`` parts by key. Keys that hardly repeat take several times their shuffled size in a task's memory, by
    which Spark merges small partitions; a given number of parts stays."""
    return df.repartition(parts, *keys) if parts else df


def row_width(df: DataFrame) -> Column:
    """Bytes of a row once decoded: a slot of 16 for each column, and what strings, binaries and nested values hold."""
    width = F.lit(16 * max(1, len(df.columns)))
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 2
    return width.cast("bigint")


def measured_bytes(df: DataFrame) -> int:
    """Decoded size of all rows, summed by one job."""
    return df.select(row_width(df).alias("w")).agg(F.sum("w")).first()[0] or 0


def fits_task(df: DataFrame, limit: int | None = None) -> bool:
    """Whether one task may hold all rows: row count times row width, both measured."""
    allowed = TASK_BYTES if limit is None else limit
    return allowed > 0 and measured_bytes(df) <= allowed


def settled(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` and whether it fits one task.

    A plan that is more than a scan is written once, so that it is not worked out again for its size and its use.
    """
    if limit == 0 and not heavy(df):
        return df, False
    written = materialize(df) if heavy(df) else df
    return written, fits_task(written, limit)


def reusable(df: DataFrame) -> DataFrame:
    """Write ``df`` once where several branches would otherwise repeat a shuffle."""
    return materialize(df) if heavy(df) else df
