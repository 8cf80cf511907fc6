"""Tables written to the shared folder, to cut lineage or to share work between branches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cohortspark.functions.storage import shared_dir


#: Bytes of one Arrow batch on its way to a Python worker; Spark's own limit is eight times that, for each of several buffers.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches are bounded by bytes, so that long texts do not add up in a task's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def stored(df: DataFrame) -> DataFrame:
    """Write `df` below the folder of spark.checkpoint.dir and read it back."""
    path = f"{shared_dir(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
