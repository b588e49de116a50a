"""Small helpers on whole tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """The rows cut from their lineage by a reliable checkpoint in the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary one; a cluster has to
    name a folder that all its machines share.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by ``key``, which is unique or nearly, to as many tasks as a shuffle has.

    For long work on rows of a compact table: its file, or a row group of it, is one task
    otherwise, however many rows it holds.  The number of tasks is stated, as small
    partitions would be merged again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)
