"""Cutting long lineages in a way that survives executor loss."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a local session without that setting (a
    bare test session) gets a folder of its own; on a cluster a missing folder is an error, as other machines could not
    read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="greenspark-checkpoint-"))
    return df.checkpoint(eager=True)
