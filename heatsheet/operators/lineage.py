"""Reliable checkpoints for results that several outputs must agree on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _use_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="heatsheet-checkpoint-")
    context.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, in the checkpoint folder."""
    _use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so later reads all see the same rows.

    The columns are aliased, because a checkpoint keeps the identity of the columns it
    was made from and could not be joined to its own source.
    """
    _use_checkpoint_dir(df.sparkSession)
    written = df.checkpoint(eager=True)
    return written.select(*[F.col(c).alias(c) for c in written.columns])
