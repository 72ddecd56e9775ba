"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The session's checkpoint folder.

    It is what ``spark.checkpoint.dir`` names. Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="copyfold-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there.

    Shuffle files and checkpoints of frames that are gone are deleted when the driver collects its garbage, which a driver with little to do
    hardly ever does, so it is asked to.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession._jvm.System.gc()
    return out


def row_count(df: DataFrame) -> int:
    """Rows of ``df``, counted task by task, without a shuffle."""
    return df._jdf.queryExecution().toRdd().count()


def compacted(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``df`` written as by checkpointed and read in no more parts than one for each ``rows`` rows; and how many rows it has.

    What is left of a table in many parts can be little; then the steps that follow need few tasks and files.
    """
    out = checkpointed(df)
    n = row_count(out)
    return out.coalesce(max(1, -(-n // rows))), n
