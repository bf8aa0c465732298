"""Checkpoints in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names. Where it names none, one under /tmp in local mode, else an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file:///tmp/morsefield-checkpoints")
    return df.checkpoint()
