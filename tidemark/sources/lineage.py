"""Steps of an iteration kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir``, so that a later step reads it instead of computing it again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()
