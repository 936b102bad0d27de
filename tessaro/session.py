"""Session settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, since no other machine would see it.
    """
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The result keeps the partitions and the order of rows within them, and survives the loss of
    executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Only its place is handed on; on a cluster whose machines don't have the package there, submit
    it with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
