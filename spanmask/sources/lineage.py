"""Cutting of lineage with files that survive the loss of executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all nodes share, named by the cluster in spark.checkpoint.dir or set on the context.

    In local mode, on one machine, a temporary folder that goes with the process serves if neither is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    return _own()


@cache
def _own() -> str:
    folder = tempfile.mkdtemp(prefix="spanmask-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` as read back from a reliable checkpoint in the shared folder, so that it's computed once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
