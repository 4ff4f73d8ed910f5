"""Cutting lineage, for loops and for results that several steps read."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

_LOCAL: list[str] = []


def shared_root(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session on one
    machine gets a temporary one; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="strandline-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        root = f"file://{_LOCAL[0]}"
    return root


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to tasks by keys before its rows are taken apart: aggregates by those keys and
    more shuffle nothing again, a small file is no single task, and what a column was made of
    is worked out once. The number is given, since whole rows are far smaller than their parts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder: a lost executor costs nothing
    that was computed before."""
    context = df.sparkSession.sparkContext
    root = shared_root(df)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return df.checkpoint()
