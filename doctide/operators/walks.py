"""Walks over a table of edges."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """df as a table in the folder that the cluster shares, without its lineage; then `spent`, earlier such tables, are deleted.

    A table survives the loss of executors.  What is not spent is deleted when the driver's process ends.
    """
    session = df.sparkSession
    context = session.sparkContext
    base = session.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = session.read.schema(df.schema).parquet(path)
    out.walk_path = path
    atexit.register(_delete, session, path)
    for old in spent:
        _delete(session, old.walk_path)
    return out


def _delete(session: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = session._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Every node (node) that a walk along edges (a, b) reaches from start (node), start included.

    The first round takes one step; each adds the nodes that the present stride leads to and doubles the stride, so a walk
    of any length takes its logarithm in rounds.  A round that adds nothing ends it: a shortest path longer than the rounds
    so far would have had a node there.
    """
    stride, seen = cut(edges.select("a", "b").distinct()), cut(start.select("node").distinct())
    n = seen.count()
    while True:
        ahead = seen.join(stride, F.col("node") == F.col("a")).select(F.col("b").alias("node"))
        seen = cut(seen.unionByName(ahead).distinct(), seen)
        if (now := seen.count()) == n:
            return seen
        n = now
        on = stride.select(F.col("a").alias("b"), F.col("b").alias("c"))
        stride = cut(stride.join(on, "b").select("a", F.col("c").alias("b")).distinct(), stride)
