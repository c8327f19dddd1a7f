"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "weftgraph", **conf: str) -> SparkSession:
    """A session with the library's defaults; settings that are passed, or that the cluster has, win."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder that checkpoint() writes to: the cluster's spark.checkpoint.dir.

    Only where neither it nor a context folder is set, as in tests on one
    machine, a temporary one is used; a cluster must name a shared folder.
    """
    context = spark.sparkContext
    have = context.getCheckpointDir()
    if have:
        return have
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftgraph-")
    context.setCheckpointDir(named)
    return named
