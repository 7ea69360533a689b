"""Session set-up shared by the bench, the tests and interactive use."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What every query of this library assumes; anything else is left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "tsengine", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """The frame without its lineage, by a checkpoint in the folder that spark.checkpoint.dir names (a temporary one for a local session without it)."""
    context = df.sparkSession.sparkContext
    found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: a checkpoint needs a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tsengine-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return df.checkpoint()
