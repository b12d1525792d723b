"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sourceloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster submits its own settings.

    Adaptive execution stays on: it coalesces small shuffles, splits skewed join
    partitions and turns a join into a broadcast once the real size is known.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``.

    Only where a local session names none (tests) does a temporary folder stand in for
    it; on a cluster the setting is needed, as executors share no local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "sourceloom-scratch")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Materialise a small intermediate result on shared storage.

    A reliable checkpoint outlives lost executors, and what reads it later does not
    compute it again.
    """
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(rows.sparkSession, "checkpoint"))
    return rows.checkpoint(eager=True)
