"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Rows of an Arrow batch, and its bytes (or one row): texts can be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Arrow batches are kept short from here on."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Only a local master may leave that unset: then it is a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodestack-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
