"""Where intermediate tables and files go: a folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


_tidied: set[str] = set()


def root(spark: SparkSession) -> str:
    """This application's folder under the cluster's spark.checkpoint.dir; only in local mode, and where that is unset, a temporary one.

    It is removed when the driver's program ends, or by `clean` before.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.environ.get("TESSERA_LOCAL_CHECKPOINT")
        if not top:
            top = os.environ["TESSERA_LOCAL_CHECKPOINT"] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, top, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(top)
    if spark.sparkContext.applicationId not in _tidied:
        _tidied.add(spark.sparkContext.applicationId)
        atexit.register(_tidy, spark)
    return f"{top.rstrip('/')}/tessera/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, tag: str) -> str:
    """A folder name that nothing else uses."""
    return f"{root(spark)}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Removes this application's folder; call it once the results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _tidy(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        clean(spark)
