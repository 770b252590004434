"""Makes this package importable in the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Arrow batches are bounded by bytes, not rows alone: texts differ in length by orders of magnitude.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application (the driver serves the archive)."""
    context = spark.sparkContext
    if not spark.conf.get(BATCH_BYTES, None) or int(spark.conf.get(BATCH_BYTES)) < 0 or int(spark.conf.get(BATCH_BYTES)) > BATCH_LIMIT:
        spark.conf.set(BATCH_BYTES, str(BATCH_LIMIT))
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(top):  # inside an archive there is nothing to send: it was sent before
            fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
            os.close(fd)
            with zipfile.ZipFile(path, "w") as z:
                for folder, _, names in os.walk(top):
                    for name in names:
                        if name.endswith(".py"):
                            full = os.path.join(folder, name)
                            z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
            context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
