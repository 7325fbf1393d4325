"""Brings this package to the Python workers, wherever the driver was started."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to what executors fetch from the driver; once for each application. Call it before a Python function is handed to Spark."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # this process has it from an archive that Spark sent already
        _SENT.add(context.applicationId)
        return
    found = sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".py"))
    digest = hashlib.sha256()
    for path in found:
        with open(path, "rb") as f:
            digest.update(path.encode() + f.read())
    # the driver serves this file to the executors; none of them opens the path
    archive = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), f"seqloom-{digest.hexdigest()[:16]}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in found:
            z.write(path, os.path.join("seqloom", os.path.relpath(path, top)))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)
