"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder under ``spark.checkpoint.dir``.

    Where that is unset, it is a temporary folder of this machine in local mode, and an error on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="kerf-files-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
