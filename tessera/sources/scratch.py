"""Where intermediate tables go: the shared folder that the cluster names, a temporary one only where none is named."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import EngineError


def scratch(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir is not set; it must be a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
