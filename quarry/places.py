"""New folders for tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name that nothing else uses, below spark.checkpoint.dir; a temporary one only where the master is local and the setting is not made."""
    shared = spark.conf.get(KEY, "") or spark.sparkContext.getConf().get(KEY, "")
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quarry-tables-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
