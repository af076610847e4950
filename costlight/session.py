"""A session for the command line and the server."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session() -> SparkSession:
    builder = SparkSession.builder.appName("costlight").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: spark.checkpoint.dir, or for Spark in one process a folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="costlight-")
        atexit.register(shutil.rmtree, own, True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")
