"""Session settings shared by the tests and the bench, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ebbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder of this machine serves a local master; on a cluster
    its absence is an error, as executors would write to disks of their own.
    """
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _fallback_folders:
            _fallback_folders[app] = tempfile.mkdtemp(prefix="ebbline-")
        named = _fallback_folders[app]
    return f"{named.rstrip('/')}/ebbline/{app}/{uuid.uuid4().hex}"
