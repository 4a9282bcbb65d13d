"""Session helper and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the plans in this package rely on. All of them can be overridden by
# the cluster; none of them names a host or a path.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Column expressions otherwise record their Python call site, which takes
    # longer than planning when hundreds of them are built for a wide table.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "colprep", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> None:
    """Apply the package defaults to a session somebody else built, static ones excepted."""
    for key, value in DEFAULTS.items():
        if spark.conf.isModifiable(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables.

    On a cluster this is below ``spark.checkpoint.dir``, the shared folder the
    cluster names. Only a local master, where driver and executors share one
    disk, falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="colprep-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
