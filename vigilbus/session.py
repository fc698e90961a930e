"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vigilbus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Small shuffles keep one task per core.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, wherever the session was started from.

    Spark serves the archive from the driver, so no shared folder is needed.
    """
    root = Path(__file__).resolve().parent
    if any(f.endswith(f"{root.name}.zip") for f in spark.sparkContext.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-modules-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineages: the cluster's setting, else a scratch folder in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="vigilbus-checkpoint-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and read it back, so a lost executor cannot change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
