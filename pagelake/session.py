"""Session helpers: a local session for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int = 8, app: str = "pagelake", memory: str = "8g", **more: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory)
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", **more}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset, as in a local
    test, a folder of this process is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = os.path.join(tempfile.gettempdir(), f"pagelake-checkpoint-{os.getpid()}")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_pagelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pagelake-")
    with zipfile.ZipFile(os.path.join(folder, "pagelake.zip"), "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(os.path.join(folder, "pagelake.zip"))
    sc._pagelake_shipped = True
