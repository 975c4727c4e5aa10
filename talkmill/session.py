"""Sessions: one for local work, and shipping this package's code to a cluster's executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Rows and bytes of an Arrow batch: what a Python worker holds at once, however long the texts are.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application, so that none needs it installed; sets ARROW."""
    context = spark.sparkContext
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "talkmill_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder that the session names. Where none is named, a local session gets a temporary one;
    a cluster's machines share no folder that it doesn't name, so there the call raises."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.mkdtemp()}/{uuid.uuid4().hex}")
    return df.checkpoint()


def local(cpus: int = 8, memory: str = "12g", name: str = "talkmill") -> SparkSession:
    """A session on this machine, with as many shuffle partitions as threads."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
