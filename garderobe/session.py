"""Session defaults and the lineage cut shared by the iterative operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "garderobe", master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once, so that functions that run there find it wherever the driver started."""
    context = spark.sparkContext
    home = os.path.dirname(os.path.abspath(__file__))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(context, "_garderobe_shipped", False) or os.path.dirname(home) in known:  # workers take over PYTHONPATH
        return
    context._garderobe_shipped = True
    archive = os.path.join(tempfile.mkdtemp(prefix="garderobe-code-"), "garderobe.zip")  # addPyFile copies it to every node
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``. Only a local master, where driver and
    tasks share one disk, may go without: it gets a scratch folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="garderobe-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the checkpoint folder: survives executor loss, unlike a cache."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, as Parquet in the same folder: for tables with a row per combination, where the same garments
    come again and again and each stage reads a few columns, and for small tables whose size joins should know."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
