"""Session and shared storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "sparkmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling on; conf overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. Where that is unset, a folder of this process on a local master; on any other a RuntimeError, as a folder of one machine would be no shared one."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
        if d is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            d = "file://" + tempfile.mkdtemp(prefix="sparkmill-")
            sc.setCheckpointDir(d)
        return d
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df as it is read, so that tasks grow with the data; input of fewer parts than there are cores (a small or unsplittable file) is spread over them by its keys, for work that costs more than moving the rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n, *keys) if df.rdd.getNumPartitions() < n else df


_SHIPPED = "_sparkmill_shipped"


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per context; Spark's driver serves the archive to every executor, also to later ones."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkmill-code-"), "sparkmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("sparkmill", os.path.relpath(full, root)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)
