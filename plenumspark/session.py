"""Session helpers: tables of a folder, lineage cuts, and a local session for tests."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects of a cluster (UTC, AQE with skew handling)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plenumspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint.

    The folder is the cluster's `spark.checkpoint.dir`, shared by all executors. Only where that is
    unset (tests on one machine) a temporary folder is used, and only under a local master.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="plenumspark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it as the driver does.

    Workers of a local master have the driver's working folder and PYTHONPATH; any others get the package
    as an archive from the driver, once an application.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    places = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.master == "local" or context.master.startswith("local["):
        places.append(os.getcwd())
    if (context.master.startswith("local") and root in places) or context.applicationId in _shipped or not os.path.isdir(package):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="plenumspark-"), "plenumspark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """`df` on as many partitions as there are cores, where its files give fewer: for Python work on small inputs.

    Large inputs have more splits than that and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` hinted for broadcast if it has no more than `most_rows` rows, else unchanged (a shuffle join)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
