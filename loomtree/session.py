"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomtree")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # text is costly to process for its size: keep cores busy on small tables too
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", os.environ.get("LOOMTREE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python workers this package, once per Spark application, so that they can import it whatever
    their path. Nothing is done where the package itself came as a zip."""
    context, package = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_loomtree_shipped", False) or not package.is_dir():
        return spark
    archive = Path(tempfile.mkdtemp(prefix="loomtree-code-")) / "loomtree.zip"  # the driver serves it from here
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._loomtree_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *, spread: bool = False) -> DataFrame:
    """One table of a data directory. ``spread`` hands the rows of a scan with fewer tasks than cores out evenly, for
    tables of texts, which are small for the work they give; a larger table is read as it lies."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if spread and rows.rdd.getNumPartitions() < cores else rows
