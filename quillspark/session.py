"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors unless PYTHONPATH already covers it."""
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))  # Spark serves it to every executor, later ones included
    if root not in sys.path:
        sys.path.insert(0, root)
    sc._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = getattr(spark.sparkContext, "_quillspark_dir", None)
        if where is None:
            where = spark.sparkContext._quillspark_dir = "file://" + tempfile.mkdtemp(prefix="quillspark-shared-")
    return where.rstrip("/")


def materialize(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    narrow: a small table, written as few files, a 32nd of the shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"
    if narrow:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 32))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep df's partitions on the executors' disks while a job uses them more than once. What a lost executor held is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all cores if a table comes in fewer partitions than there are; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
