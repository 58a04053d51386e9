"""Session settings, the shared folder, and lineage cuts.

Everything that has to outlive a task (checkpoints, intermediate tables) goes
to the folder the cluster names in ``spark.checkpoint.dir``.  A folder of our
own is only made for local sessions, i.e. in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "rollcall", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ROLLCALL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach; also makes sure checkpoints work."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="rollcall-")
        context.setCheckpointDir(named)
    return named or os.path.dirname(context.getCheckpointDir().rstrip("/"))


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table.

    All tables of an application lie in one sub-folder of the shared folder, so
    whoever owns the cluster can drop it when the application has ended.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/rollcall-{spark.sparkContext.applicationId}"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def settle_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Compute once into the shared folder; returns the written table and its row count.

    The lineage ends at the written files, so a lost executor costs a re-read and
    not a recomputation, and the planner sees the real size.
    """
    seen = Observation()
    path = new_path(df.sparkSession, "table")
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get["n"])


def settle(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder and go on from the written table."""
    return settle_counted(df)[0]


def drop_tables(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder, once its results have been read."""
    folder = new_path(spark, "x").rsplit("/", 1)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
