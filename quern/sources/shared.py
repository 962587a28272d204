"""Tables in the folder that driver and executors share: the one the cluster names in ``spark.checkpoint.dir``.

Where that is unset, a local session (tests, a laptop) gets a temporary folder of this machine, set as its checkpoint
folder; any other master raises, as executors elsewhere would not see such a folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all machines of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    where = spark._jvm.org.apache.hadoop.fs.Path(base)  # a path without a scheme is the default file system's
    return str(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()).rstrip("/")


def new_folder(spark: SparkSession, name: str, below: str = "quern") -> str:
    """URI of a fresh folder below the shared one (made by whoever first writes to it)."""
    return f"{shared_dir(spark)}/{below}/{name}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, name: str) -> str:
    """Writes ``df`` as a Parquet table in the shared folder; returns where."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path
