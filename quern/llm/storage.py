"""Files and tables in the folder that driver and executors share (see ``quern.sources.shared``).

Binary files (token files, tar shards) are written with pyarrow's file systems, so ``file:``, ``hdfs:``, ``s3:`` and
``gs:`` folders work alike.  Every file gets a name of its own per task attempt; only names that a finished task has returned are ever read, so a lost
executor or a speculative attempt leaves at worst an orphan file, never a half-read one.
"""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import shared


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared one (made by whoever first writes to it)."""
    return shared.new_folder(spark, name, "quern-llm")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: cuts lineage and recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


#: Rows of whole texts in an Arrow batch at most.
BATCH_ROWS = 1024


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS``: JVM and workers each hold a batch of whole texts or two.

    Spark has this as a session setting only; a smaller one stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has: columns named with it meet none of the user's.

    (Rows packed in a struct would do as well, but for the optimizer's constraints, whose number doubles with each field
    that is taken out again.)
    """
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more (what is made from them must be stored itself)."""
    for df in tables:
        path = getattr(df, "_quern_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_PART = r"^part-(\d+)-(?:.*-c(\d+)\.)?"


def written_place(df: DataFrame) -> Column | None:
    """Each row's place in the order in which a table that ``df`` reads was written, partition after partition.

    Spark reads files longest first and short ones together, so partitions of a read don't keep that order; the part
    numbers in file names and the rows' numbers in the files do.  Places of a file are consecutive, those of files apart.
    None where ``df`` isn't a plain read of Parquet files with part numbers of their own: its partitions are its order.
    """
    try:
        rows = df.select("_metadata.row_index", "_metadata.file_name").agg(F.max("row_index")).first()[0]
    except AnalysisException:
        return None
    found = [re.match(_PART, f.rpartition("/")[2]) for f in df.inputFiles()]
    numbers = [(int(m[1]), int(m[2] or 0)) for m in found if m]
    if rows is None or len(numbers) < len(found) or len(set(numbers)) < len(numbers):
        return None
    number = lambda group: F.coalesce(F.regexp_extract("_metadata.file_name", _PART, group).try_cast("long"), F.lit(0))
    return (number(1) * (max(c for _, c in numbers) + 1) + number(2)) * (rows + 1) + F.col("_metadata.row_index")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow file system and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def attempt_path(folder: str, stem: str, suffix: str) -> str:
    """A file name that no other task attempt uses."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def write_file(uri: str, *parts) -> int:
    """Writes the parts one after another; returns the bytes written."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    n = 0
    with fs.open_output_stream(path) as out:
        for part in parts:
            view = memoryview(part).cast("B") if not isinstance(part, bytes) else part
            out.write(view)
            n += len(view)
    return n


def tasks_for(spark: SparkSession, pieces: int) -> int:
    """Partitions for a job over ``pieces`` files: one a file, up to 16 waves of the cluster's cores."""
    return max(1, min(pieces, 16 * max(2, spark.sparkContext.defaultParallelism)))
