"""Structured Streaming forms: file-at-a-time iteration, appending sinks, running histograms, windowed aggregation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.functions import numeric
from quern.operators.histogram import Axis, bin_columns
from quern.plans.language import Compiler
from quern.sources import files


def read(spark: SparkSession, path: str, schema: Any, files_per_batch: int = 1) -> DataFrame:
    """New files of a folder (or the one file), so many a micro-batch, each file once."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    fs, where = files.hadoop_path(spark, path)
    if fs.exists(where) and fs.getFileStatus(where).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def select(stream: DataFrame, expressions: Sequence[str], cut: str | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The query language over a stream: the same compiled columns as for tables."""
    compiler = Compiler(stream.schema, aliases or {})
    if cut is not None:
        test = compiler.compile(cut)
        stream = stream.where(numeric.truth(test.typed))
    return stream.select(*[compiler.compile(e).col.alias(e) for e in expressions])


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to a function; ends when all present files are done."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extend(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a table; the file log makes each batch count once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def histogram(stream: DataFrame, axes: Sequence[Axis], values: Sequence[Column], weight: Column | None = None) -> DataFrame:
    """Running cells of a histogram: state is bounded by the grid."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    binned = stream.select(*bin_columns(axes, values), w.alias("w"))
    return binned.groupBy(*binned.columns[:-1]).agg(F.count("*").alias("entries"), F.sum("w").alias("value"), F.sum(F.col("w") * F.col("w")).alias("variance"))


def cells_to(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's changed cells under its number; a batch that runs again overwrites its own."""
    write = lambda changed, number: changed.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return cells.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_cells(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The latest state of each cell of ``cells_to``."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    keys = [c for c in schema.names if c not in ("entries", "value", "variance")]
    values = F.struct(*[c for c in schema.names if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*")


def windowed(stream: DataFrame, time: str, width: str, by: Sequence[str], late: str, **aggregates: Column) -> DataFrame:
    """Aggregates per tumbling window and key; rows later than ``late`` are dropped, and finished windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*[c.alias(k) for k, c in aggregates.items()])
