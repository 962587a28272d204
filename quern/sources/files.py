"""Paths to tables: splitting ``file:object``, expanding globs, braces, mappings and lists, and reading files as entries.

A table of files keeps two hidden columns: the file's number and the row's number in it, both free of a shuffle
(``_metadata`` of the scan).  A row's global entry is its file's offset and its row number; offsets come from one
metadata-only count per file.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path, PurePath
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, ROW = "_file_path", "_row_index"
#: More files than this are joined to their offsets rather than spelled out in an expression.
INLINE_FILES = 64


def split_object(path: str) -> tuple[str, str | None]:
    """``file:object`` at its last colon, unless that belongs to a URL, a port or a drive; ``//`` in the object collapses."""
    if "::" in path:
        head, _, tail = path.rpartition("::")
        file, obj = split_object(tail)
        return f"{head}::{file}", obj
    at = path.rfind(":")
    if at <= 0 or path[at : at + 3] == "://" or at == 1 and path[0].isalpha() and path[2:3] in ("\\", "/"):
        return path, None
    scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path)
    if scheme and "/" not in path[scheme.end() : at] or scheme and re.match(r":\d+(/|$)", path[at:]):
        return path, None
    return path[:at], re.sub("/+", "/", path[at + 1 :].strip("/")) or None


def expand_braces(path: str) -> list[str]:
    """``a{b,c}d`` as ``abd`` and ``acd``, to any nesting."""
    depth, start = 0, -1
    for i, c in enumerate(path):
        if c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                inner, parts, level, last = path[start + 1 : i], [], 0, 0
                for k, x in enumerate(inner):
                    level += (x == "{") - (x == "}")
                    if x == "," and not level:
                        parts.append(inner[last:k])
                        last = k + 1
                parts.append(inner[last:])
                if len(parts) > 1:
                    return [y for p in parts for y in expand_braces(path[:start] + p + path[i + 1 :])]
    return [path]


def hadoop_path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) on the JVM, for any scheme that Spark reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """Files and table folders that a path with globs stands for, in order; without globs the path itself."""
    if pattern.startswith("~"):
        pattern = str(Path(pattern).expanduser())
    out: list[str] = []
    for one in expand_braces(pattern):
        if not any(c in one for c in "*?["):
            out.append(one)
            continue
        fs, path = hadoop_path(spark, one)
        found = fs.globStatus(path)
        out += sorted(str(s.getPath().toString()) for s in found or [])
    return list(dict.fromkeys(out))


def regularize(spark: SparkSession, files: Any, steps_allowed: bool = False) -> list[tuple[str | DataFrame, str | None, Any]]:
    """(path or frame, object, steps) for a path, a mapping of path to object, or an iterable of such."""
    if isinstance(files, DataFrame):
        return [(files, None, None)]
    if isinstance(files, (str, PurePath)):
        path, obj = split_object(str(files)) if isinstance(files, str) else (str(files), None)
        return [(p, obj, None) for p in expand(spark, path)]
    if isinstance(files, Mapping):
        out = []
        for key, value in files.items():
            steps = None
            if isinstance(value, Mapping):
                if not steps_allowed and "steps" in value:
                    raise TypeError("steps are for partitioned reading only")
                value, steps = value.get("object_path"), value.get("steps")
            out += [(p, value, steps) for p in expand(spark, str(key))]
        return out
    if isinstance(files, Iterable):
        return [x for f in files for x in regularize(spark, f, steps_allowed)]
    raise TypeError(f"files are a path, a mapping, a frame or an iterable of these, not {type(files).__name__}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = hadoop_path(spark, path)
    return bool(fs.exists(jpath))


def part_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a file or a table folder, in order."""
    fs, jpath = hadoop_path(spark, path)
    status = fs.getFileStatus(jpath)
    if not status.isDirectory():
        return [str(status.getPath().toString())]
    found = [str(s.getPath().toString()) for s in fs.listStatus(jpath)]
    return sorted(p for p in found if not fnmatch.fnmatch(p.rpartition("/")[2], "[._]*"))


def part_files_present(spark: SparkSession, path: str) -> bool:
    """True if a folder holds data files itself (a table), not only folders (a namespace)."""
    fs, jpath = hadoop_path(spark, path)
    return any(s.isFile() and not fnmatch.fnmatch(str(s.getPath().getName()), "[._]*") for s in fs.listStatus(jpath))


@dataclass(frozen=True)
class Chunk:
    name: str
    compressed: int
    uncompressed: int


@dataclass(frozen=True)
class Group:
    rows: int
    chunks: list[Chunk]


@dataclass(frozen=True)
class Footer:
    """One Parquet file: its URI as the scan's ``_metadata.file_path`` has it, top-level columns and row groups."""

    file: str
    names: list[str]
    groups: list[Group]

    @property
    def rows(self) -> int:
        return sum(g.rows for g in self.groups)


#: Schemes whose footers executors can read by themselves.
ARROW_SCHEMES = ("file", "hdfs", "s3", "gs")


def _jvm_footer(spark: SparkSession, path: str) -> Footer:
    """A footer by Hadoop's file systems: any scheme that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, where = hadoop_path(spark, path)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    try:
        meta = reader.getFooter()
        names = [f.getName() for f in meta.getFileMetaData().getSchema().getFields()]
        groups = [Group(b.getRowCount(), [Chunk(c.getPath().toArray()[0], c.getTotalSize(), c.getTotalUncompressedSize()) for c in b.getColumns()]) for b in meta.getBlocks()]
    finally:
        reader.close()
    return Footer(str(fs.makeQualified(where).toUri().toString()), names, groups)


def footers(spark: SparkSession, paths: list[str]) -> list[Footer]:
    """The files' footers in order: by a Spark job over the paths where there are many, else by a few driver threads."""
    uris = [str(fs.makeQualified(p).toUri().toString()) for fs, p in (hadoop_path(spark, path) for path in paths)]
    if len(paths) <= INLINE_FILES or any(u.partition(":")[0] not in ARROW_SCHEMES for u in uris):
        with ThreadPoolExecutor(8) as pool:
            return list(pool.map(lambda p: _jvm_footer(spark, p), paths))

    def work(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                plain = unquote(uri)
                fs, path = (pafs.LocalFileSystem(), "/" + plain[5:].lstrip("/")) if plain.startswith("file:") else pafs.FileSystem.from_uri(uri)
                meta = pq.read_metadata(path, filesystem=fs)
                groups = [(g.num_rows, [(c.path_in_schema.split(".")[0], c.total_compressed_size, c.total_uncompressed_size) for c in map(g.column, range(g.num_columns))]) for g in map(meta.row_group, range(meta.num_row_groups))]
                out.append(json.dumps([uri, meta.schema.to_arrow_schema().names, groups]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["footer"])

    asked = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(min(len(uris), 4 * spark.sparkContext.defaultParallelism))
    said = [json.loads(r[0]) for r in asked.mapInArrow(work, "footer string").collect()]
    found = {f: Footer(f, names, [Group(n, [Chunk(*c) for c in chunks]) for n, chunks in groups]) for f, names, groups in said}
    return [found[u] for u in uris]


def read_entries(spark: SparkSession, path: str | list[str], schema=None, format: str = "parquet") -> DataFrame:
    """A file or table folder (or several) with its hidden position columns."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.load(path)
    return rows.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def file_counts(rows: DataFrame) -> list[tuple[str, int]]:
    """(file, rows) in order of names: one row per file reaches the driver, and only positions are read."""
    got = rows.groupBy(FILE).agg(F.count("*").alias("n")).collect()
    return sorted((r[FILE], r.n) for r in got)


def with_entries(rows: DataFrame, counts: list[tuple[str, int]], base: int = 0, name: str = "_entry") -> DataFrame:
    """Adds the global entry: the offset of a row's file and its number in it."""
    offset, at = [], base
    for path, n in counts:
        offset.append((path, at))
        at += n
    if len(offset) <= 1:
        return rows.withColumn(name, F.col(ROW) + F.lit(offset[0][1] if offset else base))
    if len(offset) <= INLINE_FILES:
        pick = F.create_map(*[F.lit(x) for pair in offset for x in pair])
        return rows.withColumn(name, F.element_at(pick, F.col(FILE)) + F.col(ROW))
    table = rows.sparkSession.createDataFrame(offset, f"{FILE} string, __offset long")
    return rows.join(F.broadcast(table), FILE).withColumn(name, F.col("__offset") + F.col(ROW)).drop("__offset")
