"""Queries over many files: opening, counting, concatenating, iterating, and reading with tolerance for errors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.filters import KeyInTableError
from quern.operators.tree import DEFAULT_STEP, Report, Tree, bounds
from quern.sources import files
from quern.sources.catalog import Catalog


def open(spark: SparkSession, path: Any, **options: Any) -> Any:
    """A table, or a namespace, or what ``path:object`` names in one; a one-item mapping {path: object} does too."""
    if isinstance(path, DataFrame):
        return Tree(path, **options)
    if isinstance(path, Mapping):
        if len(path) != 1:
            raise ValueError("open takes one file")
        (path, obj), = path.items()
    else:
        path, obj = files.split_object(str(path))
    found = files.expand(spark, str(path))
    if not found or not files.exists(spark, found[0]):
        raise FileNotFoundError(str(path))
    where = found[0]
    fs, p = files.hadoop_path(spark, where)
    if fs.getFileStatus(p).isDirectory() and not files.part_files_present(spark, where):
        catalog = Catalog(spark, where)
        return catalog[obj] if obj else catalog
    tree = Tree.open(spark, where, **options)
    return tree[obj] if obj else tree


def trees(spark: SparkSession, sources: Any, allow_missing: bool = False, **options: Any) -> list[Tree | None]:
    """One tree per file, in order; with ``allow_missing`` a file without the table is None."""
    out: list[Tree | None] = []
    for path, obj, _ in files.regularize(spark, sources):
        if isinstance(path, DataFrame):
            out.append(Tree(path, **options))
            continue
        try:
            got = open(spark, {path: obj}, **options)
            out.append(got.only_table() if isinstance(got, Catalog) else got)
        except (FileNotFoundError, KeyInTableError, ValueError):
            if not allow_missing:
                raise
            out.append(None)
    return out


def together(spark: SparkSession, sources: Any, allow_missing: bool = False, **options: Any) -> list[Tree | None]:
    """``trees``, but many plain files of the same columns are one tree and so one scan, whatever their number."""
    wanted = files.regularize(spark, sources)
    plain = [p for p, obj, _ in wanted if isinstance(p, str) and obj is None]
    if allow_missing or len(plain) < len(wanted) or len(plain) <= files.INLINE_FILES or len(set(plain)) < len(plain):
        return trees(spark, sources, allow_missing, **options)
    if any(files.hadoop_path(spark, p)[0].getFileStatus(files.hadoop_path(spark, p)[1]).isDirectory() for p in plain):
        return trees(spark, sources, allow_missing, **options)
    return [Tree.open_many(spark, plain, **options)]


def num_entries(spark: SparkSession, sources: Any) -> Iterator[tuple[str, str | None, int]]:
    """(file, object, rows) of each file, from positions alone."""
    for path, obj, _ in files.regularize(spark, sources):
        got = open(spark, {path: obj})
        tree = got.only_table() if isinstance(got, Catalog) else got
        yield str(path), obj, tree.num_entries


def concatenate(spark: SparkSession, sources: Any, expressions: Any = None, cut: str | None = None, *, allow_missing: bool = False, entry_start: int | None = None, entry_stop: int | None = None, entry: bool = False, options: Mapping[str, Any] | None = None, **query: Any) -> DataFrame:
    """The bag union of one query over files; an entry range counts over all of them, and files outside it aren't read.

    ``entry`` adds global entry numbers; files left out by ``allow_missing`` still count in them if they have rows.
    """
    found = [t for t in together(spark, sources, allow_missing, **(options or {})) if t is not None]
    if not found:
        raise ValueError("no file has the table")
    ranged = entry_start is not None or entry_stop is not None
    total = sum(t.num_entries for t in found) if ranged or entry else 0
    a, b = bounds(entry_start, entry_stop, total)
    parts, at = [], 0
    for t in found:
        n = t.num_entries if ranged or entry else 0
        low, high = (max(a - at, 0), min(b - at, n)) if ranged else (None, None)
        if not ranged or low < high:
            try:
                got = t.arrays(expressions, cut, entry_start=low, entry_stop=high, entry=entry, **query)
                parts.append(got.withColumn("_entry", F.col("_entry") + F.lit(at)) if entry else got)
            except KeyInTableError:
                if not allow_missing:
                    raise
        at += n
    if not parts:
        return found[0].arrays(expressions, cut, entry=entry, **query).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def iterate(spark: SparkSession, sources: Any, expressions: Any = None, cut: str | None = None, *, step_size: int | str = DEFAULT_STEP, report: bool = False, allow_missing: bool = False, **query: Any) -> Iterator[Any]:
    """Batches of all files in order; a batch never spans files, and reports carry global entries."""
    at = 0
    for t in trees(spark, sources, allow_missing):
        if t is None:
            continue
        for out, r in t.iterate(expressions, cut, step_size=step_size, report=True, **query):
            yield (out, Report(r.entry_start, r.entry_stop, r.global_start + at, r.global_stop + at, r.file)) if report else out
        at += t.num_entries


def lazy(spark: SparkSession, sources: Any, *, open_files: bool = True, schema: Any = None, filter_name: Any = None, **filters: Any) -> DataFrame:
    """All files as one frame of the columns they share, in the first file's order; no common column is an error.

    With ``open_files=False`` only the first file (or a given schema) says which columns there are.
    """
    found = together(spark, sources)
    if schema is not None:
        return reduce(DataFrame.unionByName, [t.rows.select(*schema.names) for t in found])
    first = found[0].keys(recursive=False, filter_name=filter_name, **filters)
    if open_files:
        every = [set(t.keys(recursive=False, filter_name=filter_name, **filters)) for t in found]
        first = [c for c in first if all(c in e for e in every)]
    if not first:
        raise ValueError("the files share no column")
    return reduce(DataFrame.unionByName, [t.rows.select(*[F.col(f"`{c}`") for c in first]) for t in found])


def zero_of(kind: T.DataType) -> Any:
    """What a column that a file doesn't have yet reads as: zero, the empty string, the empty list, a struct of these."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[zero_of(f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit({"string": "", "boolean": False, "binary": b""}.get(kind.simpleString())).cast(kind)


def evolved(spark: SparkSession, sources: Any) -> DataFrame:
    """All files with the union of their columns; columns added in later files are zero in the earlier ones."""
    found = trees(spark, sources)
    kinds: dict[str, T.DataType] = {}
    for t in found:
        for f in t.schema.fields:
            kinds.setdefault(f.name, f.dataType)
    full = [t.rows.select(*[F.col(f"`{c}`") if c in t.schema.names else zero_of(k).alias(c) for c, k in kinds.items()]) for t in found]
    return reduce(DataFrame.unionByName, full)


def partitions(tree: Tree, step_size: int | str | None = None, steps_per_file: int = 1) -> list[tuple[str, int, int]]:
    """(file, start, stop) of a partitioned read: one step a file by default, or steps of about a size."""
    size = None
    if step_size is not None:
        size = tree.num_entries_for(step_size) if isinstance(step_size, str) else int(step_size)
    out = []
    for path, n in tree.counts:
        step = size or max(1, -(-n // steps_per_file))
        out += [(path, k, min(k + step, n)) for k in range(0, n, step)]
    return out


def read_with_report(spark: SparkSession, sources: Any, schema: Any, expressions: Any = None, errors: tuple[type[BaseException], ...] = (OSError, PySparkException, Py4JJavaError)) -> tuple[DataFrame, list[dict[str, Any]]]:
    """The union of the readable files, and a report on each: a file that fails becomes an empty part with its error's name.

    Each file is tried by itself on its footer and first rows, so a broken one is found before the query runs.
    """
    parts, report = [], []
    for path, obj, _ in files.regularize(spark, sources):
        row = {"file": str(path), "object": obj, "ok": True, "exception": None, "message": None}
        try:
            got = open(spark, {path: obj})
            tree = got.only_table() if isinstance(got, Catalog) else got
            tree.rows.limit(1).collect()
            parts.append(tree.arrays(expressions))
        except errors as e:
            said = str(e.java_exception.getMessage() or e.java_exception) if isinstance(e, Py4JJavaError) else str(e)
            row |= {"ok": False, "exception": type(e).__name__, "message": (said.splitlines() or [""])[0]}
        report.append(row)
    empty = spark.createDataFrame([], schema)
    return (reduce(DataFrame.unionByName, parts) if parts else empty), report

