"""A namespace of tables on any file system that Spark writes: nested directories, versions (cycles), sinks.

Layout: ``root/dir/.../name/cycle=N`` is one version of a table, with ``_quern.json`` beside its data for title and
class.  A name without a cycle means the newest, by absolute value.  Files are made, listed, renamed and deleted with the
file system that the path's scheme names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.filters import KeyInTableError, NameFilter, name_filter, renamer
from quern.operators import nested
from quern.operators.histogram import Axis, Histogram
from quern.operators.tree import Tree
from quern.sources import files

META = "_quern.json"
CODECS = {"zlib": "gzip", "zstd": "zstd", "lz4": "lz4", "lzma": "zstd", None: "uncompressed"}


def split_cycle(name: str) -> tuple[str, int | None]:
    """``name;3`` as (name, 3); without a number the cycle is None."""
    head, mark, tail = name.rpartition(";")
    return (head, int(tail)) if mark and tail.lstrip("-").isdigit() else (name, None)


class Catalog:
    """A directory of tables; writable unless opened otherwise."""

    def __init__(self, spark: SparkSession, root: str, compression: str | None = "zlib", writable: bool = True):
        self.spark, self.root, self.compression, self.writable = spark, root.rstrip("/"), compression, writable

    # ---- opening

    @classmethod
    def create(cls, spark: SparkSession, root: str, **options: Any) -> Catalog:
        """A new namespace; fails if the folder exists."""
        if files.exists(spark, root):
            raise FileExistsError(root)
        out = cls(spark, root, **options)
        out._fs(root)[0].mkdirs(out._fs(root)[1])
        return out

    @classmethod
    def recreate(cls, spark: SparkSession, root: str, **options: Any) -> Catalog:
        """A new namespace in the place of whatever was there."""
        fs, path = files.hadoop_path(spark, root)
        fs.delete(path, True)
        return cls.create(spark, root, **options)

    @classmethod
    def update_existing(cls, spark: SparkSession, root: str, **options: Any) -> Catalog:
        """An existing namespace, to be added to; nothing in it is changed in place."""
        if not files.exists(spark, root):
            raise FileNotFoundError(root)
        return cls(spark, root, **options)

    open = update_existing

    # ---- file system

    def _fs(self, path: str) -> tuple[Any, Any]:
        return files.hadoop_path(self.spark, path)

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
            return []
        return sorted(str(s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory())

    def _read_meta(self, path: str) -> dict[str, Any]:
        fs, p = self._fs(f"{path}/{META}")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_meta(self, path: str, meta: dict[str, Any]) -> None:
        fs, p = self._fs(f"{path}/{META}")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(meta).encode()))
        finally:
            stream.close()

    # ---- look-up

    def _cycles(self, name: str) -> list[int]:
        return sorted((int(c[6:]) for c in self._list(f"{self.root}/{name}") if c.startswith("cycle=")), key=abs)

    def _walk(self, recursive: bool, at: str = "") -> list[tuple[str, int | None]]:
        """(path, cycle) of tables, and (path, None) of directories."""
        out: list[tuple[str, int | None]] = []
        for name in self._list(f"{self.root}/{at}"):
            if name.startswith(("_", ".")):
                continue
            cycles = self._cycles(at + name)
            out += [(at + name, c) for c in reversed(cycles)]
            if not cycles:
                out.append((at + name, None))
                if recursive:
                    out += self._walk(True, f"{at}{name}/")
        return out

    def keys(self, recursive: bool = True, cycle: bool = True, filter_name: NameFilter = None, filter_classname: NameFilter = None) -> list[str]:
        """Names, with their cycles; filters look at the path without the cycle."""
        by_name, by_class = name_filter(filter_name), name_filter(filter_classname)
        out = [f"{p};{c if c is not None else 1}" if cycle else p for p, c in self._walk(recursive) if by_name(p) and by_class(self.classname_of(f"{p};{c}" if c is not None else p))]
        return list(dict.fromkeys(out))

    def classnames(self, **options: Any) -> dict[str, str]:
        return {k: self.classname_of(k) for k in self.keys(**options)}

    def values(self, **options: Any) -> list[Any]:
        return [self[k] for k in self.keys(**options)]

    def items(self, **options: Any) -> list[tuple[str, Any]]:
        return [(k, self[k]) for k in self.keys(**options)]

    def path_of(self, key: str) -> str:
        name, cycle = split_cycle(key.strip("/"))
        cycles = self._cycles(name)
        if not cycles and files.exists(self.spark, f"{self.root}/{name}") and cycle in (None, 1):
            return f"{self.root}/{name}"
        if not cycles or cycle is not None and cycle not in cycles:
            raise KeyInTableError(key, [p if c is None else f"{p};{c}" for p, c in self._walk(True)], "namespace")
        return f"{self.root}/{name}/cycle={cycles[-1] if cycle is None else cycle}"

    def __contains__(self, key: str) -> bool:
        try:
            self.path_of(key)
        except KeyError:
            return False
        return True

    def classname_of(self, key: str) -> str:
        path = self.path_of(key)
        return self._read_meta(path).get("class", "table") if "/cycle=" in path else "directory"

    def title_of(self, key: str) -> str:
        return self._read_meta(self.path_of(key)).get("title", "")

    def __getitem__(self, key: str) -> Any:
        """A table as a tree, a histogram, a string, a subdirectory; ``dir/table:column`` goes into a table."""
        head, mark, column = key.partition(":")
        path = self.path_of(head)
        if "/cycle=" not in path:
            return Catalog(self.spark, path, self.compression, self.writable)
        meta = self._read_meta(path)
        if meta.get("class") == "string":
            return meta["value"]
        if meta.get("class") == "histogram":
            return self._histogram(path, meta)
        tree = Tree.open(self.spark, path, aliases=meta.get("aliases"))
        tree.name = split_cycle(head)[0].rpartition("/")[2]
        return tree[column] if mark else tree

    def only_table(self) -> Tree:
        """The single table of a namespace."""
        found = sorted({p for p, c in self._walk(True) if c is not None and self.classname_of(f"{p};{c}") == "table"})
        if len(found) != 1:
            raise ValueError(f"the namespace has {len(found)} tables; name one of {found}")
        return self[found[0]]

    # ---- writing

    def _new(self, name: str) -> str:
        if not self.writable:
            raise PermissionError("the namespace is open for reading only")
        name = name.strip("/")
        return f"{self.root}/{name}/cycle={max(map(abs, self._cycles(name)), default=0) + 1}"

    def _save(self, rows: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = "") -> None:
        codec = self.compression if compression == "" else compression
        rows.write.mode(mode).option("compression", CODECS.get(codec, codec)).parquet(path)

    def mkdir(self, name: str) -> Catalog:
        fs, p = self._fs(f"{self.root}/{name.strip('/')}")
        fs.mkdirs(p)
        return Catalog(self.spark, f"{self.root}/{name.strip('/')}", self.compression, self.writable)

    def __delitem__(self, key: str) -> None:
        fs, p = self._fs(self.path_of(key))
        fs.delete(p, True)
        parent = p.getParent()
        if str(p.getName()).startswith("cycle=") and not fs.listStatus(parent):
            fs.delete(parent, True)

    def __setitem__(self, name: str, value: Any) -> None:
        """Writes a frame, a histogram, a NumPy histogram, a string, or a mapping of columns as a new version."""
        self.write(name, value)

    def update(self, values: Mapping[str, Any]) -> None:
        for name, value in values.items():
            self[name] = value

    def write(self, name: str, value: Any, title: str = "", compression: str | None = "") -> str:
        path = self._new(name)
        if isinstance(value, Tree):
            value = value.arrays()
        if isinstance(value, str):
            fs, p = self._fs(path)
            fs.mkdirs(p)
            self._write_meta(path, {"class": "string", "value": value, "title": title})
            return path
        if isinstance(value, tuple) and len(value) >= 2 and hasattr(value[0], "ndim"):
            from quern.operators.histogram import from_numpy

            value = from_numpy(value[0], *value[1:])
        if isinstance(value, Histogram):
            self._save(value.to_frame(self.spark), path, compression=compression)
            axes = [{"n": a.n, "low": a.low, "high": a.high, "edges": list(a.edges_), "labels": list(a.labels_), "name": a.name, "title": a.title} for a in value.axes]
            self._write_meta(path, {"class": "histogram", "axes": axes, "weighted": value.weighted, "stats": value.stats, "name": value.name, "title": value.title or title})
            return path
        if isinstance(value, Mapping):
            import pandas as pd

            value = self.spark.createDataFrame(pd.DataFrame({k: list(v) for k, v in value.items()}))
        if not isinstance(value, DataFrame):
            raise TypeError(f"can't write a {type(value).__name__}")
        self._save(value, path, compression=compression)
        self._write_meta(path, {"class": "table", "title": title})
        return path

    def _histogram(self, path: str, meta: dict[str, Any]) -> Histogram:
        import numpy as np

        axes = [Axis(a["n"], a["low"], a["high"], tuple(a["edges"]), tuple(a["labels"]), a["name"], a["title"]) for a in meta["axes"]]
        shape = tuple(a.n + 2 for a in axes)
        grid, square = np.zeros(shape), np.zeros(shape)
        for r in self.spark.read.parquet(path).collect():
            at = tuple(r[n] for n in ("ix", "iy", "iz")[: len(axes)])
            grid[at], square[at] = r["value"], r["variance"]
        return Histogram(axes, grid, square if meta["weighted"] else None, meta["stats"], meta["name"], meta["title"])

    def mktable(self, name: str, spec: Any, title: str = "", separator: str = "_", counters: Callable[[str], str] | None = None) -> Writer:
        """A table from a type specification (then empty) or from a frame (then with its rows)."""
        rows = spec if isinstance(spec, DataFrame) else self.spark.createDataFrame([], schema_of(spec))
        path = self._new(name)
        writer = Writer(self, path, rows.schema, separator, counters)
        self._save(writer.prepare(rows), path)
        self._write_meta(path, {"class": "table", "title": title})
        return writer

    def set_aliases(self, name: str, aliases: Mapping[str, str]) -> None:
        """Stores aliases with a table, as part of its definition."""
        path = self.path_of(name)
        self._write_meta(path, {**self._read_meta(path), "aliases": dict(aliases)})

    def copy_from(self, source: Catalog, filter_name: NameFilter = None, filter_classname: NameFilter = None, rename: Any = None) -> list[str]:
        """Copies newest versions file by file, without decoding them; returns the new names."""
        to, done = renamer(rename), []
        for key in source.keys(filter_name=filter_name, filter_classname=filter_classname, cycle=False):
            path = source.path_of(key)
            if "/cycle=" not in path:
                continue
            target = self._new(to(key))
            (fs, p), (own, q) = source._fs(path), self._fs(target)
            own.mkdirs(q.getParent())
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, own, q, False, self.spark._jsc.hadoopConfiguration())
            done.append(to(key))
        return done


class Writer:
    """Appends to a table: every column required, none unknown; list columns get a counter column."""

    def __init__(self, catalog: Catalog, path: str, schema: T.StructType, separator: str = "_", counters: Callable[[str], str] | None = None):
        self.catalog, self.path, self.schema, self.separator = catalog, path, schema, separator
        self.counters = counters or (lambda name: f"n{name}")

    def prepare(self, rows: DataFrame) -> DataFrame:
        missing, extra = sorted(set(self.schema.names) - set(rows.columns)), sorted(set(rows.columns) - set(self.schema.names))
        if missing or extra:
            raise ValueError(f"columns missing: {missing}; columns unknown: {extra}")
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields])
        flat = nested.flatten_records(rows, self.separator)
        out: list[Any] = []
        for f in flat.schema.fields:
            if isinstance(f.dataType, T.ArrayType):
                name = self.counters(f.name)
                if name in flat.columns:
                    bad = F.raise_error(F.lit(f"{name} is not the length of {f.name}")).cast("int")
                    out = [c for c in out if c[0] != name]
                    out.append((name, F.when(F.col(f"`{name}`") == nested.counter(F.col(f"`{f.name}`")), F.col(f"`{name}`")).otherwise(bad)))
                else:
                    out.append((name, nested.counter(F.col(f"`{f.name}`"))))
            if not any(n == f.name for n, _ in out):
                out.append((f.name, F.col(f"`{f.name}`")))
        return flat.select(*[c.alias(n) for n, c in out])

    def extend(self, rows: DataFrame) -> None:
        """Appends a batch."""
        self.catalog._save(self.prepare(rows), self.path, mode="append")

    @property
    def num_entries(self) -> int:
        return self.catalog.spark.read.parquet(self.path).count()

    def show(self) -> str:
        return Tree(self.catalog.spark.read.parquet(self.path)).show()


#: Spark types of the type specifications' names.
SPEC_TYPES = {"bool": "boolean", "?": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "float": "double", "int": "bigint", "str": "string", "string": "string", "bytes": "binary"}


def schema_of(spec: Any) -> T.StructType:
    """A schema from a mapping of names to types: names (``int32``, ``var * float64``, ``3 * int64``), Python or NumPy types, pairs (type, shape), nested mappings, Spark types, or DDL."""
    if isinstance(spec, T.StructType):
        return spec
    if isinstance(spec, str):
        return T._parse_datatype_string(spec)
    return T.StructType([T.StructField(name, _type_of(kind)) for name, kind in spec.items()])


def _type_of(kind: Any) -> T.DataType:
    if isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, Mapping):
        return schema_of(kind)
    if isinstance(kind, tuple):
        inner = _type_of(kind[0])
        for _ in kind[1] if isinstance(kind[1], tuple) else (kind[1],):
            inner = T.ArrayType(inner)
        return inner
    if isinstance(kind, type):
        kind = kind.__name__
    text = str(getattr(kind, "name", kind)).strip()
    head, mark, tail = text.partition("*")
    if mark and (head.strip() == "var" or head.strip().isdigit()):
        return T.ArrayType(_type_of(tail))
    if text.startswith("?") and len(text) > 1:
        return _type_of(text[1:])
    return T._parse_datatype_string(SPEC_TYPES.get(text, text))
