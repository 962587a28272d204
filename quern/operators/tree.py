"""A table as a tree of columns: catalogue, selection, expressions, cuts, entry ranges and batches."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import numeric
from quern.functions.filters import KeyInTableError, NameFilter, is_pattern, memory_size, name_filter
from quern.operators import nested
from quern.plans.language import Compiler, ExpressionError, Value, field_type, masked, quoted, value_of
from quern.sources import files
from quern.sources.shared import stored_at

ENTRY = "_entry"
HIDDEN = (files.FILE, files.ROW, ENTRY)
DEFAULT_STEP = "100 MB"

#: C++ names of Spark's simple types.
CPP_NAMES = {"boolean": "bool", "tinyint": "int8_t", "smallint": "int16_t", "int": "int32_t", "bigint": "int64_t", "float": "float", "double": "double", "string": "std::string", "binary": "std::vector<uint8_t>"}


def cpp_name(kind: T.DataType) -> str:
    """A type's name in C++ style: ``int32_t``, ``float[]``, ``std::map<..>``, a struct's members in braces."""
    if isinstance(kind, T.ArrayType):
        return f"{cpp_name(kind.elementType)}[]"
    if isinstance(kind, T.MapType):
        return f"std::map<{cpp_name(kind.keyType)}, {cpp_name(kind.valueType)}>"
    if isinstance(kind, T.StructType):
        return "struct {" + "; ".join(f"{cpp_name(f.dataType)} {f.name}" for f in kind.fields) + "}"
    return CPP_NAMES.get(kind.simpleString(), kind.simpleString())


@dataclass(frozen=True)
class Report:
    """Where a batch lies: entries in its file, in all files, and the file."""

    entry_start: int
    entry_stop: int
    global_start: int
    global_stop: int
    file: str | None


def bounds(start: int | None, stop: int | None, n: int) -> tuple[int, int]:
    """An entry range with Python's rules: None for the ends, negative from the end, clamped, never backwards."""
    fix = lambda k, default: default if k is None else max(0, k + n) if k < 0 else min(k, n)
    a, b = fix(start, 0), fix(stop, n)
    return a, max(a, b)


class Tree:
    """Columns of one table (a file, a folder, or any frame) and the queries over them.

    A frame that isn't read from files gets its entries from ``order_by``: rows are numbered in that order by one range
    shuffle and per-partition counts.
    """

    def __init__(self, rows: DataFrame, name: str = "", aliases: Mapping[str, str] | None = None, functions: Mapping | None = None, path: str | list[str] | None = None, order_by: list[str] | None = None, entries: int | None = None):
        self.rows, self.name, self.aliases, self.path = rows, name, dict(aliases or {}), path
        self.functions = {**numeric.FUNCTIONS, **(functions or {})}
        self.spark: SparkSession = rows.sparkSession
        self.order_by = order_by
        self._counts: list[tuple[str, int]] | None = None
        self._entries = entries
        self._footers: list[files.Footer] | None = None
        self.access_log: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> Tree:
        return cls(files.read_entries(spark, path), name=path.rstrip("/").rpartition("/")[2].removesuffix(".parquet"), path=path, **options)

    @classmethod
    def open_many(cls, spark: SparkSession, paths: list[str], **options: Any) -> Tree:
        """Many files of the first one's columns as one scan, their entries counted in the order given."""
        rows = files.read_entries(spark, paths, spark.read.parquet(paths[0]).schema)
        out = cls(rows, path=paths, **options)
        lacking = [(f.file, c) for f in out.footers() for c in out.schema.names if c not in f.names]
        if lacking:
            raise KeyInTableError(lacking[0][1], [n for f in out.footers() if f.file == lacking[0][0] for n in f.names])
        at = {f.file: k for k, f in enumerate(out.footers())}
        out._counts = [(f, n) for f, n in sorted(((f.file, f.rows) for f in out.footers()), key=lambda x: at[x[0]])]
        return out

    # ---- catalogue

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.rows.schema.fields if f.name not in HIDDEN])

    def _walk(self, recursive: bool = True, separator: str = ".") -> Iterator[tuple[str, T.StructField]]:
        def inside(fields: list[T.StructField], at: str) -> Iterator[tuple[str, T.StructField]]:
            for f in fields:
                yield at + f.name, f
                kind = f.dataType
                while isinstance(kind, T.ArrayType):
                    kind = kind.elementType
                if recursive and isinstance(kind, T.StructType):
                    yield from inside(kind.fields, at + f.name + separator)

        yield from inside(self.schema.fields, "")

    def keys(self, recursive: bool = True, filter_name: NameFilter = None, filter_typename: NameFilter = None, filter_field: Callable[[T.StructField], Any] | None = None, full_paths: bool = True, ignore_duplicates: bool = False, separator: str = ".") -> list[str]:
        """Column names, depth first; filters apply to the bare name, the path and ``/path``."""
        by_name, by_type = name_filter(filter_name), name_filter(filter_typename)
        out = []
        for path, f in self._walk(recursive, separator):
            slashed = path.replace(separator, "/")
            typed = field_type(self.schema, path.split(separator)) or f.dataType
            if not any(map(by_name, (f.name, path, slashed, f"/{slashed}"))):
                continue
            if not (by_type(cpp_name(typed)) or by_type(typed.simpleString())):
                continue
            if filter_field is not None and not filter_field(f):
                continue
            out.append(path if full_paths else f.name)
        return list(dict.fromkeys(out)) if ignore_duplicates else out

    def typenames(self, **filters: Any) -> dict[str, str]:
        return {k: cpp_name(field_type(self.schema, k.split("."))) for k in self.keys(**filters)}

    def values(self, **filters: Any) -> list[Tree]:
        return [self[k] for k in self.keys(**filters)]

    def items(self, **filters: Any) -> list[tuple[str, Tree]]:
        return [(k, self[k]) for k in self.keys(**filters)]

    def __contains__(self, name: str) -> bool:
        return self._find(name) is not None

    def _find(self, name: str) -> list[str] | None:
        """A name's path: direct columns first, then depth first; ``/name`` looks at the top only."""
        if name.startswith("/"):
            path = name[1:].split("/")
            return path if field_type(self.schema, path) is not None else None
        for path in ([name], name.split("/"), name.split(".")):
            if field_type(self.schema, path) is not None:
                return path
        for path, f in self._walk():
            if f.name == name:
                return path.split(".")
        return None

    def __getitem__(self, name: str) -> Tree:
        """One column as a tree of its own: a struct's fields, or the column."""
        path = self._find(name)
        if path is None:
            raise KeyInTableError(name, self.keys())
        kind = field_type(self.schema, path)
        hidden = [c for c in HIDDEN if c in self.rows.columns]
        cols = [F.col(f"{quoted(path)}.`{n}`") for n in kind.names] if isinstance(kind, T.StructType) else [F.col(quoted(path)).alias(path[-1])]
        return Tree(self.rows.select(*cols, *hidden), path[-1], path=self.path, order_by=self.order_by)

    def show(self, name_width: int = 20, typename_width: int = 24, interpretation_width: int = 30, **filters: Any) -> str:
        """A table of names, type names and Spark types, cut with an ellipsis at the widths; also printed."""
        cut = lambda s, n: s if len(s) <= n else s[: n - 3] + "..."
        widths = (name_width, typename_width, interpretation_width)
        lines = [" | ".join(x.ljust(n) for x, n in zip(("name", "typename", "interpretation"), widths, strict=True)), "-+-".join("-" * n for n in widths)]
        for k, t in self.typenames(**filters).items():
            lines.append(" | ".join(cut(x, n).ljust(n) for x, n in zip((k, t, field_type(self.schema, k.split(".")).simpleString()), widths, strict=True)))
        print(out := "\n".join(lines))
        return out

    # ---- entries

    @property
    def counts(self) -> list[tuple[str, int]]:
        """(file, rows) of a table of files."""
        if self._counts is None:
            self._counts = files.file_counts(self.rows) if files.FILE in self.rows.columns else [("", self.rows.count())]
        return self._counts

    @property
    def num_entries(self) -> int:
        return sum(n for _, n in self.counts) if self._entries is None else self._entries

    def entries(self) -> DataFrame:
        """The rows with their global entry numbers."""
        if ENTRY in self.rows.columns:
            return self.rows
        if files.FILE in self.rows.columns:
            return files.with_entries(self.rows, self.counts, name=ENTRY)
        return number_rows(self.rows, self.order_by or [])

    def range(self, entry_start: int | None = None, entry_stop: int | None = None) -> DataFrame:
        """Rows of an entry range: files outside it aren't read, and the row numbers' filter reaches the scan."""
        a, b = bounds(entry_start, entry_stop, self.num_entries)
        if (a, b) == (0, self.num_entries):
            return self.rows
        if files.FILE not in self.rows.columns:
            return self.entries().where(F.col(ENTRY).between(a, b - 1) if a < b else F.lit(False)).drop(ENTRY)
        clipped, at = [], 0
        for path, n in self.counts:
            low, high = max(a - at, 0), min(b - at, n)
            if low < high:
                clipped.append((path, low, high, n))
            at += n
        if not clipped:
            return self.rows.where(F.lit(False))
        if len(self.counts) == 1 or len(clipped) == 1 and len(self.counts) <= files.INLINE_FILES:
            path, low, high, _ = clipped[0]
            keep = F.col(files.ROW).between(low, high - 1)
            return self.rows.where(keep if len(self.counts) == 1 else (F.col(files.FILE) == path) & keep)
        edges = [c for c in clipped if (c[1], c[2]) != (0, c[3])]
        inner = [c[0] for c in clipped if (c[1], c[2]) == (0, c[3])]
        if len(inner) > files.INLINE_FILES and self.counts == sorted(self.counts):
            keep = F.col(files.FILE).between(inner[0], inner[-1])  # files between two others in the order of names
        elif len(inner) > files.INLINE_FILES:
            chosen = self.spark.createDataFrame([(c[0], c[1], c[2]) for c in clipped], f"{files.FILE} string, __low long, __high long")
            return self.rows.join(F.broadcast(chosen), files.FILE).where((F.col(files.ROW) >= F.col("__low")) & (F.col(files.ROW) < F.col("__high"))).drop("__low", "__high")
        else:
            keep = F.col(files.FILE).isin(inner) if inner else F.lit(False)
        for path, low, high, _ in edges:
            keep = keep | (F.col(files.FILE) == path) & F.col(files.ROW).between(low, high - 1)
        return self.rows.where(keep)

    # ---- sizes

    def column_bytes(self, expressions: Any = None, compressed: bool = False, **filters: Any) -> int:
        """Bytes of the columns that a query reads, from the files' footers."""
        if self.path is None:
            raise TypeError("only tables of files have sizes")
        wanted = self._read_columns(expressions, **filters)
        return sum(c.compressed if compressed else c.uncompressed for f in self.footers() for g in f.groups for c in g.chunks if c.name in wanted)

    def footers(self) -> list[files.Footer]:
        """What the files' footers say of rows, row groups and chunks of columns; read once."""
        if self._footers is None:
            self._footers = files.footers(self.spark, [p for one in self.paths for p in files.part_files(self.spark, one)])
        return self._footers

    @property
    def paths(self) -> list[str]:
        return [] if self.path is None else [self.path] if isinstance(self.path, str) else list(self.path)

    def _read_columns(self, expressions: Any, **filters: Any) -> set[str]:
        compiler = Compiler(self.schema, self.aliases, self.functions)
        if expressions is None:
            return {k.split(".")[0] for k in self.keys(**filters)}
        names = [expressions] if isinstance(expressions, str) else list(expressions)
        return {re.split("[./]", s.lstrip("/"))[0] if s not in self.schema.names else s for e in names for s in compiler.symbols(e)}

    @property
    def uncompressed_bytes(self) -> int:
        return self.column_bytes()

    @property
    def compressed_bytes(self) -> int:
        return self.column_bytes(compressed=True)

    @property
    def compression_ratio(self) -> float:
        return self.uncompressed_bytes / max(1, self.compressed_bytes)

    def num_entries_for(self, memory: int | str, expressions: Any = None, **filters: Any) -> int:
        """Rows of the columns read that take about a memory size, 1 at least."""
        target = memory_size(memory) if isinstance(memory, str) else memory
        if target is None:
            raise ValueError(f"not a memory size: {memory!r}")
        return max(1, round(target * self.num_entries / max(1, self.column_bytes(expressions, **filters))))

    def common_entry_offsets(self, **filters: Any) -> list[int]:
        """Entries at which all selected columns start a chunk: the row groups' ends; none without a selected column."""
        if not self.keys(**filters):
            return []
        return list(itertools.accumulate((g.rows for f in self.footers() for g in f.groups), initial=0))

    # ---- queries

    def plan(self, expressions: Any = None, aliases: Mapping[str, str] | None = None, **filters: Any) -> tuple[Compiler, list[tuple[str, Value]]]:
        """The output columns of a query, in order, as (name, compiled value)."""
        compiler = Compiler(self.schema, {**self.aliases, **(aliases or {})}, self.functions)
        if expressions is None:
            chosen = group_cases(self.schema, self.keys(**filters))
            return compiler, [(k, value_of(F.col(quoted(k.split("."))), field_type(self.schema, k.split(".")))) for k in chosen]
        if isinstance(expressions, str):
            if is_pattern(expressions) and expressions not in self.schema.names:
                return self.plan(None, aliases, filter_name=expressions)
            pairs: list[tuple[str, Any]] = [(expressions, None)]
        elif isinstance(expressions, Mapping):
            pairs = list(expressions.items())
        elif isinstance(expressions, Iterable):
            pairs = [e if isinstance(e, tuple) else (e, None) for e in expressions]
        else:
            raise TypeError(f"expressions are None, a string, a mapping or an iterable, not {type(expressions).__name__}")
        out: dict[str, tuple[Value, Any]] = {}
        for text, kind in pairs:
            if not isinstance(text, str):
                raise TypeError(f"an expression is a string, not {text!r}")
            if text in out and out[text][1] != kind:
                raise ValueError(f"{text!r} is asked for with two types")
            value = compiler.compile(text)
            if kind is not None:
                spark_type = kind if isinstance(kind, str) else kind.simpleString()
                value = value_of(value.col.cast(spark_type), kind if not isinstance(kind, str) else T._parse_datatype_string(spark_type))
            out[text] = value, kind
        return compiler, [(k, v) for k, (v, _) in out.items()]

    def arrays(self, expressions: Any = None, cut: str | None = None, *, aliases: Mapping[str, str] | None = None, entry_start: int | None = None, entry_stop: int | None = None, how: Any = None, entry: bool = False, cut_broadcast: bool = False, **filters: Any) -> Any:
        """The query: output columns over an entry range, cut by one expression.

        A flat cut drops rows; a list-valued cut filters the elements of list-valued outputs of its shape and keeps
        the rows (``cut_broadcast`` explodes to one row per kept element, flat outputs standing beside each).
        ``how``: None for a frame, ``"zip"`` to nest lists of one shape, ``dict``, ``tuple`` or ``list`` for NumPy
        containers, ``"pd"`` for pandas.  ``entry`` adds the entry numbers.
        """
        compiler, outputs = self.plan(expressions, aliases, **filters)
        rows = self.range(entry_start, entry_stop)
        if entry:
            rows = Tree(rows, order_by=self.order_by)._with_counts(self.counts).entries() if ENTRY not in rows.columns else rows
        test = compiler.compile(cut) if cut is not None else None
        self.access_log += sorted({s for t in ([cut] if cut else []) + [k for k, _ in outputs] for s in ([t] if compiler.column(t) else compiler.symbols(t))})
        extra = [F.col(ENTRY)] if entry else []
        if test is not None and test.depth == 0:
            rows = rows.where(numeric.truth(test.typed))
        elif test is not None and cut_broadcast:
            keep = F.transform(test.col, lambda x: numeric.truth(numeric.Typed(x, test.kind)))
            return nested.explode_values(rows, outputs, extra, keep)
        elif test is not None:
            flat = [k for k, v in outputs if v.depth < test.depth]
            if flat:
                raise ExpressionError(f"a list-valued cut has no meaning for {', '.join(flat)}; explode with cut_broadcast=True")
            outputs = [(k, masked(v, test)) for k, v in outputs]
        if how is not None and how != "zip" and files.FILE in rows.columns:  # containers keep the order of entries
            rows = rows.orderBy(files.FILE, files.ROW)
        out = rows.select(*[v.col.alias(k) for k, v in outputs], *extra)
        if how == "zip":
            return nested.zip_lists(out)
        return adapt(out, how)

    def _with_counts(self, counts: list[tuple[str, int]]) -> Tree:
        self._counts = counts
        return self

    def array(self, kind: Any = None, **options: Any) -> Any:
        """The single column of this tree, read as another type if asked."""
        names = self.schema.names
        if len(names) != 1:
            raise TypeError("array() is for a single column; arrays() reads several")
        return self.arrays([(names[0], kind)] if kind else [names[0]], **options)

    def iterate(self, expressions: Any = None, cut: str | None = None, *, step_size: int | str = DEFAULT_STEP, report: bool = False, entry_start: int | None = None, entry_stop: int | None = None, **options: Any) -> Iterator[Any]:
        """Consecutive batches of entries; a batch's size counts rows before the cut and never spans files.

        Each batch is a lazy query of its own range, so a batch can run anywhere and in any order.
        """
        filters = {k: v for k, v in options.items() if k.startswith("filter_")}
        size = memory_size(step_size) if isinstance(step_size, str) else None
        step = self.num_entries_for(size, expressions, **filters) if size is not None else int(step_size)
        if step < 1:
            raise ValueError("a step has one entry at least")
        a, b = bounds(entry_start, entry_stop, self.num_entries)
        at = 0
        for path, n in self.counts:
            low, high = max(a, at), min(b, at + n)
            for start in range(low, high, step):
                stop = min(start + step, high)
                out = self.arrays(expressions, cut, entry_start=start, entry_stop=stop, **options)
                yield (out, Report(start - at, stop - at, start, stop, path or None)) if report else out
            at += n

    def batches(self, step_size: int | str, expressions: Any = None, cut: str | None = None, **options: Any) -> DataFrame:
        """All batches at once: a query's rows with ``_batch_file`` and ``_batch``, numbers of file and step.

        One pass whatever the number of batches, and no shuffle; a batch's size counts rows before the cut.
        """
        if isinstance(step_size, str):
            step_size = self.num_entries_for(step_size, expressions, **{k: v for k, v in options.items() if k.startswith("filter_")})
        numbered = self._batched(step_size)
        if expressions is None and cut is None and not options:
            return numbered
        compiler, outputs = self.plan(expressions, **options)
        if cut is not None:
            test = compiler.compile(cut)
            if test.depth:
                raise ExpressionError("batches take a flat cut")
            numbered = numbered.where(numeric.truth(test.typed))
        return numbered.select("_batch_file", "_batch", *[v.col.alias(k) for k, v in outputs])

    def _batched(self, step_size: int) -> DataFrame:
        rows = self.rows
        if files.FILE not in rows.columns:
            return self.entries().withColumns({"_batch_file": F.lit(0), "_batch": F.floor(F.col(ENTRY) / step_size)}).drop(ENTRY)
        if len(self.counts) > files.INLINE_FILES:
            table = self.spark.createDataFrame([(p, k) for k, (p, _) in enumerate(self.counts)], f"{files.FILE} string, _batch_file int")
            rows = rows.join(F.broadcast(table), files.FILE)
            return rows.withColumn("_batch", F.floor(F.col(files.ROW) / step_size)).drop(files.FILE, files.ROW)
        order = F.array_position(F.array(*[F.lit(p) for p, _ in self.counts]), F.col(files.FILE)) - 1
        return rows.withColumns({"_batch_file": order.cast("int"), "_batch": F.floor(F.col(files.ROW) / step_size)}).drop(files.FILE, files.ROW)


def number_rows(rows: DataFrame, order_by: list[str], name: str = ENTRY) -> DataFrame:
    """Numbers rows from 0 in the order of columns (all columns break ties).

    The rows are written once, sorted, after one range shuffle; their numbers are offsets of the written parts and row
    numbers in them.  Nothing is sorted again by a later job, whose sampled ranges could be others.
    """
    keys = [*order_by, *[c for c in rows.columns if c not in order_by and not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]]
    order = [F.col(quoted([k])).asc_nulls_first() for k in keys]
    place = stored_at(rows.repartitionByRange(*order).sortWithinPartitions(*order), "numbered")
    parts = files.read_entries(rows.sparkSession, place, rows.schema)
    return files.with_entries(parts, files.file_counts(parts), name=name).drop(files.FILE, files.ROW)


def group_cases(schema: T.StructType, keys: list[str]) -> list[str]:
    """What to read of structs whose parent and children a filter selects.

    Only the parent: the struct; some children: those, flat; parent and all children: the children, flat; parent and
    some children: the whole struct.
    """
    chosen, out = set(keys), []
    for f in schema.fields:
        kids = [k for k in keys if k.startswith(f.name + ".")]
        if not isinstance(f.dataType, T.StructType):
            out += [f.name] if f.name in chosen else kids
            continue
        direct = [f"{f.name}.{n}" for n in f.dataType.names]
        if f.name in chosen and not all(d in chosen for d in direct):
            out.append(f.name)
        else:
            out += [k for k in kids if not any(k.startswith(other + ".") for other in kids)]
    return out


def adapt(out: DataFrame, how: Any) -> Any:
    """A frame as the container asked for; these are terminal and collect."""
    if how is None:
        return out
    if how == "pd":
        return out.toPandas()
    table = out.toArrow()
    arrays = {c: table.column(c).to_numpy() for c in out.columns}
    if how in (dict, "np"):
        return arrays
    if how in (tuple, list):
        return how(arrays.values())
    raise TypeError(f"how is None, 'zip', 'pd', dict, tuple or list, not {how!r}")

