"""Shape operators on list-valued columns: zipping, exploding, and map look-ups."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.language import Value


def _common_name(names: list[str], flat: set[str], number: int) -> str:
    """The longest common prefix that ends in ``_``, ``.`` or ``/``, without that; else ``jagged{number}``."""
    prefix = os.path.commonprefix(names) if len(names) > 1 else names[0]
    cut = max(prefix.rfind(c) for c in "_./")
    name = prefix[:cut] if cut > 0 else ""
    return name if name and name not in flat else f"jagged{number}"


def same_shapes(rows: DataFrame, names: list[str]) -> list[list[str]]:
    """Groups of list columns whose lists have equal lengths in every row: one pass, one row back."""
    if not names:
        return []
    checks = [F.bool_and(F.size(F.col(f"`{a}`")) == F.size(F.col(f"`{b}`"))).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    equal = rows.agg(*checks).first() if checks else {}
    groups: list[list[int]] = []
    for i in range(len(names)):
        for g in groups:
            if equal[f"c{g[0]}_{i}"] is not False:
                g.append(i)
                break
        else:
            groups.append([i])
    return [[names[i] for i in g] for g in groups]


def zip_lists(rows: DataFrame) -> DataFrame:
    """Lists of one shape become one list of structs; flat columns stay."""
    lists = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)]
    flat = {f.name for f in rows.schema.fields} - set(lists)
    groups = same_shapes(rows, lists)
    place = {g[0]: g for g in groups}
    out, number = [], 0
    for c in rows.columns:
        if c in flat:
            out.append(F.col(f"`{c}`"))
        elif c in place:
            g = place[c]
            name = _common_name(g, flat, number)
            if name == f"jagged{number}":
                number += 1
            short = [x[len(name) + 1 :] if x.startswith(name) and len(x) > len(name) + 1 and x[len(name)] in "_./" else x for x in g]
            zipped = F.arrays_zip(*[F.col(f"`{x}`").alias(s) for x, s in zip(g, short, strict=True)])
            kind = T.ArrayType(T.StructType([T.StructField(s, rows.schema[x].dataType.elementType) for x, s in zip(g, short, strict=True)]))
            out.append(zipped.cast(kind).alias(name))
    return rows.select(*out)


def explode_values(rows: DataFrame, outputs: list[tuple[str, Value]], extra: list[Column], keep: Column | None = None) -> DataFrame:
    """One row per element of the list-valued outputs, with ``subentry``; flat outputs stand beside each element."""
    deep = [(k, v) for k, v in outputs if v.depth > 0]
    flat = [(k, v) for k, v in outputs if v.depth == 0]
    lead = deep[0][1].col if deep else keep
    parts = [v.col.alias(f"l{i}") for i, (_, v) in enumerate(deep)] + ([keep.alias("keep")] if keep is not None else [])
    same = F.lit(True)
    for p in [v.col for _, v in deep[1:]] + ([keep] if keep is not None and deep else []):
        same = same & (F.size(p) == F.size(lead))
    zipped = F.when(same, F.arrays_zip(*parts)).when(~same, F.raise_error(F.lit("lists of different lengths can't be exploded together")))
    held = rows.select(*[v.col.alias(f"f{i}") for i, (_, v) in enumerate(flat)], *extra, zipped.alias("z"))
    names = [c for c in held.columns if c != "z"]
    out = held.select(*names, F.posexplode("z").alias("subentry", "e"))
    if keep is not None:
        out = out.where("e.keep")
    renamed = {f"f{i}": k for i, (k, _) in enumerate(flat)}
    cols = [F.col(n).alias(renamed.get(n, n)) for n in names] + [F.col("subentry")] + [F.col(f"e.l{i}").alias(k) for i, (k, _) in enumerate(deep)]
    return out.select(*cols)


def explode(rows: DataFrame, lists: list[str], keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """(kept columns, subentry, elements): one row per position of lists of one shape; ``outer`` keeps empty rows with nulls."""
    keep = keep if keep is not None else [c for c in rows.columns if c not in lists]
    f = F.posexplode_outer if outer else F.posexplode
    zipped = F.arrays_zip(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(lists)])
    out = rows.select(*[F.col(f"`{c}`") for c in keep], f(zipped).alias("subentry", "e"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "subentry", *[F.col(f"e.l{i}").alias(c) for i, c in enumerate(lists)])


def implode(rows: DataFrame, by: list[str], order: str, lists: list[str]) -> DataFrame:
    """The inverse: one row per key, its elements in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(lists)])))
    grouped = rows.groupBy(*by).agg(packed.alias("p"))
    return grouped.select(*by, *[F.col("p").getField(f"l{i}").alias(c) for i, c in enumerate(lists)])


def map_get(column: Column, key: Column, default: Column | None = None) -> Column:
    """A map's value at a key; the default, or null, where it has none."""
    got = F.try_element_at(column, key)
    return got if default is None else F.when(F.map_contains_key(column, key), got).otherwise(default)


def sorted_set(column: Column) -> Column:
    """A list as a set: distinct and ascending."""
    return F.array_sort(F.array_distinct(column))


def counter(column: Column) -> Column:
    """The length column that a list-valued column implies."""
    return F.size(column).cast("int")


def flatten_records(rows: DataFrame, separator: str = "_", name: str | None = None) -> DataFrame:
    """Struct columns as ``outer_inner`` columns, to any depth; lists of structs as one list per field."""
    out: list[Column] = []

    def walk(col: Column, kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(col[f.name], f.dataType, f"{at}{separator}{f.name}")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                walk(col[f.name], T.ArrayType(f.dataType), f"{at}{separator}{f.name}")
        else:
            out.append(col.alias(at))

    for f in rows.schema.fields:
        if name is None or f.name == name:
            walk(F.col(f"`{f.name}`"), f.dataType, f.name)
        else:
            out.append(F.col(f"`{f.name}`"))
    return rows.select(*out)
