"""Histograms and profiles: axes, filling by aggregation, errors, statistics, comparison.

A filled histogram is a small driver-side object over a dense grid with under- and overflow, made from one map-side
combined aggregation whose result has at most as many rows as the grid has cells (``max_cells`` bounds it).  Bins are
numbered as in axis objects: 0 is underflow, 1 to n are ``[low, high)``, n + 1 is overflow; NaN counts as overflow.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 10_000_000


@dataclass(frozen=True)
class Axis:
    """A binning: regular, variable (``edges_``) or by category (``labels_``)."""

    n: int
    low: float = 0.0
    high: float = 1.0
    edges_: tuple[float, ...] = ()
    labels_: tuple[str, ...] = ()
    name: str = ""
    title: str = ""

    @classmethod
    def regular(cls, n: int, low: float, high: float, **names: str) -> Axis:
        if n < 1 or not high > low:
            raise ValueError("an axis has one bin or more and its high end above its low end")
        return cls(n, float(low), float(high), **names)

    @classmethod
    def variable(cls, edges: Iterable[float], **names: str) -> Axis:
        """An axis by its edges; evenly spaced ones make a regular axis."""
        e = [float(x) for x in edges]
        if len(e) < 2 or any(b <= a for a, b in zip(e, e[1:], strict=False)):
            raise ValueError("edges ascend and are two or more")
        if np.allclose(e, np.linspace(e[0], e[-1], len(e))):
            return cls(len(e) - 1, e[0], e[-1], **names)
        return cls(len(e) - 1, e[0], e[-1], tuple(e), **names)

    @classmethod
    def category(cls, labels: Iterable[str], **names: str) -> Axis:
        got = tuple(labels)
        return cls(len(got), 0.0, float(len(got)), labels_=got, **names)

    @property
    def traits(self) -> dict[str, bool]:
        return {"circular": False, "discrete": bool(self.labels_)}

    def edges(self, flow: bool = False) -> np.ndarray:
        e = np.array(self.edges_) if self.edges_ else np.linspace(self.low, self.high, self.n + 1)
        return np.concatenate(([-np.inf], e, [np.inf])) if flow else e

    def intervals(self, flow: bool = False) -> np.ndarray:
        e = self.edges(flow)
        return np.stack([e[:-1], e[1:]], 1)

    def centers(self, flow: bool = False) -> np.ndarray:
        return self.intervals(flow).mean(1)

    def widths(self, flow: bool = False) -> np.ndarray:
        return np.diff(self.edges(flow))

    @property
    def width(self) -> float:
        return float(self.widths().mean()) if self.edges_ else (self.high - self.low) / self.n

    def labels(self) -> list[str] | None:
        return list(self.labels_) or None

    def __getitem__(self, i: int) -> str | tuple[float, float]:
        if not -self.n <= i < self.n:
            raise IndexError(i)
        return self.labels_[i] if self.labels_ else tuple(self.intervals()[i].tolist())

    def __len__(self) -> int:
        return self.n

    def index(self, x: Column) -> Column:
        """The bin number of a value, 0 to n + 1; null where the value is null."""
        if self.labels_:
            at = F.array_position(F.array(*[F.lit(s) for s in self.labels_]), x.cast("string")).cast("int")
            return F.when(x.isNotNull(), F.when(at > 0, at).otherwise(self.n + 1))
        v = x.cast("double")
        if self.edges_:
            inner = F.size(F.filter(F.array(*[F.lit(e) for e in self.edges_]), lambda e: e <= v))
            inside = F.when(v >= self.high, self.n + 1).otherwise(inner)
        else:
            inside = F.width_bucket(v, F.lit(self.low), F.lit(self.high), F.lit(self.n)).cast("int")
        return F.when(x.isNull(), F.lit(None)).when(F.isnan(v), self.n + 1).otherwise(inside)


def _check(axes: Sequence[Axis]) -> tuple[int, ...]:
    shape = tuple(a.n + 2 for a in axes)
    if not 1 <= len(axes) <= 3:
        raise ValueError("histograms have one to three axes")
    if np.prod(shape, dtype=float) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    return shape


_NAMES = ("ix", "iy", "iz")


def bin_columns(axes: Sequence[Axis], values: Sequence[Column]) -> list[Column]:
    return [a.index(v).alias(n) for a, v, n in zip(axes, values, _NAMES, strict=False)]


def fill_frame(rows: DataFrame, axes: Sequence[Axis], values: Sequence[Column | str], weight: Column | str | None = None) -> DataFrame:
    """Filled cells as rows: bin numbers, entries, value (sum of weights), variance (sum of their squares)."""
    _check(axes)
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    binned = rows.select(*bin_columns(axes, cols), w.alias("w")).where(" and ".join(f"{n} is not null" for n in _NAMES[: len(axes)]))
    return binned.groupBy(*_NAMES[: len(axes)]).agg(F.count("*").alias("entries"), F.sum("w").alias("value"), F.sum(F.col("w") * F.col("w")).alias("variance"))


def dense_frame(filled: DataFrame, axes: Sequence[Axis], flow: bool = True) -> DataFrame:
    """All cells as rows, empty ones with zeros."""
    spark = filled.sparkSession
    grid: DataFrame | None = None
    total = int(np.prod([a.n + 2 if flow else a.n for a in axes]))
    grid = spark.range(total)
    rest, cols = F.col("id"), []
    for a, name in zip(axes, _NAMES, strict=False):
        n = a.n + 2 if flow else a.n
        cols.append((rest % n + (0 if flow else 1)).cast("int").alias(name))
        rest = F.floor(rest / n)
    keys = list(_NAMES[: len(axes)])
    measures = [c for c in filled.columns if c not in keys]
    return grid.select(*cols).join(filled, keys, "left").select(*keys, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


@dataclass
class Histogram:
    """Counts or weights on a dense grid; ``values_`` and ``sumw2_`` include the flow bins."""

    axes: list[Axis]
    values_: np.ndarray
    sumw2_: np.ndarray | None = None
    stats: dict[str, float] = field(default_factory=dict)
    name: str = ""
    title: str = ""

    kind = "COUNT"

    @classmethod
    def fill(cls, rows: DataFrame, axes: Sequence[Axis], values: Sequence[Column | str], weight: Column | str | None = None, name: str = "", title: str = "") -> Histogram:
        """Fills by one aggregation; the grid's cells come to the driver, and so do the statistics of values in range."""
        shape = _check(axes)
        grid, square = np.zeros(shape), np.zeros(shape)
        for r in fill_frame(rows, axes, values, weight).collect():
            at = tuple(r[n] for n in _NAMES[: len(axes)])
            grid[at], square[at] = r["value"], r["variance"]
        return cls(list(axes), grid, square if weight is not None else None, statistics(rows, axes, values, weight), name, title)

    def _cut(self, x: np.ndarray, flow: bool) -> np.ndarray:
        return x if flow else x[tuple(slice(1, -1) for _ in self.axes)]

    @property
    def weighted(self) -> bool:
        return self.sumw2_ is not None

    def axis(self, which: int | str = 0) -> Axis:
        return self.axes["xyz".index(which) if isinstance(which, str) else which]

    def values(self, flow: bool = False) -> np.ndarray:
        return self._cut(self.values_, flow)

    def counts(self, flow: bool = False) -> np.ndarray:
        return self.values(flow)

    def variances(self, flow: bool = False) -> np.ndarray:
        """Sum of squared weights where there is one above 0, else the value if that is above 0, else 0."""
        v = np.maximum(self.values_, 0.0)
        if self.sumw2_ is not None:
            v = np.where(self.sumw2_ > 0, self.sumw2_, v)
        return self._cut(v, flow)

    def errors(self, flow: bool = False) -> np.ndarray:
        return np.sqrt(self.variances(flow))

    def to_numpy(self, flow: bool = False, dd: bool = False) -> tuple:
        edges = [a.edges(flow) for a in self.axes]
        return (self.values(flow), edges) if dd else (self.values(flow), *edges)

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Histogram) or type(self) is not type(other) or len(self.axes) != len(other.axes):
            return False
        same = all(np.array_equal(a.edges(), b.edges()) and a.labels_ == b.labels_ for a, b in zip(self.axes, other.axes, strict=True))
        return same and np.array_equal(self.values(True), other.values(True)) and np.array_equal(self.variances(True), other.variances(True))

    __hash__ = None

    def to_frame(self, spark, flow: bool = True) -> DataFrame:
        """One row per cell: bin numbers, value, variance."""
        values, variances = self.values(flow), self.variances(flow)
        rows = [(*(int(i) + (0 if flow else 1) for i in at), float(values[at]), float(variances[at])) for at in np.ndindex(values.shape)]
        return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in _NAMES[: len(self.axes)]) + ", value double, variance double")


def statistics(rows: DataFrame, axes: Sequence[Axis], values: Sequence[Column | str], weight: Column | str | None = None) -> dict[str, float]:
    """Sums of w, w^2, w x, w x^2 (and y, z and their products) over rows inside all axes."""
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    inside = F.lit(True)
    for a, c in zip(axes, cols, strict=True):
        inside = inside & a.index(c).between(1, a.n)
    names = "xyz"[: len(axes)]
    numeric = [c.cast("double") if not a.labels_ else a.index(c) - 0.5 for a, c in zip(axes, cols, strict=True)]
    sums = [F.sum(w).alias("sumw"), F.sum(w * w).alias("sumw2")]
    for i, n in enumerate(names):
        sums += [F.sum(w * numeric[i]).alias(f"sumw{n}"), F.sum(w * numeric[i] * numeric[i]).alias(f"sumw{n}2")]
        sums += [F.sum(w * numeric[i] * numeric[j]).alias(f"sumw{names[j]}{n}") for j in range(i)]
    got = rows.where(inside).agg(F.count("*").alias("entries"), *sums).first().asDict()
    return {k: float(v or 0) for k, v in got.items()}


ERROR_MODES = ("", "s", "i", "g")


def profile_frame(rows: DataFrame, axes: Sequence[Axis], values: Sequence[Column | str], y: Column | str, weight: Column | str | None = None) -> DataFrame:
    """Filled cells of a profile: bin numbers and the sums of w, w^2, w y, w y^2."""
    _check(axes)
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    binned = rows.select(*bin_columns(axes, cols), w.alias("w"), y.alias("y")).where(" and ".join(f"{n} is not null" for n in _NAMES[: len(axes)]) + " and y is not null")
    wy = F.col("w") * F.col("y")
    return binned.groupBy(*_NAMES[: len(axes)]).agg(F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"), F.sum(wy).alias("sumwy"), F.sum(wy * F.col("y")).alias("sumwy2"))


def profile_columns(mode: str = "", weighted: bool = True) -> dict[str, Column]:
    """A profile's mean, effective counts and error as columns over its sums."""
    if mode not in ERROR_MODES:
        raise ValueError(f"error modes are {ERROR_MODES}")
    w, w2, wy, wy2 = (F.col(c) for c in ("sumw", "sumw2", "sumwy", "sumwy2"))
    mean = F.when(w != 0, wy / F.when(w != 0, w)).otherwise(0.0)
    neff = F.when(w2 > 0, w * w / F.when(w2 > 0, w2)).otherwise(0.0) if weighted else w
    spread = F.sqrt(F.abs(F.when(w != 0, wy2 / F.when(w != 0, w)).otherwise(0.0) - mean * mean))
    by = lambda x, n: F.when(n > 0, x / F.sqrt(F.when(n > 0, n))).otherwise(0.0)
    error = {
        "": by(spread, neff), "s": spread, "g": by(F.lit(1.0), w),
        "i": F.when(spread != 0, by(spread, neff)).otherwise(by(F.lit(1.0), 12 * neff)),
    }[mode]
    return {"mean": mean, "effective": neff, "error": error}


@dataclass
class Profile:
    """Means of y per bin, from sums with flow bins."""

    axes: list[Axis]
    sumw: np.ndarray
    sumw2: np.ndarray | None
    sumwy: np.ndarray
    sumwy2: np.ndarray
    mode: str = ""

    kind = "MEAN"

    @classmethod
    def fill(cls, rows: DataFrame, axes: Sequence[Axis], values: Sequence[Column | str], y: Column | str, weight: Column | str | None = None, mode: str = "") -> Profile:
        shape = _check(axes)
        grids = {k: np.zeros(shape) for k in ("sumw", "sumw2", "sumwy", "sumwy2")}
        for r in profile_frame(rows, axes, values, y, weight).collect():
            at = tuple(r[n] for n in _NAMES[: len(axes)])
            for k, g in grids.items():
                g[at] = r[k]
        if weight is None:
            grids["sumw2"] = None
        return cls(list(axes), mode=mode, **grids)

    def _cut(self, x: np.ndarray, flow: bool) -> np.ndarray:
        return x if flow else x[tuple(slice(1, -1) for _ in self.axes)]

    def counts(self, flow: bool = False) -> np.ndarray:
        """Sums of weights."""
        return self._cut(self.sumw, flow)

    def effective_counts(self, flow: bool = False) -> np.ndarray:
        """(sum w)^2 / sum w^2 where squares are stored, else sum w."""
        if self.sumw2 is None:
            return self.counts(flow)
        out = np.divide(self.sumw**2, self.sumw2, out=np.zeros_like(self.sumw), where=self.sumw2 > 0)
        return self._cut(out, flow)

    def values(self, flow: bool = False) -> np.ndarray:
        return self._cut(np.divide(self.sumwy, self.sumw, out=np.zeros_like(self.sumw), where=self.sumw != 0), flow)

    def errors(self, flow: bool = False, mode: str | None = None) -> np.ndarray:
        mode = self.mode if mode is None else mode
        if mode not in ERROR_MODES:
            raise ValueError(f"error modes are {ERROR_MODES}")
        n, w = self.effective_counts(True), self.sumw
        square = np.divide(self.sumwy2, w, out=np.zeros_like(w), where=w != 0)
        spread = np.sqrt(np.abs(square - self.values(True) ** 2))
        by = lambda x, k: np.divide(x, np.sqrt(np.maximum(k, 0)), out=np.zeros_like(w), where=k > 0)
        if mode == "s":
            out = spread
        elif mode == "g":
            out = by(np.ones_like(w), w)
        elif mode == "i":
            out = np.where(spread != 0, by(spread, n), by(np.ones_like(w), 12 * n))
        else:
            out = by(spread, n)
        return self._cut(out, flow)

    def variances(self, flow: bool = False) -> np.ndarray:
        return self.errors(flow) ** 2

    def to_histogram(self, flow: bool = True) -> Histogram:
        """Means as values and squared errors as variances."""
        return Histogram(self.axes, self.values(True), self.errors(True) ** 2)


def from_numpy(counts: np.ndarray, *edges: np.ndarray, name: str = "", title: str = "") -> Histogram:
    """A histogram from a counts array and its edges (``numpy.histogram``, ``histogram2d`` or ``histogramdd`` results)."""
    if len(edges) == 1 and counts.ndim > 1:
        edges = tuple(edges[0])
    axes = [Axis.variable(e) for e in edges]
    if counts.shape != tuple(a.n for a in axes):
        raise ValueError("counts and edges have different shapes")
    grid = np.pad(np.asarray(counts, float), 1)
    centers = [a.centers() for a in axes]
    stats = {"entries": float(counts.sum()), "sumw": float(counts.sum()), "sumw2": float(counts.sum())}
    for i, c in enumerate(centers):
        shape = [1] * counts.ndim
        shape[i] = -1
        x = c.reshape(shape)
        stats[f"sumw{'xyz'[i]}"], stats[f"sumw{'xyz'[i]}2"] = float((counts * x).sum()), float((counts * x * x).sum())
    return Histogram(axes, grid, None, stats, name, title)
