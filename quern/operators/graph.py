"""Graphs: points with errors as frames, interpolated curves, bands."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.histogram import Axis, Histogram

MAX_CURVE = 100_000
ERRORS = ("exl", "exh", "eyl", "eyh")


def as_graph(rows: DataFrame, x: str = "x", y: str = "y", x_errors: str | Sequence[str] | None = None, y_errors: str | Sequence[str] | None = None) -> DataFrame:
    """A frame (x, y, exl, exh, eyl, eyh) from columns: errors absent, symmetric (one column) or asymmetric (low, high); for both coordinates or neither."""
    if (x_errors is None) != (y_errors is None):
        raise ValueError("errors are given for both coordinates or for neither")
    pair = lambda e: (None, None) if e is None else (e, e) if isinstance(e, str) else tuple(e)
    got = (*pair(x_errors), *pair(y_errors))
    if len(got) != 4:
        raise ValueError("asymmetric errors are two columns, low and high")
    for c in (x, y, *[e for e in got if e]):
        if not isinstance(rows.schema[c].dataType, T.NumericType):
            raise TypeError(f"{c!r} is not numeric")
    out = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[(F.col(e) if e else F.lit(0.0)).cast("double").alias(n) for e, n in zip(got, ERRORS, strict=True)])
    if out.isEmpty():
        raise ValueError("a graph has one point at least")
    return out


def errors(which: str, axis: str = "y") -> Column:
    """A graph's error: ``low``, ``high``, ``mean`` (root of the mean square) or ``diff`` (half the width)."""
    low, high = F.col(f"e{axis}l"), F.col(f"e{axis}h")
    return {"low": low, "high": high, "mean": F.sqrt((low * low + high * high) / 2), "diff": (low + high) / 2}[which]


def curve_arrays(curve: DataFrame, x: str = "x", y: str = "y") -> tuple[list[float], list[float]]:
    """A curve's points in order of x; curves are objects of bounded size (``MAX_CURVE`` points)."""
    got = curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).limit(MAX_CURVE + 1).collect()
    if len(got) > MAX_CURVE:
        raise ValueError(f"a curve has at most {MAX_CURVE} points")
    if not got:
        raise ValueError("a curve has one point at least")
    got.sort(key=lambda r: r.x)
    return [r.x for r in got], [r.y for r in got]


def interpolate(rows: DataFrame, at: Column, xs: Sequence[float], ys: Sequence[float], name: str = "value") -> DataFrame:
    """Linear interpolation, clamped at the ends, at each row's position: a broadcast join on the position's segment.

    Points are the same for all rows, so a segment number is looked up in the sorted positions and its line joined.
    """
    spark = rows.sparkSession
    n = len(xs)
    lines = []
    for i in range(n + 1):
        if i == 0 or i == n or n == 1:
            lines.append((i, 0.0, ys[0] if i == 0 else ys[-1], 0.0))
        else:
            rise = (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1]) if xs[i] > xs[i - 1] else 0.0
            lines.append((i, xs[i - 1], ys[i - 1], rise))
    table = spark.createDataFrame(lines, "__seg int, __x0 double, __y0 double, __rise double")
    if n <= 64:
        seg = F.size(F.filter(F.array(*[F.lit(float(v)) for v in xs]), lambda v: v <= at))
        placed = rows.withColumn("__at", at).withColumn("__seg", seg)
    else:
        step = max(1, int(np.ceil(np.sqrt(n))))
        coarse = [float(v) for v in xs[::step]]
        block = F.size(F.filter(F.array(*[F.lit(v) for v in coarse]), lambda v: v <= at))
        blocks = spark.createDataFrame([(b, [float(v) for v in xs[max(0, (b - 1) * step) : b * step]]) for b in range(len(coarse) + 1)], "__block int, __part array<double>")
        placed = rows.withColumn("__at", at).withColumn("__block", block).join(F.broadcast(blocks), "__block")
        placed = placed.withColumn("__seg", F.when(F.col("__block") == 0, 0).otherwise((F.col("__block") - 1) * step + F.size(F.filter("__part", lambda v: v <= F.col("__at"))))).drop("__block", "__part")
    out = placed.join(F.broadcast(table), "__seg", "left")
    return out.withColumn(name, F.when(~F.isnan("__at"), F.col("__y0") + F.col("__rise") * (F.col("__at") - F.col("__x0"))).otherwise(F.when(F.col("__at").isNotNull(), float("nan")))).drop("__seg", "__x0", "__y0", "__rise", "__at")


def band(xs: Sequence[float], ys: Sequence[float], at: Sequence[float]) -> np.ndarray:
    """Half the height of a closed curve at positions: its upper and lower lines part after the rightmost point's successor."""
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    cut = int(np.argmax(x)) + 2
    up_x, up_y, down_x, down_y = x[:cut], y[:cut], x[cut:], y[cut:]
    order = np.argsort(down_x, kind="stable")
    return np.abs(np.interp(at, up_x, up_y) - np.interp(at, down_x[order], down_y[order])) / 2 if len(down_x) else np.zeros(len(at))


def curve_histogram(xs: Sequence[float], ys: Sequence[float], axis: Axis) -> Histogram:
    """A histogram of a curve's values at an axis's bin centres."""
    return Histogram([axis], np.pad(np.interp(axis.centers(), xs, ys), 1))


def points_to_numpy(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges) of binned points (x, y, exl, exh); bins must touch."""
    got = sorted(rows.select("x", "y", "exl", "exh").collect())
    low, high = np.array([r.x - r.exl for r in got]), np.array([r.x + r.exh for r in got])
    if not np.allclose(low[1:], high[:-1]):
        raise ValueError("the points' bins don't touch")
    return np.array([r.y for r in got]), np.append(low, high[-1])
