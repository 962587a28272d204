"""Histograms, profiles, graphs, packed encodings."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import packed
from quern.operators import graph
from quern.operators.histogram import Axis, Histogram, Profile, from_numpy


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 2, 500), [np.nan, np.inf, -np.inf, 4.0, -4.0]])
    y, w = rng.normal(1, 1, 505), rng.uniform(0, 2, 505)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, w, strict=True)] + [(None, 1.0, 1.0)], "x double, y double, w double").cache()
    return frame, x, y, w


def test_fill_against_numpy(rows):
    frame, x, y, w = rows
    a = Axis.regular(16, -4, 4)
    h = Histogram.fill(frame, [a], ["x"])
    inside = x[(x >= -4) & (x < 4)]
    assert np.array_equal(h.values(), np.histogram(inside, a.edges())[0]) and h.values(flow=True)[0] == (x < -4).sum()
    assert h.values(flow=True)[-1] == (x >= 4).sum() + 1 and h.kind == "COUNT" and not h.weighted and np.array_equal(h.variances(), h.values())
    hw = Histogram.fill(frame, [a], ["x"], "w")
    keep = (x >= -4) & (x < 4)
    assert np.allclose(hw.values(), np.histogram(x[keep], a.edges(), weights=w[keep])[0]) and np.allclose(hw.errors() ** 2, np.histogram(x[keep], a.edges(), weights=w[keep] ** 2)[0])
    assert hw.stats["sumwx"] == pytest.approx((w[keep] * x[keep]).sum()) and h == Histogram.fill(frame, [a], ["x"]) and h != hw


def test_two_dimensions_and_categories(spark, rows):
    frame, x, y, _ = rows
    a, b = Axis.variable([-4, -1, 0, 3]), Axis.regular(4, -1, 3)
    h = Histogram.fill(frame, [a, b], ["x", "y"])
    ok = (x >= -4) & (x < 3) & (y >= -1) & (y < 3)
    assert np.array_equal(h.values(), np.histogram2d(x[ok], y[ok], [a.edges(), b.edges()])[0])
    c = Histogram.fill(spark.createDataFrame([("u",), ("v",), ("u",), ("z",), (None,)], "s string"), [Axis.category(["u", "v"])], ["s"])
    assert c.values().tolist() == [2, 1] and c.values(flow=True).tolist() == [0, 2, 1, 1] and c.axis()[0] == "u" and c.axis().traits["discrete"]


def test_axes():
    a = Axis.variable([0, 1, 2, 3])
    assert a.edges_ == () and a.width == 1 and a[1] == (1.0, 2.0) and a.edges(flow=True)[0] == -np.inf
    v = Axis.variable([0, 1, 4])
    assert v.width == 2 and v.centers().tolist() == [0.5, 2.5] and v.widths().tolist() == [1, 3] and len(v) == 2
    for bad in (lambda: Axis.regular(0, 0, 1), lambda: Axis.variable([1]), lambda: Axis.variable([2, 1])):
        with pytest.raises(ValueError):
            bad()


def test_numpy_histograms(spark):
    counts, edges = np.histogram([1, 1, 2, 5], bins=4, range=(0, 8))
    h = from_numpy(counts, edges)
    assert h.to_numpy()[0].tolist() == counts.tolist() and h.stats["sumwx"] == (counts * (edges[:-1] + edges[1:]) / 2).sum()
    assert h.to_frame(spark).count() == 6 and from_numpy(*np.histogramdd(np.eye(3), bins=2)).values().sum() == 3


@pytest.mark.parametrize("mode", ["", "s", "i", "g"])
@pytest.mark.parametrize("weight", [None, "w"])
def test_profiles(rows, mode, weight):
    frame, x, y, w = rows
    a = Axis.regular(4, -4, 4)
    p = Profile.fill(frame, [a], ["x"], "y", weight, mode)
    w = w if weight else np.ones(len(x))
    for k in range(4):
        lo, hi = a[k]
        m = (x >= lo) & (x < hi)
        sw, sw2 = w[m].sum(), (w[m] ** 2).sum()
        mean = (w[m] * y[m]).sum() / sw
        s = np.sqrt(abs((w[m] * y[m] ** 2).sum() / sw - mean**2))
        n = sw**2 / sw2 if weight else sw
        want = {"": s / np.sqrt(n), "s": s, "i": s / np.sqrt(n) if s else 1 / np.sqrt(12 * n), "g": 1 / np.sqrt(sw)}[mode]
        assert p.values()[k] == pytest.approx(mean) and p.effective_counts()[k] == pytest.approx(n) and p.errors()[k] == pytest.approx(want)
    empty = Profile([Axis.regular(1, 0, 1)], np.zeros(3), None, np.zeros(3), np.zeros(3), mode)
    assert empty.values().tolist() == [0] and empty.errors().tolist() == [0]


def test_known_profile():
    # Values of a two-dimensional profile: means 1, 2, 0 and 2, 4, 6.
    shape = (4, 5)
    sums = np.zeros(shape)
    sums[1:3, 1:4] = [[2, 4, 0], [2, 1, 3]]
    means = np.zeros(shape)
    means[1:3, 1:4] = [[1, 2, 0], [2, 4, 6]]
    p = Profile([Axis.regular(2, 1, 3), Axis.regular(3, 1, 4)], sums, None, sums * means, sums * means**2)
    assert p.values().tolist() == [[1, 2, 0], [2, 4, 6]] and p.counts().sum() == 12 and not p.errors().any()


def test_graphs(spark):
    points = spark.createDataFrame([(0.5, 1.0, 0.5, 0.5), (1.5, 3.0, 0.5, 0.5)], "x double, y double, exl double, exh double")
    values, edges = graph.points_to_numpy(points)
    assert values.tolist() == [1, 3] and edges.tolist() == [0, 1, 2]
    with pytest.raises(ValueError, match="both"):
        graph.as_graph(points, x_errors="exl")
    with pytest.raises(ValueError, match="one point"):
        graph.as_graph(points.where("x < 0"))
    assert graph.as_graph(points).columns == ["x", "y", *graph.ERRORS]


@pytest.mark.parametrize("n", [1, 3, 200])
def test_interpolation(spark, n):
    rng = np.random.default_rng(n)
    xs, ys = np.sort(rng.uniform(0, 10, n)).tolist(), rng.uniform(0, 1, n).tolist()
    at = rng.uniform(-1, 11, 50).tolist() + [xs[0], xs[-1]]
    got = graph.interpolate(spark.createDataFrame([(v,) for v in at], "a double"), F.col("a"), xs, ys).collect()
    assert all(r.value == pytest.approx(np.interp(r.a, xs, ys), abs=1e-9) for r in got)


def test_packed(spark):
    times = [datetime.datetime(1995, 1, 1, 0, 0, 0), datetime.datetime(2058, 12, 31, 23, 59, 59), datetime.datetime(2020, 2, 29, 12, 30, 1)]
    t = spark.createDataFrame([(x,) for x in times], "t timestamp_ntz")
    assert [r[0] for r in t.select(packed.unpack_datime(packed.pack_datime(F.col("t")))).collect()] == times
    v = spark.createDataFrame([(0,), (-1,), (5,), (-(2**40),)], "v long")
    assert all(r[0] == r[1] for r in v.select("v", packed.unzigzag(packed.zigzag(F.col("v")))).collect())
    q = spark.range(0, 256).select(packed.quantise(packed.dequantise(F.col("id"), -1.0, 3.0, 8), -1.0, 3.0, 8).alias("q"), "id")
    assert q.where("q <> id").count() == 0
    assert spark.sql("select array(3L, 1L, -2L) d").select(packed.undelta(F.col("d"))).first()[0] == [3, 4, 2]
