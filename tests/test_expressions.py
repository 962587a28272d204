"""The language against NumPy: every function and operator over ordinary and extreme operands."""

import itertools
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.numeric import FUNCTIONS
from quern.plans.language import Compiler, ExpressionError, custom

REAL = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, math.nan, 1e308, 5e-324, 2.5, 3.5, -0.4, 0.3, -2.5, 7.0, 1e-5, 123456.789]
INT = [0, 1, -1, 2, -2, 3, -7, 7, 2**31 - 1, -(2**31), 5]
LONG = [0, 1, -1, 7, -7, 2**63 - 1, -(2**63), 2**31, 3]

OPERATORS = [
    *(f"{a}{op}{b}" for a, b in ("xy", "ij", "lm") for op in ("+", "-", "*", "//", "%", "<", "<=", ">", ">=", "==", "!=")), "x/y", "i/j", "x**2", "i**2", "i**3", "l**3",
    "i&j", "i|j", "i^j", "~i", "-i", "-l", "-x", "i<<3", "i>>2", "l<<m", "l>>m", "i+1", "i*2.5", "f+1", "f*1.5", "f/3", "f+i", "(x>1)&(y>1)", "~(x>1)", "(i>1)+(j>1)",
]
UNARY = "absolute arccos arccosh arcsin arcsinh arctan arctanh cbrt ceil conj conjugate cos cosh exp exp2 expm1 fabs floor isfinite isinf isnan log log10 log1p log2 rint round signbit sin sinh sqrt tan tanh trunc real imag".split()
BINARY = "arctan2 copysign fmax fmin hypot logical_and logical_or nextafter".split()
CALLS = [*(f"{f}(x)" for f in UNARY), *(f"{f}(x,y)" for f in BINARY), "abs(x)", "abs(i)", "sqrt(i)", "log(i)", "fmax(i,j)", "where(x<y,x,y)", "where(i>0,i,2.5)", "round(x,1)"]


@pytest.fixture(scope="module")
def data(spark):
    pairs, ints, longs = (list(itertools.product(v, v)) for v in (REAL, INT, LONG))
    rows = [(*pairs[k], *ints[k % len(ints)], *longs[k % len(longs)]) for k in range(len(pairs))]
    frame = spark.createDataFrame(rows, "x double, y double, i int, j int, l long, m long").withColumn("f", F.col("x").cast("float")).cache()
    raw = np.array(rows, dtype=object)
    env = {"x": raw[:, 0].astype(float), "y": raw[:, 1].astype(float), "i": raw[:, 2].astype(np.int32), "j": raw[:, 3].astype(np.int32), "l": raw[:, 4].astype(np.int64), "m": raw[:, 5].astype(np.int64)}
    env["f"] = env["x"].astype(np.float32)
    env |= {k: getattr(np, k) for k in [*UNARY, *BINARY, "abs", "where"]}
    return frame, env


def same(got, want):
    if want.dtype == bool:
        return got.astype(bool) == want
    if want.dtype.kind == "f":
        g, w = got.astype(float), want.astype(float)
        close = np.abs(g - w) <= np.abs(w) * (1e-6 if want.dtype.itemsize <= 4 else 1e-12) + 1e-15
        return (np.isnan(g) & np.isnan(w)) | ((g == w) & (np.signbit(g) == np.signbit(w))) | (close & (w != 0)) | (close & (np.abs(w) < 1e-300))
    return got.astype(np.int64) == want.astype(np.int64)


@pytest.mark.parametrize("part", range(0, len(OPERATORS + CALLS), 24))
def test_against_numpy(data, part):
    frame, env = data
    texts = (OPERATORS + CALLS)[part : part + 24]
    compiler = Compiler(frame.schema)
    got = frame.select(*[compiler.compile(t).col.alias(f"c{k}") for k, t in enumerate(texts)]).toPandas()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for k, t in enumerate(texts):
            want = np.asarray(eval(t, {}, env))
            ok = same(got[f"c{k}"].to_numpy(), want)
            assert ok.all(), (t, [(env["x"][r], env["y"][r], env["i"][r], env["j"][r], env["l"][r], env["m"][r], got[f"c{k}"][r], want[r]) for r in np.flatnonzero(~ok)[:3]])


def test_the_table_is_whole():
    names = "abs absolute acos arccos acosh arccosh asin arcsin asinh arcsinh atan atan2 arctan arctan2 atanh arctanh cbrt ceil conj conjugate copysign cos cosh erf erfc exp exp2 expm1 fabs factorial floor fmax fmin gamma hypot imag isfinite isinf isnan lgamma log log10 log1p log2 logical_and logical_or neg nextafter real rint round signbit sin sinh sqrt tan tanh tgamma trunc where".split()
    assert set(names) == set(FUNCTIONS)


def test_special_functions(spark):
    frame = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 5, 10, 21)], "x double")
    compiler = Compiler(frame.schema)
    got = frame.select(*[compiler.compile(t).col.alias(n) for n, t in (("f", "factorial(x)"), ("e", "erf(x)"), ("g", "gamma(x + 1)"), ("l", "lgamma(x + 1)"))]).collect()
    for r, n in zip(got, (0, 1, 2, 3, 5, 10, 21), strict=True):
        assert r.f == pytest.approx(math.factorial(n), rel=1e-8)
        assert r.e == pytest.approx(math.erf(n), abs=2e-7)
        assert r.g == pytest.approx(math.gamma(n + 1), rel=1e-8) and r.l == pytest.approx(math.lgamma(n + 1), abs=1e-8)


@pytest.mark.parametrize("text, hint", [
    ("x and y", "&"), ("not x", "~"), ("1 < x < 2", "chained"), ("x if y else 1", "where"), ("x @ y", "matrix"), ("x.foo()", "called"), ("[x]", "List"), ("x = 1", "one expression"),
    ("lambda: x", "Lambda"), ("x[0]", "entry_start"), ("i ** -1", "negative"), ("get(x)", "constant"), ("x & y", "whole numbers"), ("99999999999999999999", "64 bits"),
])
def test_refused(data, text, hint):
    with pytest.raises(ExpressionError, match=hint):
        Compiler(data[0].schema).compile(text)


def test_names(spark):
    frame = spark.createDataFrame([(1, (2, 3), "s")], "`a.b` int, p struct<c:int,d:int>, s string")
    compiler = Compiler(frame.schema, {"twice": "p.c * 2", "u": "v", "v": "u", "s": "p.d"})
    value = lambda t: frame.select(compiler.compile(t).col).first()[0]
    assert (value("a.b + 1"), value("twice + p.d"), value("get('p/c')"), value("s")) == (2, 7, 2, "s")
    with pytest.raises(ExpressionError, match="circle"):
        compiler.compile("u")
    with pytest.raises(KeyError, match="twice"):
        compiler.compile("twise")
    assert compiler.symbols("twice + p.d") == {"p.c", "p.d"}


def test_lists(spark):
    frame = spark.createDataFrame([(k, [10 * j + k for j in range(k % 3 + 1)], [[float(k)], []]) for k in range(6)] + [(9, [], [])], "k int, v array<int>, w array<array<double>>")
    compiler = Compiler(frame.schema, functions={**FUNCTIONS, "half": custom(lambda c: c / 2, "double")})
    run = lambda t: [r[0] for r in frame.select(compiler.compile(t).col).collect()]
    assert run("v + k")[1] == [2, 12] and run("v * v")[2] == [4, 144, 484] and run("v + k")[6] == []
    assert run("w + 1")[3] == [[4.0], []] and run("w * k")[2] == [[4.0], []] and run("w.sum()")[4] == [4.0, 0.0]
    assert run("v[v > 5]")[2] == [12, 22] and run("v.sum()")[2] == 36 and run("v.max()")[6] is None and run("v.count()")[6] == 0
    assert run("v[:, 0]")[6] is None and run("v[:, -1]")[2] == 22 and run("v[:, 1:]")[2] == [12, 22] and run("half(v)")[1] == [0.5, 5.5]
    assert run("where(v > 5, v, 0)")[2] == [0, 12, 22] and run("(v > 5).any()")[2] is True
    with pytest.raises(Exception, match="different lengths"):
        frame.where("k = 2").select(compiler.compile("v + v[v > 5]").col).collect()


def test_nulls_stay(spark):
    frame = spark.createDataFrame([(None, 1.0)], "a double, b double")
    compiler = Compiler(frame.schema)
    texts = ["a + b", "a / b", "a % b", "a // b", "a ** b", "a < b", "fmax(a, b)", "where(a, b, b)", "log(a)", "sqrt(a)", "ceil(a)", "isfinite(a)", "nextafter(a, b)"]
    assert list(frame.select(*[compiler.compile(t).col for t in texts]).first()) == [None] * len(texts)


def test_null_over_zero_is_null(spark):
    frame = spark.createDataFrame([(None, None, 0.0, -0.0)], "a double, i int, b double, c double")
    compiler = Compiler(frame.schema)
    texts = ["a / 0.0", "a / -0.0", "i / 0.0", "i / 0", "a / b", "a / c"]
    assert list(frame.select(*[compiler.compile(t).col for t in texts]).first()) == [None] * len(texts)
