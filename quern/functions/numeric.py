"""Element-wise arithmetic with array semantics, as Spark columns.

Every builder takes plain (not list-valued) columns and their kinds, and gives a column and its kind.  Kinds are names
of Spark's simple types; ``weak_int`` and ``weak_float`` are constants of the language, which take on the other operand's
kind.  Semantics are those of fixed-width array arithmetic: whole numbers wrap, a division by zero gives infinity or NaN
(0 for whole-number division), comparisons with NaN are false, logarithms of what they are not defined for are -inf or
NaN.  Forms are guarded so that they hold whether ANSI mode is on or off, and they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INTS = ("tinyint", "smallint", "int", "bigint")
FLOATS = ("float", "double")
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
INF = float("inf")


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: str
    value: object = None  # of a constant


def nan() -> Column:
    return F.lit(float("nan"))


def settle(kind: str) -> str:
    return {"weak_int": "bigint", "weak_float": "double"}.get(kind, kind)


def promote(a: str, b: str) -> str:
    """The common kind of two operands."""
    if a.startswith("decimal"):
        a = "double"
    if b.startswith("decimal"):
        b = "double"
    if a == b:
        return a
    for x, y in ((a, b), (b, a)):
        if x == "weak_int":
            return y if y != "boolean" else "bigint"
        if x == "weak_float":
            return y if y in FLOATS else "double"
    if "boolean" in (a, b):
        return a if b == "boolean" else b
    if a in INTS and b in INTS:
        return max(a, b, key=INTS.index)
    if a in FLOATS and b in FLOATS:
        return "double"
    whole = a if a in INTS else b
    real = b if a in INTS else a
    if whole in INTS and real in FLOATS:
        return "float" if real == "float" and whole in ("tinyint", "smallint") else "double"
    raise TypeError(f"no common numeric kind of {a} and {b}")


def real_kind(kind: str) -> str:
    """The floating kind that a real-valued function of this kind has."""
    return {"boolean": "float", "tinyint": "float", "smallint": "float", "float": "float"}.get(kind, "double")


def to(x: Typed, kind: str) -> Column:
    if x.kind == kind:
        return x.col
    if x.value is not None and kind in (*INTS, *FLOATS):
        return F.lit(x.value).cast(kind)
    return x.col.cast(kind)


def wrap(value: Column, kind: str) -> Column:
    """A bigint brought into the range of a narrower kind, modulo its size."""
    if kind == "bigint":
        return value
    half = 1 << BITS[kind] - 1
    return ((value + F.lit(half)).bitwiseAND(F.lit(2 * half - 1)) - F.lit(half)).cast(kind)


def _wrap_wide(value: Column) -> Column:
    """A decimal of up to 38 digits as a bigint modulo 2^64."""
    size, half = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (64, 63))
    low = F.pmod(value, size)
    return F.when(low >= half, low - size).otherwise(low).cast("bigint")


def _whole(op: str, a: Typed, b: Typed, kind: str) -> Column:
    x, y = to(a, "bigint"), to(b, "bigint")
    if kind != "bigint":
        return wrap({"+": x + y, "-": x - y, "*": x * y}[op], kind)
    dec = lambda c: c.cast("decimal(20,0)")
    if op == "+":
        return F.coalesce(F.try_add(x, y), _wrap_wide(dec(x) + dec(y)))
    if op == "-":
        return F.coalesce(F.try_subtract(x, y), _wrap_wide(dec(x) - dec(y)))
    mask, ten = F.lit((1 << 32) - 1), "decimal(10,0)"
    lo = lambda c: c.bitwiseAND(mask).cast(ten)
    hi = lambda c: F.shiftrightunsigned(c, 32).cast(ten)
    cross = F.pmod(hi(x) * lo(y) + lo(x) * hi(y), F.lit(1 << 32).cast("decimal(11,0)")).cast(ten)
    return F.coalesce(F.try_multiply(x, y), _wrap_wide((lo(x) * lo(y)).cast("decimal(37,0)") + (cross * F.lit(1 << 32).cast(ten)).cast("decimal(37,0)")))


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    kind = promote(a.kind, b.kind)
    if kind == "boolean":
        if op == "-":
            raise TypeError("booleans can't be subtracted; use ^")
        return Typed(a.col | b.col if op == "+" else a.col & b.col, "boolean")
    if kind in ("weak_int", "weak_float"):
        kind = settle(kind)
    if kind in FLOATS:
        x, y = to(a, kind), to(b, kind)
        return Typed({"+": x + y, "-": x - y, "*": x * y}[op].cast(kind), kind)
    return Typed(_whole(op, a, b, kind), kind)


def sign_of(x: Column) -> Column:
    """True where the sign bit is set, also for -0.0."""
    return (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))


def divide(a: Typed, b: Typed) -> Typed:
    kind = promote(settle(a.kind), settle(b.kind)) if not (a.kind.startswith("weak") ^ b.kind.startswith("weak")) else promote(a.kind, b.kind)
    kind = kind if kind in FLOATS else "double"
    x, y = to(a, kind).cast("double"), to(b, kind).cast("double")
    by_zero = F.when((x == 0) | F.isnan(x), nan()).when((x < 0) != sign_of(y), F.lit(-INF)).when(x.isNotNull(), F.lit(INF))
    return Typed(F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y)).cast(kind), kind)


def _fmod(x: Column, y: Column) -> Column:
    return F.when((y == 0) | F.isnan(y) | (F.abs(x) == INF), nan()).otherwise(x % F.when(y != 0, y))


def modulo(a: Typed, b: Typed) -> Typed:
    kind = settle(promote(a.kind, b.kind))
    if kind == "boolean":
        kind = "tinyint"
    x, y = to(a, kind), to(b, kind)
    if kind in FLOATS:
        r = _fmod(x.cast("double"), y.cast("double"))
        d = y.cast("double")
        out = F.when(r == 0, F.when(sign_of(d), F.lit(-0.0)).otherwise(F.lit(0.0))).when((r < 0) != (d < 0), r + d).otherwise(r)
        return Typed(F.when(F.isnan(r), r).otherwise(out).cast(kind), kind)
    safe = F.when(~y.isin(0, -1), y).cast("bigint")
    r = x.cast("bigint") % safe
    return Typed(F.when(y.isin(0, -1), F.lit(0)).otherwise(F.when((r != 0) & ((r < 0) != (y < 0)), r + y.cast("bigint")).otherwise(r)).cast(kind), kind)


def floor_divide(a: Typed, b: Typed) -> Typed:
    kind = settle(promote(a.kind, b.kind))
    if kind == "boolean":
        kind = "tinyint"
    x, y = to(a, kind), to(b, kind)
    if kind in FLOATS:
        x, y = x.cast("double"), y.cast("double")
        r = _fmod(x, y)
        q = (x - r) / F.when(y != 0, y)
        q = F.when((r != 0) & ((r < 0) != (y < 0)), q - 1).otherwise(q)
        low = floating_floor(q)
        low = F.when(q == 0, F.when(sign_of(x) != sign_of(y), F.lit(-0.0)).otherwise(F.lit(0.0))).when(q - low > 0.5, low + 1).otherwise(low)
        return Typed(F.when(y == 0, divide(Typed(x, "double"), Typed(y, "double")).col).when(F.isnan(r), nan()).otherwise(low).cast(kind), kind)
    wide, by = x.cast("bigint"), F.when(~y.isin(0, -1), y).cast("bigint")
    r = wide % by
    q = _div(wide, by)
    q = F.when((r != 0) & ((r < 0) != (y < 0)), q - 1).otherwise(q)
    return Typed(wrap(F.when(y == 0, F.lit(0)).when(y == -1, _whole("-", Typed(F.lit(0).cast("bigint"), "bigint"), Typed(wide, "bigint"), "bigint")).otherwise(q), kind), kind)


def _div(x: Column, y: Column) -> Column:
    """Whole-number quotient toward zero."""
    return F.call_function("div", x, y)


def power(a: Typed, b: Typed) -> Typed:
    kind = settle(promote(a.kind, b.kind))
    if kind == "boolean":
        kind = "tinyint"
    if kind in FLOATS:
        x, y = to(a, kind).cast("double"), to(b, kind).cast("double")
        return Typed(F.when(F.isnan(y) & (x == 1), F.lit(1.0)).when((x == -1) & (F.abs(y) == INF), F.lit(1.0)).otherwise(F.pow(x, y)).cast(kind), kind)
    if isinstance(b.value, int):
        if b.value < 0:
            raise ValueError("whole numbers to negative whole powers are not allowed")
        if b.value <= 64:
            out, base, n = Typed(F.lit(1).cast(kind), kind), Typed(to(a, kind), kind), b.value
            while n:
                if n & 1:
                    out = base if out.value is None and n == b.value and n & 1 else arithmetic("*", out, base)
                n >>= 1
                if n:
                    base = arithmetic("*", base, base)
            return Typed(out.col, kind)
    x, y = to(a, "bigint"), to(b, "bigint")
    bits = F.sequence(F.lit(0), F.lit(6))
    state = F.struct(F.lit(1).cast("bigint").alias("out"), x.alias("base"))
    mul = lambda p, q: _whole("*", Typed(p, "bigint"), Typed(q, "bigint"), "bigint")
    ran = F.aggregate(bits, state, lambda s, k: F.struct(F.when(F.call_function("getbit", y, k) == 1, mul(s["out"], s["base"])).otherwise(s["out"]).alias("out"), mul(s["base"], s["base"]).alias("base")))
    bad = F.raise_error("whole numbers to negative whole powers are not allowed").cast("bigint")
    big = F.when(F.abs(x) <= 1, F.when((x == -1) & (y % 2 == 1), F.lit(-1)).when(x == 0, 0).otherwise(F.lit(1)).cast("bigint"))
    return Typed(wrap(F.when(y < 0, bad).when((y > 127) & (F.abs(x) <= 1), big).otherwise(ran["out"]), kind), kind)


def bitwise(op: str, a: Typed, b: Typed) -> Typed:
    kind = settle(promote(a.kind, b.kind))
    if kind in FLOATS:
        raise TypeError(f"{op} needs booleans or whole numbers")
    if kind == "boolean":
        return Typed({"&": a.col & b.col, "|": a.col | b.col, "^": a.col != b.col}[op], kind)
    x, y = to(a, kind), to(b, kind)
    return Typed({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op], kind)


def shift(op: str, a: Typed, b: Typed) -> Typed:
    kind = settle(promote(a.kind, b.kind))
    if kind not in INTS:
        raise TypeError(f"{op} needs whole numbers")
    x, n = to(a, "bigint"), to(b, "bigint")
    far = (n < 0) | (n >= BITS[kind])
    by = F.when(~far, n).otherwise(0).cast("int")
    if op == "<<":
        return Typed(wrap(F.when(far, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", x, by)), kind), kind)
    return Typed(F.when(far, F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(F.call_function("shiftright", x, by)).cast(kind), kind)


def compare(op: str, a: Typed, b: Typed) -> Typed:
    if "string" in (a.kind, b.kind):
        x, y, floating = a.col, b.col, False
    else:
        kind = promote(a.kind, b.kind)
        kind = settle(kind)
        x, y, floating = to(a, kind), to(b, kind), kind in FLOATS
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[op]
    if floating:
        either = F.isnan(x) | F.isnan(y)
        out = out | either if op == "!=" else out & ~either
    return Typed(out, "boolean")


def truth(a: Typed) -> Column:
    """Not zero; NaN is true."""
    if a.kind == "boolean":
        return a.col
    if a.kind == "string":
        return F.length(a.col) > 0
    return compare("!=", a, Typed(F.lit(0), "weak_int", 0)).col


def invert(a: Typed) -> Typed:
    if a.kind == "boolean":
        return Typed(~a.col, "boolean")
    if settle(a.kind) not in INTS:
        raise TypeError("~ needs booleans or whole numbers")
    return Typed(F.bitwise_not(to(a, settle(a.kind))), settle(a.kind))


def negate(a: Typed) -> Typed:
    if a.value is not None and not isinstance(a.value, bool):
        return Typed(F.lit(-a.value), a.kind, -a.value)
    if a.kind == "boolean":
        raise TypeError("booleans have no negative; use ~")
    if a.kind in FLOATS:
        return Typed((a.col * F.lit(-1.0)).cast(a.kind), a.kind)
    return arithmetic("-", Typed(F.lit(0), "weak_int", 0), a)


def floating_floor(x: Column) -> Column:
    """floor as a double, also beyond the whole numbers' range, keeping -0.0, infinities and NaN."""
    small = (F.abs(x) < float(1 << 52)) & (x != 0)
    low = F.floor(F.when(small, x)).cast("double")
    return F.when(small, low).otherwise(x)


def floating_ceil(x: Column) -> Column:
    small = (F.abs(x) < float(1 << 52)) & (x != 0)
    high = F.ceil(F.when(small, x)).cast("double")
    return F.when(small & (x < 0) & (x > -1), F.lit(-0.0)).when(small, high).otherwise(x)


def lgamma(x: Column) -> Column:
    """The language's own six-term series for ln gamma: good to about 1e-8 for positive numbers, NaN where the sum is negative."""
    # The series' coefficients and the root of 2 pi, as the function table has them.
    terms, root = (76.18009173, -86.50532033, 24.01409822, -1.231739516e0, 0.120858003e-2, -0.536382e-5), 2.50662827465
    pole = (x <= 0) & (x > -len(terms)) & (x == F.rint(x))  # a term divides by zero there, with its own sign
    at = F.when(~pole, x)
    total = F.lit(1.0)
    for k, c in enumerate(terms):
        total = total + F.lit(c) / (at + k)
    value = (at - 0.5) * safe_log(at + 4.5) - (at + 4.5) + safe_log(F.lit(root) * total)
    return F.when(pole, F.when(x.cast("int") % 2 == 0, F.lit(INF)).otherwise(nan())).otherwise(value)


def _safe_ratio(a: Column, b: Column) -> Column:
    return divide(Typed(a, "double"), Typed(b, "double")).col


def safe_log(x: Column, log: Callable[[Column], Column] = F.log, at: float = 0.0) -> Column:
    return F.when(F.isnan(x) | (x < at), nan()).when(x == at, F.lit(-INF)).otherwise(log(x))


def erf(x: Column) -> Column:
    """The language's polynomial of five terms (Abramowitz and Stegun 7.1.26)."""
    # The polynomial's coefficients and p.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = F.lit(1.0) / (F.abs(x) * 0.3275911 + 1.0)
    total = F.lit(0.0)
    for c in reversed(a):
        total = (total + c) * t
    value = 1.0 - total * F.exp(-(x * x))
    return F.when(x < 0, -value).otherwise(value)


def _real(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    """A real-valued function of one number."""

    def build(a: Typed) -> Typed:
        kind = real_kind(settle(a.kind))
        return Typed(f(to(a, settle(a.kind)).cast("double")).cast(kind), kind)

    return build


def _pair(f: Callable[[Column, Column], Column]) -> Callable[..., Typed]:
    def build(a: Typed, b: Typed) -> Typed:
        kind = real_kind(settle(promote(a.kind, b.kind)))
        return Typed(f(to(a, kind).cast("double"), to(b, kind).cast("double")).cast(kind), kind)

    return build


def _flag(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    return lambda a: Typed(f(to(a, settle(a.kind)).cast("double")), "boolean")


def _between(x: Column, f: Callable[[Column], Column], low: float, high: float) -> Column:
    inside = (x >= low) & (x <= high) & ~F.isnan(x)
    return F.when(inside, f(F.when(inside, x))).otherwise(nan())


def _absolute(a: Typed) -> Typed:
    kind = settle(a.kind)
    if kind in FLOATS or kind == "boolean":
        return Typed(F.abs(a.col) if kind != "boolean" else a.col, kind)
    x = to(a, "bigint")
    return Typed(wrap(F.when(x < 0, negate(Typed(x, "bigint")).col).otherwise(x), kind), kind)


def _same(a: Typed) -> Typed:
    return Typed(to(a, settle(a.kind)), settle(a.kind))


def _imaginary(a: Typed) -> Typed:
    kind = settle(a.kind)
    return Typed(F.when(a.col.isNotNull(), F.lit(0).cast("int" if kind == "boolean" else kind)), "int" if kind == "boolean" else kind)


def _round(a: Typed, digits: Typed | None = None) -> Typed:
    kind = settle(a.kind)
    n = 0 if digits is None else digits.value
    if not isinstance(n, int):
        raise TypeError("round takes a constant number of digits")
    if kind in INTS:
        return _same(a)
    x = a.col.cast("double")
    if n == 0:
        return Typed(F.rint(x).cast(kind), kind)
    by = F.lit(float(10 ** abs(n)))
    return Typed((F.rint(x * by) / by if n > 0 else F.rint(x / by) * by).cast(kind), kind)


def _where(c: Typed, a: Typed, b: Typed) -> Typed:
    kind = "string" if a.kind == b.kind == "string" else settle(promote(a.kind, b.kind))
    cast = lambda x: x.col if kind == "string" else to(x, kind)
    return Typed(F.when(c.col.isNull(), F.lit(None)).when(truth(c), cast(a)).otherwise(cast(b)), kind)


def _extreme(larger: bool) -> Callable[..., Typed]:
    def build(a: Typed, b: Typed) -> Typed:
        kind = settle(promote(a.kind, b.kind))
        x, y = to(a, kind), to(b, kind)
        pick = F.when(x >= y, x).otherwise(y) if larger else F.when(x <= y, x).otherwise(y)
        if kind in FLOATS:
            pick = F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(pick)
        return Typed(F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(pick), kind)

    return build


def _copysign(x: Column, y: Column) -> Column:
    size = F.abs(x)
    return F.when(sign_of(y), -size).otherwise(size)


def _next_after(x: Column, y: Column) -> Column:
    """The neighbouring double toward y: by exponent and a power of two, in plain arithmetic."""
    size = F.abs(x)
    tiny = F.lit(5e-324)
    exponent = F.greatest(F.floor(safe_log(size, F.log2)), F.lit(-1022))
    low = F.pow(F.lit(2.0), exponent.cast("double"))
    exponent = F.when(low > size, exponent - 1).when(low * 2 <= size, exponent + 1).otherwise(exponent)
    exponent = F.greatest(exponent, F.lit(-1022)).cast("double")
    step = F.when(size < 2.2250738585072014e-308, tiny).otherwise(F.greatest(tiny, F.pow(F.lit(2.0), exponent - 26) * F.pow(F.lit(2.0), F.lit(-26.0))))
    away = size + step
    at_power = size == F.pow(F.lit(2.0), exponent)
    toward = size - F.when(at_power & (exponent > -1022), step / 2).otherwise(step)
    top = F.lit(1.7976931348623157e308)
    grows = (y > x) == (x > 0)
    moved = F.when(size == INF, top).when(grows, F.when(size == top, F.lit(INF)).otherwise(away)).otherwise(toward)
    out = F.when(x == 0, F.when(y > 0, tiny).otherwise(-tiny)).otherwise(F.when(x < 0, -moved).otherwise(moved))
    return F.when(F.isnan(x) | F.isnan(y), nan()).when(x == y, y).otherwise(out)


def _logical(op: str) -> Callable[..., Typed]:
    return lambda a, b: Typed(truth(a) & truth(b) if op == "and" else truth(a) | truth(b), "boolean")


def _trunc(x: Column) -> Column:
    return F.when(x < 0, floating_ceil(x)).otherwise(floating_floor(x))


_ACOS, _ASIN = _real(lambda x: _between(x, F.acos, -1, 1)), _real(lambda x: _between(x, F.asin, -1, 1))
_ACOSH = _real(lambda x: F.when(F.isnan(x) | (x < 1), nan()).when(x > 1e150, F.log(x) + 0.6931471805599453).otherwise(F.acosh(x)))
_ASINH = _real(lambda x: F.when((x == 0) | F.isnan(x) | (F.abs(x) == INF), x).otherwise(_copysign(F.when(F.abs(x) > 1e150, F.log(F.abs(x)) + 0.6931471805599453).when(F.abs(x) < 1e-4, F.abs(x) - F.pow(F.abs(x), F.lit(3.0)) / 6).otherwise(F.asinh(F.abs(x))), x)))
_ATAN, _ATAN2 = _real(F.atan), _pair(lambda x, y: F.when((x == 0) & ~F.isnan(y), F.when(sign_of(y), _copysign(F.lit(3.141592653589793), x)).otherwise(x)).otherwise(F.atan2(x, y)))
_ATANH = _real(lambda x: F.when(F.isnan(x) | (F.abs(x) > 1), nan()).when(F.abs(x) == 1, x * INF).when(F.abs(x) < 1e-4, x + x * x * x / 3).otherwise(F.atanh(F.when(F.abs(x) < 1, x))))
_FABS = _real(F.abs)
_GAMMA = _real(lambda x: F.exp(lgamma(x)))

FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "abs": _absolute, "absolute": _absolute,
    "acos": _ACOS, "arccos": _ACOS, "acosh": _ACOSH, "arccosh": _ACOSH,
    "asin": _ASIN, "arcsin": _ASIN, "asinh": _ASINH, "arcsinh": _ASINH,
    "atan": _ATAN, "arctan": _ATAN, "atan2": _ATAN2, "arctan2": _ATAN2, "atanh": _ATANH, "arctanh": _ATANH,
    "cbrt": _real(F.cbrt), "ceil": _real(floating_ceil), "conj": _same, "conjugate": _same,
    "copysign": _pair(_copysign), "cos": _real(F.cos), "cosh": _real(F.cosh),
    "erf": _real(erf), "erfc": _real(lambda x: 1.0 - erf(x)),
    "exp": _real(F.exp), "exp2": _real(lambda x: F.pow(F.lit(2.0), x)), "expm1": _real(F.expm1), "fabs": _FABS,
    "factorial": _real(lambda x: F.rint(F.exp(lgamma(F.rint(x) + 1)))),
    "floor": _real(floating_floor), "fmax": _extreme(True), "fmin": _extreme(False),
    "gamma": _GAMMA, "tgamma": _GAMMA, "hypot": _pair(F.hypot), "imag": _imaginary, "real": _same,
    "isfinite": _flag(lambda x: ~F.isnan(x) & (F.abs(x) < INF)), "isinf": _flag(lambda x: F.abs(x) == INF), "isnan": _flag(F.isnan),
    "lgamma": _real(lgamma), "log": _real(safe_log), "log10": _real(lambda x: safe_log(x, F.log10)),
    "log1p": _real(lambda x: F.when(x == 0, x).otherwise(safe_log(x, F.log1p, -1.0))), "log2": _real(lambda x: safe_log(x, F.log2)),
    "logical_and": _logical("and"), "logical_or": _logical("or"), "neg": negate,
    "nextafter": _pair(_next_after), "rint": _real(F.rint), "round": _round, "signbit": _flag(sign_of),
    "sin": _real(F.sin), "sinh": _real(F.sinh), "sqrt": _real(lambda x: F.sqrt(x)),
    "tan": _real(F.tan), "tanh": _real(F.tanh), "trunc": _real(_trunc), "where": _where,
}

ARITHMETIC = {"+": lambda a, b: arithmetic("+", a, b), "-": lambda a, b: arithmetic("-", a, b), "*": lambda a, b: arithmetic("*", a, b), "/": divide, "//": floor_divide, "%": modulo, "**": power}
