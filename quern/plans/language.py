"""The expression language: Python syntax, compiled from its syntax tree to Spark columns; nothing is evaluated in Python.

Names are columns, paths of nested fields (``a.b``, ``a/b`` by ``get("a/b")``) or aliases; columns come before aliases,
and in the place of a called name functions come first.  Operands may be flat or list-valued: operations go element by
element to any depth, a flat operand standing beside every element, and lists that meet must have equal lengths.
``and``, ``or``, ``not``, chained comparisons and ``x if c else y`` have no element-wise meaning and are refused with
the form to use instead.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import numeric
from quern.functions.filters import KeyInTableError
from quern.functions.numeric import FUNCTIONS, Typed

BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^", ast.LShift: "<<", ast.RShift: ">>"}
COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
REDUCERS = ("sum", "min", "max", "any", "all", "count")


class ExpressionError(ValueError):
    """An expression that the language refuses."""


@dataclass(frozen=True)
class Value:
    """A compiled expression: its column, the kind of its elements and how many list levels are around them."""

    col: Column
    kind: str
    depth: int = 0
    const: object = None

    @property
    def typed(self) -> Typed:
        return Typed(self.col, self.kind, self.const)


def value_of(col: Column, kind: T.DataType) -> Value:
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    return Value(col, kind.simpleString(), depth)


def field_type(schema: T.StructType, path: list[str]) -> T.DataType | None:
    """The type at a path of field names; a field of structs in a list is a list of that field."""
    here: T.DataType = schema
    levels = 0
    for name in path:
        while isinstance(here, T.ArrayType):
            here, levels = here.elementType, levels + 1
        if not isinstance(here, T.StructType) or name not in here.names:
            return None
        here = here[name].dataType
    for _ in range(levels):
        here = T.ArrayType(here)
    return here


def quoted(path: list[str]) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in path)


def lift(build: Callable[..., Typed], *args: Value) -> Value:
    """Applies an element-wise builder at the depth of the deepest operand."""
    depth = max((a.depth for a in args), default=0)
    if depth == 0:
        out = build(*[a.typed for a in args])
        return Value(out.col, out.kind, 0, out.value)
    kinds: list[str] = []

    def inner(parts: list[Value]) -> Column:
        got = lift(build, *parts)
        kinds.append(got.kind)
        return got.col

    deep = [i for i, a in enumerate(args) if a.depth == depth]
    lead = args[deep[0]]
    under = lambda a, c: replace(a, col=c, depth=a.depth - 1, const=None)
    if len(deep) == 1:
        col = F.transform(lead.col, lambda x: inner([under(a, x) if i == deep[0] else a for i, a in enumerate(args)]))
    else:
        if len(deep) == 2:
            other = args[deep[1]]
            col = F.zip_with(lead.col, other.col, lambda x, y: inner([under(a, x) if i == deep[0] else under(a, y) if i == deep[1] else a for i, a in enumerate(args)]))
        else:
            col = F.transform(lead.col, lambda x, k: inner([(under(a, x) if i == deep[0] else under(a, F.get(a.col, k))) if i in deep else a for i, a in enumerate(args)]))
        same = F.lit(True)
        for i in deep[1:]:
            same = same & (F.size(lead.col) == F.size(args[i].col))
        col = F.when(same, col).when(~same, F.raise_error(F.lit("lists of different lengths meet in an expression")))
    return Value(col, kinds[-1], depth)


def reduce_list(name: str, a: Value) -> Value:
    """A reduction over the innermost lists; of empty lists: 0 for sum and count, null for min and max."""
    if a.depth < 1:
        raise ExpressionError(f"{name} needs a list-valued expression")
    if a.depth > 1:
        kinds: list[str] = []

        def inner(x: Column) -> Column:
            got = reduce_list(name, replace(a, col=x, depth=a.depth - 1))
            kinds.append(got.kind)
            return got.col

        col = F.transform(a.col, inner)
        return Value(col, kinds[-1], a.depth - 1)
    if name == "count":
        return Value(F.size(a.col).cast("bigint"), "bigint")
    if name in ("any", "all"):
        test = lambda x: numeric.truth(Typed(x, a.kind))
        return Value(F.exists(a.col, test) if name == "any" else F.forall(a.col, test), "boolean")
    if name == "sum":
        kind = a.kind if a.kind in numeric.FLOATS else "bigint"
        start = F.lit(0.0) if kind in numeric.FLOATS else F.lit(0).cast("bigint")
        add = (lambda s, x: s + x.cast("double")) if kind in numeric.FLOATS else (lambda s, x: numeric.arithmetic("+", Typed(s, "bigint"), Typed(x.cast("bigint"), "bigint")).col)
        return Value(F.aggregate(a.col, start, add).cast(kind), kind)
    if a.kind in numeric.FLOATS:  # NaN spreads, as in array reductions
        plain = F.array_max(a.col) if name == "max" else F.array_min(a.col)
        return Value(F.when(F.exists(a.col, F.isnan), numeric.nan().cast(a.kind)).otherwise(plain), a.kind)
    return Value(F.array_max(a.col) if name == "max" else F.array_min(a.col), a.kind)


def masked(a: Value, mask: Value) -> Value:
    """Elements of a list-valued expression where a mask of its shape is true."""
    if mask.depth > a.depth or mask.depth < 1:
        raise ExpressionError("an element-wise selection needs a list-valued mask no deeper than its operand")
    if mask.depth > 1:
        col = F.zip_with(a.col, mask.col, lambda x, m: masked(replace(a, col=x, depth=a.depth - 1), replace(mask, col=m, depth=mask.depth - 1)).col)
    else:
        ok = lambda i: numeric.truth(Typed(F.get(mask.col, i), mask.kind))
        col = F.filter(a.col, lambda x, i: ok(i))
    same = F.size(a.col) == F.size(mask.col)
    return Value(F.when(same, col).when(~same, F.raise_error(F.lit("a mask has another length than its list"))), a.kind, a.depth)


@dataclass
class Compiler:
    """Compiles expressions over a schema."""

    schema: T.StructType
    aliases: Mapping[str, str] = field(default_factory=dict)
    functions: Mapping[str, Callable[..., Typed]] = field(default_factory=lambda: FUNCTIONS)
    warnings: list[str] = field(default_factory=list)
    _open: list[str] = field(default_factory=list)

    def known(self) -> list[str]:
        out: list[str] = []

        def walk(kind: T.DataType, at: str) -> None:
            while isinstance(kind, T.ArrayType):
                kind = kind.elementType
            if isinstance(kind, T.StructType):
                for f in kind.fields:
                    out.append(at + f.name)
                    walk(f.dataType, at + f.name + ".")

        walk(self.schema, "")
        return [*out, *self.aliases]

    def column(self, name: str) -> Value | None:
        for path in ([name], name.split("."), name.strip("/").split("/")):
            if (kind := field_type(self.schema, path)) is not None:
                return value_of(F.col(quoted(path)), kind)
        return None

    def name(self, name: str) -> Value:
        if (got := self.column(name)) is not None:
            if name in self.aliases:
                self.warnings.append(f"{name!r} is both a column and an alias; the column is used")
            return got
        if name in self.aliases:
            if name in self._open:
                raise ExpressionError(f"aliases refer to each other in a circle: {' -> '.join([*self._open, name])}")
            self._open.append(name)
            try:
                return self.compile(self.aliases[name])
            finally:
                self._open.pop()
        raise KeyInTableError(name, self.known())

    def compile(self, text: str) -> Value:
        """Compiles one expression."""
        if not text.isidentifier() and (got := self.column(text)) is not None:
            return got
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as e:
            raise ExpressionError(f"not one expression: {text!r} ({e.msg})") from None
        return self.visit(tree.body)

    def symbols(self, text: str) -> set[str]:
        """Names that an expression reads, aliases followed down to columns."""
        found: set[str] = set()
        outer = self

        class Spy(Compiler):
            def column(self, name: str) -> Value | None:
                got = outer.column(name)
                if got is not None:
                    found.add(name)
                return got

        Spy(self.schema, self.aliases, self.functions).compile(text)
        return found

    def visit(self, node: ast.AST) -> Value:
        method = getattr(self, f"_{type(node).__name__}", None)
        if method is None:
            raise ExpressionError(f"{ast.unparse(node)!r}: {type(node).__name__} is not part of the language")
        return method(node)

    def _Constant(self, node: ast.Constant) -> Value:
        v = node.value
        if isinstance(v, bool):
            return Value(F.lit(v), "boolean", 0, v)
        if isinstance(v, int):
            if not -(1 << 63) <= v < 1 << 63:
                raise ExpressionError(f"{v} has more than 64 bits")
            return Value(F.lit(v), "weak_int", 0, v)
        if isinstance(v, float):
            return Value(F.lit(v), "weak_float", 0, v)
        if isinstance(v, str):
            return Value(F.lit(v), "string", 0, v)
        raise ExpressionError(f"{v!r} is no constant of the language")

    def _dotted(self, node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (base := self._dotted(node.value)) is not None:
            return f"{base}.{node.attr}"
        return None

    def _Name(self, node: ast.Name) -> Value:
        return self.name(node.id)

    def _Attribute(self, node: ast.Attribute) -> Value:
        name = self._dotted(node)
        if name is None:
            raise ExpressionError(f"{ast.unparse(node)!r}: only names have fields")
        return self.name(name)

    def _UnaryOp(self, node: ast.UnaryOp) -> Value:
        if isinstance(node.op, ast.Not):
            raise ExpressionError("'not' has no element-wise meaning; use ~")
        a = self.visit(node.operand)
        if isinstance(node.op, ast.UAdd):
            return lift(numeric._same, a) if a.const is None else a
        return lift(numeric.negate if isinstance(node.op, ast.USub) else numeric.invert, a)

    def _BinOp(self, node: ast.BinOp) -> Value:
        op = BINARY.get(type(node.op))
        if op is None:
            raise ExpressionError("'@' (matrix product) has no meaning for columns of scalars and lists")
        a, b = self.visit(node.left), self.visit(node.right)
        try:
            if op in numeric.ARITHMETIC:
                return lift(numeric.ARITHMETIC[op], a, b)
            if op in ("<<", ">>"):
                return lift(lambda x, y: numeric.shift(op, x, y), a, b)
            return lift(lambda x, y: numeric.bitwise(op, x, y), a, b)
        except (TypeError, ValueError) as e:
            raise ExpressionError(f"{ast.unparse(node)!r}: {e}") from None

    def _Compare(self, node: ast.Compare) -> Value:
        if len(node.ops) > 1:
            raise ExpressionError("chained comparisons have no element-wise meaning; join two with &")
        op = COMPARE.get(type(node.ops[0]))
        if op is None:
            raise ExpressionError("'in' and 'is' are not part of the language")
        return lift(lambda x, y: numeric.compare(op, x, y), self.visit(node.left), self.visit(node.comparators[0]))

    def _BoolOp(self, node: ast.BoolOp) -> Value:
        raise ExpressionError("'and' and 'or' have no element-wise meaning; use & and | with parentheses")

    def _IfExp(self, node: ast.IfExp) -> Value:
        raise ExpressionError("'x if c else y' has no element-wise meaning; use where(c, x, y)")

    def _Call(self, node: ast.Call) -> Value:
        if node.keywords:
            raise ExpressionError("functions take no keyword arguments")
        if isinstance(node.func, ast.Attribute):
            if self._dotted(node.func) not in self.functions and node.func.attr in REDUCERS and not node.args:
                return reduce_list(node.func.attr, self.visit(node.func.value))
            raise ExpressionError(f"only {', '.join(REDUCERS)} can be called on a value")
        if not isinstance(node.func, ast.Name):
            raise ExpressionError("only named functions can be called")
        name = node.func.id
        if name == "get":
            if len(node.args) != 1 or not isinstance(node.args[0], ast.Constant) or not isinstance(node.args[0].value, str):
                raise ExpressionError("get takes one constant string")
            return self.name(node.args[0].value)
        if name not in self.functions:
            raise KeyInTableError(name, self.functions, "function table")
        if field_type(self.schema, [name]) is not None or name in self.aliases:
            self.warnings.append(f"{name!r} is both a function and a name; the function is called")
        args = [self.visit(a) for a in node.args]
        try:
            return lift(self.functions[name], *args)
        except TypeError as e:
            raise ExpressionError(f"{ast.unparse(node)!r}: {e}") from None

    def _Subscript(self, node: ast.Subscript) -> Value:
        a, at = self.visit(node.value), node.slice
        if isinstance(at, ast.Tuple) and len(at.elts) == 2 and isinstance(at.elts[0], ast.Slice) and not any((at.elts[0].lower, at.elts[0].upper, at.elts[0].step)):
            if a.depth < 1:
                raise ExpressionError("only list-valued expressions have elements")
            return self._element(a, at.elts[1])
        if isinstance(at, (ast.Slice, ast.Tuple)):
            raise ExpressionError("rows are chosen by entry_start and entry_stop; elements by x[:, i] or x[:, a:b]")
        mask = self.visit(at)
        if mask.const is not None or mask.kind != "boolean":
            raise ExpressionError("rows are chosen by entry_start and entry_stop; x[...] takes a list-valued mask")
        return masked(a, mask)

    def _element(self, a: Value, at: ast.AST) -> Value:
        def whole(n: ast.AST | None) -> int | None:
            if n is None:
                return None
            got = self.visit(n).const
            if not isinstance(got, int) or isinstance(got, bool):
                raise ExpressionError("element numbers are constant whole numbers")
            return got

        if not isinstance(at, ast.Slice):
            k = whole(at)
            return Value(F.get(a.col, F.lit(k) if k >= 0 else F.size(a.col) + k), a.kind, a.depth - 1)
        low, high, step = whole(at.lower), whole(at.upper), whole(at.step)
        if step not in (None, 1):
            raise ExpressionError("slices of elements have no step")
        n = F.size(a.col)
        bound = lambda k, default: default if k is None else F.least(F.lit(k), n) if k >= 0 else F.greatest(n + k, F.lit(0))
        first, last = bound(low, F.lit(0)), bound(high, n)
        return Value(F.slice(a.col, first + 1, F.greatest(last - first, F.lit(0))), a.kind, a.depth)


def custom(function: Callable[..., Column], kind: str) -> Callable[..., Typed]:
    """Makes a function of columns (a built-in composition or a vectorised UDF) callable in expressions."""
    return lambda *args: Typed(function(*[a.col for a in args]).cast(kind), kind)
