"""C++ type names as Spark types, by recursive descent."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Names of primitive types and the Spark type that holds all their values.
PRIMITIVES = {
    "bool": "boolean", "Bool_t": "boolean",
    "char": "tinyint", "signed char": "tinyint", "Char_t": "tinyint", "int8_t": "tinyint", "std::byte": "tinyint",
    "unsigned char": "smallint", "UChar_t": "smallint", "uint8_t": "smallint",
    "short": "smallint", "Short_t": "smallint", "int16_t": "smallint", "unsigned short": "int", "UShort_t": "int", "uint16_t": "int",
    "int": "int", "Int_t": "int", "int32_t": "int", "unsigned int": "bigint", "unsigned": "bigint", "UInt_t": "bigint", "uint32_t": "bigint",
    "long": "bigint", "Long_t": "bigint", "Long64_t": "bigint", "int64_t": "bigint", "long long": "bigint",
    "unsigned long": "decimal(20,0)", "unsigned long long": "decimal(20,0)", "ULong_t": "decimal(20,0)", "ULong64_t": "decimal(20,0)", "uint64_t": "decimal(20,0)", "size_t": "decimal(20,0)",
    "float": "float", "Float_t": "float", "Float16_t": "float", "Real16": "float", "double": "double", "Double_t": "double", "Double32_t": "double",
    "std::string": "string", "string": "string", "TString": "string", "char*": "string", "TDatime": "timestamp_ntz", "TTime": "bigint", "TRef": "bigint",
}
SPARK_TYPES = {t.simpleString(): t for t in (T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.TimestampNTZType(), T.DecimalType(20, 0))}
_LISTS = ("vector", "list", "deque", "forward_list", "RVec", "set", "multiset", "unordered_set", "unordered_multiset")
_MAPS = ("map", "unordered_map", "multimap", "unordered_multimap")
_TOKEN = re.compile(r"\s*(\"[^\"]*\"|[A-Za-z_]\w*(?:::\w+)*|\d+|[<>,*&\[\]])")


class CppTypeError(ValueError):
    """A type name that can't be read, or that no Spark type holds."""


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CppTypeError(f"{self.text!r}: unexpected {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.k = 0

    def peek(self) -> str | None:
        return self.tokens[self.k] if self.k < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if got is None or wanted is not None and got != wanted:
            raise CppTypeError(f"{self.text!r}: expected {wanted or 'a name'}, found {got!r}")
        self.k += 1
        return got

    def arguments(self) -> list[T.DataType | int]:
        self.take("<")
        out: list[T.DataType | int] = []
        while True:
            out.append(int(self.take()) if (self.peek() or "").isdigit() else self.type())
            if self.peek() == ",":
                self.take()
                continue
            self.take(">")
            return out

    def type(self) -> T.DataType:
        words = []
        while (t := self.peek()) and re.match(r"[A-Za-z_\"]", t):
            if t not in ("const", "volatile", "struct", "class"):
                words.append(t)
            self.take()
            if self.peek() == "<":
                break
        name = " ".join(words)
        if self.peek() == "<":
            out = self.template(name.rpartition("::")[2].removeprefix("VecOps::"), self.arguments())
        elif name in PRIMITIVES or name + "*" in PRIMITIVES and self.peek() == "*":
            if name not in PRIMITIVES or name == "char" and self.peek() == "*":
                self.take("*")
                name += "*"
            out = SPARK_TYPES[PRIMITIVES[name]]
        else:
            raise CppTypeError(f"{self.text!r}: no Spark type for {name!r}")
        while self.peek() in ("*", "&", "const", "["):
            if self.take() == "[":
                if (self.peek() or "").isdigit():
                    self.take()
                self.take("]")
                out = T.ArrayType(out)
        return out

    def template(self, name: str, args: list) -> T.DataType:
        if name in _LISTS:
            return T.ArrayType(args[0])
        if name == "array":
            return T.ArrayType(args[0])
        if name in _MAPS:
            return T.MapType(args[0], args[1])
        if name == "bitset":
            return T.ArrayType(T.BooleanType())
        if name in ("pair", "tuple"):
            return T.StructType([T.StructField(f"_{i}", a) for i, a in enumerate(args)])
        if name in ("optional", "unique_ptr", "shared_ptr", "atomic", "complex"):
            return args[0] if name != "complex" else T.StructType([T.StructField(n, args[0]) for n in ("re", "im")])
        if name == "variant":  # the tag, and one nullable member per alternative
            return T.StructType([T.StructField("tag", T.IntegerType()), *[T.StructField(f"_{i}", a) for i, a in enumerate(args)]])
        raise CppTypeError(f"{self.text!r}: no Spark type for {name!r}")


def parse(text: str) -> T.DataType:
    """The Spark type of a C++ type name."""
    parser = _Parser(text)
    out = parser.type()
    if parser.peek() is not None:
        raise CppTypeError(f"{text!r}: {parser.peek()!r} is left over")
    return out
