"""Column filters, rename rules, memory sizes, and near matches of misspelt names."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

NameFilter = None | str | Callable[[str], bool] | Iterable[Any]


class KeyInTableError(KeyError):
    """A name that a table or namespace doesn't have; lists the nearest ones that it has."""

    def __init__(self, name: str, known: Iterable[str], where: str = "table"):
        self.name = name
        self.near = sorted(known, key=lambda k: (edit_distance(name, k), k))[:5]
        super().__init__(f"{name!r} is not in the {where}; near matches: {', '.join(map(repr, self.near)) or 'none'}")


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


_FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL, "x": re.VERBOSE, "a": re.ASCII, "u": re.UNICODE, "l": 0}


def is_pattern(text: str) -> bool:
    return text.startswith("/") and text.rfind("/") > 0 or any(c in text for c in "*?[")


def name_filter(spec: NameFilter) -> Callable[[str], bool]:
    """A predicate on names.

    None keeps all; ``/regex/flags`` matches at the start; a string with ``*``, ``?`` or ``[`` is a case-sensitive glob;
    another string is a name; a callable is used as it is; an iterable keeps what any of its members keeps.
    """
    if spec is None:
        return lambda name: True
    if isinstance(spec, str):
        end = spec.rfind("/")
        if spec.startswith("/") and end > 0 and all(c in _FLAGS for c in spec[end + 1 :]):
            flags = 0
            for c in spec[end + 1 :]:
                flags |= _FLAGS[c]
            compiled = re.compile(spec[1:end], flags)
            return lambda name: compiled.match(name) is not None
        if any(c in spec for c in "*?["):
            return lambda name: fnmatch.fnmatchcase(name, spec)
        return lambda name: name == spec
    if callable(spec):
        return lambda name: bool(spec(name))
    if isinstance(spec, Iterable):
        parts = [name_filter(s) for s in spec]
        return lambda name: any(p(name) for p in parts)
    raise TypeError(f"a filter is None, a string, a callable or an iterable of these, not {spec!r}")


def renamer(spec: None | str | Callable[[str], str] | Mapping[str, str] | Iterable[Any]) -> Callable[[str], str]:
    """A renaming: None, ``/from/to/flags`` or ``s/from/to/flags`` (a regular expression), a mapping, a callable, or a list whose first applicable rule counts."""
    rules = [spec] if isinstance(spec, str) or callable(spec) or isinstance(spec, Mapping) or spec is None else list(spec)
    steps: list[Callable[[str], str]] = []
    for rule in rules:
        if rule is None:
            continue
        if isinstance(rule, Mapping):
            steps.append(lambda name, m=dict(rule): m.get(name, name))
        elif callable(rule):
            steps.append(rule)
        elif isinstance(rule, str) and (m := re.fullmatch(r"s?/((?:[^/\\]|\\.)*)/((?:[^/\\]|\\.)*)/([a-z]*)", rule)):
            flags = 0
            for c in m[3]:
                if c not in _FLAGS:
                    raise ValueError(f"unknown flag {c!r} in {rule!r}; flags are {''.join(_FLAGS)}")
                flags |= _FLAGS[c]
            steps.append(lambda name, p=re.compile(m[1], flags), to=m[2]: p.sub(to, name))
        else:
            raise TypeError(f"a rename rule is /from/to/flags, a mapping or a callable, not {rule!r}")

    def apply(name: str) -> str:
        for step in steps:
            if (new := step(name)) != name:
                return new
        return name

    return apply


#: The powers of the prefixes of decimal and binary units.
PREFIXES = "KMGTPEZY"


def memory_size(spec: int | float | str) -> int | None:
    """Bytes of ``"100 MB"``, ``"1.5 GiB"`` ...; a plain number, or one without a unit, is no size in bytes: None."""
    if not isinstance(spec, str):
        return None
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*([kmgtpezy]?)(i?)b\s*", spec, re.IGNORECASE)
    if not m or m[3] and not m[2]:
        if re.fullmatch(r"\s*\d+\s*", spec):
            return None
        raise ValueError(f"not a memory size: {spec!r}")
    base = 1024 if m[3] else 1000
    return int(float(m[1]) * base ** (PREFIXES.index(m[2].upper()) + 1 if m[2] else 0))
