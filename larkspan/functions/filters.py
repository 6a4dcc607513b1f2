"""Filters over JSON metadata: a field-query language, a dictionary of operators, and equality maps.

Language: ``field:value`` (a word of the field or of one of its array's elements), ``field:>n``, ``>=``,
``<``, ``<=``, ``field:"two words"`` (adjacent words), ``AND``, ``OR``, ``NOT``, parentheses.  NOT binds
closest, then AND, then OR; expressions side by side mean OR.  Everything compiles to one boolean Column,
so Catalyst sees it; ``resolve`` may name real columns for fields, and those comparisons reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.types import InvalidParameter

Resolve = Callable[[str], Column]


@dataclass(frozen=True)
class Term:
    field: str
    value: str


@dataclass(frozen=True)
class Range:
    field: str
    sign: str
    value: float


@dataclass(frozen=True)
class Phrase:
    field: str
    words: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)\b|([\w.]+):(?:"([^"]*)"|(>=|<=|>|<)\s*(-?[0-9.]+)|([^\s()"]+)))')


def parse(query: str):
    """The tree of a query string."""
    tokens, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise InvalidParameter(f"can't read {query[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek(group: int) -> str | None:
        return tokens[place][group] if place < len(tokens) else None

    def either():
        nonlocal place
        parts = [both()]
        while place < len(tokens) and not peek(2):
            if peek(3) == "OR":
                place += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both():
        nonlocal place
        parts = [one()]
        while peek(3) == "AND":
            place += 1
            parts.append(one())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def one():
        nonlocal place
        if place >= len(tokens):
            raise InvalidParameter(f"{query!r} ends too early")
        m = tokens[place]
        place += 1
        if m[3] == "NOT":
            return Not(one())
        if m[1]:
            inner = either()
            if not peek(2):
                raise InvalidParameter(f"{query!r} lacks a parenthesis")
            place += 1
            return inner
        if not m[4]:
            raise InvalidParameter(f"unexpected {m[0].strip()!r}")
        if m[5] is not None:
            return Phrase(m[4], tuple(m[5].lower().split()))
        return Range(m[4], m[6], float(m[7])) if m[6] else Term(m[4], m[8])

    if not tokens:
        raise InvalidParameter("the query is empty")
    tree = either()
    if place < len(tokens):
        raise InvalidParameter(f"unexpected {tokens[place][0].strip()!r}")
    return tree


def json_field(metadata: Column) -> Resolve:
    """Fields by JSON path in a string column."""
    return lambda field: F.get_json_object(metadata, f"$.{field}")


BREAKS = r"[^\p{L}\p{N}]+"


def _field_words(value: Column) -> Column:
    """The words of a value, a list for each element of a JSON array and one list for anything else; whatever is no letter or digit parts words."""
    text = value.cast("string")
    elements = F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array(text))).otherwise(F.array(text))
    return F.transform(F.filter(elements, F.isnotnull), lambda e: F.filter(F.split(F.lower(e), BREAKS), lambda w: w != ""))


def _phrase(words: Column, wanted: list[str]) -> Column:
    """Whether the wanted words follow each other in one element."""
    if not wanted:
        return F.lit(False)
    if len(wanted) == 1:
        return F.exists(words, lambda e: F.array_contains(e, wanted[0]))
    here = F.array(*[F.lit(w) for w in wanted])
    return F.exists(words, lambda e: F.exists(F.sequence(F.lit(1), F.greatest(F.size(e), F.lit(1))), lambda i: F.slice(e, i, len(wanted)) == here))


_SIGNS = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


def compile_tree(tree, resolve: Resolve) -> Column:
    """One boolean column, false where a field is missing."""
    if isinstance(tree, (Term, Phrase)):
        said = tree.value if isinstance(tree, Term) else " ".join(tree.words)
        wanted = [w for w in re.split(r"[\W_]+", said.lower()) if w]
        return F.coalesce(_phrase(_field_words(resolve(tree.field)), wanted), F.lit(False))
    if isinstance(tree, Range):
        return F.coalesce(_SIGNS[tree.sign](resolve(tree.field).try_cast("double"), F.lit(tree.value)), F.lit(False))
    if isinstance(tree, Not):
        return ~compile_tree(tree.inner, resolve)
    parts = [compile_tree(p, resolve) for p in tree.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(tree, And) else out | p
    return out


def where(query: str, resolve: Resolve) -> Column:
    return compile_tree(parse(query), resolve)


_OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: ~c.isin(*v),
}


def _typed(c: Column, value) -> Column:
    sample = value[0] if isinstance(value, (list, tuple)) and value else value
    if isinstance(sample, bool):
        return c.try_cast("boolean")
    return c.try_cast("double") if isinstance(sample, (int, float)) else c.cast("string")


def from_operators(spec: Mapping, resolve: Resolve) -> Column:
    """``{"field": {"$gte": 3}, "$or": [...]}``: fields side by side must all hold; a missing field holds nothing."""
    parts = []
    for name, rule in spec.items():
        if name in ("$and", "$or"):
            inner = [from_operators(r, resolve) for r in rule]
            out = inner[0]
            for p in inner[1:]:
                out = out & p if name == "$and" else out | p
            parts.append(out)
            continue
        for op, value in (rule if isinstance(rule, Mapping) else {"$eq": rule}).items():
            c = resolve(name)
            if op == "$contains":
                test = F.array_contains(F.from_json(c, "array<string>"), str(value))
            elif op in _OPERATORS:
                test = _OPERATORS[op](_typed(c, value), value)
            else:
                raise InvalidParameter(f"unknown operator {op}")
            parts.append(F.coalesce(test, F.lit(False)))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def map_field(metadata: Column) -> Resolve:
    """Fields of a map column."""
    return lambda field: metadata[field]


def equality(wanted: Mapping[str, str], resolve: Resolve) -> Column:
    """All fields equal the given strings."""
    return from_operators({k: {"$eq": v} for k, v in wanted.items()}, resolve)
