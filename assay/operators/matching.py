"""Matching strategies: each is a function of two Columns (retrieved, expected) that gives a boolean Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.scalar import contains_either, equals_ignore_case, normalize_text

Strategy = Callable[[Column, Column], Column]


def by_equality() -> Strategy:
    return lambda r, e: r.eqNullSafe(e)


def by_typed_equality() -> Strategy:
    """Values (VARIANT) of equal type that are equal: 1 matches neither 1.0 nor "1"."""
    return typed.same


def by_typed_field(name: str) -> Strategy:
    """Objects (VARIANT) that agree in a field, two missing ones included; a value that is no object stands for itself."""
    of = lambda x: F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), typed.signature(typed.field(x, name))).otherwise(typed.signature(x))
    return by_identifier(of)


def by_identifier(of: Callable[[Column], Column]) -> Strategy:
    return lambda r, e: of(r).eqNullSafe(of(e))


def by_field(name: str) -> Strategy:
    """Structs that agree in a field; two missing fields agree."""
    return by_identifier(lambda x: x[name])


def by_fields(*names: str) -> Strategy:
    return all_of(*map(by_field, names))


def custom(predicate: Strategy) -> Strategy:
    return predicate


def case_insensitive() -> Strategy:
    return lambda r, e: F.coalesce(equals_ignore_case(r, e), r.isNull() & e.isNull())


def by_containment(normalize: bool = True) -> Strategy:
    def match(r: Column, e: Column) -> Column:
        return contains_either(normalize_text(r), normalize_text(e)) if normalize else contains_either(r, e)

    return match


def any_of(*strategies: Strategy) -> Strategy:
    return lambda r, e: reduce(lambda a, b: a | b, (s(r, e) for s in strategies), F.lit(False))


def all_of(*strategies: Strategy) -> Strategy:
    """All must agree; none agrees to everything."""
    return lambda r, e: reduce(lambda a, b: a & b, (s(r, e) for s in strategies), F.lit(True))


def matching(retrieved: Column | str, expected: Column | str, strategy: Strategy) -> Column:
    """The retrieved items, repeats included, that match any expected item."""
    expected = F.col(expected) if isinstance(expected, str) else expected
    return F.filter(retrieved, lambda r: F.exists(expected, lambda e: F.coalesce(strategy(r, e), F.lit(False))))


def count_matches(retrieved: Column | str, expected: Column | str, strategy: Strategy) -> Column:
    return F.size(matching(retrieved, expected, strategy))

