"""Values that keep their types: JSON as VARIANT, where 1, 1.0 and "1" differ and lists stay lists.

VARIANT can neither be compared nor grouped; a value's signature, a text, stands for it there: equal values of equal types have
equal signatures, whatever the order of an object's keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed(text: Column | str) -> Column:
    """A JSON text as a value; null where it is none."""
    return F.try_parse_json(text)


def items(v: Column | str) -> Column:
    """A list's items; of any other value, itself alone; null for null."""
    v = _col(v)
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))


def field(v: Column | str, key: str) -> Column:
    """An object's value under a key; null without it."""
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(_col(v), f"$['{quoted}']", "variant")


def text(v: Column | str) -> Column:
    """As the reference's language prints it: texts bare, lists as ``[a, b]``, a JSON null as null."""
    v = _col(v)
    plain = F.try_variant_get(v, "$", "string")
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.coalesce(F.try_variant_get(e, "$", "string"), F.lit("null")))
    return F.coalesce(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")), plain)


def kind(v: Column | str) -> Column:
    """A value's type, decimals of JSON numbers told from whole numbers; that of each item of a list."""
    of = lambda x: F.regexp_replace(F.schema_of_variant(x), r"DECIMAL\((1[0-8]|[1-9]),\d+\)", "DOUBLE")
    v = _col(v)
    each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.coalesce(of(e), F.lit("VOID")))
    return F.coalesce(F.concat(F.lit("ARRAY<"), F.array_join(each, ","), F.lit(">")), of(v))


def signature(v: Column | str) -> Column:
    """A text that equal values of equal types share, and no others; null for null. Types are told apart to the items of a list and the values of an object."""
    v = _col(v)
    return F.when(v.isNotNull(), F.concat(kind(v), F.lit(" "), F.to_json(v)))


def same(a: Column | str, b: Column | str) -> Column:
    """Equal in type and value; two nulls are equal."""
    return signature(a).eqNullSafe(signature(b))
