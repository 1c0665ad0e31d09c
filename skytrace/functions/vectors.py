"""Vector math on ARRAY<DOUBLE> columns, and the text forms of vectors, sets and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*cols: Column | str) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols])


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def divide(a: Column, divisor: Column | float) -> Column:
    d = divisor if isinstance(divisor, Column) else F.lit(divisor)
    return F.transform(a, lambda x: F.try_divide(x, d))


def diagonal_product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(diagonal_product(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Column, b: Column) -> Column:
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def mahalanobis2(a: Column, b: Column, bandwidth: Column) -> Column:
    """Squared distance after dividing each component by its bandwidth."""
    scaled = F.zip_with(subtract(a, b), bandwidth, lambda d, h: d / h)
    return dot(scaled, scaled)


def within_range(a: Column, b: Column, bandwidth: Column) -> Column:
    return mahalanobis2(a, b, bandwidth) <= 1.0


def closer_than(a: Column, b: Column, distance: Column | float) -> Column:
    return norm(subtract(a, b)) < distance


def is_null_vector(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def index_of_first(a: Column, value: Column) -> Column:
    """Zero-based position of the first occurrence, -1 if absent."""
    return (F.array_position(a, value) - 1).cast("int")


def vector_to_text(a: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit(")"))


def vector_from_text(s: Column) -> Column:
    return F.split(F.regexp_replace(s, r"[()\s]", ""), ",").cast("array<double>")


def vector_to_json(a: Column) -> Column:
    return F.to_json(a)


def set_to_text(ids: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(ids)).cast("array<string>"), ","), F.lit("}"))


def set_from_text(s: Column) -> Column:
    inner = F.regexp_replace(s, r"[{}\s]", "")
    return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(F.split(inner, ",").cast("array<bigint>"))


def map_to_text(entries: Column) -> Column:
    """Entries: ARRAY<STRUCT<key, ids>>, written as ``[k:{a,b};...;]`` in key order."""
    parts = F.transform(
        F.array_sort(entries), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), set_to_text(e["ids"]), F.lit(";"))
    )
    return F.concat(F.lit("["), F.array_join(parts, ""), F.lit("]"))


def map_from_text(s: Column) -> Column:
    """Inverse of :func:`map_to_text`: MAP<BIGINT, ARRAY<BIGINT>>."""
    inner = F.regexp_replace(s, r"[\[\]\s]", "")
    parts = F.filter(F.split(inner, ";"), lambda p: p != "")
    return F.map_from_arrays(
        F.transform(parts, lambda p: F.split_part(p, F.lit(":"), F.lit(1)).cast("bigint")),
        F.transform(parts, lambda p: set_from_text(F.split_part(p, F.lit(":"), F.lit(2)))),
    )


def assignments_from_text(s: Column) -> Column:
    """``name=value,name=value`` lists as MAP<STRING, DOUBLE>."""
    pairs = F.str_to_map(F.regexp_replace(s, r"\s", ""), F.lit(","), F.lit("="))
    return F.transform_values(pairs, lambda _, v: v.cast("double"))
