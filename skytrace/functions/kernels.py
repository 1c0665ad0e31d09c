"""Kernel profiles. Each takes the squared bandwidth-scaled distance and a size; new ones are plain callables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[[Column, float], Column]


def gauss(d2: Column, size: float = 1.0) -> Column:
    return F.exp(d2 * -0.5) * 0.5


def epanechnikov(d2: Column, size: float = 1.0) -> Column:
    return F.when(d2 <= size, F.lit(float(size)) - d2).otherwise(0.0)


def uniform(d2: Column, size: float = 1.0) -> Column:
    return F.when(F.abs(d2) <= size, F.lit(1.0 / size)).otherwise(0.0)


KERNELS: dict[str, Kernel | None] = {
    "gauss": gauss,
    "epanechnikov": epanechnikov,
    "uniform": uniform,
    "none": None,
}
