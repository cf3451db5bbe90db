"""A name for a value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once, however often the body uses it: the optimizer puts a projection's expression in the place of
    each use inside a lambda, where it would be worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
