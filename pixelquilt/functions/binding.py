"""Name a value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column that is mentioned in several places, or inside a lambda, is otherwise evaluated at each of them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """The same for several values, given to ``body`` as one struct."""
    return let(F.struct(*[value.alias(name) for name, value in values.items()]), body)
