"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it.

    Without this, a value that several branches use is written out in each of them, and the generated code of a
    chain of such values outgrows what the JVM compiles.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
