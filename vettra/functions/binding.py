"""Evaluate a sub-expression once.

Spark re-evaluates whatever a lambda body refers to for every element. Passing the value through a one-element array
makes it a lambda variable instead, which is computed a single time per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
