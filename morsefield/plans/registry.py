"""The decorator that names queries, and rounding that two engines agree on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def r_many(c: str | Column, digits: int = 6) -> Column:
    """As ``r`` for numbers of 0 and more, by arithmetic on doubles: F.round goes by way of a decimal string, which tells on billions of rows."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * 10.0**digits
    whole = F.rint(scaled)  # halves go to even numbers there, and up here
    near = F.when(scaled - whole == 0.5, whole + 1.0).otherwise(whole) / 10.0**digits
    return F.when(scaled < 2.0**52, near).otherwise(c) + F.lit(0.0)
