"""The registry of value functions ("verbs"): name -> a function of Columns and Python constants that gives a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VERBS: dict[str, Callable[..., Column]] = {}


def verb(*names: str):
    def register(f):
        for name in names:
            VERBS[name] = f
        return f

    return register


def col(x) -> Column:
    """A Column as it is, any other value as a constant."""
    return x if isinstance(x, Column) else F.lit(x)


def text(x) -> Column:
    return col(x).cast("string")


def number(x) -> Column:
    """As double; null where that can't be."""
    return col(x).try_cast("double")


def finite(x: Column) -> Column:
    """null for NaN and the infinities"""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def let(value, use) -> Column:
    """use(value), value being computed once."""
    return F.get(F.transform(F.array(col(value)), use), F.lit(0))


def truthy(x) -> Column:
    """One rule for all predicates: null, false, zero, NaN and the strings "", "0" and "false" are not."""
    s = F.lower(text(x))
    return F.coalesce(~s.isin("", "0", "0.0", "-0.0", "nan", "false"), F.lit(False))


def call(name: str, *args) -> Column:
    """The function of that name; one that isn't known gives its first argument."""
    f = VERBS.get(name)
    return f(*args) if f else col(args[0]) if args else F.lit(None)


def register(name: str, f: Callable[..., Column]) -> None:
    """Adds a function of one's own, which specifications can call as %&name."""
    VERBS[name] = f
