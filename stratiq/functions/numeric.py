"""Guarded arithmetic, normalisation and bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: C, b: C) -> Column:
    """a / b, null where b is 0."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def r6(c: C) -> Column:
    """Rounded to six digits, for results that another engine must reproduce."""
    return F.round(col(c).cast("double"), 6)


def missing_to_null(c: C, codes: Sequence[float] = (-999, -9999)) -> Column:
    """NaN and the no-data codes become null."""
    x = col(c)
    return F.when(~x.isin(*[float(v) for v in codes]) & ~F.isnan(x.cast("double")), x)


def is_finite(c: C) -> Column:
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def all_finite(columns: Sequence[C]) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(c) for c in columns])


def sector(angle: C, width: float = 30.0, turn: float = 360.0) -> Column:
    """Bins [a, a + width) over [0, turn]; the last is closed; null outside."""
    x, last = col(angle), int(turn // width) - 1
    return F.when((x >= 0) & (x <= turn), F.least(F.floor(x / width), F.lit(last))).cast("int")


def bin_right_closed(x: C, cuts: C) -> Column:
    """1-based bin of a value among an array of rising cuts: (a, b], the lowest cut included in the first; null outside."""
    v, at = col(x), col(cuts)
    inner = F.size(F.filter(at, lambda c: c < v))
    inside = (v >= F.element_at(at, 1)) & (v <= F.element_at(at, -1))
    return F.when(inside, F.greatest(inner, F.lit(1))).cast("int")


def tertile(x: C, low: C, high: C) -> Column:
    """1 up to the first cut, 2 up to the second, 3 above."""
    v = col(x)
    return F.when(v <= col(low), 1).when(v <= col(high), 2).when(v.isNotNull(), 3)


def cases(c: C, rules: Sequence[tuple[Column, str]]) -> Column:
    """The first rule that holds; null if none does."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def row_argmax(columns: Sequence[str]) -> Column:
    """Name of the column with the largest value, the first of ties."""
    best = F.greatest(*[F.col(c) for c in columns])
    return cases(best, [(F.col(c) == best, c) for c in columns])


def weighted_sum(weights: dict[str, float]) -> Column:
    """Null if any term is."""
    return reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in weights.items()])
