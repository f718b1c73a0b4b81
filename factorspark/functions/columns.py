"""Column builders shared by the operators. Everything is a built-in expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec, functions as F


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0 or either is NULL."""
    return F.try_divide(a if isinstance(a, Column) else F.col(a), b if isinstance(b, Column) else F.col(b))


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def by_code(code: str = "code", t: str = "t") -> WindowSpec:
    return Window.partitionBy(code).orderBy(t)


def half_life_weights(window: int, half_life: float, standardize: bool = True) -> list[float]:
    """Weights of ages 0 (newest) to window - 1: 0.5 ** ((age + 1) / half_life), summing to 1 if standardized."""
    raw = [0.5 ** ((age + 1) / half_life) for age in range(window)]
    return [w / sum(raw) for w in raw] if standardize else raw


def decay(half_life: float, t: Column | str = "t") -> Column:
    """2 ** (t / half_life): the growing part of a half-life weight, for a `t` that does not reach 1000 half-lives."""
    return F.pow(F.lit(2.0), (F.col(t) if isinstance(t, str) else t) / F.lit(float(half_life)))


def lagged_sum(value: Column, weights: list[float], over: WindowSpec) -> Column:
    """Sum of weights[i] * (value i rows before), NULL if any is NULL; needs dense rows."""
    return reduce(lambda a, b: a + b, [F.lag(value, i).over(over) * w for i, w in enumerate(weights)])


def row_mean(columns: list[str]) -> Column:
    """Mean of the non-null columns of a row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    count = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return div(total, count.cast("double"))


def report_deadline(stat_date: str = "statDate") -> Column:
    """Last date of disclosure of a report period: May 1, Sep 1 or Nov 1; annual reports on May 1 of the next year."""
    d = F.col(stat_date)
    month = F.month(d)
    return F.when(month.isin(3, 6, 9, 12), F.make_date(F.year(d) + (month == 12).cast("int"), F.when(month == 6, 9).when(month == 9, 11).otherwise(5), F.lit(1)))
