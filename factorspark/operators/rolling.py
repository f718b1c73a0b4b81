"""Time-series operators: windows over a code's calendar ordinal `t`.

All of a function's sums share one window specification, so a panel partitioned by code is sorted once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import by_code, decay, div, half_life_weights
from .panel import densify


Layers = list[dict[str, Column]]  # columns by name; those of a layer read the ones of the layers before


def layered(df: DataFrame, *parts: Layers) -> DataFrame:
    """Adds the columns of the parts. The windows of one layer of all parts share a pass over the rows of a code."""
    for k in range(max(map(len, parts))):
        df = df.withColumns({name: c for part in parts if k < len(part) for name, c in part[k].items()})
    return df


def window_sum(value: Column, n: int, how: Callable[[Column], Column] = F.sum) -> Column:
    """Sum (or count) of the known values of the last n calendar steps, 0 without any: what the code's rows sum to so far,
    less what they did n steps ago. Both grow from row to row, so a row costs the same for windows of any length."""
    so_far = lambda last: F.coalesce(how(value).over(by_code().rangeBetween(Window.unboundedPreceding, last)), F.lit(0))
    return so_far(0) - so_far(-n)


def window_count(value: Column, n: int) -> Column:
    return window_sum(value, n, F.count)


def full_window(value: Column, n: int, mean: bool = False) -> Column:
    """Sum or mean of n calendar steps, NULL unless all have a value."""
    total = window_sum(value, n)
    return F.when(window_count(value, n) == n, total / n if mean else total)


def decayed_sum(value: Column, window: int, half_life: float) -> Column:
    """Sum over the last `window` calendar steps of the values, each times 0.5 ** (age / half_life); 0 without values.

    Weights count from the start of blocks of `window` steps. A window meets two neighbouring blocks at most, so the sums
    over even and odd blocks are those over this block and the one before, and no weight leaves the range of doubles
    however long the calendar is.
    """
    block = F.floor(F.col("t") / window)
    even = block % 2 == 0
    grown = decay(half_life, F.col("t") - block * window)
    sums = [window_sum(F.when(side, value * grown), window) for side in (even, ~even)]
    this, before = F.when(even, sums[0]).otherwise(sums[1]), F.when(even, sums[1]).otherwise(sums[0])
    return (this + before * F.lit(0.5 ** (window / half_life))) / grown


def beta_layers(y: str, x: str, window: int, half_life: float, least: int | None = None, mark: str = "") -> Layers:
    """Columns `alpha`, `beta` and `sigma` followed by `mark` (`weighted_beta`). The first layer is the
    same for all windows."""
    least = half_life if least is None else least
    own = lambda name: F.col(f"_{name}" if name in ("my", "mx", "px", "pt") else f"_{name}{mark}")
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    ys, xs = F.when(both, F.col(y)), F.when(both, F.col(x))
    whole, earlier = (by_code().rowsBetween(Window.unboundedPreceding, last) for last in (Window.unboundedFollowing, -1))
    seen = lambda c: F.last(c, ignorenulls=True).over(earlier)
    means = {"_my": F.avg(ys).over(whole), "_mx": F.avg(xs).over(whole), "_px": seen(xs), "_pt": seen(F.when(both, F.col("t")))}
    a, b = xs - own("mx"), ys - own("my")
    decayed, plain = (lambda c: decayed_sum(c, window, half_life)), (lambda c: window_sum(c, window))
    sums = {"n": window_count(ys, window), "w": decayed(F.when(both, F.lit(1.0))), "x": decayed(a), "y": decayed(b), "xx": decayed(a * a), "xy": decayed(a * b)}
    sums |= {"sx": plain(a), "sy": plain(b), "sxx": plain(a * a), "syy": plain(b * b), "sxy": plain(a * b)}
    # x varies in a window that holds a value and the one before, which differ
    sums |= {"at": F.max(F.when(xs != own("px"), own("pt"))).over(by_code().rowsBetween(Window.unboundedPreceding, 0))}
    enough = (own("n") >= least) & (F.col("t") >= window) & (own("at") > F.col("t") - window)
    spread = own("w") * own("xx") - own("x") * own("x")
    mean = lambda c: div(own(c), own("n").cast("double"))
    moment = lambda c, d, e: mean(c) - mean(d) * mean(e)
    beta = F.col(f"beta{mark}")
    left = moment("syy", "sy", "sy") + beta * beta * moment("sxx", "sx", "sx") - 2 * beta * moment("sxy", "sx", "sy")
    return [
        means,
        {f"_{name}{mark}": c for name, c in sums.items()},
        {f"beta{mark}": F.when(enough, div(own("w") * own("xy") - own("x") * own("y"), spread))},
        {f"alpha{mark}": div(own("y") - beta * own("x"), own("w")) + own("my") - beta * own("mx"), f"sigma{mark}": F.when(beta.isNotNull(), F.sqrt(F.greatest(left, F.lit(0.0))))},
    ]


def weighted_beta(df: DataFrame, y: str, x: str, window: int, half_life: float, least: int | None = None) -> DataFrame:
    """Adds alpha, beta and sigma of y on x with half-life weights over `window` calendar steps.

    Rows with both values count; at least `least` of them are needed and `window` steps of calendar. sigma is
    the population deviation of the unweighted residuals. All are NULL where x does not vary. Sums are taken of
    deviations from the code's means, so that large values with small changes keep their digits.
    """
    return layered(df, beta_layers(y, x, window, half_life, least)).select(*df.columns, "beta", "alpha", "sigma")


def weighted_sum(value: Column, window: int, half_life: float, null_share: float = 0.1, null_denominator: int | None = None) -> Column:
    """Half-life weighted sum over `window` steps, NULL values as 0; NULL if the share of missing steps
    (over `null_denominator`, the window by default) exceeds `null_share` or the calendar is too short."""
    norm = sum(half_life_weights(window, half_life, standardize=False))
    total = decayed_sum(value, window, half_life) * F.lit(0.5 ** (1 / half_life) / norm)
    missing = window - window_count(value, window)
    return F.when((missing / F.lit(float(null_denominator or window)) <= null_share) & (F.col("t") >= window), total)


def ewma_deviation(df: DataFrame, value: str, half_life: float) -> DataFrame:
    """Adds `ewma`: sqrt of v = L v + (1 - L) x^2, from the code's full-sample variance on.

    A NULL gives NULL and starts over from the seed, so the closed form runs within each run of values.
    """
    keep = 0.5 ** (1 / half_life)
    df = df.withColumn("_seed", F.var_samp(value).over(by_code().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_run", F.sum(F.col(value).isNull().cast("int")).over(by_code().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("code", "_run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_n", F.count(value).over(run))
    square = F.col(value) * F.col(value)
    tail = F.sum(square * F.pow(F.lit(keep), -F.col("_n"))).over(run)
    v = F.pow(F.lit(keep), F.col("_n")) * (F.col("_seed") + (1 - keep) * tail)
    return df.withColumn("ewma", F.when(F.col(value).isNotNull(), F.sqrt(v))).drop("_seed", "_run", "_n")


def sampled_lags(value: Column, step: int, count: int) -> list[Column]:
    """value, and value step, 2 step, .. rows before; needs dense rows."""
    return [value if k == 0 else F.lag(value, k * step).over(by_code()) for k in range(count)]


def panel_rolling_apply(df: DataFrame, time: str, code: str, value: str, window: int, fn: Callable[[pd.Series], float]) -> DataFrame:
    """Any function of a full window: duplicates are averaged, a NULL in the window gives NULL, results carry
    forward. Rows are (code, time, value) without NULL. Runs per code in pandas: for built-in functions use windows."""
    times = df.select(time).distinct()
    grid = df.select(code).distinct().join(F.broadcast(times))
    dense = grid.join(df.groupBy(code, time).agg(F.avg(value).alias(value)), [code, time], "left")

    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time)
        rows[value] = rows[value].astype(float).rolling(window).apply(fn, raw=False).ffill()
        return rows.dropna(subset=[value])[[code, time, value]]

    kinds = dict(df.dtypes)
    return dense.groupBy(code).applyInPandas(apply, f"{code} {kinds[code]}, {time} {kinds[time]}, {value} double")


def dense_panel(df: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """The columns on every calendar step from a code's first row on."""
    return densify(df.select("code", "time", "t", *columns), calendar)
