"""Constrained cross-sectional regression of returns on country, industries and styles, for all dates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _solve(styles: list[str]):
    s = len(styles)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        """One date from its sums per industry: a system of 1 + industries + styles unknowns."""
        rows = rows.sort_values("L1")
        m = len(rows)
        k = 1 + m + s
        gram, right = np.zeros((k, k)), np.zeros((k, 2))
        for j, r in enumerate(rows.to_dict("records")):
            part = np.zeros((2 + s, 2 + s))  # country, industry, styles
            part[:2, :2] = r["w"]
            for a in range(s):
                part[:2, 2 + a] = part[2 + a, :2] = r[f"w{a}"]
                for b in range(s):
                    part[2 + a, 2 + b] = r[f"w{min(a, b)}_{max(a, b)}"]
            at = [0, 1 + j, *range(1 + m, k)]
            gram[np.ix_(at, at)] += part
            right[at] += np.array([[r[f"{n}{c}"] for c in range(2)] for n in ("r", "r", *(f"r{a}_" for a in range(s)))])
        cap = rows["cap"].to_numpy(float)
        tie = np.eye(k)
        if cap[-1]:  # the last industry's factor follows from the constraint
            tie[m, 1:m] = -cap[:-1] / cap[-1]
        tie = np.delete(tie, m, 1)
        found = tie @ np.linalg.pinv(tie.T @ gram @ tie) @ (tie.T @ right)
        return pd.DataFrame({"time": rows["time"].iloc[0], "factor": ["country", *rows["L1"], *styles], "simple": found[:, 0], "log": found[:, 1]})

    return solve


def pure_factor_returns(rows: DataFrame, styles: list[str], capital: DataFrame | None = None) -> DataFrame:
    """(time, factor, simple, log) from rows (time, L1, styles, cap, next_ret, next_log).

    Weights are sqrt(cap), normalized per date, which does not change the solution; missing capital or return
    counts as 0; rows need industry and styles. Industry factors weighted by capital sum to 0: by that of `capital`
    (time, L1, cap), the sums over all codes with an industry, or else by that of the rows. A date has a factor for each
    of its industries in `capital`, with rows or without; where the system is singular, the smallest solution counts.
    Only sums per (date, industry) leave the executors' partial aggregation, at most a few dozen rows a date.
    """
    rows = rows.dropna(subset=["L1", *styles]).fillna(0.0, ["cap", "next_ret", "next_log"])
    v = F.sqrt(F.col("cap"))
    sums = [F.sum(v).alias("w"), F.sum("cap").alias("cap"), F.sum(v * F.col("next_ret")).alias("r0"), F.sum(v * F.col("next_log")).alias("r1")]
    for a, x in enumerate(styles):
        sums.append(F.sum(v * F.col(x)).alias(f"w{a}"))
        sums += [F.sum(v * F.col(x) * F.col(r)).alias(f"r{a}_{c}") for c, r in enumerate(("next_ret", "next_log"))]
        sums += [F.sum(v * F.col(x) * F.col(y)).alias(f"w{a}_{b}") for b, y in enumerate(styles) if b >= a]
    grouped = rows.groupBy("time", "L1").agg(*sums)
    if capital is not None:
        dates = grouped.select("time").distinct()
        whole = capital.where("L1 is not null").join(dates, "time", "left_semi").select("time", "L1", F.col("cap").alias("_cap"))
        grouped = whole.join(grouped, ["time", "L1"], "left").withColumn("cap", F.col("_cap")).drop("_cap").fillna(0.0)
    return grouped.groupBy("time").applyInPandas(_solve(styles), "time date, factor string, simple double, log double")
