"""Budget-conserving harmonisation of trajectories to a historical value.

The shifted trajectory starts at history, keeps the cumulative (trapezoid) budget of the model over the
window, and among all such trajectories changes the year-on-year slopes least (least squares). On an annual
grid that minimiser has a closed form, so it is one column expression over all scenarios at once:

    x_t = m_t + d * (1 - 6 t (2n - t) / (4 n^2 - 1)),   t = 0..n,   d = history - m_0
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import fixed
from pathloom.operators.joins import small_side
from pathloom.operators.timeaxis import interpolate_gaps

NO_HISTORY, NO_ANCHOR = "no history", "no value in the anchor year"


class Harmonised(NamedTuple):
    trajectories: DataFrame  # keys, year, modelled, value
    diagnostics: DataFrame   # keys, method, offset, budget_before, budget_after, reason: one row per trajectory
    failed: DataFrame        # keys, reason


def tagged_trajectories(df: DataFrame, history: DataFrame, keys: Sequence[str] = ("scen_id",), region: str = "Region",
                        variable: str | None = None, anchor_year: int = fixed.HARMONISE_YEAR, first: int = 2020,
                        last: int = 2050) -> DataFrame:
    """Every trajectory with its harmonised values, from one pass: keys, year, modelled, value, offset, reason.

    A trajectory that cannot be harmonised keeps at least one row, with the reason and no value.
    """
    if not first <= anchor_year < last:
        raise ValueError("the anchor year must lie inside the window")
    match = [region, *([variable] if variable else [])]
    by = [*keys, *match]
    n = last - anchor_year
    filled = interpolate_gaps(df, by, first, last, zero_missing=True, keep_empty=True)
    w = Window.partitionBy(*by)
    at_anchor = F.max(F.when(F.col("year") == anchor_year, F.col("value"))).over(w)
    rows = filled.withColumn("_m0", at_anchor).where(F.col("year").isNull() | (F.col("year") >= anchor_year))
    hist = small_side(history.select(*match, F.col("value").alias("_h")))
    rows = rows.join(hist, match, "left").withColumn("offset", F.col("_h") - F.col("_m0"))
    reason = F.when(F.col("_h").isNull(), NO_HISTORY).when(F.col("_m0").isNull(), NO_ANCHOR)
    t = F.col("year") - F.lit(anchor_year)
    shift = F.lit(1.0) - F.lit(6.0) * t * (F.lit(2 * n) - t) / F.lit(4.0 * n * n - 1.0)
    return rows.select(*by, "year", F.col("value").alias("modelled"),
                       (F.col("value") + F.col("offset") * shift).alias("value"), "offset", reason.alias("reason"))


def harmonise_budget(df: DataFrame, history: DataFrame, keys: Sequence[str] = ("scen_id",), region: str = "Region",
                     variable: str | None = None, anchor_year: int = fixed.HARMONISE_YEAR, first: int = 2020,
                     last: int = 2050, keep=lambda frame: frame) -> Harmonised:
    """``df``: keys, region, year, value, and the column ``variable`` if that is named. ``history``: region, variable,
    value in the anchor year.

    Zeros count as missing; gaps are filled over first..last before the window anchor_year..last is cut. All three
    results are read from one tagged frame; ``keep`` may stage it for callers that use more than one.
    """
    tagged = keep(tagged_trajectories(df, history, keys, region, variable, anchor_year, first, last))
    by = [*keys, region, *([variable] if variable else [])]
    good = F.col("reason").isNull()
    weight = F.when(F.col("year").isin(anchor_year, last), 0.5).otherwise(1.0)
    diagnostics = tagged.groupBy(*by, "reason").agg(
        F.when(good, "budget").otherwise("failed").alias("method"),
        F.max(F.when(good, F.col("offset"))).alias("offset"),
        F.sum(F.when(good, weight * F.col("modelled"))).alias("budget_before"),
        F.sum(F.when(good, weight * F.col("value"))).alias("budget_after"),
    )
    return Harmonised(
        tagged.where(good).select(*by, "year", "modelled", "value"),
        diagnostics.select(*by, "method", "offset", "budget_before", "budget_after", "reason"),
        tagged.where(~good).select(*by, "reason").distinct(),
    )
