"""Operators along the year axis of a (key..., year, value) table.

Gaps are filled between *knots*: one window per key looks at the next reported year, then each knot
produces the years up to it. Windows are always keyed by one trajectory (at most one row per year), so
no partition grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom.functions.columns import sum_or_zero, zero_as_missing

TRAJECTORY = ("scen_id", "Variable")


def year_slice(df: DataFrame, first: int, last: int, step: int = 1) -> DataFrame:
    """Rows inside a year range, or on a regular grid within it."""
    if step == 1:
        return df.where(F.col("year").between(first, last))
    return df.where(F.col("year").isin(list(range(first, last + 1, step))))


def milestones(df: DataFrame, years: Sequence[int]) -> DataFrame:
    return df.where(F.col("year").isin(list(years)))


def densify_years(df: DataFrame, keys: Sequence[str], first: int, last: int, value: str = "value") -> DataFrame:
    """Every key carries every year; unreported years are NULL rows.

    A trajectory's reported years (at most one per year) travel as one map, so there is a single shuffle by
    key and no join against a year grid. Two rows for one year of a key raise an error.
    """
    reported = F.collect_list(F.when(F.col("year").between(first, last), F.struct("year", F.col(value))))
    return (
        df.groupBy(*keys)
        .agg(F.map_from_entries(reported).alias("_m"))
        .select(*keys, "_m", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
        .select(*keys, "year", F.col("_m")[F.col("year")].alias(value))
    )


def interpolate_gaps(df: DataFrame, keys: Sequence[str] = TRAJECTORY, first: int = 2020, last: int = 2050,
                     zero_missing: bool = False, leading: bool = False, value: str = "value",
                     keep_empty: bool = False) -> DataFrame:
    """Linear fill between reported years of the slice; the last value holds, leading gaps stay missing.

    Only knots inside the slice count. ``leading`` also returns the missing years before the first knot, as
    NULL rows. A key without any knot has no rows, or with ``keep_empty`` one row without year and value.
    """
    v = zero_as_missing(value) if zero_missing else F.col(value)
    inside = F.col("year").between(first, last)
    if keep_empty:  # what is no knot sorts last, so a key's first row is a knot or the key has none
        knots = df.select(*keys, "year", F.when(inside, v).alias("_v"))
        w = Window.partitionBy(*keys).orderBy(F.col("_v").isNull(), "year")
        knots = knots.withColumn("_first", F.row_number().over(w) == 1)
    else:
        knots = df.where(inside).select(*keys, "year", v.alias("_v")).where(F.col("_v").isNotNull())
        w = Window.partitionBy(*keys).orderBy("year")
    steps = knots.withColumns({"_nv": F.lead("_v").over(w), "_ny": F.lead("year").over(w)})
    if keep_empty:
        steps = steps.withColumns({
            "year": F.when(F.col("_v").isNotNull(), F.col("year")), "_ny": F.when(F.col("_nv").isNotNull(), F.col("_ny")),
        }).where(F.col("_v").isNotNull() | F.col("_first"))
    start = F.col("year")
    if leading:
        steps = steps.withColumn("_py", F.lag("year").over(w))
        start = F.when(F.col("_py").isNull(), F.lit(first)).otherwise(F.col("year"))
    years = F.sequence(start, F.coalesce(F.col("_ny") - 1, F.lit(last)))
    filled = (
        F.when(F.col("_y") < F.col("year"), None)
        .when(F.col("_ny").isNull(), F.col("_v"))
        .otherwise(
            F.col("_v")
            + (F.col("_nv") - F.col("_v")) * (F.col("_y") - F.col("year")) / (F.col("_ny") - F.col("year"))
        )
    )
    grid = (F.explode_outer if keep_empty else F.explode)(years)
    return steps.withColumn("_y", grid).select(*keys, F.col("_y").alias("year"), filled.alias(value))


def interpolated_total(df: DataFrame, keys: Sequence[str] = ("scen_id",), first: int = 2020, last: int | Column = 2050,
                       zero_missing: bool = False, value: str = "value", out: str = "total",
                       step: int = 1) -> DataFrame:
    """Sum over a year slice after gap filling, without producing the filled years.

    Each knot contributes the arithmetic series up to the next knot (the last one holds to the end), so a
    trajectory costs as many rows as it has reported years. A key present with no value in the slice is 0.
    With ``step`` the slice is the grid first, first+step, ...; rows off the grid do not count. ``last`` may be
    one of the key columns, so several windows come from one pass.
    """
    end = last if isinstance(last, Column) else F.lit(last)
    v = zero_as_missing(value) if zero_missing else F.col(value)
    inside = F.col("year").between(F.lit(first), end)
    if step != 1:
        inside = inside & ((F.col("year") - F.lit(first)) % F.lit(step) == 0)
    rows = df.select(*keys, "year", F.when(inside, v).alias("_v"))
    # rows that are no knots sort last, so a knot's successor is a knot or nothing
    w = Window.partitionBy(*keys).orderBy(F.col("_v").isNull(), "year")
    nv, ny = F.lead("_v").over(w), F.lead("year").over(w)
    rows = rows.withColumns({"_nv": nv, "_ny": ny})
    n = (F.col("_ny") - F.col("year")) / F.lit(step)
    series = F.when(
        F.col("_nv").isNull(), F.col("_v") * (F.floor((end - F.col("year")) / F.lit(step)) + 1)
    ).otherwise(n * F.col("_v") + (F.col("_nv") - F.col("_v")) * (n - 1) / 2)
    return rows.withColumn("_s", series).groupBy(*keys).agg(sum_or_zero("_s").alias(out))


def slice_max(df: DataFrame, keys: Sequence[str], first: int, last: int, value: str = "value",
              out: str = "max_value") -> DataFrame:
    """Highest value in the slice; missing for keys reported only outside it."""
    return df.groupBy(*keys).agg(F.max(F.when(F.col("year").between(first, last), F.col(value))).alias(out))


def anchor_and_bridge(df: DataFrame, anchored: Column, anchor: float, anchor_year: int = 2020,
                      blank: Sequence[int] = (2021,), keys: Sequence[str] = TRAJECTORY, first: int = 2020,
                      last: int = 2050) -> DataFrame:
    """Pin ``anchor_year`` to a constant on the anchored trajectories, blank years on all, refill the gaps.

    ``anchored`` is a predicate over the key columns. Zeros count as missing.
    """
    kept = df.where(~F.col("year").isin(list(blank)) & ~(anchored & (F.col("year") == anchor_year)))
    pinned = (
        df.where(anchored)
        .select(*keys)
        .distinct()
        .select(*keys, F.lit(anchor_year).alias("year"), F.lit(float(anchor)).alias("value"))
    )
    return interpolate_gaps(kept.select(*keys, "year", "value").unionByName(pinned), keys, first, last,
                            zero_missing=True)
