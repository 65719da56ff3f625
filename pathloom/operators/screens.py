"""Threshold screens. All criteria come from one scan and one pass; combinations are rows of a flag table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import fixed
from pathloom.functions.columns import any_true, land_sector_co2e, sum_or_zero, zero_as_missing
from pathloom.operators.emissions import afolu_co2e_cumulative
from pathloom.operators.joins import not_in_ids
from pathloom.operators.summary import sum_variables
from pathloom.operators.timeaxis import interpolated_total


def _any_year_above(df: DataFrame, variable: str, limit: float, first: int, last: int) -> DataFrame:
    hit = (F.col("Variable") == variable) & F.col("year").between(first, last) & (F.col("value") > limit)
    return df.where(hit).select("scen_id").distinct()


def screen_bioenergy(df: DataFrame, limit: float = fixed.Limits.bioenergy, first: int = 2010,
                     last: int = 2050) -> DataFrame:
    """Removed ids: any year above the limit."""
    return _any_year_above(df, fixed.BIOENERGY, limit, first, last)


def screen_afforestation(df: DataFrame, limit: float = fixed.Limits.afforestation, first: int = 2010,
                         last: int = 2050) -> DataFrame:
    return _any_year_above(df, fixed.AFFORESTATION, limit, first, last)


def screen_total_ccs(df: DataFrame, limit: float = fixed.Limits.total_ccs, first: int = 2010,
                     last: int = 2050) -> DataFrame:
    """Removed ids: gap-filled sum above the limit; zeros are values here."""
    total = interpolated_total(df.where(F.col("Variable") == fixed.CCS), ("scen_id",), first, last)
    return total.where(F.col("total") > limit).select("scen_id")


def screen_removals_year(df: DataFrame, limit: float = fixed.Limits.removals_2020, year: int = 2020) -> DataFrame:
    total = sum_variables(df.where(F.col("year") == year), fixed.REMOVALS, ("scen_id",))
    return total.where(F.col("value") > limit).select("scen_id")


def screen_land_sector(df: DataFrame, limit: float = fixed.Limits.land_sector, convert: bool = True,
                       first: int = 2020, last: int = 2050) -> DataFrame:
    """Removed ids: cumulative land-sector CO2e below the limit."""
    total = afolu_co2e_cumulative(df, first, last, convert=convert)
    return total.where(F.col("afolu_co2e") < limit).select("scen_id")


def screen_criteria(df: DataFrame, limits: fixed.Limits = fixed.Limits(), convert: bool = True) -> DataFrame:
    """All five criteria per scenario as booleans (true = removed): one scan, one row per scenario.

    On a table bucketed by scen_id the whole pass runs without a shuffle.
    """
    v, y = F.col("Variable"), F.col("year")
    land = v.isin([fixed.AFOLU_CO2, fixed.AFOLU_CH4, fixed.AFOLU_N2O])
    series = (
        F.when(v == fixed.BIOENERGY, "bio")
        .when(v == fixed.AFFORESTATION, "afforestation")
        .when(v == fixed.CCS, "ccs")
        .when(land, "land")
        .otherwise("removals")
    )
    wanted = [fixed.BIOENERGY, fixed.AFFORESTATION, fixed.CCS, fixed.AFOLU_CO2, fixed.AFOLU_CH4, fixed.AFOLU_N2O,
              *fixed.REMOVALS]
    amount = F.when(land, land_sector_co2e("Variable", "value", "AR5", convert)).otherwise(F.col("value"))
    yearly = (
        df.where(v.isin(wanted) & y.between(2010, 2050))
        .select("scen_id", series.alias("series"), "year", amount.alias("value"))
        .groupBy("scen_id", "series", "year")
        .agg(F.sum("value").alias("value"))
    )
    s = F.col("series")
    yearly = yearly.withColumn("value", F.when(s == "land", zero_as_missing("value")).otherwise(F.col("value")))
    knot = F.col("value").isNotNull() & ((s == "ccs") | ((s == "land") & (y >= 2020)))
    rows = yearly.withColumn("_v", F.when(knot, F.col("value")))
    w = Window.partitionBy("scen_id", "series").orderBy(F.col("_v").isNull(), "year")
    rows = rows.withColumns({"_nv": F.lead("_v").over(w), "_ny": F.lead("year").over(w)})
    n = F.col("_ny") - y
    area = F.when(F.col("_nv").isNull(), F.col("_v") * (2050 - y + 1)).otherwise(
        n * F.col("_v") + (F.col("_nv") - F.col("_v")) * (n - 1) / 2
    )
    rows = rows.withColumn("_a", area)

    def total(name: str) -> Column:
        return sum_or_zero(F.when(s == name, F.col("_a")))

    return rows.groupBy("scen_id").agg(
        any_true((s == "bio") & (F.col("value") > limits.bioenergy)).alias("bio"),
        any_true((s == "afforestation") & (F.col("value") > limits.afforestation)).alias("afforestation"),
        (total("ccs") > limits.total_ccs).alias("ccs"),
        (total("land") < limits.land_sector).alias("land"),
        any_true((s == "removals") & (y == 2020) & (F.col("value") > limits.removals_2020)).alias("removals"),
    )


def _criteria_of(flag: int) -> tuple[str, ...]:
    if flag not in fixed.SCREEN_FLAGS:
        raise ValueError(f"screening flag must be one of {sorted(fixed.SCREEN_FLAGS)}")
    return fixed.SCREEN_FLAGS[flag]


def removed_by(flag: int) -> Column:
    """Predicate over ``screen_criteria`` columns; a scenario without data is not removed."""
    out = F.lit(False)
    for name in _criteria_of(flag):
        out = out | F.coalesce(F.col(name), F.lit(False))
    return out


def sustainability_filters(ids: DataFrame, df: DataFrame, flag: int, limits: fixed.Limits = fixed.Limits(),
                           convert: bool = True) -> DataFrame:
    """Candidates that survive one combination of criteria."""
    _criteria_of(flag)
    return not_in_ids(ids.select("scen_id"), screen_criteria(df, limits, convert).where(removed_by(flag)))


def screen_cohorts(ids: DataFrame, criteria: DataFrame, flags=tuple(fixed.SCREEN_FLAGS)) -> DataFrame:
    """(scen_id, cohort array<int>): every flag each candidate survives, from one pass of the criteria."""
    kept = F.array_compact(F.array(*[F.when(~removed_by(f), F.lit(f)) for f in flags]))
    return ids.select("scen_id").join(criteria, "scen_id", "left").select("scen_id", kept.alias("cohort"))


def iisd_filter_variations(ids: DataFrame, df: DataFrame, flag: int, limits: fixed.Limits = fixed.Limits(),
                           years: tuple[int, int] = (2040, 2060)) -> DataFrame:
    """Candidates whose mean of two reported years stays within the capture and land-use limits."""
    if flag not in (1, 2, 3):
        raise ValueError("screening flag must be one of [1, 2, 3]")
    beccs = limits.beccs_high if flag == 1 else limits.beccs_medium
    fossil = limits.fossil_ccs_high if flag == 1 else limits.fossil_ccs_medium
    land = fixed.AFFORESTATION if flag == 2 else fixed.LAND_USE
    caps = {fixed.BECCS: beccs, fixed.CCS_FOSSIL: fossil, land: limits.land_use}
    cap = F.lit(None).cast("double")
    for name, value in caps.items():
        cap = F.when(F.col("Variable") == name, F.lit(float(value))).otherwise(cap)
    means = (
        df.where(F.col("Variable").isin(list(caps)) & F.col("year").isin(list(years)))
        .groupBy("scen_id", "Variable")
        .agg(F.avg("value").alias("mid"))
    )
    return not_in_ids(ids.select("scen_id"), means.where(F.col("mid") > cap))
