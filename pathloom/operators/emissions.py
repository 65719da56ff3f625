"""Derived emission variables: filled totals, gross emissions, sector sums, land sector, removals.

All take and return the canonical long columns; a missing value is an absent row unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import fixed
from pathloom.functions.columns import (
    any_true, co2e, land_sector_co2e, positive_where, sum_or_zero, zero_as_missing,
)
from pathloom.operators.summary import sum_variables
from pathloom.operators.timeaxis import interpolate_gaps, interpolated_total

LONG = ("scen_id", "Variable", "year", "value")


def filled_totals(df: DataFrame, ids: DataFrame, years: Sequence[int], total: str = fixed.NET_TOTAL,
                  parts: Sequence[str] = (fixed.NET_ENERGY, fixed.NET_INDUSTRY)) -> DataFrame:
    """The total for the ids that report none: the sum of its parts per year, 0 where neither is there.

    One scan: whether the total is reported and the yearly sums of the parts come from the same aggregation by
    scenario. An id without any data gets zeros too.
    """
    yearly = _eip_rows(df, ids, total, parts, ()).groupBy("scen_id", "year").agg(
        any_true(F.col("_is_total")).alias("_r"), F.sum("_part").alias("_part")
    )
    part = F.when(F.col("_part").isNotNull(), F.struct("year", F.col("_part").alias("v")))
    packed = yearly.groupBy("scen_id").agg(
        F.bool_or("_r").alias("_reported"), F.map_from_entries(F.collect_list(part)).alias("_m")
    )
    return (
        packed.where(~F.col("_reported"))
        .select("scen_id", "_m", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
        .select("scen_id", F.lit(total).alias("Variable"), "year",
                F.coalesce(F.col("_m")[F.col("year")], F.lit(0.0)).alias("value"))
    )


def fill_missing_total(df: DataFrame, ids: DataFrame, years: Sequence[int], total: str = fixed.NET_TOTAL,
                       parts: Sequence[str] = (fixed.NET_ENERGY, fixed.NET_INDUSTRY)) -> DataFrame:
    """All rows plus the total for ids that do not report it; reported totals are left as they are."""
    return df.select(*LONG).unionByName(filled_totals(df, ids, years, total, parts))


def gross_rows(df: DataFrame, total: str = fixed.NET_TOTAL, removals: Sequence[str] = fixed.REMOVALS) -> DataFrame:
    """The rows that add up to gross emissions: total plus removals of any sign, zeros missing."""
    is_removal = F.col("Variable").isin(list(removals))
    return df.where(F.col("Variable").isin([total, *removals])).select(
        "scen_id", "Variable", "year", zero_as_missing(positive_where(is_removal, "value")).alias("value")
    )


def gross_emissions(df: DataFrame, fill: bool = False, first: int = 2010, last: int = 2092,
                    name: str = fixed.GROSS_TOTAL) -> DataFrame:
    """Gross emissions per scenario and year: net total plus removals.

    Valid for a cohort whose total has been filled; others come out as removals only. ``fill`` interpolates
    each variable over the given years before the sum. Years without any row stay absent; they count as 0
    (use ``sums_at`` on ``gross_rows`` for listed years with that 0).
    """
    rows = gross_rows(df)
    if fill:
        rows = interpolate_gaps(rows, ("scen_id", "Variable"), first, last)
    return (
        rows.groupBy("scen_id", "year")
        .agg(sum_or_zero("value").alias("value"))
        .select("scen_id", F.lit(name).alias("Variable"), "year", "value")
    )


def gross_emissions_plain(df: DataFrame, name: str = fixed.GROSS_TOTAL) -> DataFrame:
    """Older form: net total plus biomass capture as reported."""
    return sum_variables(df, [fixed.NET_TOTAL, fixed.BECCS]).withColumn("Variable", F.lit(name)).select(*LONG)


def _eip_rows(df: DataFrame, ids: DataFrame, total: str, parts: Sequence[str], removals: Sequence[str]) -> DataFrame:
    """Rows of the total, its parts and the removals for each id; an id without any keeps one empty row."""
    v = F.col("Variable")
    rows = df.where(v.isin([total, *parts, *removals])).select(
        "scen_id", "year", (v == total).alias("_is_total"), F.when(v == total, F.col("value")).alias("_total"),
        F.when(v.isin(list(parts)), F.col("value")).alias("_part"),
        F.when(v.isin(list(removals)), F.abs("value")).alias("_removal"),
    )
    flagged = ids if "fill" in ids.columns else ids.select("scen_id").withColumn("fill", F.lit(True))
    # an id listed twice must not count its rows twice; it is filled if any listing says so
    once = flagged.groupBy("scen_id").agg(F.bool_or("fill").alias("fill"))
    return once.join(rows, "scen_id", "left")


def _net_and_gross(use_parts: Column, total: Column, part: Column, removal: Column) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    net = F.when(use_parts, F.coalesce(part, zero)).otherwise(total)
    return net, F.coalesce(net, zero) + F.coalesce(removal, zero)


def eip_at(df: DataFrame, ids: DataFrame, years: Sequence[int], total: str = fixed.NET_TOTAL,
           parts: Sequence[str] = (fixed.NET_ENERGY, fixed.NET_INDUSTRY),
           removals: Sequence[str] = fixed.REMOVALS) -> DataFrame:
    """Filled net total and gross emissions of each id at listed years: scen_id, net_<y>..., gross_<y>...

    The same numbers as ``fill_missing_total`` and ``gross_rows`` + ``sums_at``, from one scan and one
    aggregation by scenario (no shuffle on a table bucketed by it). A net value is missing where a reporting
    scenario has none; gross counts that as 0. ``ids`` may carry a boolean ``fill``; ids with fill = false
    keep an unreported total missing and need some row of their own.
    """
    y = F.col("year")
    aggs = [any_true(F.col("_is_total")).alias("_reported"), F.bool_or(F.col("_total").isNotNull() | F.col("_removal").isNotNull()).alias("_seen")]
    for year in years:
        aggs += [F.sum(F.when(y == year, F.col(f"_{c}"))).alias(f"_{c}_{year}") for c in ("total", "part", "removal")]
    wide = _eip_rows(df, ids, total, parts, removals).groupBy("scen_id", "fill").agg(*aggs)
    use_parts = F.col("fill") & ~F.col("_reported")
    net, gross = [], []
    for year in years:
        n, g = _net_and_gross(use_parts, *[F.col(f"_{c}_{year}") for c in ("total", "part", "removal")])
        net.append(n.alias(f"net_{year}"))
        gross.append(g.alias(f"gross_{year}"))
    return wide.where(F.col("fill") | F.col("_seen")).select("scen_id", *net, *gross)


def eip_yearly(df: DataFrame, ids: DataFrame, first: int, last: int, total: str = fixed.NET_TOTAL,
               parts: Sequence[str] = (fixed.NET_ENERGY, fixed.NET_INDUSTRY),
               removals: Sequence[str] = fixed.REMOVALS) -> DataFrame:
    """As ``eip_at`` for every year of a range: scen_id, year, net, gross; one dense row per id and year."""
    yearly = _eip_rows(df, ids, total, parts, removals).groupBy("scen_id", "year").agg(
        any_true(F.col("_is_total")).alias("_r"),
        *[F.sum(f"_{c}").alias(f"_{c}") for c in ("total", "part", "removal")],
    )
    values = F.struct("_total", "_part", "_removal")
    inside = F.when(F.col("year").between(first, last), F.struct("year", values.alias("v")))
    packed = yearly.groupBy("scen_id").agg(
        F.bool_or("_r").alias("_reported"), F.map_from_entries(F.collect_list(inside)).alias("_m")
    )
    dense = packed.select(
        "scen_id", "_reported", "_m", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    ).select("scen_id", "_reported", "year", F.col("_m")[F.col("year")].alias("v"))
    net, gross = _net_and_gross(~F.col("_reported"), F.col("v._total"), F.col("v._part"), F.col("v._removal"))
    return dense.select("scen_id", "year", net.alias("net"), gross.alias("gross"))


def eip_n2o(df: DataFrame) -> DataFrame:
    """N2O outside the land sector, kt per year."""
    return sum_variables(df, fixed.N2O_SECTORS)


def eip_ch4(df: DataFrame) -> DataFrame:
    """CH4 outside the land sector, Mt per year."""
    return sum_variables(df, fixed.CH4_SECTORS)


def gases_at(df: DataFrame, years: Sequence[int], gases: Sequence[str] = tuple(fixed.GAS_VARIABLES),
             vintage: str | None = None) -> DataFrame:
    """The other gases at listed years: scen_id, <gas>_<year>..., from one scan and one aggregation.

    A gas summed over sectors is 0 in a year nothing is reported (missing only if the scenario reports no sector
    at all); a gas reported directly stays missing. With a vintage the values are in Mt CO2e.
    """
    v, y = F.col("Variable"), F.col("year")
    aggs, out = [], []
    for gas in gases:
        names = list(fixed.GAS_VARIABLES[gas])
        mine = v.isin(names)
        if len(names) > 1:
            aggs.append(F.bool_or(mine).alias(f"_has_{gas}"))
        for year in years:
            aggs.append(F.sum(F.when(mine & (y == year), F.col("value"))).alias(f"_{gas}_{year}"))
            value = F.col(f"_{gas}_{year}")
            if len(names) > 1:
                value = F.when(F.col(f"_has_{gas}"), F.coalesce(value, F.lit(0.0)))
            out.append((co2e(value, gas, vintage) if vintage else value).alias(f"{gas}_{year}"))
    wanted = [n for gas in gases for n in fixed.GAS_VARIABLES[gas]]
    return df.where(v.isin(wanted)).groupBy("scen_id").agg(*aggs).select("scen_id", *out)


def eip_co2e(df: DataFrame, gas: str, vintage: str = "AR6", name: str | None = None) -> DataFrame:
    sectors = fixed.N2O_SECTORS if gas == "N2O" else fixed.CH4_SECTORS
    out = sum_variables(df, sectors).withColumn("value", co2e("value", gas, vintage))
    return out.select("scen_id", F.lit(name or f"EIP {gas} CO2e").alias("Variable"), "year", "value")


def removals_sum(df: DataFrame, name: str = fixed.REMOVALS_SUM) -> DataFrame:
    """The three removal variables as reported, summed."""
    return sum_variables(df, fixed.REMOVALS).withColumn("Variable", F.lit(name)).select(*LONG)


def land_sector_rows(df: DataFrame, vintage: str = "AR5", convert: bool = True) -> DataFrame:
    gases = [fixed.AFOLU_CO2, fixed.AFOLU_CH4, fixed.AFOLU_N2O]
    return df.where(F.col("Variable").isin(gases)).withColumn(
        "value", land_sector_co2e("Variable", "value", vintage, convert)
    )


def afolu_co2_cumulative(df: DataFrame, first: int = 2020, last: int = 2050, keys: Sequence[str] = ("scen_id",),
                         out: str = "afolu_co2", step: int = 1) -> DataFrame:
    rows = df.where(F.col("Variable") == fixed.AFOLU_CO2)
    return interpolated_total(rows, keys, first, last, zero_missing=True, out=out, step=step)


def afolu_co2e_cumulative(df: DataFrame, first: int = 2020, last: int = 2050, keys: Sequence[str] = ("scen_id",),
                          vintage: str = "AR5", convert: bool = True, out: str = "afolu_co2e",
                          step: int = 1) -> DataFrame:
    """Land-sector gases summed per year, zeros missing, gaps filled, summed over the slice."""
    yearly = land_sector_rows(df, vintage, convert).groupBy(*keys, "year").agg(sum_or_zero("value").alias("value"))
    return interpolated_total(yearly, keys, first, last, zero_missing=True, out=out, step=step)


def afolu_co2e_year(df: DataFrame, year: int = 2050, vintage: str = "AR5", convert: bool = True,
                    out: str = "afolu_co2e") -> DataFrame:
    """Land-sector CO2e of one year; 0 for scenarios that report the sector but not that year."""
    rows = land_sector_rows(df, vintage, convert)
    return rows.groupBy("scen_id").agg(sum_or_zero(F.when(F.col("year") == year, F.col("value"))).alias(out))


def fossil_ch4_co2e(df: DataFrame, source: str, vintage: str = "AR6") -> DataFrame:
    """Methane rows of one source in CO2e."""
    return df.where(F.col("Source") == source).withColumn("value", co2e("value", "CH4", vintage))
