"""Pieces the reports share: cohorts, gross frames, cohort medians, key metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import fixed
from pathloom.functions.columns import land_sector_co2e, share_of, sum_or_zero, value_when
from pathloom.operators.emissions import eip_at, eip_yearly
from pathloom.operators.joins import by_cohort, in_ids
from pathloom.operators.reshape import stack_rows
from pathloom.operators.screens import removed_by, screen_criteria
from pathloom.operators.summary import median
from pathloom.operators.timeaxis import interpolated_total
from pathloom.sources.staging import Staging
from pathloom.sources.tables import ScenarioDb

DECADES = (2020, 2030, 2040, 2050, 2060)
MILESTONES = (2020, 2030, 2040, 2050)
LAND_GASES = (fixed.AFOLU_CO2, fixed.AFOLU_CH4, fixed.AFOLU_N2O)
QUARTILES = {"25th perc": 0.25, "median": 0.5, "75th perc": 0.75}


def shared(df: DataFrame, staging: Staging | None = None) -> DataFrame:
    """A frame that a report uses more than once, computed once by whatever action needs it first."""
    return (staging or Staging.of(df.sparkSession)).shared(df)


def candidates(db: ScenarioDb, category: str = fixed.TARGET_CATEGORY) -> DataFrame:
    return db.key.where(F.col("Category") == category).select("scen_id")


def filtered(db: ScenarioDb, limits: fixed.Limits, flag: int = 7, category: str = fixed.TARGET_CATEGORY) -> DataFrame:
    """Candidates that survive a screen. Only the candidates' rows are screened."""
    ids = candidates(db, category)
    removed = screen_criteria(in_ids(db.long, ids), limits).where(removed_by(flag))
    return ids.join(removed.select("scen_id"), "scen_id", "left_anti")


def marked(db: ScenarioDb, markers: Sequence[str]) -> DataFrame:
    return db.key.where(F.col("IMP_marker").isin(list(markers))).select("scen_id", "IMP_marker")


_NAMES = {"net": fixed.NET_TOTAL, "gross": fixed.GROSS_TOTAL}


def net_and_gross_at(db: ScenarioDb, ids: DataFrame, years: Sequence[int], kinds=("net", "gross")) -> DataFrame:
    """Net totals and gross emissions of ``ids`` at listed years, long, from one pass.

    Totals are filled; a missing reported net value stays absent, gross is 0 where nothing is reported.
    """
    items = {f"{k}_{y}": {"Variable": _NAMES[k], "year": y} for k in kinds for y in years}
    return stack_rows(eip_at(db.long, ids, years), ("scen_id",), items).where(F.col("value").isNotNull())


def gross_at(db: ScenarioDb, ids: DataFrame, years: Sequence[int]) -> DataFrame:
    return net_and_gross_at(db, ids, years, ("gross",))


def net_at(db: ScenarioDb, ids: DataFrame, years: Sequence[int]) -> DataFrame:
    return net_and_gross_at(db, ids, years, ("net",))


def net_and_gross_every_year(db: ScenarioDb, ids: DataFrame, first: int, last: int) -> DataFrame:
    """As ``net_and_gross_at`` for every year of a range."""
    items = {k: {"Variable": v} for k, v in _NAMES.items()}
    long = stack_rows(eip_yearly(db.long, ids, first, last), ("scen_id", "year"), items)
    return long.where(F.col("value").isNotNull()).select("scen_id", "Variable", "year", "value")


def gross_every_year(db: ScenarioDb, ids: DataFrame) -> DataFrame:
    """Gross emissions of ``ids`` for each year of the table, 0 where nothing is reported."""
    rows = eip_yearly(db.long, ids, db.first_year, db.last_year)
    return rows.select("scen_id", F.lit(fixed.GROSS_TOTAL).alias("Variable"), "year", F.col("gross").alias("value"))


def net_every_year(db: ScenarioDb, ids: DataFrame, first: int, last: int) -> DataFrame:
    rows = eip_yearly(db.long, ids, first, last).where(F.col("net").isNotNull())
    return rows.select("scen_id", F.lit(fixed.NET_TOTAL).alias("Variable"), "year", F.col("net").alias("value"))


def cohort_medians(rows: DataFrame, members: DataFrame, years: Sequence[int], name: str = "cohort") -> DataFrame:
    """Median per cohort, variable and milestone, milestones as columns, and the number of scenarios ``n``.

    ``n`` is the largest count over the milestones: the cohort's size if every member has a value somewhere.
    """
    med = median(by_cohort(rows, members, name=name), (name, "Variable", "year"), count="n")
    return med.groupBy(name, "Variable").agg(
        *[F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"y{y}") for y in years], F.max("n").alias("n")
    )


def cumulative_gross(db: ScenarioDb, ids: DataFrame, first: int = 2020, last: int = 2050,
                     out: str = "cum_gross") -> DataFrame:
    """Gross emissions of ``ids``: zeros missing, gaps filled, summed over the slice."""
    yearly = eip_yearly(db.long, ids, first, last).select("scen_id", "year", F.col("gross").alias("value"))
    return interpolated_total(yearly, ("scen_id",), first, last, zero_missing=True, out=out)


KEY_METRICS = (
    "afolu_co2e_2050", "final_energy_2050", "max_bioenergy", "cum_ccs_2010_2050", "removals_2050",
    "ren_share_2050", "ren_share_2030", "industrial_ccs_2050", "cum_gross_2020_2050",
)


def key_metrics(db: ScenarioDb, ids: DataFrame) -> DataFrame:
    """Nine metrics per scenario. Seven come from one conditional aggregation, two need the gap filling: of the captured
    carbon, and of the gross emissions, which are put together first."""
    v, y = F.col("Variable"), F.col("year")

    def at(name: str, year: int):
        return value_when((v == name) & (y == year))

    removal, land = v.isin(list(fixed.REMOVALS)), v.isin(list(LAND_GASES))
    rows = in_ids(db.long, ids)
    plain = (
        rows.where(v.isin([fixed.FINAL_ENERGY, fixed.BIOENERGY, fixed.PRIMARY_ENERGY, fixed.RENEWABLES,
                           fixed.CCS_INDUSTRY, *fixed.REMOVALS, *LAND_GASES]))
        .groupBy("scen_id")
        .agg(
            at(fixed.FINAL_ENERGY, 2050).alias("final_energy_2050"),
            value_when((v == fixed.BIOENERGY) & y.between(2010, 2050)).alias("max_bioenergy"),
            F.when(F.bool_or(removal), sum_or_zero(F.when(removal & (y == 2050), F.col("value")))).alias("removals_2050"),
            share_of(at(fixed.RENEWABLES, 2050), at(fixed.PRIMARY_ENERGY, 2050)).alias("ren_share_2050"),
            share_of(at(fixed.RENEWABLES, 2030), at(fixed.PRIMARY_ENERGY, 2030)).alias("ren_share_2030"),
            at(fixed.CCS_INDUSTRY, 2050).alias("industrial_ccs_2050"),
            F.when(F.bool_or(land), sum_or_zero(F.when(y == 2050, land_sector_co2e(v, "value")))).alias("afolu_co2e_2050"),
        )
    )
    ccs = interpolated_total(rows.where(v == fixed.CCS), ("scen_id",), 2010, 2050, out="cum_ccs_2010_2050")
    gross = cumulative_gross(db, ids, out="cum_gross_2020_2050")
    # every frame is about ids only, so left joins align them without a shuffle
    out = ids.select("scen_id")
    for frame in (plain, ccs, gross):
        out = out.join(frame, "scen_id", "left")
    return out.select("scen_id", *KEY_METRICS)
