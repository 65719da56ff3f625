"""Named report pipelines. Each takes a scenario database and returns one result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import fixed
from pathloom.functions.columns import apply_change, co2e, joined_key, relative_change, share_of, value_when, zero_as_missing
from pathloom.operators.emissions import (
    afolu_co2_cumulative, afolu_co2e_cumulative, eip_at, gases_at, gross_emissions, gross_emissions_plain,
    removals_sum,
)
from pathloom.operators.harmonise import Harmonised, harmonise_budget
from pathloom.operators.joins import align, by_cohort, flag_members, in_ids, intersect_ids, recode, union_all
from pathloom.operators.reshape import pivot_multi_value, pivot_variables, pivot_years, stack_rows, unpivot_years
from pathloom.operators.screens import screen_cohorts, screen_criteria
from pathloom.operators.summary import (
    add_total, boxplot_stats, change_columns, interquartile_band, median, pearson_cor_test, quantile_rows, quantiles,
    scatter_vs_identity, sums_at, welch_t_test,
)
from pathloom.operators.timeaxis import anchor_and_bridge, densify_years, interpolated_total, milestones, slice_max
from pathloom.plans.building import (
    DECADES, KEY_METRICS, MILESTONES, QUARTILES, candidates, cohort_medians, filtered, gross_at, gross_every_year,
    key_metrics, marked, net_and_gross_at, net_and_gross_every_year, net_every_year, shared,
)
from pathloom.sources.staging import Staging
from pathloom.sources.tables import ScenarioDb

Limits = fixed.Limits


# --- cohort quantiles -----------------------------------------------------------

def sr15_quantiles(older: ScenarioDb, categories: Sequence[str] = fixed.OLDER_CATEGORIES,
                   in_range: str = fixed.OLDER_IN_RANGE) -> DataFrame:
    """Quartiles of net, captured and gross emissions per year for the older generation's cohort."""
    ids = older.key.where(F.col("category").isin(list(categories)) & (F.col("kyoto_2010") == in_range))
    rows = in_ids(older.long.where(F.col("Variable").isin(fixed.NET_TOTAL, fixed.BECCS)), ids)
    cols = ("scen_id", "Variable", "year", "value")
    gross = sums_at(gross_emissions_plain(rows), older.years).withColumn("Variable", F.lit(fixed.GROSS_TOTAL))
    both = rows.select(*cols).unionByName(gross.select(*cols))
    q = quantile_rows(both, ("Variable", "year"), QUARTILES)
    label = F.coalesce(*[F.when(F.col("perc") == p, F.lit(text)) for p, text in fixed.OLDER_LABELS.items()])
    return q.withColumn("source", label)


def sr15_cross_sector(older: ScenarioDb, external_ch4: DataFrame) -> DataFrame:
    """The quartiles, plus mean energy N2O in CO2e and an external methane path."""
    ids = older.key.where(
        F.col("category").isin(list(fixed.OLDER_CATEGORIES)) & (F.col("kyoto_2010") == fixed.OLDER_IN_RANGE)
    )
    n2o = (
        in_ids(older.long.where(F.col("Variable") == fixed.N2O_ENERGY), ids)
        .groupBy("year")
        .agg(co2e(F.avg("value"), "N2O", "AR5").alias("value"))
        .select("year", "value", F.lit(fixed.OLDER_MEAN_LABEL).alias("source"),
                F.lit(fixed.N2O_ENERGY_CO2E).alias("Variable"))
    )
    ch4 = external_ch4.select("year", "value", F.lit(fixed.EXTERNAL_CH4_LABEL).alias("source"),
                              F.lit(fixed.CH4_FOSSIL_CO2E).alias("Variable"))
    return union_all(sr15_quantiles(older), n2o, ch4)


def filtered_quantiles(db: ScenarioDb, list_a: DataFrame, variables: Sequence[str] | None = None,
                       years: Sequence[int] | None = None) -> DataFrame:
    """Quartiles of the C1 cohort and of an external id list, per variable and year.

    Every variable, gross emissions and every year, unless ``variables`` or ``years`` name fewer.
    """
    c1 = candidates(db)
    ids = c1.unionByName(list_a.select("scen_id")).distinct()
    tags = F.array_compact(F.array(
        F.when(F.col("in_c1") == 1, F.lit(fixed.COHORT_LABEL)), F.when(F.col("in_a") == 1, F.lit(fixed.LIST_A_LABEL))
    ))
    members = flag_members(flag_members(ids, c1, "in_c1"), list_a, "in_a").select("scen_id", tags.alias("source"))
    cols = ("scen_id", "Variable", "year", "value")
    other = in_ids(db.long.where(F.col("Variable") != fixed.NET_TOTAL), ids).select(*cols)
    rows = net_and_gross_every_year(db, ids, db.first_year, db.last_year)
    if variables is None:
        rows = other.unionByName(rows)
    elif set(variables) - {fixed.NET_TOTAL, fixed.GROSS_TOTAL}:
        rows = other.unionByName(rows).where(F.col("Variable").isin(list(variables)))
    else:
        rows = rows.where(F.col("Variable").isin(list(variables)))
    if years is not None:
        rows = milestones(rows, years)
    return quantile_rows(by_cohort(rows, members, name="source"), ("source", "Variable", "year"), QUARTILES)


def illustrative_paths(db: ScenarioDb, markers: Sequence[str] = fixed.MARKERS) -> DataFrame:
    return gross_every_year(db, marked(db, markers).select("scen_id"))


def _all_flags(db: ScenarioDb, limits: Limits, flags=tuple(fixed.SCREEN_FLAGS)) -> DataFrame:
    c1 = candidates(db)
    return screen_cohorts(c1, screen_criteria(in_ids(db.long, c1), limits), flags).withColumnRenamed(
        "cohort", "filter_flag"
    )


def _flag_medians(rows: DataFrame, members: DataFrame) -> DataFrame:
    return cohort_medians(rows, members, DECADES, "filter_flag")


def compare_filters_co2(db: ScenarioDb, limits: Limits) -> DataFrame:
    """Median gross emissions per screening flag, change since 2020, number of scenarios."""
    members = _all_flags(db, limits)
    med = _flag_medians(gross_at(db, candidates(db), DECADES), members)
    # gross emissions have a value for every candidate in every milestone
    return change_columns(med, (2030, 2050)).withColumnRenamed("n", "num_scenarios")


def _gas_items(gases: Sequence[str], years: Sequence[int], label: str = "EIP {} CO2e") -> dict[str, dict]:
    return {f"{g}_{y}": {"Variable": label.format(g), "year": y} for g in gases for y in years}


def components_at(db: ScenarioDb, ids: DataFrame, years: Sequence[int]) -> DataFrame:
    """Gross CO2 and energy and industry N2O and CH4 in CO2e of ``ids`` at listed years, long.

    Both parts are one row per scenario and are joined as such, so nothing is shuffled.
    """
    gases = gases_at(in_ids(db.long, ids), years, ("N2O", "CH4"), "AR6")
    both = eip_at(db.long, ids, years).join(gases, "scen_id", "left")
    gross = {f"gross_{y}": {"Variable": fixed.GROSS_TOTAL, "year": y} for y in years}
    rows = stack_rows(both, ("scen_id",), {**gross, **_gas_items(("N2O", "CH4"), years)})
    return rows.where(F.col("value").isNotNull())


def compare_filters_nonco2(db: ScenarioDb, limits: Limits) -> DataFrame:
    """Median N2O and CH4 in CO2e per screening flag."""
    members = _all_flags(db, limits)
    wide = gases_at(in_ids(db.long, candidates(db)), DECADES, ("N2O", "CH4"), "AR6")
    rows = stack_rows(wide, ("scen_id",), _gas_items(("N2O", "CH4"), DECADES)).where(F.col("value").isNotNull())
    med = cohort_medians(rows, members, DECADES, "filter_flag")
    return med.drop("n").withColumn("Units", F.lit("MtCO2e/year"))


def compare_filters_total(db: ScenarioDb, limits: Limits) -> DataFrame:
    """The three medians added per flag."""
    members = _all_flags(db, limits)
    rows = components_at(db, candidates(db), DECADES)
    med = cohort_medians(rows, members, DECADES, "filter_flag")
    size = F.max(F.when(F.col("Variable") == fixed.GROSS_TOTAL, F.col("n")))
    total = med.groupBy("filter_flag").agg(
        *[F.sum(f"y{y}").alias(f"y{y}") for y in DECADES], size.alias("num_scenarios")
    )
    return change_columns(total, (2030, 2050))


def fig_gross(db: ScenarioDb, limits: Limits, years: Sequence[int] = DECADES, zero_missing: bool = False,
              staging: Staging | None = None) -> DataFrame:
    """Gross emissions of each C1 scenario at milestones, and a row with the median of the filtered ones."""
    # the rows themselves and the median of some of them
    rows = shared(gross_at(db, candidates(db), years), staging)
    if zero_missing:
        rows = rows.withColumn("value", zero_as_missing("value"))
    med = median(in_ids(rows, filtered(db, limits)), ("year",))
    med = med.withColumn("scen_id", F.lit(fixed.FILTERED_MEDIAN))
    return pivot_years(rows, ("scen_id",), years).unionByName(pivot_years(med, ("scen_id",), years))


def gross_summary(db: ScenarioDb, limits: Limits, staging: Staging | None = None) -> DataFrame:
    """As ``fig_gross`` with zeros missing, tagged with the variable."""
    return fig_gross(db, limits, DECADES, True, staging).withColumn("Variable", F.lit(fixed.GROSS_TOTAL))


def afforestation_test(db: ScenarioDb) -> DataFrame:
    """Land-use sequestration maximum against net and gross emissions and their change."""
    c1, years = candidates(db), (2020, 2030, 2050)
    land = slice_max(in_ids(db.long.where(F.col("Variable") == fixed.LAND_USE), c1), ("scen_id",), 2010, 2050,
                     out="max_lu_seq")
    # net and gross hold every C1 scenario, so they are the left side of the alignment
    out = eip_at(db.long, c1, years).join(land, "scen_id", "left")
    return out.withColumns(
        {f"perc_ch_{k}_{y}": relative_change(f"{k}_2020", f"{k}_{y}") for y in (2030, 2050) for k in ("net", "gross")}
    )


def final_energy(db: ScenarioDb, limits: Limits) -> DataFrame:
    """Final energy quartiles at milestones for flags 0 and 7."""
    members = _all_flags(db, limits, (0, 7))
    rows = milestones(db.long.where(F.col("Variable") == fixed.FINAL_ENERGY), DECADES)
    rows = by_cohort(rows.select("scen_id", "Variable", "year", "value"), members, name="filter_flag")
    q = quantile_rows(rows, ("filter_flag", "Variable", "year"), {"q25": 0.25, "q50": 0.5, "q75": 0.75}, label="quantile")
    q = q.withColumn("quantile", F.substring("quantile", 2, 2).cast("double") / 100)
    return pivot_years(q, ("filter_flag", "Variable", "quantile"), DECADES)


# --- key variables ----------------------------------------------------------------

def key_variables_filtered(db: ScenarioDb, limits: Limits, external: DataFrame) -> DataFrame:
    """Mean of each metric over the filtered scenarios and the external rows."""
    # metrics of all candidates, then the survivors: the screen runs once instead of under every metric
    rows = union_all(in_ids(key_metrics(db, candidates(db)), filtered(db, limits)), external)
    long = rows.unpivot(["scen_id"], list(KEY_METRICS), "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("scenario_set_mean"))


def key_variables_c1(db: ScenarioDb) -> DataFrame:
    """Quartiles of six metrics over C1."""
    six = [m for m in KEY_METRICS if m not in ("final_energy_2050", "ren_share_2030", "industrial_ccs_2050")]
    long = key_metrics(db, candidates(db)).unpivot(["scen_id"], six, "metric", "value")
    return quantiles(long, ("metric",), {"c1_25_perc": 0.25, "c1_75_perc": 0.75})


def afolu_by_model(db: ScenarioDb, step: int = 5) -> DataFrame:
    """Land-sector totals over a stepped grid of years, one row per model."""
    co2 = db.long.where(F.col("Variable") == fixed.AFOLU_CO2)
    yearly = co2.groupBy("Model", "year").agg(F.sum("value").alias("value"))
    return align(
        afolu_co2e_cumulative(db.long, keys=("Model",), step=step),
        interpolated_total(yearly, ("Model",), 2020, 2050, out="afolu_co2", step=step),
        on="Model",
    )


def n2o_ch4(db: ScenarioDb) -> DataFrame:
    """C1 medians of energy and industry N2O and CH4 in their own units."""
    wide = gases_at(in_ids(db.long, candidates(db)), MILESTONES, ("N2O", "CH4"))
    rows = stack_rows(wide, ("scen_id",), _gas_items(("N2O", "CH4"), MILESTONES, "EIP {}"))
    med = median(rows, ("Variable", "year"))
    return pivot_years(med, ("Variable",), MILESTONES)


def renewables_2030(db: ScenarioDb, limits: Limits, year: int = 2030) -> DataFrame:
    """Renewable share: quartiles of C1 and the median of the filtered scenarios, one row."""
    members = _all_flags(db, limits, (0, 7))
    v = F.col("Variable")
    at = db.long.where((F.col("year") == year) & v.isin(fixed.PRIMARY_ENERGY, fixed.RENEWABLES))
    shares = pivot_variables(at, ("scen_id",), {fixed.PRIMARY_ENERGY: "whole", fixed.RENEWABLES: "part"}).select(
        "scen_id", share_of("part", "whole").alias("value")
    )
    q = quantiles(by_cohort(shares, members, name="filter_flag"), ("filter_flag",),
                  {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    flag = F.col("filter_flag")
    return q.agg(
        F.max(F.when(flag == 0, F.col("p25"))).alias("c1_25"), F.max(F.when(flag == 0, F.col("p75"))).alias("c1_75"),
        F.max(F.when(flag == 7, F.col("p50"))).alias("filtered_median"),
    )


def industrial_ccs(db: ScenarioDb, limits: Limits, year: int = 2050) -> DataFrame:
    rows = db.long.where((F.col("Variable") == fixed.CCS_INDUSTRY) & (F.col("year") == year))
    return median(in_ids(rows, filtered(db, limits)), (), out="filtered_median")


def kyoto_gases(db: ScenarioDb, limits: Limits) -> DataFrame:
    """Medians of all gases for C1 and the filtered set.

    ``num_scen`` counts scenarios reporting 2050 for the fluorinated gases, all reporting scenarios for the
    sector sums.
    """
    c1 = candidates(db)
    members = _all_flags(db, limits, (0, 7))
    source = F.when(F.col("filter_flag") == 0, fixed.MEDIAN_OF_C1).otherwise(fixed.MEDIAN_OF_FILTERED)
    items = _gas_items(("N2O", "CH4"), MILESTONES, "EIP {}") | _gas_items(("HFC", "PFC", "SF6"), MILESTONES, "Emissions|{}")
    rows = stack_rows(gases_at(in_ids(db.long, c1), MILESTONES), ("scen_id",), items)
    tagged = by_cohort(rows.where(F.col("value").isNotNull()), members, name="filter_flag")
    med = median(tagged, ("filter_flag", "Variable", "year"), count="n")
    # the sector sums have a value in every milestone, so counting 2050 counts their scenarios
    out = med.groupBy("filter_flag", "Variable").agg(
        *[F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"y{y}") for y in MILESTONES],
        F.coalesce(F.max(F.when(F.col("year") == 2050, F.col("n"))), F.lit(0)).alias("num_scen"),
    )
    return out.withColumn("source", source).drop("filter_flag")


def external_comparison(db: ScenarioDb, limits: Limits, list_b: DataFrame) -> DataFrame:
    """Median gross emissions of the filtered scenarios and of an external list (totals filled for C1 only)."""
    c1, filt = candidates(db), filtered(db, limits)
    ids = c1.unionByName(list_b.select("scen_id")).distinct()
    tags = F.array_compact(F.array(
        F.when(F.col("in_f") == 1, F.lit(fixed.FILTERED_LABEL)), F.when(F.col("in_b") == 1, F.lit(fixed.LIST_B_LABEL))
    ))
    members = flag_members(flag_members(ids, filt, "in_f"), list_b, "in_b").select("scen_id", tags.alias("Source"))
    rows = gross_at(db, flag_members(ids, c1, "in_c1").select("scen_id", (F.col("in_c1") == 1).alias("fill")), MILESTONES)
    return cohort_medians(rows, members, MILESTONES, "Source").drop("n")


# --- benchmarks -------------------------------------------------------------------

def non_co2_pathway(db: ScenarioDb, years: Sequence[int] = MILESTONES) -> DataFrame:
    """C1 medians of the other gases in CO2e, one row per gas: Variable, y<year>..."""
    wide = gases_at(in_ids(db.long, candidates(db)), years, vintage="AR6")
    rows = stack_rows(wide, ("scen_id",), _gas_items(tuple(fixed.GAS_VARIABLES), years, "{} (Mt CO2e)"))
    med = median(rows, ("Variable", "year"))
    return pivot_years(med, ("Variable",), years).withColumn("Source", F.lit(fixed.BENCHMARK))


_Y = [f"y{y}" for y in MILESTONES]
_LATER = (2030, 2040, 2050)


def _with_total(co2: DataFrame, other: DataFrame) -> DataFrame:
    return add_total(union_all(co2, other), "Variable", fixed.GROSS_CO2E, _Y, ("Source",))


def benchmark_unharmonised(db: ScenarioDb, limits: Limits, focal: DataFrame, markers: Sequence[str] = fixed.FOCAL_MARKERS,
                           external: Sequence[str] = ("NZE",), anchor: float = fixed.GROSS_2020_ANCHOR,
                           staging: Staging | None = None) -> DataFrame:
    """Filtered median and focal scenarios; their mean change moves the 2020 anchor; other gases and the total."""
    marker_ids = marked(db, markers)
    either = (F.col("Category") == fixed.TARGET_CATEGORY) | F.col("IMP_marker").isin(list(markers))
    gross = shared(gross_at(db, db.key.where(either).select("scen_id"), MILESTONES), staging)
    med = median(in_ids(gross, filtered(db, limits)), ("year",))
    marker_rows = gross.join(marker_ids.withColumnRenamed("IMP_marker", "Source"), "scen_id")
    members = union_all(
        pivot_years(med.withColumn("Source", F.lit(fixed.FILTERED_LABEL)), ("Source",), MILESTONES),
        pivot_years(marker_rows, ("scen_id", "Source"), MILESTONES), focal.where(F.col("Source").isin(list(external))),
    )
    # each member counts as itself and once more under the benchmark, whose values come from the mean change
    is_mean = F.col("kind") == "mean"
    grouped = (
        change_columns(members, _LATER)
        .withColumn("kind", F.explode(F.array(F.lit("member"), F.lit("mean"))))
        .groupBy(
            "kind", F.when(~is_mean, F.col("scen_id")).alias("scen_id"),
            F.when(is_mean, F.lit(fixed.BENCHMARK)).otherwise(F.col("Source")).alias("Source"),
        )
        .agg(*[F.max(c).alias(c) for c in _Y], *[F.avg(f"percch_{y}").alias(f"c{y}") for y in _LATER])
    )
    co2 = grouped.select(
        "kind", "scen_id", F.lit(fixed.GROSS_CO2).alias("Variable"), "Source",
        F.when(is_mean, F.lit(anchor)).otherwise(F.col("y2020")).alias("y2020"),
        *[F.when(is_mean, apply_change(anchor, f"c{y}")).otherwise(F.col(f"y{y}")).alias(f"y{y}") for y in _LATER],
    )
    other = non_co2_pathway(db).withColumns({"kind": F.lit("mean")})
    rows = union_all(co2, other)
    total = F.lit(fixed.GROSS_CO2E)
    labels = F.when(is_mean, F.array(F.col("Variable"), total)).otherwise(F.array(F.col("Variable")))
    # several scenarios may share a source, so members stay apart by scenario
    out = rows.withColumn("Variable", F.explode(labels)).groupBy("Variable", "Source", "scen_id").agg(
        *[F.sum(c).alias(c) for c in _Y]
    )
    return change_columns(out.drop("scen_id"), _LATER)


def harmonised_net(net: DataFrame, history: DataFrame, staging: Staging | None = None) -> Harmonised:
    """``net``: scen_id, year, value."""
    return harmonise_budget(net.withColumn("Region", F.lit("World")), history, ("scen_id",),
                            keep=lambda frame: shared(frame, staging))


def harmonised_gross(db: ScenarioDb, harmonised: DataFrame) -> DataFrame:
    """Gross emissions of harmonised net trajectories (scen_id, year, value), each year of 2020-2050."""
    cols = ("scen_id", "Variable", "year", "value")
    net = harmonised.select("scen_id", F.lit(fixed.NET_TOTAL).alias("Variable"), "year", "value")
    removals = in_ids(db.long.where(F.col("Variable").isin(list(fixed.REMOVALS))), harmonised)
    gross = gross_emissions(removals.select(*cols).unionByName(net), fill=True, first=db.first_year, last=db.last_year,
                            name=fixed.GROSS_HARMONISED)
    dense = densify_years(gross, ("scen_id", "Variable"), 2020, 2050)
    return dense.select("scen_id", "Variable", "year", F.coalesce("value", F.lit(0.0)).alias("value"))


def _as_gross(external: DataFrame) -> DataFrame:
    return external.select("scen_id", F.lit(fixed.GROSS_TOTAL).alias("Variable"), "year", "value")


def combined_emissions(db: ScenarioDb, limits: Limits, history: DataFrame, external: DataFrame,
                       staging: Staging | None = None) -> DataFrame:
    """Net and gross emissions of the filtered scenarios, before and after harmonisation, and an external path.

    ``external``: scen_id, year, value.
    """
    # net is harmonised and reported, and the harmonised net is reported and made gross
    both = shared(net_and_gross_every_year(db, filtered(db, limits), 2020, 2050), staging)
    harmonised = harmonised_net(both.where(F.col("Variable") == fixed.NET_TOTAL), history, staging).trajectories
    out = union_all(
        both.withColumn("value", zero_as_missing("value")),
        harmonised.select("scen_id", F.lit(fixed.NET_HARMONISED).alias("Variable"), "year", "value"),
        harmonised_gross(db, harmonised), _as_gross(external),
    )
    return out.where(F.col("value").isNotNull())


def harmonised_paths(db: ScenarioDb, limits: Limits, history: DataFrame, external: DataFrame,
                     staging: Staging | None = None) -> DataFrame:
    """The rows of ``combined_emissions`` that the benchmark takes: harmonised gross emissions and the external path."""
    net = net_every_year(db, filtered(db, limits), 2020, 2050)
    gross = harmonised_gross(db, harmonised_net(net, history, staging).trajectories)
    return gross.unionByName(_as_gross(external)).where(F.col("value").isNotNull())


def benchmark_harmonised(db: ScenarioDb, combined: DataFrame, external_id: str = fixed.EXTERNAL_ID,
                         anchor: float = fixed.GROSS_2020_ANCHOR, staging: Staging | None = None) -> DataFrame:
    """Median of the harmonised gross paths and the external one, other gases, total, change since 2020.

    ``combined``: the combined emissions, or only the rows of them that count (``harmonised_paths``).
    """
    harm = F.col("Variable") == fixed.GROSS_HARMONISED
    rows = shared(combined.where(harm | (F.col("scen_id") == external_id)), staging)
    paths = shared(milestones(anchor_and_bridge(rows, harm, anchor), MILESTONES), staging)
    med = median(paths, ("year",))
    co2 = pivot_years(
        med.withColumn("Variable", F.lit(fixed.GROSS_CO2)), ("Variable",), MILESTONES
    ).withColumn("Source", F.lit(fixed.BENCHMARK))
    return change_columns(_with_total(co2, non_co2_pathway(db)), (2030, 2040, 2050))


def harmonised_long(db: ScenarioDb, limits: Limits, history: DataFrame, staging: Staging | None = None) -> DataFrame:
    """History, model and harmonised net emissions of the filtered scenarios in one labelled long table."""
    net = shared(net_every_year(db, filtered(db, limits), 2020, 2050), staging)
    harm = harmonised_net(net, history, staging).trajectories
    names = db.key.select("scen_id", "Model", "Scenario")

    def named(df: DataFrame, variable: str) -> DataFrame:
        return df.join(names, "scen_id").select(
            "Model", "Scenario", F.lit("World").alias("Region"), F.lit(variable).alias("Variable"), "year",
            F.col("value").alias("Emissions"),
        )

    hist = history.select(
        F.lit("History").alias("Model"), F.lit("Historical").alias("Scenario"), "Region",
        F.lit(fixed.NET_TOTAL).alias("Variable"), "year", F.col("value").alias("Emissions"),
    )
    out = union_all(
        hist, named(net, fixed.NET_TOTAL), named(harm, fixed.NET_HARMONISED)
    )
    return out.where(F.col("Region") == "World").withColumn("Label", joined_key("Model", "Variable"))


# --- scenario tables --------------------------------------------------------------

def filtered_metadata(db: ScenarioDb, limits: Limits) -> DataFrame:
    return in_ids(db.key, filtered(db, limits)).select("Model", "Scenario", "Literature_reference")


def ambition_rows(db: ScenarioDb, years: Sequence[int]) -> DataFrame:
    """Net, summed removals and gross emissions of C1 at listed years, long."""
    c1 = candidates(db)
    cols = ("scen_id", "Variable", "year", "value")
    removals = sums_at(in_ids(removals_sum(db.long), c1), years).withColumn("Variable", F.lit(fixed.REMOVALS_SUM))
    return net_and_gross_at(db, c1, years).unionByName(removals.select(*cols))


def ambition_table(db: ScenarioDb, limits: Limits, years: Sequence[int] | None = None) -> DataFrame:
    """One row per scenario and variable, years as columns (all of the table unless listed), filtered 0/1."""
    years = years or range(db.first_year, db.last_year + 1)
    wide = pivot_years(ambition_rows(db, years), ("scen_id", "Variable"), years)
    return flag_members(wide, filtered(db, limits), "filtered")


def removals_cumulative(db: ScenarioDb) -> DataFrame:
    """Cumulative net emissions, removals and gross emissions per C1 scenario: to 2050 and to the last year."""
    c1 = candidates(db)
    cols = ("scen_id", "Variable", "year", "value")
    rows = net_and_gross_every_year(db, c1, db.first_year, db.last_year).unionByName(
        in_ids(removals_sum(db.long), c1).select(*cols)
    )
    ends = {"cum_sum_20_50": 2050, "cum_sum_20_2100": min(2099, db.last_year)}
    # both windows in one pass: each row counts towards every end it precedes
    rows = rows.withColumn("upto", F.explode(F.array(*[F.lit(y) for y in ends.values()])))
    totals = interpolated_total(rows, ("scen_id", "Variable", "upto"), 2020, F.col("upto"), True)
    return totals.groupBy("scen_id", "Variable").agg(
        *[F.max(F.when(F.col("upto") == y, F.col("total"))).alias(n) for n, y in ends.items()]
    )


def removal_ratio(db: ScenarioDb) -> DataFrame:
    names = {fixed.REMOVALS_SUM: "removals", fixed.NET_TOTAL: "net", fixed.GROSS_TOTAL: "gross"}
    wide = pivot_multi_value(removals_cumulative(db), ("scen_id",), names, ("cum_sum_20_50", "cum_sum_20_2100"))
    return wide.withColumn("ratio_removals_net_2050", share_of("cum_sum_20_50_removals", "cum_sum_20_50_net"))


def c1_band(db: ScenarioDb, staging: Staging | None = None) -> DataFrame:
    """Quartiles of the C1 scenarios' gross emissions at each milestone, zeros missing: year, c1_25, c1_75."""
    gross = shared(gross_at(db, candidates(db), DECADES), staging)
    rows = gross.where(F.col("year").isin(list(MILESTONES))).withColumn("value", zero_as_missing("value"))
    return interquartile_band(rows, ("year",))


def band_vs_median(db: ScenarioDb, limits: Limits, staging: Staging | None = None) -> DataFrame:
    """All C1 trajectories and the filtered median, long, with the C1 quartile band of each milestone."""
    wide = gross_summary(db, limits, staging)
    long = unpivot_years(wide, ["scen_id", "Variable"], [f"y{y}" for y in DECADES], "CO2", strip="y")
    return long.join(c1_band(db, staging), "year", "left")


def raw_vs_harmonised(combined: DataFrame, external_id: str = fixed.EXTERNAL_ID) -> DataFrame:
    keep = F.col("Variable").isin(fixed.GROSS_TOTAL, fixed.GROSS_HARMONISED) & (F.col("scen_id") != external_id)
    rows = combined.where(keep).select("scen_id", "Variable", "year", zero_as_missing("value").alias("CO2"))
    return rows.where(F.col("CO2").isNotNull())


def removals_vs_reduction(db: ScenarioDb, limits: Limits) -> DataFrame:
    """Removals in 2050 next to the gross reduction 2020-2050, scenarios that have both."""
    # both variables of a scenario fold to one row, as the milestones do
    v, y = F.col("Variable"), F.col("year")

    def at(name: str, year: int):
        return value_when((v == name) & (y == year))

    wide = ambition_rows(db, (2020, 2050)).groupBy("scen_id").agg(
        at(fixed.GROSS_TOTAL, 2020).alias("y2020"), at(fixed.GROSS_TOTAL, 2050).alias("y2050"),
        at(fixed.REMOVALS_SUM, 2050).alias("removals_2050"),
        F.bool_or(v == fixed.GROSS_TOTAL).alias("has_gross"), F.bool_or(v == fixed.REMOVALS_SUM).alias("has_removals"),
    )
    rows = wide.where("has_gross AND has_removals").select(
        "scen_id", relative_change("y2020", "y2050").alias("gross_change_2020_2050"), "removals_2050")
    return flag_members(rows, filtered(db, limits), "filtered")


def ambition_cut(db: ScenarioDb, cut: float = fixed.AMBITION_CUT, markers: Sequence[str] = fixed.MARKERS) -> DataFrame:
    """Gross change of each C1 scenario, with the ambitious and the illustrative ones flagged."""
    wide = pivot_years(gross_at(db, candidates(db), (2020, 2030, 2050)), ("scen_id",), (2020, 2030, 2050))
    out = wide.select(
        "scen_id", relative_change("y2020", "y2030").alias("pchange_2030"),
        relative_change("y2020", "y2050").alias("pchange_2050"),
    ).withColumn("ambitious", F.when(F.col("pchange_2050") <= cut, 1).otherwise(0))
    return flag_members(out, marked(db, markers), "illustrative")


def summary_metrics(db: ScenarioDb, limits: Limits, external: DataFrame) -> DataFrame:
    """Metric panel input: (Metric, Value, source) for the external scenario, the filtered median, C1 quartiles."""
    labels = {
        "final_energy_2050": fixed.PANEL_METRICS[0][0], "ren_share_2050": fixed.PANEL_METRICS[1][0],
        "max_bioenergy": fixed.PANEL_METRICS[2][0], "removals_2050": fixed.PANEL_METRICS[3][0],
        "cum_ccs_2010_2050": fixed.PANEL_METRICS[4][0], "cum_gross_2020_2050": fixed.PANEL_METRICS[5][0],
    }
    c1 = candidates(db)
    metrics = flag_members(key_metrics(db, c1), filtered(db, limits), "filtered")
    long = metrics.unpivot(["scen_id", "filtered"], list(labels), "metric", "value")
    both = long.withColumn("cohort", F.explode(F.when(F.col("filtered") == 1, F.array(F.lit("f"), F.lit("c")))
                                               .otherwise(F.array(F.lit("c")))))
    q = quantile_rows(both, ("cohort", "metric"), {"25": 0.25, "50": 0.5, "75": 0.75})
    source = (
        F.when((F.col("cohort") == "f") & (F.col("perc") == "50"), fixed.FILTERED_MEDIAN)
        .when((F.col("cohort") == "c") & (F.col("perc") == "25"), "AR6 C1 (25th percentile)")
        .when((F.col("cohort") == "c") & (F.col("perc") == "75"), "AR6 C1 (75th percentile)")
    )
    rows = q.withColumn("source", source).where(F.col("source").isNotNull()).select("metric", "value", "source")
    outside = external.unpivot(["source"], [c for c in external.columns if c in labels], "metric", "value")
    label = F.lit(None).cast("string")
    for k, text in labels.items():
        label = F.when(F.col("metric") == k, text).otherwise(label)
    both = rows.unionByName(outside)
    return both.select(label.alias("Metric"), F.col("value").alias("Value"), "source")


def key_metric_panel(metrics: DataFrame, focal: Sequence[str] = ("IEA NZE", fixed.FILTERED_MEDIAN),
                     metric_levels=fixed.PANEL_METRICS, source_levels=fixed.PANEL_SOURCES) -> DataFrame:
    """Focal sources per metric next to the C1 quartile lines, codes replaced by ordered labels."""
    coded = recode(recode(metrics, "Metric", metric_levels, "metric_label", "metric_ord"), "source", source_levels,
                   "scenario", "scenario_ord").where(F.col("metric_label").isNotNull())
    lines = coded.groupBy("metric_label").agg(
        F.max(F.when(F.col("scenario") == "AR6 C1-25", F.col("Value"))).alias("line_25"),
        F.max(F.when(F.col("scenario") == "AR6 C1-75", F.col("Value"))).alias("line_75"),
    )
    bars = coded.where(F.col("source").isin(list(focal)))
    return bars.join(lines, "metric_label").select(
        "metric_label", "metric_ord", "scenario", "scenario_ord", "Value", "line_25", "line_75"
    )


def afolu_generations(db: ScenarioDb, older: ScenarioDb, co2e_line: float = fixed.AFOLU_CO2E_LINE,
                      co2_line: float = fixed.AFOLU_CO2_LINE) -> DataFrame:
    """Distribution of cumulative land-sector emissions by generation and category, and the share above a line."""

    def rows(d: ScenarioDb, generation: str) -> DataFrame:
        category = F.lower(F.col("category")).alias("category")
        both = afolu_co2e_cumulative(d.long, out="total").withColumn("measure", F.lit("co2e")).unionByName(
            afolu_co2_cumulative(d.long, out="total").withColumn("measure", F.lit("co2"))
        )
        return both.join(d.key.select("scen_id", category), "scen_id").withColumn("gen", F.lit(generation))

    both = rows(db, "AR6").unionByName(rows(older, "SR15"))
    keys = ("measure", "gen", "category")
    line = F.when(F.col("measure") == "co2e", co2e_line).otherwise(co2_line)
    return boxplot_stats(both, keys, "total", {"share_above": F.col("total") > line})


def project_highlight(db: ScenarioDb, project: str = fixed.PROJECT) -> DataFrame:
    """C1 gross trajectories, members of one project flagged."""
    rows = gross_at(db, candidates(db), DECADES).select("scen_id", "year", F.col("value").alias("CO2"))
    members = intersect_ids(rows, db.key.where(F.col("Project_study") == project))
    return flag_members(rows, members, "highlighted")


def focal_vs_median(db: ScenarioDb, limits: Limits, focal: DataFrame, names: Sequence[str] = ("NZE", "CWF"),
                    staging: Staging | None = None) -> DataFrame:
    """External focal paths and the filtered median before 2060, labelled in order, with the C1 quartile band."""
    cols = [f"y{y}" for y in MILESTONES]
    outside = unpivot_years(
        focal.where(F.col("Source").isin(list(names))).withColumnRenamed("Source", "scen_id").select("scen_id", *cols),
        ["scen_id"], cols, "CO2", strip="y",
    )
    gross = shared(gross_at(db, candidates(db), DECADES), staging)
    some = in_ids(gross.where(F.col("year") < 2060), filtered(db, limits)).withColumn("value", zero_as_missing("value"))
    med = median(some, ("year",), out="CO2").select(F.lit(fixed.FILTERED_MEDIAN).alias("scen_id"), "year", "CO2")
    levels = [("NZE", "NZE"), ("CWF", "CWF"), (fixed.FILTERED_MEDIAN, "Filtered")]
    paths = recode(outside.unionByName(med), "scen_id", levels, "Scenario", "ord")
    return paths.join(c1_band(db, staging), "year", "left")


def pathway_vs_subset(db: ScenarioDb, limits: Limits, focal: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Gross CO2e of each C1 scenario and the cross-sector path, with the marker and net-zero subsets flagged."""
    c1 = candidates(db)
    rows = components_at(db, c1, MILESTONES)
    total = rows.groupBy("scen_id", "year").agg(F.sum("value").alias("CO2eq"))
    bench = benchmark_unharmonised(db, limits, focal, staging=staging).where(F.col("Variable") == fixed.GROSS_CO2E)
    path = unpivot_years(
        bench.select(F.lit(fixed.PATHWAY).alias("scen_id"), *[f"y{y}" for y in MILESTONES]), ["scen_id"],
        [f"y{y}" for y in MILESTONES], "CO2eq", strip="y",
    )
    out = flag_members(total.unionByName(path.select("scen_id", "year", "CO2eq")), marked(db, fixed.MARKERS), "is_marker")
    return flag_members(out, db.key.where(F.col("Category_subset") == fixed.SUBSET), "is_subset")


FIVE_YEARLY = tuple(range(2020, 2061, 5))


def net_vs_gross(quartiles: DataFrame) -> DataFrame:
    """Net against gross quantiles of each source, five-yearly 2020-2060: how far above y = x they lie."""
    rows = milestones(quartiles, FIVE_YEARLY)
    xy = pivot_variables(rows, ("source", "perc", "year"), {fixed.NET_TOTAL: "net", fixed.GROSS_TOTAL: "gross"})
    return scatter_vs_identity(xy, ("source",), "net", "gross")


def generation_bands(quartiles: DataFrame, older_quartiles: DataFrame) -> DataFrame:
    """Both generations' quartiles and medians in one labelled table."""
    newer = milestones(quartiles, FIVE_YEARLY)
    older = older_quartiles.where(
        F.col("year").isin(list(range(2020, 2061, 10))) & (F.col("Variable") != fixed.BECCS)
    )
    both = newer.unionByName(older.select(*newer.columns))
    panel = F.when(F.col("perc") == "median", "median").otherwise("band")
    return both.withColumn("group", joined_key("source", "perc")).withColumn("panel", panel)


def median_plus_paths(quartiles: DataFrame, paths: DataFrame) -> DataFrame:
    """Relabelled gross medians and the illustrative scenarios."""
    med = quartiles.where(
        (F.col("perc") == "median") & (F.col("Variable") == fixed.GROSS_TOTAL)
        & F.col("year").isin(list(FIVE_YEARLY))
    )
    label = (
        F.when(F.col("source") == "AR6 C1", "AR6 C1 (median)")
        .when(F.col("source") == "AR6 C1+IISD", "AR6 C1+IISD (median)")
        .otherwise(F.col("source"))
    )
    imps = paths.where(F.col("year").isin(list(range(2020, 2061, 10)))).select(
        F.col("scen_id").alias("source"), "Variable", "year", "value"
    )
    return union_all(med.withColumn("source", label), imps)


def land_use_table(db: ScenarioDb, line: float = fixed.LAND_USE_LINE, missing: float = fixed.LAND_USE_MISSING) -> DataFrame:
    t = afforestation_test(db).withColumn("max_lu_seq", F.coalesce("max_lu_seq", F.lit(missing)))
    return t.withColumn("filter_flag", F.when(F.col("max_lu_seq") > line, fixed.REMOVED).otherwise(fixed.NOT_REMOVED))


LAND_USE_METRICS = (
    "net_2020", "net_2030", "net_2050", "gross_2020", "gross_2030", "gross_2050", "perc_ch_net_2030",
    "perc_ch_net_2050", "perc_ch_gross_2030", "perc_ch_gross_2050",
)


def land_use_boxplots(db: ScenarioDb, line: float = fixed.LAND_USE_LINE) -> DataFrame:
    long = land_use_table(db, line).unpivot(["scen_id", "filter_flag"], list(LAND_USE_METRICS), "metric", "value")
    return boxplot_stats(long, ("metric", "filter_flag"), "value")


def land_use_tests(db: ScenarioDb, line: float = fixed.LAND_USE_LINE) -> DataFrame:
    return welch_t_test(land_use_table(db, line), "filter_flag", fixed.NOT_REMOVED, fixed.REMOVED,
                        ("perc_ch_gross_2030", "perc_ch_gross_2050"))


def land_use_correlations(db: ScenarioDb, line: float = fixed.LAND_USE_LINE) -> DataFrame:
    pairs = [("max_lu_seq", m) for m in ("net_2050", "gross_2050", "net_2030", "gross_2030")]
    return pearson_cor_test(land_use_table(db, line), pairs)
