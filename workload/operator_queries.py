"""One query per operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathloom.functions import columns as c
from pathloom.functions import fixed
from pathloom.operators import emissions as em
from pathloom.operators import joins as j
from pathloom.operators import reshape as rs
from pathloom.operators import screens as sc
from pathloom.operators import summary as sm
from pathloom.operators import targets as tg
from pathloom.operators import timeaxis as ta
from pathloom.operators.harmonise import harmonise_budget
from pathloom.plans import building as b
from pathloom.plans import reports as rp
from pathloom.session import shared_dir
from pathloom.sources import tables as src
from workload import tables as t
from workload.registry import register
from workload.sqlparts import (
    CH4, GROSS, L, N2O, NET, REM, change, inlist, interp, pivot, q, r, years_between,
)



def V():
    return F.col("Variable")


LONG = ("scen_id", "Variable", "year", "value")
MS = (2020, 2030, 2040, 2050)


def _long(spark, sf):
    return t.db(spark, sf).long


def _wide(spark, sf):
    """Wide year-column form of the scenario table."""
    years = list(range(t.FIRST_YEAR, t.LAST_YEAR + 1))
    ids = ("scen_id", "Model", "Scenario", "Region", "Variable", "Unit")
    return rs.pivot_years(_long(spark, sf), ids, years, prefix="")


def _csv(spark, sf, name, df):
    return src.sink_csv(df, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")


# --- sources and sinks --------------------------------------------------------

_BY_VARIABLE = f"""select Variable, count(*) as n_rows, {r('sum(value)')} as total, cast(min(year) as int) as first_year,
    cast(max(year) as int) as last_year from scen_long group by 1"""


def _by_variable(long):
    return long.groupBy("Variable").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total"), F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


@register("scan_wide_csv", _BY_VARIABLE)
def _(spark, sf):
    wide = src.scan_wide_csv(spark, _csv(spark, sf, "wide", _wide(spark, sf)))
    years = src.discover_year_columns(wide.columns)
    return _by_variable(rs.unpivot_years(wide, ["scen_id", "Variable"], years))


@register("scan_metadata", """select Category, count(*) as n, count(IMP_marker) as n_marked, count(Project_study) as n_project
    from scen_key group by 1""")
def _(spark, sf):
    meta = src.scan_metadata(spark, _csv(spark, sf, "meta", t.db(spark, sf).key))
    return meta.groupBy("Category").agg(
        F.count(F.lit(1)).alias("n"), F.count("IMP_marker").alias("n_marked"), F.count("Project_study").alias("n_project")
    )


@register("read_scenario_db", f"""select k.Category, l.Variable, count(*) as n_rows, count(distinct l.scen_id) as n_scen,
    {r('sum(l.value)')} as total from scen_long l join scen_key k on k.scen_id = l.scen_id group by 1, 2""")
def _(spark, sf):
    d = src.read_scenario_db(
        spark, _csv(spark, sf, "wide", _wide(spark, sf).drop("scen_id")),
        _csv(spark, sf, "meta", t.db(spark, sf).key.drop("scen_id")),
    )
    return d.long.join(d.key.select("scen_id", "Category"), "scen_id").groupBy("Category", "Variable").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("scen_id").alias("n_scen"), F.sum("value").alias("total")
    )


@register("discover_year_columns", f"""select year, count(value) as n_reported from allyears left join scen_long using (year)
    group by 1""")
def _(spark, sf):
    wide = _wide(spark, sf)
    years = src.discover_year_columns(wide.columns)
    counts = wide.agg(*[F.count(y).alias(y) for y in years])
    return counts.unpivot([], years, "year", "n_reported").withColumn("year", c.col("year").cast("int"))


@register("year_slice", f"""select scen_id, Variable, year, {r('value')} as value from scen_long where year in
    (2020, 2025, 2030, 2035, 2040, 2045, 2050)""")
def _(spark, sf):
    return ta.year_slice(_long(spark, sf), 2020, 2050, 5).select(*LONG)


@register("literal_table", f"""select Source, f.year, {r('f.value')} as focal_value, n from (
      select Source, 2020 as year, y2020 as value from focal union all select Source, 2030, y2030 from focal
      union all select Source, 2040, y2040 from focal union all select Source, 2050, y2050 from focal) f
    join (select year, count(*) as n from scen_long group by 1) l on l.year = f.year""")
def _(spark, sf):
    focal = rs.unpivot_years(t.focal(spark), ["Source"], [f"y{y}" for y in MS], "focal_value", strip="y")
    counts = _long(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(j.small_side(focal), "year").select("Source", "year", "focal_value", "n")


@register("sink_csv", f"select scen_id, {pivot(MS, 'value')} from gross where scen_id in (select scen_id from c1) group by 1")
def _(spark, sf):
    d = t.db(spark, sf)
    path = _csv(spark, sf, "gross", rs.pivot_years(b.gross_at(d, b.candidates(d), MS), ("scen_id",), MS))
    return spark.read.option("header", True).schema("scen_id string, y2020 double, y2030 double, y2040 double, y2050 double").csv(path)


@register("staged_result_reuse", f"""select year, {r('quantile_cont(value, 0.5)')} as med, {r('avg(value)')} as mean_value
    from gross where scen_id in (select scen_id from c1) and year in (2020, 2030, 2040, 2050) group by 1""")
def _(spark, sf):
    d = t.db(spark, sf)
    gross = b.shared(b.gross_at(d, b.candidates(d), MS))
    med = sm.median(gross, ("year",), out="med")
    return med.join(gross.groupBy("year").agg(F.avg("value").alias("mean_value")), "year")


# --- projections and scalar expressions --------------------------------------------

@register("scenario_key", """select distinct Model || ' ' || Scenario as key_spaced, Model || Scenario as key_plain,
    Model || ' ' || Variable as label from scen_long""")
def _(spark, sf):
    return _long(spark, sf).select(
        c.joined_key("Model", "Scenario").alias("key_spaced"), c.joined_key("Model", "Scenario", sep="").alias("key_plain"),
        c.joined_key("Model", "Variable").alias("label"),
    ).distinct()


@register("project_columns", f"select Scenario, Variable, year, {r('value')} as value from scen_long")
def _(spark, sf):
    return _long(spark, sf).select("Scenario", "Variable", "year", "value")


@register("drop_columns", """select scen_id, Category, Category_subset, IMP_marker, Project_study, in_list_a, in_list_b from scen_key""")
def _(spark, sf):
    return t.db(spark, sf).key.drop("Model", "Scenario", "Literature_reference")


@register("rename_columns", f"select scen_id as source, Variable as metric, {r('value')} as Value, year as at from scen_long")
def _(spark, sf):
    return _long(spark, sf).select("scen_id", "Variable", "value", "year").toDF("source", "metric", "Value", "at")


@register("tag_literal", f"""select 'AR6 C1' as source, 0 as filter_flag, Variable, {r('quantile_cont(value, 0.5)')} as value
    , year from scen_long where scen_id in (select scen_id from c1) group by Variable, year""")
def _(spark, sf):
    d = t.db(spark, sf)
    rows = j.in_ids(d.long, b.candidates(d))
    med = sm.median(rows, ("Variable", "year"))
    return med.withColumns({"source": F.lit("AR6 C1"), "filter_flag": F.lit(0)})


@register("cast_year_numeric", f"select year, count(*) as n, {r('sum(value)')} as total from scen_long group by 1")
def _(spark, sf):
    wide = _wide(spark, sf)
    long = rs.unpivot_years(wide, ["scen_id", "Variable"], src.discover_year_columns(wide.columns))
    return long.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@register("index_as_column", "select scen_id, Variable, cast(count(*) as bigint) as n_years from scen_long group by 1, 2")
def _(spark, sf):
    return _long(spark, sf).groupBy("scen_id", "Variable").agg(F.count(F.lit(1)).alias("n_years"))


@register("zero_to_null", """select Variable, count(*) as n_rows, count(nullif(value, 0)) as n_reported from scen_long group by 1""")
def _(spark, sf):
    return _long(spark, sf).groupBy("Variable").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(c.zero_as_missing("value")).alias("n_reported")
    )


@register("sentinel_to_null", f"""select company, {r("cast(nullif(by_scope1, 'NA') as double)")} as by_scope1,
    {r("cast(nullif(by_scope2, 'NA') as double)")} as by_scope2 from companies""")
def _(spark, sf):
    return tg.numeric_arguments(t.companies(spark, sf), ["by_scope1", "by_scope2"]).select("company", "by_scope1", "by_scope2")


@register("sign_normalise", f"""select scen_id, Variable, year,
    {r(f'case when Variable in {REM} then abs(value) else value end')} as value from scen_long""")
def _(spark, sf):
    rows = _long(spark, sf)
    return rows.select("scen_id", "Variable", "year", c.positive_where(V().isin(list(fixed.REMOVALS)), "value").alias("value"))


@register("unit_convert", f"""select scen_id, Variable, year, {r("value * (case when Unit like 'kt%' then 0.001 else 1.0 end)")} as mt
    from scen_long""")
def _(spark, sf):
    rows = _long(spark, sf)
    mt = F.when(F.col("Unit").startswith("kt"), c.scaled("value", fixed.KT_TO_MT)).otherwise(F.col("value"))
    return rows.select("scen_id", "Variable", "year", mt.alias("mt"))


@register("gwp_convert", f"""select scen_id, Variable, year, vintage, {r('value * factor')} as co2e from scen_long
    join (values ('Emissions|CH4|AFOLU', 'AR5', 28.0), ('Emissions|N2O|AFOLU', 'AR5', 0.265), ('Emissions|CH4|AFOLU', 'AR6', 29.8),
      ('Emissions|N2O|AFOLU', 'AR6', 0.273), ('Emissions|HFC', 'AR6', 1.53), ('Emissions|PFC', 'AR6', 7.38),
      ('Emissions|SF6', 'AR6', 25.2)) as f(Variable, vintage, factor) using (Variable)""")
def _(spark, sf):
    rows = [
        (f"Emissions|{gas}|AFOLU" if gas in ("CH4", "N2O") else f"Emissions|{gas}", vintage, c.co2e_factor(gas, vintage))
        for vintage, gas in fixed.WARMING_FACTORS
    ]
    factors = j.lookup_table(spark, rows, "Variable string, vintage string, factor double")
    joined = _long(spark, sf).join(j.small_side(factors), "Variable")
    return joined.select("scen_id", "Variable", "year", "vintage", (F.col("value") * F.col("factor")).alias("co2e"))


@register("fossil_ch4_co2e", f"""select Model as Source, year, {r('value * 29.8')} as value from (
    select Model, year, sum(value) as value from scen_long where Variable = 'Emissions|CH4|Energy' group by 1, 2)
    where Model = 'NATION_7'""")
def _(spark, sf):
    summary = _long(spark, sf).where(V() == "Emissions|CH4|Energy").groupBy(F.col("Model").alias("Source"), "year").agg(
        F.sum("value").alias("value")
    )
    return em.fossil_ch4_co2e(summary, "NATION_7")


_GROSS_WIDE = f"select scen_id, {pivot(MS, rounded=False)} from gross where scen_id in (select scen_id from c1) group by 1"


@register("pct_change_milestones", f"""select scen_id, {r('y2020')} as y2020, {r(change('y2020', 'y2030'))} as percch_2030,
    {r(change('y2020', 'y2040'))} as percch_2040, {r(change('y2020', 'y2050'))} as percch_2050 from ({_GROSS_WIDE})""")
def _(spark, sf):
    d = t.db(spark, sf)
    wide = rs.pivot_years(b.gross_at(d, b.candidates(d), MS), ("scen_id",), MS)
    return sm.change_columns(wide, (2030, 2040, 2050)).drop("y2030", "y2040", "y2050")


@register("ratio_of_variables", f"""select scen_id, year, {r('part / nullif(whole, 0)')} as share from (select scen_id, year,
      max(case when Variable = {q(fixed.RENEWABLES)} then value end) as part,
      max(case when Variable = {q(fixed.PRIMARY_ENERGY)} then value end) as whole
    from scen_long where Variable in ({q(fixed.RENEWABLES)}, {q(fixed.PRIMARY_ENERGY)}) group by 1, 2)""")
def _(spark, sf):
    names = {fixed.RENEWABLES: "part", fixed.PRIMARY_ENERGY: "whole"}
    wide = rs.pivot_variables(_long(spark, sf).where(V().isin(list(names))), ("scen_id", "year"), names)
    return wide.select("scen_id", "year", c.share_of("part", "whole").alias("share"))


@register("apply_mean_change_to_anchor", f"""select {r("35289.751 + 35289.751 * avg(" + change('y2020', 'y2030') + ")")} as y2030,
    {r("35289.751 + 35289.751 * avg(" + change('y2020', 'y2050') + ")")} as y2050 from ({_GROSS_WIDE})""")
def _(spark, sf):
    d = t.db(spark, sf)
    wide = sm.change_columns(rs.pivot_years(b.gross_at(d, b.candidates(d), MS), ("scen_id",), MS), (2030, 2050))
    mean = wide.agg(F.avg("percch_2030").alias("a"), F.avg("percch_2050").alias("b"))
    return mean.select(
        c.apply_change(fixed.GROSS_2020_ANCHOR, "a").alias("y2030"), c.apply_change(fixed.GROSS_2020_ANCHOR, "b").alias("y2050")
    )


@register("conditional_overwrite", f"""select scen_id, Variable, year, {r(f'''case when year = 2020 and Variable = {NET}
    then 35289.751 when year = 2021 then null else value end''')} as value from scen_long where year between 2020 and 2050""")
def _(spark, sf):
    v = (
        F.when((F.col("year") == 2020) & (V() == fixed.NET_TOTAL), F.lit(fixed.GROSS_2020_ANCHOR))
        .when(F.col("year") == 2021, None).otherwise(F.col("value"))
    )
    return ta.year_slice(_long(spark, sf), 2020, 2050).select("scen_id", "Variable", "year", v.alias("value"))


@register("membership_flag", """select scen_id, Category, case when scen_id in (select scen_id from filt) then 1 else 0 end as filtered
    from scen_key""")
def _(spark, sf):
    d = t.db(spark, sf)
    return j.flag_members(d.key.select("scen_id", "Category"), b.filtered(d, t.LIMITS), "filtered")


_LEVELS = [("C1", "low overshoot"), ("C2", "high overshoot")]


@register("recode_levels", """select scen_id, case Category when 'C1' then 'low overshoot' when 'C2' then 'high overshoot' end as label,
    cast(case Category when 'C1' then 0 when 'C2' then 1 end as int) as ord from scen_key""")
def _(spark, sf):
    return j.recode(t.db(spark, sf).key.select("scen_id", "Category"), "Category", _LEVELS, "label", "ord").drop("Category")


_ROWWISE = """from scen_long where year between 2010 and 2050 group by 1, 2"""


@register("row_max", f"select scen_id, Variable, {r('max(value)')} as max_value {_ROWWISE}")
def _(spark, sf):
    return ta.slice_max(ta.year_slice(_long(spark, sf), 2010, 2050), ("scen_id", "Variable"), 2010, 2050)


@register("row_mean", f"select scen_id, Variable, {r('avg(value)')} as mean_value from scen_long where year in (2040, 2060) group by 1, 2")
def _(spark, sf):
    return ta.milestones(_long(spark, sf), (2040, 2060)).groupBy("scen_id", "Variable").agg(F.avg("value").alias("mean_value"))


@register("row_any", f"select scen_id, Variable, cast(max(case when value > 150 then 1 else 0 end) as int) as any_above {_ROWWISE}")
def _(spark, sf):
    rows = ta.year_slice(_long(spark, sf), 2010, 2050)
    return rows.groupBy("scen_id", "Variable").agg(c.any_true(F.col("value") > 150).cast("int").alias("any_above"))


# --- filters ------------------------------------------------------------------------

@register("filter_equals", f"select scen_id, year, {r('value')} as value from scen_long where Variable = {q(fixed.FINAL_ENERGY)} and Region = 'World'")
def _(spark, sf):
    return _long(spark, sf).where((V() == fixed.FINAL_ENERGY) & (F.col("Region") == "World")).select("scen_id", "year", "value")


@register("filter_in_list", f"select scen_id, Variable, year, {r('value')} as value from scen_long where Variable in {CH4}")
def _(spark, sf):
    return _long(spark, sf).where(V().isin(list(fixed.CH4_SECTORS))).select(*LONG)


@register("filter_not_equals", "select scen_id, Category, IMP_marker from scen_key where IMP_marker is distinct from 'SP'")
def _(spark, sf):
    key = t.db(spark, sf).key
    return key.where(~F.col("IMP_marker").eqNullSafe("SP")).select("scen_id", "Category", "IMP_marker")


@register("filter_compound", f"""select scen_id, Variable, year, {r('value')} as value from scen_long where
    (Variable = {q(fixed.CCS)} and value > 120) or (Variable = {NET} and year < 2030)""")
def _(spark, sf):
    cond = ((V() == fixed.CCS) & (F.col("value") > 120)) | ((V() == fixed.NET_TOTAL) & (F.col("year") < 2030))
    return _long(spark, sf).where(cond).select(*LONG)


@register("filter_threshold", f"""select scen_id, {r(change('y2020', 'y2050'))} as pchange_2050 from ({_GROSS_WIDE})
    where {change('y2020', 'y2050')} <= -0.5""")
def _(spark, sf):
    d = t.db(spark, sf)
    return rp.ambition_cut(d).where(F.col("pchange_2050") <= -0.5).select("scen_id", "pchange_2050")


@register("filter_not_null", "select scen_id, IMP_marker from scen_key where IMP_marker is not null")
def _(spark, sf):
    return t.db(spark, sf).key.where(F.col("IMP_marker").isNotNull()).select("scen_id", "IMP_marker")


@register("domain_check", """select company, concat_ws(',', case when sector not in ('power', 'buildings_res', 'buildings_serv', 'cement')
      then 'sector' end, case when ty_activity_type not in ('fixed_market_share', 'ty_output') then 'ty_activity_type' end) as violations
    from companies where sector not in ('power', 'buildings_res', 'buildings_serv', 'cement')
      or ty_activity_type not in ('fixed_market_share', 'ty_output')""")
def _(spark, sf):
    return tg.domain_check(t.companies(spark, sf), tg.domain_table(spark), tg.DOMAINS)[1].select("company", "violations")


@register("domain_check_table", """select company, concat_ws(',', case when sector not in (select sector from (select sector, count(*) as n
        from companies group by 1 order by n desc, sector limit 3)) then 'sector' end,
      case when not starts_with(company, 'Customer#') then 'company' end) as violations
    from companies where sector not in (select sector from (select sector, count(*) as n from companies group by 1 order by n desc, sector limit 3))
      or not starts_with(company, 'Customer#')""")
def _(spark, sf):
    # the domain comes from the data: the three sectors most companies are in, and every well-formed name
    rows = t.companies(spark, sf)
    top = rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sector").limit(3)
    names = rows.where(F.col("company").startswith("Customer#")).select(F.lit("company").alias("domain"), F.col("company").alias("allowed"))
    allowed = names.unionByName(top.select(F.lit("sector").alias("domain"), F.col("sector").alias("allowed")))
    return tg.domain_check(rows, allowed, ("sector", "company"))[1].select("company", "violations")


@register("positional_distinct_pick", """select scen_id, label from (select scen_id, case Category when 'C1' then 'low overshoot'
    when 'C2' then 'high overshoot' end as label, case Category when 'C1' then 0 when 'C2' then 1 end as ord from scen_key) where ord = 1""")
def _(spark, sf):
    coded = j.recode(t.db(spark, sf).key.select("scen_id", "Category"), "Category", _LEVELS, "label", "ord")
    return coded.where("ord = 1").select("scen_id", "label")


# --- joins ----------------------------------------------------------------------------

@register("semi_join_ids", f"select scen_id, Variable, year, {r('value')} as value from scen_long where scen_id in (select scen_id from c1)")
def _(spark, sf):
    d = t.db(spark, sf)
    return j.in_ids(d.long, b.candidates(d)).select(*LONG)


@register("anti_join_ids", f"""select scen_id from scen_key where scen_id not in (select scen_id from scen_long where Variable = {NET})""")
def _(spark, sf):
    d = t.db(spark, sf)
    return j.not_in_ids(d.key.select("scen_id"), d.long.where(V() == fixed.NET_TOTAL))


@register("outer_align_metrics", f"""select coalesce(a.scen_id, b.scen_id) as scen_id, {r('a.v')} as bio_max, {r('b.v')} as net_2050 from
    (select scen_id, max(value) as v from scen_long where Variable = {q(fixed.BIOENERGY)} and value > 150 group by 1) a full join
    (select scen_id, value as v from scen_long where Variable = {NET} and year = 2050) b on a.scen_id = b.scen_id""")
def _(spark, sf):
    long = _long(spark, sf)
    bio = long.where((V() == fixed.BIOENERGY) & (F.col("value") > 150)).groupBy("scen_id").agg(F.max("value").alias("bio_max"))
    net = long.where((V() == fixed.NET_TOTAL) & (F.col("year") == 2050)).select("scen_id", F.col("value").alias("net_2050"))
    return j.align(bio, net)


@register("inner_merge", f"""select a.scen_id, {r('a.value')} as final_energy, {r('b.value')} as primary_energy from scen_long a join scen_long b
    on a.scen_id = b.scen_id and a.year = b.year where a.Variable = {q(fixed.FINAL_ENERGY)} and b.Variable = {q(fixed.PRIMARY_ENERGY)}
    and a.year = 2050""")
def _(spark, sf):
    at = _long(spark, sf).where("year = 2050")
    a = at.where(V() == fixed.FINAL_ENERGY).select("scen_id", F.col("value").alias("final_energy"))
    return a.join(at.where(V() == fixed.PRIMARY_ENERGY).select("scen_id", F.col("value").alias("primary_energy")), "scen_id")


@register("align_counts_to_medians", f"""select Variable, {r('quantile_cont(value, 0.5)')} as med, count(value) as num_scen from fgas
    where year = 2050 group by 1""")
def _(spark, sf):
    d = t.db(spark, sf)
    rows = j.in_ids(d.long.where(V().isin(list(fixed.F_GASES)) & (F.col("year") == 2050)), b.candidates(d))
    return sm.median(rows, ("Variable",), out="med", count="num_scen")


@register("historical_anchor_join", f"""select scen_id, Variable, {r('value')} as model, {r('50.0 - value')} as gap from scen_long
    where year = 2022 and Region = 'World'""")
def _(spark, sf):
    hist = t.history(spark).select("Region", "year", F.col("value").alias("h"))
    rows = _long(spark, sf).join(j.small_side(hist), ["Region", "year"])
    return rows.select("scen_id", "Variable", F.col("value").alias("model"), (F.col("h") - F.col("value")).alias("gap"))


@register("cohort_membership", f"""select cohort, Variable, year, count(*) as n, {r('quantile_cont(value, 0.5)')} as med from scen_long join (
      select scen_id, 'C1' as cohort from c1 union all select scen_id, 'list a' from lista
      union all select scen_id, 'marked' from scen_key where IMP_marker is not null) m using (scen_id)
    group by 1, 2, 3""")
def _(spark, sf):
    d = t.db(spark, sf)
    members = j.cohort_table(d.key, {
        "C1": F.col("Category") == "C1", "list a": F.col("in_list_a") == 1, "marked": F.col("IMP_marker").isNotNull(),
    })
    rows = j.by_cohort(d.long, members)
    return sm.median(rows, ("cohort", "Variable", "year"), out="med", count="n")


@register("positional_label_join", f"""select k.IMP_marker as Source, g.scen_id, {pivot(MS)} from gross g join scen_key k
    on k.scen_id = g.scen_id where k.IMP_marker in ('LD', 'Ren') group by 1, 2""")
def _(spark, sf):
    d = t.db(spark, sf)
    m = b.marked(d, ("LD", "Ren"))
    rows = b.gross_at(d, m.select("scen_id"), MS).join(m.withColumnRenamed("IMP_marker", "Source"), "scen_id")
    return rs.pivot_years(rows, ("Source", "scen_id"), MS)


# --- aggregations -----------------------------------------------------------------------

@register("sum_variables_by_scenario", f"select scen_id, year, {r('coalesce(sum(value), 0)')} as value from scen_long where Variable in {N2O} group by 1, 2")
def _(spark, sf):
    return sm.sum_variables(_long(spark, sf), fixed.N2O_SECTORS)


@register("mean_by_variable", f"select Variable, year, {r('avg(value)')} as value from scen_long group by 1, 2")
def _(spark, sf):
    return _long(spark, sf).groupBy("Variable", "year").agg(F.avg("value").alias("value"))


@register("quantile_by_group", f"""select Variable, year, {r('quantile_cont(value, 0.25)')} as p25, {r('quantile_cont(value, 0.5)')} as p50,
    {r('quantile_cont(value, 0.75)')} as p75 from scen_long group by 1, 2""")
def _(spark, sf):
    return sm.quantiles(_long(spark, sf), ("Variable", "year"), {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@register("quantile_global", f"""select {r('quantile_cont(value, 0.25)')} as p25, {r('quantile_cont(value, 0.5)')} as p50,
    {r('quantile_cont(value, 0.75)')} as p75 from scen_long""")
def _(spark, sf):
    return sm.quantiles(_long(spark, sf), (), {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@register("interquartile_band", f"""select year, {r('quantile_cont(value, 0.25)')} as c1_25, {r('quantile_cont(value, 0.75)')} as c1_75
    from gross where scen_id in (select scen_id from c1) and year in (2020, 2030, 2040, 2050) group by 1""")
def _(spark, sf):
    d = t.db(spark, sf)
    return sm.interquartile_band(b.gross_at(d, b.candidates(d), MS), ("year",))


@register("count_reported", "select Variable, count(value) as n_2050 from scen_long where year = 2050 group by 1")
def _(spark, sf):
    return _long(spark, sf).where("year = 2050").groupBy("Variable").agg(F.count("value").alias("n_2050"))


@register("count_rows", "select Variable, count(*) as n_rows, count(distinct scen_id) as n_scen from scen_long group by 1")
def _(spark, sf):
    return _long(spark, sf).groupBy("Variable").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("scen_id").alias("n_scen"))


@register("distinct_ids", f"select distinct scen_id from scen_long where Variable = {q(fixed.BIOENERGY)} and value > 200")
def _(spark, sf):
    return j.distinct_ids(_long(spark, sf).where((V() == fixed.BIOENERGY) & (F.col("value") > 200)))


@register("cross_scenario_mean", " union all ".join(
    f"select '{m}' as metric, {r(f'avg({m})')} as mean_value from km" for m in b.KEY_METRICS))
def _(spark, sf):
    d = t.db(spark, sf)
    long = b.key_metrics(d, b.candidates(d)).unpivot(["scen_id"], list(b.KEY_METRICS), "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean_value"))


@register("sum_across_components", f"""select year, {r('sum(m)')} as total from (
    select year, quantile_cont(value, 0.5) as m from gross where scen_id in (select scen_id from c1) group by 1
    union all select year, quantile_cont(value, 0.5) * 0.273 from n2o where scen_id in (select scen_id from c1) group by 1
    union all select year, quantile_cont(value, 0.5) * 29.8 from ch4 where scen_id in (select scen_id from c1) group by 1)
    where year in (2020, 2030, 2040, 2050, 2060) group by 1""")
def _(spark, sf):
    d = t.db(spark, sf)
    c1 = b.candidates(d)
    rows = rp.components_at(d, c1, b.DECADES)
    med = sm.median(rows, ("Variable", "year"))
    return med.groupBy("year").agg(F.sum("value").alias("total"))


@register("cumulative_over_years", f"select scen_id, {r('coalesce(sum(value), 0)')} as total from {interp('ccsr', 'scen_id', 2010, 2050)} group by 1")
def _(spark, sf):
    return ta.interpolated_total(_long(spark, sf).where(V() == fixed.CCS), ("scen_id",), 2010, 2050)


@register("max_over_years", f"""select scen_id, {r('max(case when year between 2010 and 2050 then value end)')} as max_value from scen_long
    where Variable = {q(fixed.LAND_USE)} group by 1""")
def _(spark, sf):
    return ta.slice_max(_long(spark, sf).where(V() == fixed.LAND_USE), ("scen_id",), 2010, 2050)


_BOXES = f"""(select Category, value, quantile_cont(value, 0.25) over (partition by Category) as q1,
      quantile_cont(value, 0.5) over (partition by Category) as q2, quantile_cont(value, 0.75) over (partition by Category) as q3
      from scen_long join scen_key using (scen_id) where Variable = {q(fixed.FINAL_ENERGY)})"""
_INSIDE = "value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)"


def _boxes(spark, sf):
    d = t.db(spark, sf)
    rows = d.long.where(V() == fixed.FINAL_ENERGY).join(d.key.select("scen_id", "Category"), "scen_id")
    return sm.boxplots(rows, ("Category",), "value")


@register("boxplot_stats", f"""select Category, {r('q1')} as q1, {r('q2')} as q2, {r('q3')} as q3,
    {r(f'min(case when {_INSIDE} then value end)')} as whisker_low,
    {r(f'max(case when {_INSIDE} then value end)')} as whisker_high,
    count(case when not {_INSIDE} then 1 end) as n_outliers, count(*) as n
    from {_BOXES} group by Category, q1, q2, q3""")
def _(spark, sf):
    return _boxes(spark, sf).stats


@register("boxplot_outliers", f"select Category, {r('value')} as value, count(*) as n from {_BOXES} where not {_INSIDE} group by Category, value")
def _(spark, sf):
    return _boxes(spark, sf).outliers


@register("histogram", f"""select cast(case when x < -1 then 0 when x >= 1 then 21 else floor((x + 1) / 0.1) + 1 end as int) as bin,
      count(*) as n, {r("-1.0 + (case when x < -1 then 0 when x >= 1 then 21 else floor((x + 1) / 0.1) + 1 end - 1) * 0.1")} as bin_from
    from (select {change('y2020', 'y2050')} as x from ({_GROSS_WIDE})) where x is not null group by 1, 3""")
def _(spark, sf):
    return sm.histogram(rp.ambition_cut(t.db(spark, sf)), "pchange_2050", -1.0, 1.0, 20)


_NODES = 200_000


def _student(rows: str) -> str:
    """``rows`` (id, t, df, ...) with p and the two-sided 95 % quantile, by summing the density over a fine grid of angles:
    with x = sqrt(df) tan(a) the area beyond x is that of cos(a) ^ (df - 1) beyond a."""
    n = f"{_NODES}.0"
    return f"""(select s.*, p.p, c.quantile from {rows} s
      left join (select id, sum(pow(cos(lo + (i + 0.5) * (pi() / 2 - lo) / {n}), df - 1)) * (pi() / 2 - lo)
            / (sum(pow(cos((i + 0.5) * pi() / 2 / {n}), df - 1)) * pi() / 2) as p
          from (select id, df, atan(abs(t) / sqrt(df)) as lo from {rows} where t is not null and df >= 1), range({_NODES}) g(i)
          group by id, df, lo) p on p.id = s.id
      left join (select id, min(sqrt(df) * tan((i + 1 - (cdf - 0.95) / v) * pi() / 2 / {n})) as quantile from (
          select id, df, i, v / sum(v) over (partition by id) as v, sum(v) over (partition by id order by i) / sum(v) over (partition by id) as cdf
          from (select id, df, i, pow(cos((i + 0.5) * pi() / 2 / {n}), df - 1) as v from {rows}, range({_NODES}) g(i) where df >= 1))
          where cdf >= 0.95 and cdf - v < 0.95 group by id) c on c.id = s.id)"""


def _welch_sql(src: str, group: str, a: str, bb: str, metrics) -> str:
    def one(m):
        return f"""select {q(m)} as id, ma, mb, na, nb, sqrt(nullif(va / na + vb / nb, 0)) as error,
          (ma - mb) / sqrt(nullif(va / na + vb / nb, 0)) as t,
          (va / na + vb / nb) * (va / na + vb / nb) / (va / na * va / na / (na - 1) + vb / nb * vb / nb / (nb - 1)) as df
        from (select avg({m}) filter (where {group} = {q(a)}) as ma, avg({m}) filter (where {group} = {q(bb)}) as mb,
          var_samp({m}) filter (where {group} = {q(a)}) as va, var_samp({m}) filter (where {group} = {q(bb)}) as vb,
          count({m}) filter (where {group} = {q(a)}) as na, count({m}) filter (where {group} = {q(bb)}) as nb from {src})"""

    rows = "(" + " union all ".join(one(m) for m in metrics) + ")"
    return f"""select id as metric, {r('ma')} as mean_a, {r('mb')} as mean_b, na as n_a, nb as n_b, {r('t')} as t, {r('df')} as df,
      {r('p')} as p, {r('ma - mb - quantile * error')} as low, {r('ma - mb + quantile * error')} as high from {_student(rows)}"""


@register("welch_t_test", _welch_sql(
    "(select km.*, case when Project_study is null then 'a' else 'b' end as g from km join scen_key using (scen_id))", "g", "a", "b",
    ("removals_2050", "cum_gross_2020_2050")))
def _(spark, sf):
    d = t.db(spark, sf)
    g = F.when(F.col("Project_study").isNull(), "a").otherwise("b").alias("g")
    rows = b.key_metrics(d, b.candidates(d)).join(d.key.select("scen_id", g), "scen_id")
    return sm.welch_t_test(rows, "g", "a", "b", ("removals_2050", "cum_gross_2020_2050"))


def _cor_sql(src: str, pairs) -> str:
    rows = "(" + " union all ".join(
        f"""select {q(x + ' ' + y)} as id, {q(x)} as x, {q(y)} as y, r, n, cast(n - 2 as double) as df,
        r * sqrt((n - 2) / nullif(1 - r * r, 0)) as t from (
        select corr({y}, {x}) as r, cast(regr_count({y}, {x}) as bigint) as n from {src})""" for x, y in pairs) + ")"
    bound = "tanh(atanh(r) {} 1.959963984540054 / sqrt(n - 3))"
    return f"""select x, y, {r('r')} as r, n, n - 2 as df, {r('t')} as t, {r('p')} as p, {r(bound.format('-'))} as low,
      {r(bound.format('+'))} as high from {_student(rows)}"""


_PAIRS = [("max_bioenergy", "cum_ccs_2010_2050"), ("final_energy_2050", "cum_gross_2020_2050")]


@register("pearson_cor_test", _cor_sql("km", _PAIRS))
def _(spark, sf):
    d = t.db(spark, sf)
    return sm.pearson_cor_test(b.key_metrics(d, b.candidates(d)), _PAIRS)


@register("scatter_fit_vs_identity", f"""select Model, {r('avg(g - n)')} as mean_gap, count(case when g > n then 1 end) as n_above, count(*) as n
    from (select k.Model, x.scen_id, x.year, max(x.n) as n, max(x.g) as g from (
        select scen_id, year, value as n, null as g from net union all select scen_id, year, null, value from gross) x
      join scen_key k using (scen_id) where x.year in (2020, 2030, 2040, 2050) group by 1, 2, 3)
    where n is not null and g is not null group by 1""")
def _(spark, sf):
    d = t.db(spark, sf)
    c1 = b.candidates(d)
    rows = b.net_and_gross_at(d, c1, MS)
    xy = rs.pivot_variables(rows, ("scen_id", "year"), {fixed.NET_TOTAL: "net", fixed.GROSS_TOTAL: "gross"})
    return sm.scatter_vs_identity(xy.join(d.key.select("scen_id", "Model"), "scen_id"), ("Model",), "net", "gross")


# --- time axis ------------------------------------------------------------------------------

@register("densify_years", f"""select k.scen_id, k.Variable, y.year, {r('s.value')} as value from
    (select distinct scen_id, Variable from scen_long) k
    cross join {years_between(2020, 2050)} y
    left join scen_long s on s.scen_id = k.scen_id and s.Variable = k.Variable and s.year = y.year""")
def _(spark, sf):
    return ta.densify_years(_long(spark, sf), ("scen_id", "Variable"), 2020, 2050)


@register("interpolate_gaps", f"""select scen_id, Variable, year, {r('value')} as value from {interp('scen_long', 'scen_id, Variable', 2020, 2050)}
    where value is not null""")
def _(spark, sf):
    return ta.interpolate_gaps(_long(spark, sf), first=2020, last=2050)


@register("interpolate_gaps_ticks", f"""select user_id, event_type, year, {r('value')} as value from (select *, count(value) over
    (partition by user_id, event_type) as n from {interp('ticks', 'user_id, event_type', 1, 31)}) where n > 0""")
def _(spark, sf):
    return ta.interpolate_gaps(t.event_ticks(spark, sf), ("user_id", "event_type"), 1, 31, leading=True)


@register("interp_zero_as_gap_removals", f"""select scen_id, Variable, year, {r('value')} as value from
    {interp('grossr', 'scen_id, Variable', 2020, 2050, True)} where value is not null and scen_id in (select scen_id from c1)
    and Variable in {REM}""")
def _(spark, sf):
    d = t.db(spark, sf)
    rows = j.in_ids(d.long.where(V().isin(list(fixed.REMOVALS))), b.candidates(d))
    rows = rows.withColumn("value", c.positive_where(V().isin(list(fixed.REMOVALS)), "value"))
    return ta.interpolate_gaps(rows, first=2020, last=2050, zero_missing=True)


@register("interp_zero_as_gap", f"""select scen_id, Variable, year, {r('value')} as value from
    {interp('scen_long', 'scen_id, Variable', 2020, 2050, True)} where value is not null""")
def _(spark, sf):
    return ta.interpolate_gaps(_long(spark, sf), first=2020, last=2050, zero_missing=True)


_ANCHORED = f"""(select scen_id, year, case when year = 2020 then cast(35289.751 as double) when year = 2021 then null else value end as value
    from grossharm)"""


@register("anchor_and_bridge", f"""select scen_id, year, {r('value')} as value from {interp(_ANCHORED, 'scen_id', 2020, 2050, True)}
    where value is not null""")
def _(spark, sf):
    d = t.db(spark, sf)
    rows = rp.harmonised_paths(d, t.LIMITS, t.history(spark), _external(spark)).where(V() == fixed.GROSS_HARMONISED)
    rows = b.shared(rows)
    return ta.anchor_and_bridge(rows, V() == fixed.GROSS_HARMONISED, fixed.GROSS_2020_ANCHOR).drop("Variable")


def _external(spark):
    long = rs.unpivot_years(t.focal(spark).where("Source = 'NZE'"), ["Source"], [f"y{y}" for y in MS], strip="y")
    return long.select(F.lit("NZE 2023").alias("scen_id"), "year", "value")


def _net_filtered(spark, sf):
    d = t.db(spark, sf)
    return b.net_every_year(d, b.filtered(d, t.LIMITS), 2020, 2050).withColumn("Region", F.lit("World"))


@register("harmonise_budget", f"select scen_id, year, {r('model')} as modelled, {r('value')} as value from harm")
def _(spark, sf):
    return harmonise_budget(_net_filtered(spark, sf), t.history(spark)).trajectories.drop("Region")


@register("harmonise_diagnostics", f"""select k.scen_id, case when h.scen_id is null then 'failed' else 'budget' end as method,
    case when h.scen_id is null then 'no value in the anchor year' end as reason, coalesce(h.n_years, 0) as n_years,
    {r('h.offset_')} as offset_value, {r('h.before_')} as budget_before, {r('h.after_')} as budget_after
    from (select distinct scen_id from netfilt) k left join (select scen_id, count(*) as n_years, 50.0 - max(m0) as offset_,
      sum(model * case when year in (2022, 2050) then 0.5 else 1.0 end) as before_,
      sum(value * case when year in (2022, 2050) then 0.5 else 1.0 end) as after_ from harm group by 1) h on h.scen_id = k.scen_id""")
def _(spark, sf):
    h = harmonise_budget(_net_filtered(spark, sf), t.history(spark), keep=b.shared)
    n = h.trajectories.groupBy("scen_id").agg(F.count(F.lit(1)).alias("n_years"))
    failed = h.failed.select("scen_id", F.col("reason").alias("also"))
    out = h.diagnostics.drop("Region").withColumnRenamed("offset", "offset_value").join(n, "scen_id", "left")
    out = out.join(failed, "scen_id", "left").where(F.col("reason").eqNullSafe(F.col("also"))).drop("also")
    return out.withColumn("n_years", F.coalesce("n_years", F.lit(0)))


# --- reshape -------------------------------------------------------------------------------------

@register("unpivot_years", f"select scen_id, Variable, year, {r('value')} as value from scen_long")
def _(spark, sf):
    wide = _wide(spark, sf)
    return rs.unpivot_years(wide, ["scen_id", "Variable"], src.discover_year_columns(wide.columns))


_PV = {fixed.PRIMARY_ENERGY: "primary_energy", fixed.FINAL_ENERGY: "final_energy", fixed.BIOENERGY: "bioenergy"}


@register("pivot_variables", "select scen_id, year, " + ", ".join(
    r(f"max(case when Variable = {q(v)} then value end)") + f" as {n}" for v, n in _PV.items())
    + f" from scen_long where Variable in {inlist(_PV)} group by 1, 2")
def _(spark, sf):
    return rs.pivot_variables(_long(spark, sf).where(V().isin(list(_PV))), ("scen_id", "year"), _PV)


@register("pivot_multi_value", "select scen_id, " + ", ".join(
    r(f"max(case when Variable = {q(v)} then {a} end)") + f" as {a}_{n}" for a in ("lo", "hi") for v, n in _PV.items())
    + f" from (select scen_id, Variable, min(value) as lo, max(value) as hi from scen_long where Variable in {inlist(_PV)} group by 1, 2) group by 1")
def _(spark, sf):
    rows = _long(spark, sf).where(V().isin(list(_PV))).groupBy("scen_id", "Variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rs.pivot_multi_value(rows, ("scen_id",), _PV, ("lo", "hi"))


@register("pivot_milestones", f"select scen_id, Variable, {pivot((2020, 2030, 2040, 2050, 2060))} from scen_long where year in (2020, 2030, 2040, 2050, 2060) group by 1, 2")
def _(spark, sf):
    return rs.pivot_years(ta.milestones(_long(spark, sf), b.DECADES), ("scen_id", "Variable"), b.DECADES)


@register("transpose_series", " union all ".join(
    f"select 'p{p}' as item, " + ", ".join(
        r(f"max(case when Variable = {q(v)} then quantile end)") + f" as {q(v)}".replace("'", '"') for v in fixed.F_GASES)
    + f" from (select Variable, quantile_cont(value, 0.{p}) as quantile from scen_long where Variable in {inlist(fixed.F_GASES)} group by 1)"
    for p in (25, 75)))
def _(spark, sf):
    d = t.db(spark, sf)
    qs = sm.quantiles(d.long.where(V().isin(list(fixed.F_GASES))), ("Variable",), {"p25": 0.25, "p75": 0.75})
    return rs.transpose(qs, "Variable", ["p25", "p75"], list(fixed.F_GASES))


# --- set operations ---------------------------------------------------------------------------------

@register("union_by_name", f"""select scen_id, Variable, year, {r('value')} as value, Unit from scen_long where Variable = {NET}
    union all select scen_id, Variable, year, {r('value')}, null from fills""")
def _(spark, sf):
    d = t.db(spark, sf)
    years = range(t.FIRST_YEAR, t.LAST_YEAR + 1)
    return j.union_all(d.long.where(V() == fixed.NET_TOTAL).select(*LONG, "Unit"), em.filled_totals(d.long, b.candidates(d), years))


_BIO = f"select scen_id from scen_long where Variable = {q(fixed.BIOENERGY)} and year between 2010 and 2050 and value > {L.bioenergy}"
_CCS = f"select scen_id from {interp('ccsr', 'scen_id', 2010, 2050)} group by 1 having sum(value) > {L.total_ccs}"


@register("id_set_union", f"({_BIO}) union ({_CCS})")
def _(spark, sf):
    long = _long(spark, sf)
    return j.union_ids(sc.screen_bioenergy(long, L.bioenergy), sc.screen_total_ccs(long, L.total_ccs))


@register("id_set_difference", f"(select scen_id from c1) except ({_BIO})")
def _(spark, sf):
    d = t.db(spark, sf)
    return j.difference_ids(b.candidates(d), sc.screen_bioenergy(d.long, L.bioenergy))


@register("id_set_intersect", f"(select scen_id from c1) intersect ({_BIO})")
def _(spark, sf):
    d = t.db(spark, sf)
    return j.intersect_ids(b.candidates(d), sc.screen_bioenergy(d.long, L.bioenergy))


# --- domain operators ---------------------------------------------------------------------------------

@register("fill_missing_total", f"select scen_id, year, {r('value')} as value from filled where Variable = {NET}")
def _(spark, sf):
    d = t.db(spark, sf)
    out = em.fill_missing_total(d.long, b.candidates(d), range(t.FIRST_YEAR, t.LAST_YEAR + 1))
    return out.where(V() == fixed.NET_TOTAL).select("scen_id", "year", "value")


@register("gross_emissions", f"select scen_id, year, {r('value')} as value from gross where scen_id in (select scen_id from c1)")
def _(spark, sf):
    d = t.db(spark, sf)
    filled = em.fill_missing_total(d.long, b.candidates(d), range(t.FIRST_YEAR, t.LAST_YEAR + 1))
    gross = em.gross_emissions(j.in_ids(filled, b.candidates(d)))
    dense = ta.densify_years(gross, ("scen_id",), t.FIRST_YEAR, t.LAST_YEAR)
    return dense.withColumn("value", F.coalesce("value", F.lit(0.0)))


@register("gross_emissions_filled_gaps", f"""select scen_id, year, {r('sum(value)')} as value from
    {interp('grossr', 'scen_id, Variable', t.FIRST_YEAR, t.LAST_YEAR)} where value is not null and scen_id in (select scen_id from c1) group by 1, 2""")
def _(spark, sf):
    d = t.db(spark, sf)
    filled = em.fill_missing_total(d.long, b.candidates(d), range(t.FIRST_YEAR, t.LAST_YEAR + 1))
    rows = j.in_ids(filled, b.candidates(d))
    return em.gross_emissions(rows, True, t.FIRST_YEAR, t.LAST_YEAR).drop("Variable")


@register("gross_emissions_sr15", f"""select scen_id, {GROSS} as Variable, year, {r('sum(value)')} as value from older_long
    where Variable in ({NET}, {q(fixed.BECCS)}) group by 1, 3""")
def _(spark, sf):
    return em.gross_emissions_plain(t.older_db(spark, sf).long)


@register("eip_n2o", f"select scen_id, year, {r('sum(value)')} as value from scen_long where Variable in {N2O} group by 1, 2")
def _(spark, sf):
    return em.eip_n2o(_long(spark, sf))


@register("eip_ch4", f"select scen_id, year, {r('sum(value)')} as value from scen_long where Variable in {CH4} group by 1, 2")
def _(spark, sf):
    return em.eip_ch4(_long(spark, sf))


@register("eip_n2o_co2e", f"select scen_id, 'EIP N2O CO2e' as Variable, year, {r('sum(value) * 0.273')} as value from scen_long where Variable in {N2O} group by 1, 3")
def _(spark, sf):
    return em.eip_co2e(_long(spark, sf), "N2O")


@register("eip_ch4_co2e", f"select scen_id, 'EIP CH4 CO2e' as Variable, year, {r('sum(value) * 29.8')} as value from scen_long where Variable in {CH4} group by 1, 3")
def _(spark, sf):
    return em.eip_co2e(_long(spark, sf), "CH4")


@register("afolu_co2_cumulative", f"""select scen_id, {r('coalesce(sum(value), 0)')} as afolu_co2 from {interp(
    f"(select scen_id, year, value from scen_long where Variable = {q(fixed.AFOLU_CO2)})", 'scen_id', 2020, 2050, True)} group by 1""")
def _(spark, sf):
    return em.afolu_co2_cumulative(_long(spark, sf))


@register("afolu_co2e_year", f"select scen_id, {r('coalesce(sum(case when year = 2050 then value end), 0)')} as afolu_co2e from landr group by 1")
def _(spark, sf):
    return em.afolu_co2e_year(_long(spark, sf))


@register("afolu_co2e_year_unconverted", f"""select scen_id, {r('coalesce(sum(case when year = 2050 then value end), 0)')} as afolu_co2e
    from scen_long where Variable in {inlist([fixed.AFOLU_CO2, fixed.AFOLU_CH4, fixed.AFOLU_N2O])} group by 1""")
def _(spark, sf):
    return em.afolu_co2e_year(_long(spark, sf), convert=False)


@register("screen_land_sector", f"""select scen_id from {interp('land', 'scen_id', 2020, 2050, True)} group by 1
    having coalesce(sum(value), 0) < {L.land_sector}""")
def _(spark, sf):
    return sc.screen_land_sector(_long(spark, sf), L.land_sector)


@register("screen_bioenergy", f"select distinct scen_id from ({_BIO})")
def _(spark, sf):
    return sc.screen_bioenergy(_long(spark, sf), L.bioenergy)


@register("screen_afforestation", f"""select distinct scen_id from scen_long where Variable = {q(fixed.AFFORESTATION)}
    and year between 2010 and 2050 and value > {L.afforestation}""")
def _(spark, sf):
    return sc.screen_afforestation(_long(spark, sf), L.afforestation)


@register("screen_total_ccs", _CCS)
def _(spark, sf):
    return sc.screen_total_ccs(_long(spark, sf), L.total_ccs)


@register("screen_cdr_2020", f"select scen_id from scen_long where Variable in {REM} and year = 2020 group by 1 having sum(value) > {L.removals_2020}")
def _(spark, sf):
    return sc.screen_removals_year(_long(spark, sf), L.removals_2020)


@register("sustainability_filters", "select flag, scen_id from flagset")
def _(spark, sf):
    d = t.db(spark, sf)
    cohorts = sc.screen_cohorts(b.candidates(d), sc.screen_criteria(d.long, t.LIMITS))
    return cohorts.select(F.explode("cohort").alias("flag"), "scen_id")


@register("sustainability_filter_7", "select scen_id from filt")
def _(spark, sf):
    d = t.db(spark, sf)
    return sc.sustainability_filters(b.candidates(d), d.long, 7, t.LIMITS)


def _iisd_sql(flag, beccs, fossil, land):
    return f"""select {flag} as flag, scen_id from c1 where scen_id not in (select scen_id from (select scen_id, Variable, avg(value) as m
      from scen_long where year in (2040, 2060) group by 1, 2) where (Variable = {q(fixed.BECCS)} and m > {beccs})
      or (Variable = {q(fixed.CCS_FOSSIL)} and m > {fossil}) or (Variable = {q(land)} and m > {L.land_use}))"""


@register("iisd_filter_variations", " union all ".join([
    _iisd_sql(1, L.beccs_high, L.fossil_ccs_high, fixed.LAND_USE),
    _iisd_sql(2, L.beccs_medium, L.fossil_ccs_medium, fixed.AFFORESTATION),
    _iisd_sql(3, L.beccs_medium, L.fossil_ccs_medium, fixed.LAND_USE)]))
def _(spark, sf):
    d = t.db(spark, sf)
    return j.union_all(*[
        sc.iisd_filter_variations(b.candidates(d), d.long, f, t.LIMITS).select(F.lit(f).alias("flag"), "scen_id") for f in (1, 2, 3)
    ])


@register("nonco2_pathway", "select Variable, Source, " + ", ".join(f"{r(f'y{y}')} as y{y}" for y in MS) + " from nonco2")
def _(spark, sf):
    return rp.non_co2_pathway(t.db(spark, sf))


@register("removals_sum", f"select scen_id, {q(fixed.REMOVALS_SUM)} as Variable, year, {r('sum(value)')} as value from scen_long where Variable in {REM} group by 1, 3")
def _(spark, sf):
    return em.removals_sum(_long(spark, sf))


@register("focal_pathways", f"""select Source, {', '.join(f"{r(f'y{y}')} as y{y}" for y in MS)} from (
    select 'filtered C1' as Source, {pivot(MS, 'm', rounded=False)} from (select year, quantile_cont(value, 0.5) as m from gross
      where scen_id in (select scen_id from filt) group by 1)
    union all select * from focal where Source = 'NZE'
    union all select Source, y2020, y2030, y2040, y2050 from (select k.IMP_marker as Source, g.scen_id, {pivot(MS, rounded=False)} from gross g
      join scen_key k on k.scen_id = g.scen_id where k.IMP_marker in ('LD', 'Ren') group by 1, 2))""")
def _(spark, sf):
    d = t.db(spark, sf)
    out = rp.benchmark_unharmonised(d, t.LIMITS, t.focal(spark))
    return out.where((V() == "Gross fossil CO2") & (F.col("Source") != "Cross sector benchmark")).select("Source", *[f"y{y}" for y in MS])


@register("target_records_union", """select company, cast(nullif(by_scope1, 'NA') as double) as ty_scope1,
    cast(nullif(by_scope2, 'NA') as double) as ty_scope2, target_year, method from companies
    cross join (values ('SDA'), ('ARA')) as m(method) where sector in ('power', 'buildings_res', 'buildings_serv', 'cement')
      and ty_activity_type in ('fixed_market_share', 'ty_output')""")
def _(spark, sf):
    args = tg.numeric_arguments(t.companies(spark, sf), ["by_scope1", "by_scope2"])
    args = tg.domain_check(args, tg.domain_table(spark), tg.DOMAINS)[0]
    one = [tg.target_record(args, m, F.col("by_scope1"), F.col("by_scope2")) for m in fixed.TARGET_METHODS]
    return tg.target_records_union(*one)


@register("duplicate_check", "select Model, Variable, year, count(*) as n_rows from scen_long group by 1, 2, 3 having count(*) > 1")
def _(spark, sf):
    # several scenarios of one model share a year, so this key is not unique
    return src.duplicate_rows(_long(spark, sf), ("Model", "Variable", "year"))
