"""One query per report pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import fixed
from pathloom.operators.joins import lookup_table
from pathloom.plans import building as b
from pathloom.plans import reports as rp
from workload import tables as t
from workload.operator_queries import _cor_sql, _external, _welch_sql
from workload.registry import register
from workload.sqlparts import GROSS, NET, change, interp, pivot, q, r

D = b.DECADES
MS = b.MILESTONES
LIM = t.LIMITS
NZE_METRICS = dict(zip(b.KEY_METRICS, (-500.0, 340.0, 100.0, 4100.0, 190.0, 0.7, 0.3, 12.0, 3900.0)))
AFOLU_LINES = (8000.0, 4000.0)
LU_LINE = 160.0


def _nze(spark):
    return lookup_table(spark, [tuple(NZE_METRICS.values())], ", ".join(f"{k} double" for k in NZE_METRICS))


def _nze_named(spark):
    return _nze(spark).withColumn("source", F.lit("IEA NZE"))


def _ys(years, prefix="y", src=""):
    return ", ".join(f"{r(f'{src}{prefix}{y}')} as {prefix}{y}" for y in years)


@register("rpt_sr15_quantiles", f"select Variable, year, perc, {r('value')} as value, source from older_q")
def _(spark, sf):
    return rp.sr15_quantiles(t.older_db(spark, sf))


@register("rpt_sr15_cross_sector", f"""select Variable, year, perc, {r('value')} as value, source from older_q
    union all select 'Emissions|N2O|Energy_CO2eq', year, null, {r('avg(value) * 0.265')}, 'IPCC SR15 (mean)' from older_long
      where Variable = 'Emissions|N2O|Energy' and scen_id in (select scen_id from older_cohort) group by year
    union all select 'Emissions|CH4|Fossil_CO2eq', year, null, {r('value')}, 'IEA_NZE' from external""")
def _(spark, sf):
    return rp.sr15_cross_sector(t.older_db(spark, sf), _external(spark))


@register("rpt_filtered_quantiles", f"select source, Variable, year, perc, {r('value')} as value from cohort_q")
def _(spark, sf):
    d = t.db(spark, sf)
    return rp.filtered_quantiles(d, d.key.where("in_list_a = 1"))


@register("rpt_illustrative_paths", f"""select scen_id, {GROSS} as Variable, year, {r('value')} as value from gross
    where scen_id in (select scen_id from scen_key where IMP_marker in ('SP', 'LD', 'Ren'))""")
def _(spark, sf):
    return rp.illustrative_paths(t.db(spark, sf))


def _flag_med(src, factor="1.0"):
    return f"""select f.flag as filter_flag, s.year, quantile_cont(s.value, 0.5) * {factor} as value from {src} s
      join flagset f on f.scen_id = s.scen_id where s.year in (2020, 2030, 2040, 2050, 2060) group by 1, 2"""


_SIZES = "select flag as filter_flag, count(*) as num_scenarios from flagset group by 1"


def _flag_table(src):
    return f"""select filter_flag, {pivot(D, rounded=False)} from ({src}) group by 1"""


@register("rpt_compare_filters_co2", f"""select filter_flag, {GROSS} as Variable, {_ys(D)}, {r(change('y2020', 'y2030'))} as percch_2030,
    {r(change('y2020', 'y2050'))} as percch_2050, num_scenarios from ({_flag_table(_flag_med('gross'))}) join ({_SIZES}) using (filter_flag)""")
def _(spark, sf):
    return rp.compare_filters_co2(t.db(spark, sf), LIM)


@register("rpt_compare_filters_nonco2", f"""select filter_flag, 'EIP N2O CO2e' as Variable, {_ys(D)}, 'MtCO2e/year' as Units
      from ({_flag_table(_flag_med('n2o', '0.273'))})
    union all select filter_flag, 'EIP CH4 CO2e', {_ys(D)}, 'MtCO2e/year' from ({_flag_table(_flag_med('ch4', '29.8'))})""")
def _(spark, sf):
    return rp.compare_filters_nonco2(t.db(spark, sf), LIM)


_ALL3 = f"""select filter_flag, year, sum(value) as value from ({_flag_med('gross')} union all {_flag_med('n2o', '0.273')}
    union all {_flag_med('ch4', '29.8')}) group by 1, 2"""


@register("rpt_compare_filters_total", f"""select filter_flag, {_ys(D)}, {r(change('y2020', 'y2030'))} as percch_2030,
    {r(change('y2020', 'y2050'))} as percch_2050, num_scenarios from ({_flag_table(_ALL3)}) join ({_SIZES}) using (filter_flag)""")
def _(spark, sf):
    return rp.compare_filters_total(t.db(spark, sf), LIM)


def _fig(value):
    return f"""select scen_id, {pivot(D, value)} from gross where scen_id in (select scen_id from c1) group by 1
      union all select {q(fixed.FILTERED_MEDIAN)}, {pivot(D, 'm')} from (select year, quantile_cont({value}, 0.5) as m from gross
        where scen_id in (select scen_id from filt) group by 1)"""


@register("rpt_fig_gross", _fig("value"))
def _(spark, sf):
    return rp.fig_gross(t.db(spark, sf), LIM)


@register("rpt_gross_summary", f"select *, {GROSS} as Variable from ({_fig('nullif(value, 0)')})")
def _(spark, sf):
    return rp.gross_summary(t.db(spark, sf), LIM)


_LU = ["max_lu_seq", *rp.LAND_USE_METRICS]


@register("rpt_afforestation_test", "select scen_id, " + ", ".join(f"{r(m)} as {m}" for m in _LU) + " from lut")
def _(spark, sf):
    return rp.afforestation_test(t.db(spark, sf))


@register("rpt_final_energy", " union all ".join(f"""select filter_flag, Variable, cast({p} as double) as quantile, {pivot(D)} from (
    select f.flag as filter_flag, l.Variable, l.year, quantile_cont(l.value, {p}) as value from scen_long l
      join flagset f on f.scen_id = l.scen_id and f.flag in (0, 7)
      where l.Variable = {q(fixed.FINAL_ENERGY)} and l.year in (2020, 2030, 2040, 2050, 2060) group by 1, 2, 3) group by 1, 2""" for p in (0.25, 0.5, 0.75)))
def _(spark, sf):
    return rp.final_energy(t.db(spark, sf), LIM)


@register("rpt_key_variables_filtered", " union all ".join(
    f"""select '{m}' as metric, {r(f'avg({m})')} as scenario_set_mean from (select {m} from km where scen_id in (select scen_id from filt)
      union all select {v})""" for m, v in NZE_METRICS.items()))
def _(spark, sf):
    return rp.key_variables_filtered(t.db(spark, sf), LIM, _nze(spark))


_SIX = [m for m in b.KEY_METRICS if m not in ("final_energy_2050", "ren_share_2030", "industrial_ccs_2050")]


@register("rpt_key_variables_c1", " union all ".join(
    f"select '{m}' as metric, {r(f'quantile_cont({m}, 0.25)')} as c1_25_perc, {r(f'quantile_cont({m}, 0.75)')} as c1_75_perc from km" for m in _SIX))
def _(spark, sf):
    return rp.key_variables_c1(t.db(spark, sf))


_BYM = "(select Model, year, sum(value) as value from landr group by 1, 2)"
_BYM2 = f"(select Model, year, sum(value) as value from scen_long where Variable = {q(fixed.AFOLU_CO2)} group by 1, 2)"


@register("rpt_afolu_by_model", f"""select a.Model, {r('a.v')} as afolu_co2e, {r('b.v')} as afolu_co2 from
    (select Model, coalesce(sum(value), 0) as v from {interp(_BYM, 'Model', 2020, 2050, True, 5)} group by 1) a
    full join (select Model, coalesce(sum(value), 0) as v from {interp(_BYM2, 'Model', 2020, 2050, False, 5)} group by 1) b on a.Model = b.Model""")
def _(spark, sf):
    return rp.afolu_by_model(t.db(spark, sf))


_MEMBERS = """select Source, y2020, y2030, y2040, y2050 from (
      select 'filtered C1' as Source, """ + pivot(MS, 'm', rounded=False) + """ from (select year, quantile_cont(value, 0.5) as m from gross
        where scen_id in (select scen_id from filt) group by 1)
      union all select * from focal where Source = 'NZE'
      union all select Source, y2020, y2030, y2040, y2050 from (select k.IMP_marker as Source, g.scen_id, """ + pivot(MS, rounded=False) + """
        from gross g join scen_key k on k.scen_id = g.scen_id where k.IMP_marker in ('LD', 'Ren') group by 1, 2))"""
_BENCH_CO2 = f"""select 'Gross fossil CO2' as Variable, 'Cross sector benchmark' as Source, cast(35289.751 as double) as y2020, """ + ", ".join(
    f"35289.751 + 35289.751 * avg({change('y2020', f'y{y}')}) as y{y}" for y in (2030, 2040, 2050)) + f" from ({_MEMBERS})"


def _with_total(co2):
    cols = "Variable, Source, y2020, y2030, y2040, y2050"
    rows = f"select {cols} from ({co2}) union all select {cols} from nonco2"
    return f"""{rows} union all select 'Gross fossil CO2e', 'Cross sector benchmark', sum(y2020), sum(y2030), sum(y2040), sum(y2050)
      from ({rows})"""


def _changes(body):
    return f"""select Variable, Source, {_ys(MS)}, {r(change('y2020', 'y2030'))} as percch_2030, {r(change('y2020', 'y2040'))} as percch_2040,
      {r(change('y2020', 'y2050'))} as percch_2050 from ({body})"""


_UNHARM = f"select 'Gross fossil CO2' as Variable, Source, y2020, y2030, y2040, y2050 from ({_MEMBERS}) union all {_with_total(_BENCH_CO2)}"


@register("rpt_benchmark_unharmonised", _changes(_UNHARM))
def _(spark, sf):
    return rp.benchmark_unharmonised(t.db(spark, sf), LIM, t.focal(spark))


_PATHS = f"""(select scen_id, Variable, year, case when year = 2020 and Variable = {q(fixed.GROSS_HARMONISED)} then cast(35289.751 as double)
    when year = 2021 then null else value end as value from combined where Variable = {q(fixed.GROSS_HARMONISED)} or scen_id = 'NZE 2023')"""
_HARM_CO2 = f"""select 'Gross fossil CO2' as Variable, 'Cross sector benchmark' as Source, {pivot(MS, 'm', rounded=False)} from (
    select year, quantile_cont(value, 0.5) as m from {interp(_PATHS, 'scen_id, Variable', 2020, 2050, True)} group by 1)"""


@register("rpt_benchmark_harmonised", _changes(_with_total(_HARM_CO2)))
def _(spark, sf):
    d = t.db(spark, sf)
    return rp.benchmark_harmonised(d, rp.harmonised_paths(d, LIM, t.history(spark), _external(spark)))


@register("rpt_n2o_ch4", " union all ".join(f"""select '{n}' as Variable, {pivot(MS, 'm')} from (select year, quantile_cont(value, 0.5) as m
    from {s} where scen_id in (select scen_id from c1) group by 1)""" for n, s in (("EIP N2O", "n2o"), ("EIP CH4", "ch4"))))
def _(spark, sf):
    return rp.n2o_ch4(t.db(spark, sf))


@register("rpt_renewables_2030", f"""select {r('quantile_cont(ren_share_2030, 0.25)')} as c1_25, {r('quantile_cont(ren_share_2030, 0.75)')} as c1_75,
    {r('quantile_cont(case when scen_id in (select scen_id from filt) then ren_share_2030 end, 0.5)')} as filtered_median from km""")
def _(spark, sf):
    return rp.renewables_2030(t.db(spark, sf), LIM)


@register("rpt_industrial_ccs", f"""select {r('quantile_cont(value, 0.5)')} as filtered_median from scen_long
    where Variable = {q(fixed.CCS_INDUSTRY)} and year = 2050 and scen_id in (select scen_id from filt)""")
def _(spark, sf):
    return rp.industrial_ccs(t.db(spark, sf), LIM)


def _kyoto(flag, source):
    ids = f"(select scen_id from flagset where flag = {flag})"
    parts = [f"""select Variable, {pivot(MS, 'm')}, cast(max(n) as bigint) as num_scen, {q(source)} as source from (select Variable, year,
        quantile_cont(value, 0.5) as m, case when year = 2050 then count(value) else 0 end as n from fgas where scen_id in {ids}
        and year in (2020, 2030, 2040, 2050) group by 1, 2) group by 1"""]
    for name, src in (("EIP N2O", "n2o"), ("EIP CH4", "ch4")):
        parts.append(f"""select '{name}', {pivot(MS, 'm')}, cast(max(n) as bigint), {q(source)} from (select year, quantile_cont(value, 0.5) as m,
          count(distinct scen_id) as n from {src} where scen_id in {ids} group by 1)""")
    return " union all ".join(parts)


@register("rpt_kyoto_gases", _kyoto(0, "median of C1") + " union all " + _kyoto(7, "median of filtered scenarios"))
def _(spark, sf):
    return rp.kyoto_gases(t.db(spark, sf), LIM)


@register("rpt_external_comparison", f"""select Source, {GROSS} as Variable, {pivot(MS, 'm')} from (
    select Source, year, quantile_cont(value, 0.5) as m from gross join (select scen_id, 'filtered C1' as Source from filt
      union all select scen_id, 'OECD' from listb) s using (scen_id) group by 1, 2) group by 1""")
def _(spark, sf):
    d = t.db(spark, sf)
    return rp.external_comparison(d, LIM, d.key.where("in_list_b = 1"))


_ALL = range(t.FIRST_YEAR, t.LAST_YEAR + 1)
_AMB = f"""select scen_id, Variable, {pivot(_ALL, rounded=False)} from (select scen_id, {NET} as Variable, year, value from net
    union all select scen_id, {q(fixed.REMOVALS_SUM)}, year, value from remsum where scen_id in (select scen_id from c1)
    union all select scen_id, {GROSS}, year, value from gross where scen_id in (select scen_id from c1))
    group by 1, 2"""


@register("rpt_ambition_table", f"""select scen_id, Variable, {_ys(_ALL)}, case when scen_id in (select scen_id from filt) then 1 else 0 end as filtered
    from ({_AMB})""")
def _(spark, sf):
    return rp.ambition_table(t.db(spark, sf), LIM)


_EM = f"""(select scen_id, {NET} as Variable, year, value from net
    union all select scen_id, {q(fixed.REMOVALS_SUM)}, year, value from remsum where scen_id in (select scen_id from c1)
    union all select scen_id, {GROSS}, year, value from gross where scen_id in (select scen_id from c1))"""
_CUM = f"""select a.scen_id, a.Variable, a.v as cum_sum_20_50, b.v as cum_sum_20_2100 from
    (select scen_id, Variable, coalesce(sum(value), 0) as v from {interp(_EM, 'scen_id, Variable', 2020, 2050, True)} group by 1, 2) a
    join (select scen_id, Variable, coalesce(sum(value), 0) as v from {interp(_EM, 'scen_id, Variable', 2020, t.LAST_YEAR, True)} group by 1, 2) b
    on a.scen_id = b.scen_id and a.Variable = b.Variable"""


@register("rpt_removals_cumulative", f"select scen_id, Variable, {r('cum_sum_20_50')} as cum_sum_20_50, {r('cum_sum_20_2100')} as cum_sum_20_2100 from ({_CUM})")
def _(spark, sf):
    return rp.removals_cumulative(t.db(spark, sf))


_RR = ", ".join(f"max(case when Variable = {q(v)} then {c} end) as {c}_{n}" for c in ("cum_sum_20_50", "cum_sum_20_2100")
                for v, n in ((fixed.REMOVALS_SUM, "removals"), (fixed.NET_TOTAL, "net"), (fixed.GROSS_TOTAL, "gross")))
_RRN = [f"{c}_{n}" for c in ("cum_sum_20_50", "cum_sum_20_2100") for n in ("removals", "net", "gross")]


@register("rpt_removal_ratio", f"""select scen_id, {', '.join(f'{r(n)} as {n}' for n in _RRN)},
    {r('cum_sum_20_50_removals / nullif(cum_sum_20_50_net, 0)')} as ratio_removals_net_2050 from (select scen_id, {_RR} from ({_CUM}) group by 1)""")
def _(spark, sf):
    return rp.removal_ratio(t.db(spark, sf))


@register("rpt_harmonised_long", f"""select Model, Scenario, Region, Variable, year, {r('Emissions')} as Emissions, Model || ' ' || Variable as Label from (
    select 'History' as Model, 'Historical' as Scenario, 'World' as Region, {NET} as Variable, cast(2022 as int) as year, cast(50.0 as double) as Emissions
    union all select k.Model, k.Scenario, 'World', {NET}, n.year, n.value from netfilt n join scen_key k on k.scen_id = n.scen_id
    union all select k.Model, k.Scenario, 'World', {q(fixed.NET_HARMONISED)}, h.year, h.value from harm h join scen_key k on k.scen_id = h.scen_id)""")
def _(spark, sf):
    return rp.harmonised_long(t.db(spark, sf), LIM, t.history(spark))


@register("rpt_combined_emissions", f"select scen_id, Variable, year, {r('value')} as value from combined")
def _(spark, sf):
    return rp.combined_emissions(t.db(spark, sf), LIM, t.history(spark), _external(spark))


@register("rpt_filtered_metadata", "select Model, Scenario, Literature_reference from scen_key where scen_id in (select scen_id from filt)")
def _(spark, sf):
    return rp.filtered_metadata(t.db(spark, sf), LIM)


_LONGFIG = f"""select scen_id, year, nullif(value, 0) as CO2 from gross where scen_id in (select scen_id from c1) and year in (2020, 2030, 2040, 2050, 2060)
    union all select {q(fixed.FILTERED_MEDIAN)}, year, quantile_cont(nullif(value, 0), 0.5) from gross where scen_id in (select scen_id from filt)
      and year in (2020, 2030, 2040, 2050, 2060) group by year"""


@register("rpt_band_vs_median", f"""select scen_id, {GROSS} as Variable, x.year, {r('CO2')} as CO2, {r('c1_25')} as c1_25, {r('c1_75')} as c1_75
    from ({_LONGFIG}) x left join (select year, quantile_cont(nullif(value, 0), 0.25) as c1_25, quantile_cont(nullif(value, 0), 0.75) as c1_75 from gross
      where scen_id in (select scen_id from c1) and year in (2020, 2030, 2040, 2050) group by 1) b on b.year = x.year where CO2 is not null""")
def _(spark, sf):
    return rp.band_vs_median(t.db(spark, sf), LIM)


@register("rpt_raw_vs_harmonised", f"""select scen_id, Variable, year, {r('value')} as CO2 from combined
    where Variable in ({GROSS}, {q(fixed.GROSS_HARMONISED)}) and scen_id <> 'NZE 2023' and value <> 0""")
def _(spark, sf):
    return rp.raw_vs_harmonised(rp.combined_emissions(t.db(spark, sf), LIM, t.history(spark), _external(spark)))


@register("rpt_removals_vs_reduction", f"""select g.scen_id, case when g.scen_id in (select scen_id from filt) then 1 else 0 end as filtered,
    {r(change('g.y2020', 'g.y2050'))} as gross_change_2020_2050, {r('c.y2050')} as removals_2050 from ({_AMB}) g join ({_AMB}) c
    on c.scen_id = g.scen_id where g.Variable = {GROSS} and c.Variable = {q(fixed.REMOVALS_SUM)}""")
def _(spark, sf):
    return rp.removals_vs_reduction(t.db(spark, sf), LIM)


_GW = f"select scen_id, {pivot((2020, 2030, 2050), rounded=False)} from gross where scen_id in (select scen_id from c1) group by 1"


@register("rpt_ambition_cut", f"""select scen_id, {r(change('y2020', 'y2030'))} as pchange_2030, {r(change('y2020', 'y2050'))} as pchange_2050,
    case when {change('y2020', 'y2050')} <= -0.89 then 1 else 0 end as ambitious, case when scen_id in (select scen_id from scen_key
      where IMP_marker in ('SP', 'LD', 'Ren')) then 1 else 0 end as illustrative from ({_GW})""")
def _(spark, sf):
    return rp.ambition_cut(t.db(spark, sf))


_METRIC_COLS = dict(zip(("final_energy_2050", "ren_share_2050", "max_bioenergy", "removals_2050", "cum_ccs_2010_2050", "cum_gross_2020_2050"),
                        fixed.PANEL_METRICS))


def _panel(levels, sources, focal):
    parts = []
    for col, (code, _) in _METRIC_COLS.items():
        hit = [(i, lab) for i, (cd, lab) in enumerate(levels) if cd == code]
        if not hit:
            continue
        (o, lab), = hit
        for i, (sc, sl) in enumerate(sources):
            if sc not in focal:
                continue
            value = str(NZE_METRICS[col]) if sc == "IEA NZE" else f"quantile_cont(case when scen_id in (select scen_id from filt) then {col} end, 0.5)"
            parts.append(f"""select {q(lab)} as metric_label, cast({o} as int) as metric_ord, {q(sl)} as scenario, cast({i} as int) as scenario_ord,
              {r(f'cast({value} as double)')} as Value, {r(f'quantile_cont({col}, 0.25)')} as line_25, {r(f'quantile_cont({col}, 0.75)')} as line_75 from km""")
    return " union all ".join(parts)


@register("rpt_key_metric_panel", _panel(fixed.PANEL_METRICS, fixed.PANEL_SOURCES, ("IEA NZE", fixed.FILTERED_MEDIAN)))
def _(spark, sf):
    return rp.key_metric_panel(rp.summary_metrics(t.db(spark, sf), LIM, _nze_named(spark)))


@register("rpt_key_metric_panel_all", _panel(fixed.WIDE_PANEL_METRICS, fixed.PANEL_SOURCES, ("IEA NZE",)))
def _(spark, sf):
    metrics = rp.summary_metrics(t.db(spark, sf), LIM, _nze_named(spark))
    return rp.key_metric_panel(metrics, ("IEA NZE",), fixed.WIDE_PANEL_METRICS)


def _gen_rows():
    land_older = f"(select scen_id, year, sum(case when Variable = {q(fixed.AFOLU_CH4)} then value * 28 else value end) as value from older_long where Variable in ({q(fixed.AFOLU_CO2)}, {q(fixed.AFOLU_CH4)}) group by 1, 2)"
    co2_older = f"(select scen_id, year, value from older_long where Variable = {q(fixed.AFOLU_CO2)})"
    co2_new = f"(select scen_id, year, value from scen_long where Variable = {q(fixed.AFOLU_CO2)})"
    out = []
    for measure, gen, src, step, key in (("co2e", "AR6", "land", 1, "scen_key"), ("co2", "AR6", co2_new, 1, "scen_key"),
                                         ("co2e", "SR15", land_older, 1, "older_key"), ("co2", "SR15", co2_older, 1, "older_key")):
        cat = "Category" if key == "scen_key" else "category"
        out.append(f"""select '{measure}' as measure, '{gen}' as gen, lower(k.{cat}) as category, t.v as total from
          (select scen_id, coalesce(sum(value), 0) as v from {interp(src, 'scen_id', 2020, 2050, True, step)} group by 1) t join {key} k on k.scen_id = t.scen_id""")
    return " union all ".join(out)


@register("rpt_afolu_generations", f"""select measure, gen, category, {r('q1')} as q1, {r('q2')} as q2, {r('q3')} as q3,
    {r('min(case when total between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then total end)')} as whisker_low,
    {r('max(case when total between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then total end)')} as whisker_high,
    count(case when not total between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then 1 end) as n_outliers, count(*) as n,
    {r("avg(case when total > (case when measure = 'co2e' then 8000.0 else 4000.0 end) then 1.0 else 0.0 end)")} as share_above from (select *,
      quantile_cont(total, 0.25) over w as q1, quantile_cont(total, 0.5) over w as q2, quantile_cont(total, 0.75) over w as q3
      from ({_gen_rows()}) window w as (partition by measure, gen, category)) group by measure, gen, category, q1, q2, q3""")
def _(spark, sf):
    return rp.afolu_generations(t.db(spark, sf), t.older_db(spark, sf), *AFOLU_LINES)


@register("rpt_project_highlight", f"""select scen_id, year, {r('value')} as CO2, case when scen_id in (select scen_id from scen_key
    where Project_study = 'ENGAGE') then 1 else 0 end as highlighted from gross where scen_id in (select scen_id from c1)
    and year in (2020, 2030, 2040, 2050, 2060)""")
def _(spark, sf):
    return rp.project_highlight(t.db(spark, sf))


@register("rpt_focal_vs_median", f"""select scen_id, year, {r('CO2')} as CO2, {r('c1_25')} as c1_25, {r('c1_75')} as c1_75, case scen_id when 'NZE' then 'NZE' when 'CWF' then 'CWF' else 'Filtered' end as Scenario,
    cast(case scen_id when 'NZE' then 0 when 'CWF' then 1 else 2 end as int) as ord from (select Source as scen_id, cast(year as int) as year, CO2 from (
      select Source, unnest([2020, 2030, 2040, 2050]) as year, unnest([y2020, y2030, y2040, y2050]) as CO2 from focal where Source in ('NZE', 'CWF'))
    union all select * from ({_LONGFIG}) where scen_id = {q(fixed.FILTERED_MEDIAN)} and year < 2060)
    join (select year, quantile_cont(nullif(value, 0), 0.25) as c1_25, quantile_cont(nullif(value, 0), 0.75) as c1_75 from gross
      where scen_id in (select scen_id from c1) and year in (2020, 2030, 2040, 2050) group by 1) using (year)""")
def _(spark, sf):
    return rp.focal_vs_median(t.db(spark, sf), LIM, t.focal(spark))


@register("rpt_pathway_vs_subset", f"""select scen_id, year, {r('CO2eq')} as CO2eq,
    case when scen_id in (select scen_id from scen_key where IMP_marker is not null) then 1 else 0 end as is_marker,
    case when scen_id in (select scen_id from scen_key where Category_subset = 'C1a_NZGHGs') then 1 else 0 end as is_subset from (
      select scen_id, year, sum(value) as CO2eq from (select scen_id, year, value from gross union all select scen_id, year, value * 0.273 from n2o
        union all select scen_id, year, value * 29.8 from ch4) where scen_id in (select scen_id from c1) and year in (2020, 2030, 2040, 2050) group by 1, 2
      union all select 'cross-sector pathway', cast(year as int), v from (select unnest([2020, 2030, 2040, 2050]) as year, unnest([y2020, y2030, y2040, y2050]) as v
        from ({_UNHARM}) where Variable = 'Gross fossil CO2e'))""")
def _(spark, sf):
    return rp.pathway_vs_subset(t.db(spark, sf), LIM, t.focal(spark))


def _quart(spark, sf, variables=None):
    d = t.db(spark, sf)
    return rp.filtered_quantiles(d, d.key.where("in_list_a = 1"), variables, rp.FIVE_YEARLY)


@register("rpt_net_vs_gross", f"""select source, {r('avg(g - n)')} as mean_gap, count(case when g > n then 1 end) as n_above, count(*) as n from (
    select source, perc, year, max(case when Variable = {NET} then value end) as n, max(case when Variable = {GROSS} then value end) as g from cohort_q
    where year between 2020 and 2060 and (year % 5) = 0 group by 1, 2, 3) where n is not null and g is not null group by 1""")
def _(spark, sf):
    return rp.net_vs_gross(_quart(spark, sf, (fixed.NET_TOTAL, fixed.GROSS_TOTAL)))


@register("rpt_generation_bands", f"""select source, Variable, year, perc, {r('value')} as value, source || ' ' || perc as "group",
    case when perc = 'median' then 'median' else 'band' end as panel from (
    select source, Variable, year, perc, value from cohort_q where year in (2020, 2025, 2030, 2035, 2040, 2045, 2050, 2055, 2060)
    union all select source, Variable, year, perc, value from older_q where year in (2020, 2030, 2040, 2050, 2060)
      and Variable <> {q(fixed.BECCS)})""")
def _(spark, sf):
    return rp.generation_bands(_quart(spark, sf), rp.sr15_quantiles(t.older_db(spark, sf)))


@register("rpt_median_plus_paths", f"""select source || ' (median)' as source, Variable, year, perc, {r('value')} as value from cohort_q
      where perc = 'median' and Variable = {GROSS} and year in (2020, 2025, 2030, 2035, 2040, 2045, 2050, 2055, 2060)
    union all select scen_id, {GROSS}, year, null, {r('value')} from gross where year in (2020, 2030, 2040, 2050, 2060)
      and scen_id in (select scen_id from scen_key where IMP_marker in ('SP', 'LD', 'Ren'))""")
def _(spark, sf):
    return rp.median_plus_paths(_quart(spark, sf, (fixed.GROSS_TOTAL,)), rp.illustrative_paths(t.db(spark, sf)))


_LUL = " union all ".join(f"select '{m}' as metric, filter_flag, {m} as v from lutf" for m in rp.LAND_USE_METRICS)


@register("rpt_land_use_effect", f"""select metric, filter_flag, {r('q1')} as q1, {r('q2')} as q2, {r('q3')} as q3,
    {r('min(case when v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then v end)')} as whisker_low,
    {r('max(case when v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then v end)')} as whisker_high,
    count(case when not v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then 1 end) as n_outliers, count(*) as n from (select *,
      quantile_cont(v, 0.25) over w as q1, quantile_cont(v, 0.5) over w as q2, quantile_cont(v, 0.75) over w as q3
      from ({_LUL}) where v is not null window w as (partition by metric, filter_flag)) group by metric, filter_flag, q1, q2, q3""")
def _(spark, sf):
    return rp.land_use_boxplots(t.db(spark, sf), LU_LINE)


@register("rpt_land_use_tests", _welch_sql("lutf", "filter_flag", "Not filtered", "Removed by filter", ("perc_ch_gross_2030", "perc_ch_gross_2050")))
def _(spark, sf):
    return rp.land_use_tests(t.db(spark, sf), LU_LINE)


@register("rpt_land_use_correlations", _cor_sql("lutf", [("max_lu_seq", m) for m in ("net_2050", "gross_2050", "net_2030", "gross_2030")]))
def _(spark, sf):
    return rp.land_use_correlations(t.db(spark, sf), LU_LINE)
