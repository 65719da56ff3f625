"""Building blocks of the SQL twins: named common table expressions and the text that joins them.

The twins state the same results in plain SQL over the raw tables, along a different route than the
DataFrame code: dense year grids, ``quantile_cont``, set operators.
"""

from __future__ import annotations

import re

from pathloom.functions import fixed
from workload import tables as t


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(names) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


def r(expr: str) -> str:
    return f"round({expr}, 4)"


NET, GROSS = q(fixed.NET_TOTAL), q(fixed.GROSS_TOTAL)
REM = inlist(fixed.REMOVALS)
N2O, CH4 = inlist(fixed.N2O_SECTORS), inlist(fixed.CH4_SECTORS)
L = t.LIMITS


def change(base: str, later: str) -> str:
    return f"(({later}) - ({base})) / nullif({base}, 0)"


def interp(src: str, keys: str, first: int, last: int, zero: bool = False, step: int = 1) -> str:
    """Dense gap-filled grid of every key in ``src`` (keys, year, value)."""
    on = " and ".join(f"k.{c.strip()} = s.{c.strip()}" for c in keys.split(","))
    kk = ", ".join(f"k.{c.strip()}" for c in keys.split(","))
    v = "nullif(s.value, 0)" if zero else "s.value"
    up = f"over (partition by {keys} order by year rows between unbounded preceding and current row)"
    down = f"over (partition by {keys} order by year rows between current row and unbounded following)"
    y = "case when v is not null then year end"
    return f"""(select {keys}, year, case when v is not null then v when pv is null then null when nv is null then pv
      else pv + (nv - pv) * (year - py) / (ny - py) end as value
    from (select {keys}, year, v, last_value(v ignore nulls) {up} as pv, last_value({y} ignore nulls) {up} as py,
        first_value(v ignore nulls) {down} as nv, first_value({y} ignore nulls) {down} as ny
      from (select {kk}, g.year, {v} as v from (select distinct {keys} from {src}) k
        cross join (select cast(unnest(range({first}, {last + 1}, {step})) as int) as year) g
        left join {src} s on {on} and s.year = g.year)))"""


def years_between(first: int, last: int) -> str:
    return f"(select cast(unnest(range({first}, {last + 1})) as int) as year)"


def pivot(years, value: str = "value", prefix: str = "y", rounded: bool = True) -> str:
    def one(y):
        e = f"max(case when year = {y} then {value} end)"
        return f"{r(e) if rounded else e} as {prefix}{y}"

    return ", ".join(one(y) for y in years)


def _quartiles(src: str, keys: str) -> str:
    return " union all ".join(
        f"select {keys}, '{n}' as perc, quantile_cont(value, {p}) as value from {src} group by {keys}"
        for n, p in (("25th perc", 0.25), ("median", 0.5), ("75th perc", 0.75))
    )


_slots = ", ".join(f"({i}, {q(v)}, {q(u)})" for i, (v, u) in enumerate(t.VARIABLES))
_older = ", ".join(f"({q(p)}, {q(v)})" for p, v in t.OLDER_VARIABLES)
_month = "(year({0}) - 1995) * 12 + month({0}) - 1"
_flags = ", ".join(str(f) for f in fixed.SCREEN_FLAGS)
_crit_cols = {"bio": "bio", "afforestation": "lu", "ccs": "ccs", "land": "land", "removals": "cdr"}
_kept = " or ".join(
    f"(f.flag = {f}" + "".join(f" and not coalesce(c.{_crit_cols[n]}, false)" for n in names) + ")"
    for f, names in fixed.SCREEN_FLAGS.items()
)
_weight = f"""case when Variable = {q(fixed.AFOLU_CO2)} then value
    when Variable = {q(fixed.AFOLU_CH4)} then value * 28.0 when Variable = {q(fixed.AFOLU_N2O)} then value * 0.265 end"""
LAND = inlist([fixed.AFOLU_CO2, fixed.AFOLU_CH4, fixed.AFOLU_N2O])

CTES: dict[str, str] = {
    "slots": f"select * from (values {_slots}) as s(slot, name, unit)",
    "nat": "select * from nation join region on n_regionkey = r_regionkey",
    "cell": f"""select l_suppkey, cast(l_partkey % 30 as int) as slot,
        cast(case when l_linestatus = 'O' then 2010 + mm - ((2010 + mm) % 10) else 2010 + mm end as int) as year,
        cast(sum(cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint))) as double)
          / cast({int(t.UNIT)} as double) as v
      from (select *, {_month.format('l_shipdate')} as mm from lineitem) group by 1, 2, 3""",
    "scen_long": """select n_name || ' ' || s_name as scen_id, n_name as Model, s_name as Scenario, 'World' as Region,
        slots.name as Variable, slots.unit as Unit, cell.year,
        case when cell.slot in (3, 4, 5) and n_nationkey in (0, 7, 14, 21) then -v
             when cell.slot in (3, 4, 5) and cell.year in (2025, 2050, 2075) then cast(0 as double)
             when cell.slot = 11 then -20 * v else v end as value
      from cell join supplier on l_suppkey = s_suppkey join nat on s_nationkey = n_nationkey
        join slots on cell.slot = slots.slot
      where not (cell.slot = 0 and r_name = 'AFRICA')""",
    "scen_key": """select n_name || ' ' || s_name as scen_id, n_name as Model, s_name as Scenario,
        case when s_acctbal >= 3000 then 'C1' when s_acctbal >= 1000 then 'C2' else 'C3' end as Category,
        case when s_acctbal >= 3000 and r_name in ('ASIA', 'AFRICA') then 'C1a_NZGHGs' end as Category_subset,
        case when s_acctbal < 3000 then null when n_nationkey in (1, 4, 10) then 'SP'
             when n_nationkey in (2, 5, 13) then 'LD' when n_nationkey in (3, 15, 19) then 'Ren' end as IMP_marker,
        case when r_name = 'EUROPE' then 'ENGAGE' end as Project_study,
        'Study of ' || n_name as Literature_reference,
        case when s_acctbal >= 6000 then 1 else 0 end as in_list_a,
        case when s_acctbal >= 4000 and s_acctbal < 8000 then 1 else 0 end as in_list_b
      from supplier join nat on s_nationkey = n_nationkey""",
    "older_names": f"select * from (values {_older}) as s(prio, name)",
    "older_long": f"""select c_mktsegment || c_name as scen_id, c_mktsegment as Model, c_name as Scenario,
        older_names.name as Variable, year, v as value
      from (select o_custkey, o_orderpriority, cast(2010 + floor(({_month.format('o_orderdate')}) / 8.0) * 10 as int) as year,
          cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast({int(t.OLDER_UNIT)} as double) as v
        from orders group by 1, 2, 3) c
        join customer on o_custkey = c_custkey join older_names on o_orderpriority = prio""",
    "older_key": """select c_mktsegment || c_name as scen_id,
        case when c_acctbal >= 7000 then 'Below 1.5C' when c_acctbal >= 4000 then '1.5C low overshoot' else 'Higher' end as category,
        case when c_mktsegment <> 'HOUSEHOLD' then 'in range' else 'out of range' end as kyoto_2010
      from customer""",
    "older_cohort": """select scen_id from older_key where category in ('1.5C low overshoot', 'Below 1.5C')
        and kyoto_2010 = 'in range'""",
    "ticks": f"""select user_id, event_type, cast(day(ts) as int) as year,
        cast(sum(cast(round(value * 100) as bigint)) as double) / cast({int(t.TICK_UNIT)} as double) as value
      from events group by 1, 2, 3""",
    "c1": "select scen_id from scen_key where Category = 'C1'",
    "allyears": f"select year from {years_between(t.FIRST_YEAR, t.LAST_YEAR)}",
    # totals filled for C1: every year, zero where neither part is there
    "fills": f"""select m.scen_id, {NET} as Variable, y.year, coalesce(sum(p.value), 0) as value
      from (select scen_id from c1 except select scen_id from scen_long where Variable = {NET}) m
        cross join allyears y left join scen_long p on p.scen_id = m.scen_id and p.year = y.year
          and p.Variable in ({q(fixed.NET_ENERGY)}, {q(fixed.NET_INDUSTRY)})
      group by 1, 2, 3""",
    "filled": "select scen_id, Variable, year, value from scen_long union all select * from fills",
    "net": f"select scen_id, year, value from filled where Variable = {NET} and scen_id in (select scen_id from c1)",
    "grossr": f"""select scen_id, Variable, year, nullif(case when Variable in {REM} then abs(value) else value end, 0) as value
      from filled where Variable in {REM} or Variable = {NET}""",
    "gross": """select k.scen_id, y.year, coalesce(sum(g.value), 0) as value
      from (select distinct scen_id from grossr) k cross join allyears y
        left join grossr g on g.scen_id = k.scen_id and g.year = y.year group by 1, 2""",
    "landr": f"select scen_id, Model, Variable, year, {_weight} as value from scen_long where Variable in {LAND}",
    "land": "select scen_id, year, sum(value) as value from landr group by 1, 2",
    "ccsr": f"select scen_id, year, value from scen_long where Variable = {q(fixed.CCS)}",
    "crit": f"""select k.scen_id, b.scen_id is not null as bio, u.scen_id is not null as lu, c.scen_id is not null as ccs,
        a.scen_id is not null as land, d.scen_id is not null as cdr
      from (select distinct scen_id from scen_long) k
        left join (select distinct scen_id from scen_long where Variable = {q(fixed.BIOENERGY)}
          and year between 2010 and 2050 and value > {L.bioenergy}) b on b.scen_id = k.scen_id
        left join (select distinct scen_id from scen_long where Variable = {q(fixed.AFFORESTATION)}
          and year between 2010 and 2050 and value > {L.afforestation}) u on u.scen_id = k.scen_id
        left join (select scen_id from {interp('ccsr', 'scen_id', 2010, 2050)} group by 1
          having sum(value) > {L.total_ccs}) c on c.scen_id = k.scen_id
        left join (select scen_id from {interp('land', 'scen_id', 2020, 2050, True)} group by 1
          having coalesce(sum(value), 0) < {L.land_sector}) a on a.scen_id = k.scen_id
        left join (select scen_id from scen_long where Variable in {REM} and year = 2020 group by 1
          having sum(value) > {L.removals_2020}) d on d.scen_id = k.scen_id""",
    "flagset": f"""select f.flag, i.scen_id from c1 i cross join (select cast(unnest([{_flags}]) as int) as flag) f
        left join crit c on c.scen_id = i.scen_id where {_kept}""",
    "filt": "select scen_id from flagset where flag = 7",
    "n2o": f"""select k.scen_id, y.year, coalesce(sum(s.value), 0) as value
      from (select distinct scen_id from scen_long where Variable in {N2O}) k cross join allyears y
        left join scen_long s on s.scen_id = k.scen_id and s.year = y.year and s.Variable in {N2O} group by 1, 2""",
    "ch4": f"""select k.scen_id, y.year, coalesce(sum(s.value), 0) as value
      from (select distinct scen_id from scen_long where Variable in {CH4}) k cross join allyears y
        left join scen_long s on s.scen_id = k.scen_id and s.year = y.year and s.Variable in {CH4} group by 1, 2""",
    "remsum": f"""select k.scen_id, y.year, coalesce(sum(s.value), 0) as value
      from (select distinct scen_id from scen_long where Variable in {REM}) k cross join allyears y
        left join scen_long s on s.scen_id = k.scen_id and s.year = y.year and s.Variable in {REM} group by 1, 2""",
    "focal": "select * from (values " + ", ".join(
        f"({q(n)}, " + ", ".join(f"cast({v} as double)" for v in vs) + ")" for n, *vs in t.FOCAL
    ) + ") as f(Source, y2020, y2030, y2040, y2050)",
    # harmonised net totals of the filtered scenarios
    "netgap": f"select * from {interp('netfilt', 'scen_id', 2020, 2050, True)}",
    "netfilt": "select scen_id, year, value from net where scen_id in (select scen_id from filt) and year between 2020 and 2050",
    "harm": f"""select g.scen_id, g.year, g.value as model, a.value as m0,
        g.value + (h.h - a.value) * (1 - 6.0 * (g.year - 2022) * (2 * 28 - (g.year - 2022)) / (4.0 * 28 * 28 - 1)) as value
      from netgap g join netgap a on a.scen_id = g.scen_id and a.year = 2022 and a.value is not null
        cross join (select cast({t.HISTORY[0][2]} as double) as h) h where g.year >= 2022""",
    "external": """select 'NZE 2023' as scen_id, cast(year as int) as year, value from (
        select unnest([2020, 2030, 2040, 2050]) as year, unnest([y2020, y2030, y2040, y2050]) as value
        from focal where Source = 'NZE')""",
    "harmrows": f"""select scen_id, Variable, year, value from (
        select scen_id, {NET} as Variable, year, value from harm
        union all select scen_id, Variable, year, abs(value) from scen_long
          where Variable in {REM} and scen_id in (select scen_id from harm))""",
    "grossharm": f"""select k.scen_id, y.year, coalesce(sum(g.value), 0) as value
      from (select distinct scen_id from harm) k cross join (select year from allyears where year between 2020 and 2050) y
        left join {interp('harmrows', 'scen_id, Variable', t.FIRST_YEAR, t.LAST_YEAR, True)} g
          on g.scen_id = k.scen_id and g.year = y.year group by 1, 2""",
    "combined": f"""select scen_id, {NET} as Variable, year, nullif(value, 0) as value from netfilt where value <> 0
      union all select scen_id, {q(fixed.NET_HARMONISED)}, year, value from harm
      union all select scen_id, {GROSS}, year, value from gross where value <> 0 and year between 2020 and 2050
        and scen_id in (select scen_id from filt)
      union all select scen_id, {q(fixed.GROSS_HARMONISED)}, year, value from grossharm
      union all select scen_id, {GROSS}, year, value from external""",
    "fgas": f"""select scen_id, Variable, year, value from scen_long where Variable in {inlist(fixed.F_GASES)}
        and scen_id in (select scen_id from c1)""",
    "nonco2": f"""select Variable, {', '.join(
        f"max(case when year = {y} then value end) as y{y}" for y in (2020, 2030, 2040, 2050))},
        'Cross sector benchmark' as Source from (
        select 'N2O (Mt CO2e)' as Variable, year, quantile_cont(value, 0.5) * 0.273 as value from n2o
          where scen_id in (select scen_id from c1) and year in (2020, 2030, 2040, 2050) group by 1, 2
        union all select 'CH4 (Mt CO2e)', year, quantile_cont(value, 0.5) * 29.8 from ch4
          where scen_id in (select scen_id from c1) and year in (2020, 2030, 2040, 2050) group by 1, 2
        union all select replace(Variable, 'Emissions|', '') || ' (Mt CO2e)', year, quantile_cont(value, 0.5) *
          (case Variable when 'Emissions|HFC' then 1.53 when 'Emissions|PFC' then 7.38 else 25.2 end)
          from fgas where year in (2020, 2030, 2040, 2050) group by 2, Variable) group by 1""",
    "km": f"""select k.scen_id, a.v as afolu_co2e_2050, p.final_energy_2050, p.max_bioenergy, c.v as cum_ccs_2010_2050,
        p.removals_2050, p.ren_share_2050, p.ren_share_2030, p.industrial_ccs_2050, g.v as cum_gross_2020_2050
      from c1 k
        left join (select scen_id, coalesce(sum(case when year = 2050 then value end), 0) as v from landr group by 1) a
          on a.scen_id = k.scen_id
        left join (select scen_id, coalesce(sum(value), 0) as v from {interp('ccsr', 'scen_id', 2010, 2050)} group by 1) c
          on c.scen_id = k.scen_id
        left join (select scen_id, coalesce(sum(value), 0) as v from {interp('gross', 'scen_id', 2020, 2050, True)} group by 1) g
          on g.scen_id = k.scen_id
        left join (select scen_id,
            max(case when Variable = {q(fixed.FINAL_ENERGY)} and year = 2050 then value end) as final_energy_2050,
            max(case when Variable = {q(fixed.BIOENERGY)} and year between 2010 and 2050 then value end) as max_bioenergy,
            case when count(case when Variable in {REM} then 1 end) > 0
              then coalesce(sum(case when Variable in {REM} and year = 2050 then value end), 0) end as removals_2050,
            max(case when Variable = {q(fixed.RENEWABLES)} and year = 2050 then value end)
              / nullif(max(case when Variable = {q(fixed.PRIMARY_ENERGY)} and year = 2050 then value end), 0) as ren_share_2050,
            max(case when Variable = {q(fixed.RENEWABLES)} and year = 2030 then value end)
              / nullif(max(case when Variable = {q(fixed.PRIMARY_ENERGY)} and year = 2030 then value end), 0) as ren_share_2030,
            max(case when Variable = {q(fixed.CCS_INDUSTRY)} and year = 2050 then value end) as industrial_ccs_2050
          from scen_long group by 1) p on p.scen_id = k.scen_id""",
    "older_gross": f"""select k.scen_id, y.year, coalesce(sum(s.value), 0) as value
      from (select distinct scen_id from older_long where Variable in ({NET}, {q(fixed.BECCS)})
          and scen_id in (select scen_id from older_cohort)) k
        cross join (select distinct year from older_long) y
        left join older_long s on s.scen_id = k.scen_id and s.year = y.year and s.Variable in ({NET}, {q(fixed.BECCS)})
      group by 1, 2""",
    "older_q": f"""select Variable, year, perc, value,
        case perc when 'median' then 'IPCC SR15 (median)' when '25th perc' then 'IPCC SR15 (25th percentile)'
          else 'IPCC SR15 (75th percentile)' end as source
      from ({_quartiles(f"""(select Variable, year, value from older_long where Variable in ({NET}, {q(fixed.BECCS)})
            and scen_id in (select scen_id from older_cohort)
          union all select {GROSS}, year, value from older_gross)""", "Variable, year")})""",
    "lista": "select scen_id from scen_key where in_list_a = 1",
    "listb": "select scen_id from scen_key where in_list_b = 1",
    "cohort_q": _quartiles(f"""(select scen_id, Variable, year, value from filled
        union all select scen_id, Variable, year, value from (select scen_id, {GROSS} as Variable, year, value from gross)) x
      join (select scen_id, 'AR6 C1' as source from c1 union all select scen_id, 'AR6 C1+IISD' from lista) m using (scen_id)""",
        "source, Variable, year"),
    "lut": f"""select *, {change('net_2020', 'net_2030')} as perc_ch_net_2030, {change('net_2020', 'net_2050')} as perc_ch_net_2050,
        {change('gross_2020', 'gross_2030')} as perc_ch_gross_2030, {change('gross_2020', 'gross_2050')} as perc_ch_gross_2050
      from (select k.scen_id, l.max_lu_seq, n.net_2020, n.net_2030, n.net_2050, g.gross_2020, g.gross_2030, g.gross_2050
        from c1 k
          left join (select scen_id, max(case when year between 2010 and 2050 then value end) as max_lu_seq from scen_long
            where Variable = {q(fixed.LAND_USE)} group by 1) l on l.scen_id = k.scen_id
          left join (select scen_id, {pivot((2020, 2030, 2050), prefix='net_', rounded=False)} from net group by 1) n on n.scen_id = k.scen_id
          left join (select scen_id, {pivot((2020, 2030, 2050), prefix='gross_', rounded=False)} from gross group by 1) g on g.scen_id = k.scen_id)""",
    "lutf": """select * replace (coalesce(max_lu_seq, -1000) as max_lu_seq),
        case when coalesce(max_lu_seq, -1000) > 160 then 'Removed by filter' else 'Not filtered' end as filter_flag from lut""",
    "companies": """select c_name as company, case c_mktsegment when 'BUILDING' then 'buildings_res'
          when 'FURNITURE' then 'buildings_serv' when 'MACHINERY' then 'cement' when 'AUTOMOBILE' then 'power'
          else 'household' end as sector, cast(2020 as int) as base_year, cast(2030 as int) as target_year,
        case when c_acctbal >= 0 then 'fixed_market_share' when c_acctbal >= -500 then 'ty_output' else 'other' end as ty_activity_type,
        coalesce(cast(n as varchar), 'NA') as by_activity, coalesce(cast(s as varchar), 'NA') as by_scope1,
        case when c_acctbal < 0 then 'NA' else cast(cast(round(c_acctbal * 100) as bigint) as varchar) end as by_scope2
      from customer left join (select o_custkey, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as s
        from orders group by 1) o on c_custkey = o_custkey""",
}


def sql(body: str) -> str:
    """Prefix ``body`` with the expressions it names, in the order they need each other."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "''", text)):
                visit_one(name)

    def visit_one(name: str) -> None:
        rest = re.sub(r"'[^']*'", "''", CTES[name])
        for other in CTES:
            if other != name and other not in order and re.search(rf"\b{other}\b", rest):
                visit_one(other)
        if name not in order:
            order.append(name)

    visit(body)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order) + "\n" + body
