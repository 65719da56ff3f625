import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pathloom.functions import columns as c
from pathloom.functions import fixed as fx
from pathloom.operators import emissions as em
from pathloom.operators import screens as sc
from pathloom.operators import targets as tg
from pathloom.operators.harmonise import harmonise_budget
from pathloom.operators.joins import align, cohort_table, by_cohort, flag_members, recode
from pathloom.operators.summary import sums_at
from pathloom.plans import reports as rp
from pathloom.plans.building import QUARTILES
from pathloom.sources.tables import ScenarioDb
from tests.conftest import rows


@pytest.fixture(scope="module")
def ids(make):
    return lambda *names: make("scen_id string", [(n,) for n in names])


def test_missing_totals_are_filled_and_reported_ones_left(long, ids):
    df = long([("a", fx.NET_ENERGY, 2020, 7.0), ("b", fx.NET_TOTAL, 2020, 5.0), ("b", fx.NET_ENERGY, 2021, 9.0),
               ("d", fx.NET_ENERGY, 2020, 1.0)])
    out = em.fill_missing_total(df, ids("a", "b", "c"), (2020, 2021)).where(F.col("Variable") == fx.NET_TOTAL)
    got = {(r[0], r[2]): r[3] for r in rows(out)}
    twice = em.filled_totals(df, ids("a", "a", "b", "c"), (2020, 2021))
    assert {(r[0], r[2]): r[3] for r in rows(twice)} == {k: v for k, v in got.items() if k[0] != "b"}
    assert got == {("a", 2020): 7, ("a", 2021): 0, ("b", 2020): 5, ("c", 2020): 0, ("c", 2021): 0}


MIX = [("a", fx.NET_TOTAL, 2020, 10.0), ("a", fx.BECCS, 2020, -3.0), ("a", fx.DIRECT_AIR, 2020, 2.0),
       ("a", fx.BECCS, 2030, 4.0), ("b", fx.NET_INDUSTRY, 2030, 6.0), ("b", fx.WEATHERING, 2030, 1.0),
       ("b", fx.WEATHERING, 2020, 0.0), ("e", fx.NET_ENERGY, 2020, 1.0), ("f", fx.BECCS, 2020, 1.5)]


def test_gross_undoes_wrong_signs(long):
    got = {(r[0], r[2]): r[3] for r in rows(em.gross_emissions(long(MIX)))}
    assert got[("a", 2020)] == 15 and got[("a", 2030)] == 4 and got[("f", 2020)] == 1.5


def test_fused_pass_equals_the_composed_operators(long, ids):
    df, who, years = long(MIX), ids("a", "b", "z"), (2020, 2030)
    filled = em.fill_missing_total(df, who, years)
    want = {(r[0], r[1]): r[2] for r in rows(sums_at(em.gross_rows(filled), years)) if r[0] in "abz"}
    wide = em.eip_at(df, who, years).collect()
    assert {(r.scen_id, y): r[f"gross_{y}"] for r in wide for y in years} == want
    net = {(r.scen_id, y): r[f"net_{y}"] for r in wide for y in years}
    assert net == {("a", 2020): 10, ("a", 2030): None, ("b", 2020): 0, ("b", 2030): 6, ("z", 2020): 0, ("z", 2030): 0}
    yearly = {(r.scen_id, r.year): (r.net, r.gross) for r in em.eip_yearly(df, who, 2020, 2030).collect()}
    assert all(yearly[k] == (net[k], want[k]) for k in want) and len(yearly) == 33


def test_ids_outside_the_filled_cohort_keep_removals_only(long, make):
    who = make("scen_id string, fill int", [("e", 0), ("f", 0), ("a", 1)]).withColumn("fill", F.col("fill") == 1)
    got = {r.scen_id: r.gross_2020 for r in em.eip_at(long(MIX), who, (2020,)).collect()}
    assert got == {"a": 15, "f": 1.5}


def test_land_sector_converted_and_literal(long):
    df = long([("a", fx.AFOLU_CO2, 2050, 100.0), ("a", fx.AFOLU_CH4, 2050, 2.0), ("a", fx.AFOLU_N2O, 2050, 1000.0),
               ("b", fx.AFOLU_CO2, 2040, 5.0)])
    assert rows(em.afolu_co2e_year(df)) == [("a", 100 + 56 + 265), ("b", 0)]
    assert rows(em.afolu_co2e_year(df, convert=False)) == [("a", 1102), ("b", 0)]


def test_screens_are_strict_and_missing_stays(long, ids):
    lim = fx.Limits(bioenergy=100.0, afforestation=10.0, total_ccs=410.0, removals_2020=2.0, land_sector=-31.0)
    df = long([
        ("eq", fx.BIOENERGY, 2030, 100.0), ("hi", fx.BIOENERGY, 2030, 100.1), ("late", fx.BIOENERGY, 2051, 900.0),
        ("ccs0", fx.CCS, 2010, 10.0), ("ccs1", fx.CCS, 2010, 10.1), ("af", fx.AFFORESTATION, 2050, 11.0),
        ("l0", fx.AFOLU_CO2, 2020, -1.0), ("l1", fx.AFOLU_CO2, 2020, -1.1), ("l2", fx.AFOLU_CO2, 2021, -1.03),
        ("r1", fx.BECCS, 2020, 1.0), ("r1", fx.DIRECT_AIR, 2020, 1.1), ("r2", fx.BECCS, 2020, 5.0), ("r2", fx.WEATHERING, 2020, -4.0),
    ])
    crit = {r.scen_id: {k for k in ("bio", "afforestation", "ccs", "land", "removals") if r[k]}
            for r in sc.screen_criteria(df, lim).collect()}
    assert {k for k, v in crit.items() if v} == {"hi", "ccs1", "af", "l1", "r1"}
    everyone = ids("eq", "hi", "late", "ccs0", "ccs1", "af", "l0", "l1", "l2", "r1", "r2", "nodata")
    kept = {r.scen_id: set(r.cohort) for r in sc.screen_cohorts(everyone, sc.screen_criteria(df, lim)).collect()}
    assert kept["nodata"] == set(range(8)) and kept["hi"] == {0, 2, 3} and kept["r1"] == set(range(7))
    for name, got in (
        ("bio", sc.screen_bioenergy(df, lim.bioenergy)), ("afforestation", sc.screen_afforestation(df, lim.afforestation)),
        ("ccs", sc.screen_total_ccs(df, lim.total_ccs)), ("land", sc.screen_land_sector(df, lim.land_sector)),
        ("removals", sc.screen_removals_year(df, lim.removals_2020)),
    ):
        assert {r[0] for r in rows(got)} == {k for k, v in crit.items() if name in v}
    # combined flags are intersections of the single criteria
    for f, names in fx.SCREEN_FLAGS.items():
        want = {k for k in kept if not crit.get(k, set()) & set(names)}
        assert {k for k, v in kept.items() if f in v} == want
        assert {r[0] for r in rows(sc.sustainability_filters(everyone, df, f, lim))} == want


def test_unknown_flags_raise(long, ids):
    with pytest.raises(ValueError):
        sc.sustainability_filters(ids("a"), long(MIX), 8)
    with pytest.raises(ValueError):
        sc.iisd_filter_variations(ids("a"), long(MIX), 4)


def test_mean_of_two_years_skips_missing(long, ids):
    df = long([("a", fx.BECCS, 2060, 3001.0), ("b", fx.BECCS, 2040, 1000.0), ("b", fx.BECCS, 2060, 5000.0),
               ("c", fx.LAND_USE, 2040, 3601.0)])
    who = ids("a", "b", "c", "d")
    assert [r[0] for r in rows(sc.iisd_filter_variations(who, df, 2))] == ["b", "c", "d"]
    assert [r[0] for r in rows(sc.iisd_filter_variations(who, df, 3))] == ["b", "d"]
    assert [r[0] for r in rows(sc.iisd_filter_variations(who, df, 1))] == ["a", "b", "d"]


def test_harmonise_small(make):
    df = make("scen_id string, Region string, year int, value double",
              [("a", "World", 2022, 10.0), ("a", "World", 2023, 20.0), ("late", "World", 2023, 5.0), ("b", "Mars", 2022, 1.0)])
    hist = make("Region string, value double", [("World", 12.0)])
    h = harmonise_budget(df, hist, first=2022, last=2023)
    assert [(r.year, pytest.approx(r.value)) for r in h.trajectories.orderBy("year").collect()] == [(2022, 12), (2023, 18)]
    assert {(r.scen_id, r.reason) for r in h.failed.collect()} == {
        ("late", "no value in the anchor year"), ("b", "no history")}


def test_harmonise_by_region_and_variable(make):
    schema = "scen_id string, Region string, Variable string, year int, value double"
    df = make(schema, [("a", g, v, y, 10.0 * i) for i, (g, v) in enumerate([("World", "p"), ("World", "q"), ("R5", "p")], 1)
                       for y in (2022, 2050)] + [("a", "R5", "q", 2022, 1.0), ("b", "World", "p", 2021, 0.0)])
    hist = make("Region string, Variable string, value double", [("World", "p", 1.0), ("World", "q", 2.0), ("R5", "p", 3.0)])
    h = harmonise_budget(df, hist, variable="Variable")
    got = {(r.scen_id, r.Region, r.Variable): r for r in h.diagnostics.collect()}
    assert {k: r.offset for k, r in got.items()} == {
        ("a", "World", "p"): -9, ("a", "World", "q"): -18, ("a", "R5", "p"): -27, ("a", "R5", "q"): None, ("b", "World", "p"): None}
    assert got["a", "R5", "q"].reason == "no history" and got["b", "World", "p"].reason == "no value in the anchor year"
    assert h.trajectories.count() == 3 * 29 and h.failed.count() == 2
    for r in got.values():
        assert r.budget_before is None or r.budget_before == pytest.approx(r.budget_after)


def test_harmonise_is_the_least_squares_solution(make):
    n, hist = 28, 50.0
    rng = np.random.default_rng(3)
    m = rng.normal(100, 30, n + 1)
    df = make("scen_id string, Region string, year int, value double", [("a", "World", 2022 + i, float(v)) for i, v in enumerate(m)])
    h = harmonise_budget(df, make("Region string, value double", [("World", hist)]))
    x = np.array([r.value for r in h.trajectories.orderBy("year").collect()])
    d = h.diagnostics.collect()[0]
    assert x[0] == pytest.approx(hist) and d.budget_before == pytest.approx(d.budget_after, rel=1e-12)
    # minimise the sum of squared slope changes under both constraints, as a dense linear system
    D = np.diff(np.eye(n + 1), axis=0)
    w = np.ones(n + 1)
    w[[0, -1]] = 0.5
    C = np.vstack([np.eye(n + 1)[0], w])
    K = np.block([[2 * D.T @ D, C.T], [C, np.zeros((2, 2))]])
    want = np.linalg.solve(K, np.concatenate([2 * D.T @ D @ m, [hist, w @ m]]))[: n + 1]
    assert x == pytest.approx(want, abs=1e-8)


def test_harmonise_needs_the_anchor_inside(make):
    df = make("scen_id string, Region string, year int, value double", [("a", "World", 2022, 1.0)])
    with pytest.raises(ValueError):
        harmonise_budget(df, make("Region string, value double", [("World", 1.0)]), first=2023, last=2030)


def test_alignment_is_a_full_outer_join(make):
    p = make("scen_id string, p double", [("a", 1.0), ("b", 2.0)])
    q = make("scen_id string, q double", [("c", 3.0)])
    assert rows(align(p, q)) == [("a", 1, None), ("b", 2, None), ("c", None, 3)]


def test_cohorts_and_flags(make, ids):
    key = make("scen_id string, k string", [("a", "x"), ("b", None), ("c", "y")])
    members = cohort_table(key, {"all": F.lit(True), "x": F.col("k") == "x"})
    data = make("scen_id string, value double", [("a", 1.0), ("b", 2.0)])
    assert rows(by_cohort(data, members).select("scen_id", "cohort")) == [("a", "all"), ("a", "x"), ("b", "all")]
    assert rows(flag_members(data, ids("a", "a"), "m").select("scen_id", "m")) == [("a", 1), ("b", 0)]


def test_recode_outside_levels_is_missing(make):
    df = make("k string", [("b",), ("q",), ("a",)])
    assert rows(recode(df, "k", [("a", "Alpha"), ("b", "Beta")], "label", "ord")) == [("a", "Alpha", 0), ("b", "Beta", 1), ("q", None, None)]


def test_scalar_expressions(make):
    df = make("s string, v double, z double", [("NA", float("nan"), 0.0), ("3.5", 2.0, 4.0), ("x", None, 1.0)])
    got = [tuple(r) for r in df.select(
        c.number_or_missing("s"), c.nan_as_missing("v"), c.zero_as_missing("z"), c.share_of("v", "z"),
        c.joined_key("s", F.lit("m")), c.co2e("z", "SF6"),
    ).collect()]
    assert got[1][:5] == (3.5, 2.0, 4.0, 0.5, "3.5 m") and got[1][5] == pytest.approx(4 * 25.2)
    assert got[0][:3] == (None, None, None) and got[2][0] is None


def test_target_records_and_domains(make):
    args = make("company string, sector string, ty_activity_type string, target_year int, s string",
                [("a", "power", "ty_output", 2030, "1.5"), ("b", "steel", "ty_output", 2030, "NA"), ("c", None, "x", 2030, "2")])
    seen = Observation("domains")
    good, bad = tg.domain_check(args, tg.domain_table(args.sparkSession), tg.DOMAINS, seen)
    assert [r[0] for r in rows(good)] == ["a"]
    assert seen.get == {"rows": 3, "outside_sector": 2, "outside_ty_activity_type": 1}
    assert rows(bad.select("company", "violations")) == [("b", "sector"), ("c", "sector,ty_activity_type")]
    # a domain that comes from data, with a repeated and a missing value
    own = make("domain string, allowed string", [("sector", "steel"), ("sector", "steel"), ("sector", None), ("other", "power")])
    good, bad = tg.domain_check(args, own, ("sector",))
    assert [r[0] for r in rows(good)] == ["b"] and {r.company for r in bad.collect()} == {"a", "c"}
    good, bad = tg.domain_check(args, own.where("domain = 'none'"), ("target_year",))
    assert good.count() == 0 and bad.count() == 3
    num = tg.numeric_arguments(args, ["s"])
    rec = tg.target_records_union(*[tg.target_record(num, m, F.col("s"), F.lit(None).cast("double")) for m in ("SDA", "ARA")])
    assert {(r.company, r.method, r.ty_scope1, r.target_year) for r in rec.collect()} >= {("a", "SDA", 1.5, 2030), ("b", "ARA", None, 2030)}
    with pytest.raises(ValueError):
        tg.target_record(num, "XYZ", F.col("s"), F.col("s"))


def test_gases_at_tells_nothing_reported_from_zero(long):
    df = long([("a", "Emissions|N2O|Waste", 2020, 1000.0), ("a", "Emissions|N2O|Energy", 2020, 500.0),
               ("b", "Emissions|HFC", 2030, 2.0), ("b", "Emissions|CH4|Other", 2040, 3.0), ("c", "Emissions|CO2|AFOLU", 2020, 1.0)])
    got = {r.scen_id: r for r in em.gases_at(df, (2020, 2030)).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].N2O_2020, got["a"].N2O_2030, got["a"].CH4_2020, got["a"].HFC_2020) == (1500, 0, None, None)
    assert (got["b"].N2O_2020, got["b"].CH4_2020, got["b"].HFC_2030, got["b"].HFC_2020) == (None, 0, 2, None)
    co2e = {r.scen_id: r for r in em.gases_at(df, (2020, 2030), vintage="AR6").collect()}
    assert co2e["a"].N2O_2020 == pytest.approx(1.5 * 273) and co2e["b"].HFC_2030 == pytest.approx(2 * 1.53)


@pytest.mark.parametrize("years", [(2010, 2015, 2020, 2025), (2005, 2010, 2020, 2050)])
def test_older_gross_quartiles_cover_every_year_of_the_table(make, long, years):
    last = years[-1]
    cells = [("a", fx.NET_TOTAL, y, float(y - 2000)) for y in years[:-1]] + [("a", fx.BECCS, y, 1.0) for y in years[:2]]
    cells += [("b", fx.NET_TOTAL, y, 3.0 * (y - 2000)) for y in years[:-1]] + [("x", fx.NET_TOTAL, last, 1.0)]
    key = make("scen_id string, category string, kyoto_2010 string",
               [(n, fx.OLDER_CATEGORIES[0], fx.OLDER_IN_RANGE) for n in "ab"] + [("x", "other", fx.OLDER_IN_RANGE)])
    db = ScenarioDb(long(cells), key, years, 3)
    want = {}
    for y in years:  # a year that only others report counts as 0
        per = [sum(v for s, _, at, v in cells if s == n and at == y) for n in "ab"]
        want |= {(y, name): np.quantile(per, p) for name, p in QUARTILES.items()}
    out = rp.sr15_quantiles(db)
    got = {(r.year, r.perc): r.value for r in out.where(F.col("Variable") == fx.GROSS_TOTAL).collect()}
    assert got == pytest.approx(want)
    bands = rp.generation_bands(out, out).where(F.col("Variable") == fx.GROSS_TOTAL)
    assert {r.year for r in bands.collect()} == {y for y in years if y >= 2020}
