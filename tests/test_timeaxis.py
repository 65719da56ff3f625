import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.operators import timeaxis as ta
from tests.conftest import rows

CASES = {
    "gap": ([None, 1, None, 3, None, None], [None, 1, 2, 3, 3, 3]),
    "single": ([None, 5, None, None, None, None], [None, 5, 5, 5, 5, 5]),
    "full": ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]),
    "zeros": ([4, 0, 8, None, None, 0], [4, 0, 8, 16 / 3, 8 / 3, 0]),
}


def _frame(long, cases):
    return long([(k, "v", 2020 + i, float(x)) for k, (src, _) in cases.items() for i, x in enumerate(src) if x is not None])


def test_gap_filling_holds_last_and_leaves_leading(long):
    got = ta.interpolate_gaps(_frame(long, CASES), first=2020, last=2025, leading=True)
    by = {}
    for s, _, y, v in rows(got):
        by.setdefault(s, {})[y] = v
    for k, (_, want) in CASES.items():
        for i, w in enumerate(want):
            assert by[k][2020 + i] is None if w is None else by[k][2020 + i] == pytest.approx(w)


def test_leading_rows_are_absent_by_default(long):
    got = ta.interpolate_gaps(_frame(long, {"gap": CASES["gap"]}), first=2020, last=2025)
    assert min(r[2] for r in rows(got)) == 2021


def test_zero_as_missing_is_a_switch(long):
    df = long([("a", "v", 2020, 4.0), ("a", "v", 2021, 0.0), ("a", "v", 2022, 8.0)])
    on = [r[3] for r in sorted(rows(ta.interpolate_gaps(df, first=2020, last=2022, zero_missing=True)))]
    off = [r[3] for r in sorted(rows(ta.interpolate_gaps(df, first=2020, last=2022)))]
    assert (on, off) == ([4, 6, 8], [4, 0, 8])


def test_knots_outside_the_slice_do_not_count(long):
    df = long([("a", "v", 2020, 2.0), ("a", "v", 2023, 8.0)])
    assert [r[3] for r in sorted(rows(ta.interpolate_gaps(df, first=2020, last=2022)))] == [2, 2, 2]
    assert rows(ta.interpolated_total(df, first=2020, last=2022))[0][1] == 6


def test_total_of_nothing_is_zero_but_the_key_stays(long):
    df = long([("a", "v", 2060, 2.0), ("b", "v", 2020, 0.0), ("c", "v", 2019, 7.0), ("c", "v", 2021, 1.0)])
    got = dict(rows(ta.interpolated_total(df, first=2020, last=2023, zero_missing=True)))
    assert got == {"a": 0.0, "b": 0.0, "c": 3.0}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=11, max_size=11), min_size=1, max_size=12))
def test_filling_and_total_agree_with_pandas(long, data):
    cells = [(f"s{i}", "v", 2020 + j, float(x)) for i, s in enumerate(data) for j, x in enumerate(s) if x is not None]
    if not cells:
        return
    for zero in (False, True):
        wide = pd.DataFrame(data, columns=range(2020, 2031), dtype=float)
        if zero:
            wide = wide.replace(0, np.nan)
        want = wide.interpolate(axis=1)
        got = {(r[0], r[2]): r[3] for r in rows(ta.interpolate_gaps(long(cells), first=2020, last=2030, zero_missing=zero))}
        for i in range(len(data)):
            for y in range(2020, 2031):
                w = want.loc[i, y]
                assert (f"s{i}", y) not in got if math.isnan(w) else got[(f"s{i}", y)] == pytest.approx(w)
        totals = dict(rows(ta.interpolated_total(long(cells), first=2020, last=2030, zero_missing=zero)))
        for s, t in totals.items():
            assert t == pytest.approx(want.loc[int(s[1:])].sum())


def test_stepped_total_uses_only_the_grid(long):
    df = long([("a", "v", 2020, 1.0), ("a", "v", 2022, 100.0), ("a", "v", 2030, 3.0)])
    assert rows(ta.interpolated_total(df, first=2020, last=2030, step=5)) == [("a", 1 + 2 + 3)]


def test_densify(long):
    df = long([("a", "v", 2021, 5.0), ("b", "v", 2030, 1.0)])
    got = rows(ta.densify_years(df, ("scen_id",), 2020, 2022))
    assert got == [("a", 2020, None), ("a", 2021, 5.0), ("a", 2022, None)] + [("b", y, None) for y in (2020, 2021, 2022)]


def test_densify_refuses_two_rows_for_one_year(long):
    df = long([("a", "v", 2021, 5.0), ("a", "v", 2021, 6.0)])
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        ta.densify_years(df, ("scen_id",), 2020, 2022).collect()


def test_anchor_and_bridge(long):
    df = long([("a", "h", 2020, 7.0), ("a", "h", 2021, 9.0), ("a", "h", 2022, 20.0), ("x", "g", 2020, 4.0),
               ("x", "g", 2021, 100.0), ("x", "g", 2022, 8.0)])
    got = rows(ta.anchor_and_bridge(df, F.col("Variable") == "h", 10.0, first=2020, last=2022))
    assert got == [("a", "h", 2020, 10), ("a", "h", 2021, 15), ("a", "h", 2022, 20), ("x", "g", 2020, 4),
                   ("x", "g", 2021, 6), ("x", "g", 2022, 8)]


def test_result_does_not_depend_on_partitioning(long):
    df = _frame(long, CASES)
    assert rows(ta.interpolate_gaps(df, last=2025)) == rows(ta.interpolate_gaps(df.repartition(7, "value"), last=2025))
