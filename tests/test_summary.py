import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.student import two_sided_p, two_sided_quantile
from pathloom.operators import selection
from pathloom.operators import summary as sm
from tests.conftest import rows

Q = {"a": 0.25, "b": 0.5, "c": 0.75}


def test_quantiles_are_linear_and_skip_missing(make):
    df = make("g string, value double", [("x", 1.0), ("x", 2.0), ("x", 3.0), ("x", 4.0), ("y", 1.0), ("y", 2.0),
                                         ("y", None), ("y", 10.0), ("z", None), ("y", float("nan"))])
    assert rows(sm.quantiles(df, ("g",), Q)) == [("x", 1.75, 2.5, 3.25), ("y", 1.5, 2.0, 6.0)]
    assert rows(sm.quantiles(df, (), Q, count="n")) == [(1.5, 2.0, 3.5, 7)]
    assert rows(sm.quantiles(df.where("g = 'z'"), (), Q)) == []


def test_places_are_the_order_of_values(spark, make):
    rng = np.random.default_rng(1)
    tiny = 2.2250738585072014e-308
    values = [0.0, -0.0, 5e-324, tiny, np.nextafter(tiny, 0), 1.7976931348623157e308, math.inf,
              *[2.0**k for k in range(-1074, 1024, 11)], *[np.nextafter(2.0**k, 0) for k in range(-1000, 1024, 11)],
              *[np.nextafter(2.0**k, math.inf) for k in range(-1000, 1023, 11)],
              *(rng.uniform(1, 2, 500) * 2.0 ** rng.integers(-1022, 1023, 500))]
    values = [float(v) for v in values] + [-float(v) for v in values]
    got = {r.v: r.k for r in make("v double", [(v,) for v in values]).withColumn("k", selection.place(F.col("v"))).collect()}
    for v, k in got.items():
        bits = int(np.float64(abs(v)).view(np.int64))
        assert k == (-bits if v < 0 else bits), v
    bins = {r.v: r.b for r in make("v double", [(v,) for v in values]).withColumn("b", selection.coarse(F.col("v"))).collect()}
    ordered = [bins[v] for v in sorted(bins)]
    assert ordered == sorted(ordered) and bins[0.0] == 0 and max(map(abs, ordered)) < 2**22 + 2**18


@pytest.mark.parametrize("keys", [("g",), ()])
def test_quantiles_of_large_skewed_groups(spark, keys):
    # one group holds most rows, a third of them one value; others have a single value or ties at a quartile
    n = 90_000
    df = spark.range(n).select(
        F.when(F.col("id") < 70_000, "hot").when(F.col("id") < 89_990, "warm").otherwise("tiny").alias("g"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.sin(F.col("id").cast("double")) * F.col("id")).alias("value"),
    )
    pdf = df.toPandas()
    probs = {"q1": 0.01, "q25": 0.25, "q33": 1 / 3, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    got = {r[:len(keys)]: r[len(keys):] for r in rows(sm.quantiles(df, keys, probs))}
    for g, part in pdf.groupby("g") if keys else [((), pdf)]:
        assert got[(g,) if keys else ()] == pytest.approx(tuple(np.quantile(part.value, list(probs.values()))), abs=1e-9)


def test_no_task_holds_a_large_group(spark):
    """Two million close values of one group: what any task of the later steps reads is a small part of them."""
    n = 2_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("g").alias("g"), (1.0 + F.col("id") / n).alias("value"))
    placed = selection.values(df, ("g",), F.col("value"))
    bins = placed.groupBy(selection.coarse(F.col("_x")).alias("b")).count()
    assert bins.agg(F.max("count")).first()[0] < n / 500
    got = sm.quantiles(df, ("g",), {"m": 0.5, "q": 0.999}).first()
    assert (got.m, got.q) == pytest.approx((1.0 + (n - 1) / 2 / n, 1.0 + 0.999 * (n - 1) / n), rel=1e-12)
    # values that differ in the last bits only
    near = df.withColumn("value", F.lit(1.0) + (F.round((F.col("value") - 1) * n).cast("long") % 1000) * F.lit(2.0**-52))
    assert sm.quantiles(near, ("g",), {"m": 0.5}).first().m == 1 + 499.5 * 2.0**-52


def test_quantiles_of_one_value_of_two_and_without_end(spark, make):
    df = spark.range(30_000).select(F.lit("g").alias("g"), F.when(F.col("id") < 15_000, 1.0).otherwise(2.0).alias("value"))
    assert rows(sm.quantiles(df, ("g",), {"m": 0.5}))[0][1] == 1.5
    assert rows(sm.quantiles(df.withColumn("value", F.lit(7.0)), (), {"m": 0.5}))[0][0] == 7.0
    ends = make("value double", [(v,) for v in (-math.inf, -math.inf, -1.0, 0.0, -0.0, 2.0, math.inf, math.inf)])
    assert rows(sm.quantiles(ends, (), {"a": 0.1, "b": 0.5, "c": 1.0})) == [(-math.inf, 0.0, math.inf)]


def test_null_group_keys_are_a_group(make):
    df = make("g string, value double", [(None, 1.0), (None, 3.0), ("x", 5.0)])
    assert rows(sm.median(df, ("g",))) == [("x", 5.0), (None, 2.0)]


def test_sums_count_nothing_as_zero(long):
    df = long([("a", "v", 2020, 2.0), ("a", "w", 2020, 3.0), ("b", "v", 2040, 1.0)])
    assert rows(sm.sums_at(df, (2020, 2030))) == [("a", 2020, 5), ("a", 2030, 0), ("b", 2020, 0), ("b", 2030, 0)]


def test_change_from_zero_is_missing(make):
    df = make("y2020 double, y2030 double", [(0.0, 5.0), (4.0, 5.0)])
    got = {r.y2020: r.percch_2030 for r in sm.change_columns(df, (2030,)).collect()}
    assert got == {0.0: None, 4.0: 0.25}


def test_boxplot(make):
    df = make("g string, value double", [("x", float(v)) for v in (1, 2, 3, 4, 5, 100, 100)] + [("x", None), ("y", 3.0)])
    box = sm.boxplots(df, ("g",), "value", {"above": F.col("value") > 3})
    r = {r.g: r for r in box.stats.collect()}
    assert (r["x"].q1, r["x"].q2, r["x"].q3, r["x"].whisker_low, r["x"].whisker_high) == (2.5, 4, 52.5, 1, 100)
    assert (r["x"].n_outliers, r["x"].n, r["x"].above, r["y"].n, r["y"].above) == (0, 7, 4 / 7, 1, 0)
    box = sm.boxplots(df.where("value != 100 or value is null").unionByName(make("g string, value double", [("x", 50.0)] * 1)),
                      ("g",), "value")
    assert rows(box.outliers) == [("x", 50.0, 1)]
    assert {r.g: r.n_outliers for r in box.stats.collect()} == {"x": 1, "y": 0}


def test_boxplots_read_their_input_once(spark, tmp_path):
    spark.range(5000).selectExpr("id % 3 as g", "sin(id) * id as value").write.parquet(f"{tmp_path}/x")
    out = sm.boxplots(spark.read.parquet(f"{tmp_path}/x"), ("g",), "value").stats
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_histogram_bins(make):
    df = make("value double", [(-2.0,), (-1.0,), (0.0,), (0.99,), (1.0,), (None,)])
    assert {(r.bin, r.n) for r in sm.histogram(df, "value", -1, 1, 2).collect()} == {(0, 1), (1, 1), (2, 2), (3, 1)}


def student(make, t, df):
    one = make("t double, df double", [(t, df)])
    return one.select(two_sided_p(F.col("t"), F.col("df")).alias("p"), two_sided_quantile(F.col("df")).alias("q")).first()


def summed(t: float, df: float) -> float:
    """Two-sided tail by the midpoint rule over the angle."""
    def area(low):
        a = low + (np.arange(400_000) + 0.5) * (math.pi / 2 - low) / 400_000
        return np.sum(np.cos(a) ** (df - 1)) * (math.pi / 2 - low)

    return area(math.atan(abs(t) / math.sqrt(df))) / area(0.0)


@pytest.mark.parametrize("t, df", [(2.0, 10.0), (0.3, 3.5), (-7.0, 2.0), (4.5, 40.0), (1.1, 900.0), (12.0, 15.5)])
def test_student_tail_is_the_area_under_the_density(make, t, df):
    r = student(make, t, df)
    assert r.p == pytest.approx(summed(t, df), rel=1e-8)
    assert summed(r.q, df) == pytest.approx(0.05, rel=1e-8)


def test_student_at_the_ends(make):
    assert student(make, 0.0, 5.0).p == pytest.approx(1.0)
    one = student(make, 12.706204736174698, 1.0)  # one degree of freedom has a closed form
    assert (one.p, one.q) == (pytest.approx(0.05, rel=1e-10), pytest.approx(math.tan(math.pi / 2 * 0.95), rel=1e-9))
    two = student(make, 3.0, 2.0)
    assert two.p == pytest.approx(1 - 3 / math.sqrt(11), rel=1e-10)
    for df in (1e6, 1e8, 1e10):  # nearly normal, with the first term of the difference
        r = student(make, 1.0, df)
        normal = math.erfc(1 / math.sqrt(2))
        assert r.p == pytest.approx(normal + 2 * (1 + 1) / (4 * df) * math.exp(-0.5) / math.sqrt(2 * math.pi), rel=1e-10)
        z = 1.959963984540054
        assert r.q == pytest.approx(z + (z**3 + z) / (4 * df), rel=1e-10)
    assert student(make, 40.0, 1e10).p == pytest.approx(math.erfc(40 / math.sqrt(2)), rel=1e-4)
    assert student(make, float("inf"), 3.0).p == 0
    assert (student(make, None, 3.0).p, student(make, 1.0, 0.5).p, student(make, 1.0, None).q) == (None, None, None)


def test_welch(make):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 9.0]
    df = make("g string, m double", [("a", x) for x in a] + [("b", x) for x in b])
    r = sm.welch_t_test(df, "g", "a", "b", ("m",)).collect()[0]
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 3
    assert r.t == pytest.approx((np.mean(a) - np.mean(b)) / np.sqrt(va + vb))
    assert r.df == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 2))
    assert r.p == pytest.approx(summed(r.t, r.df), rel=1e-6)
    assert summed((r.high - r.low) / 2 / math.sqrt(va + vb), r.df) == pytest.approx(0.05, rel=1e-6)
    assert (r.low + r.high) / 2 == pytest.approx(np.mean(a) - np.mean(b))
    lone = sm.welch_t_test(df.where("g = 'a'"), "g", "a", "b", ("m",)).collect()[0]
    assert (lone.t, lone.p, lone.low) == (None, None, None)


def test_correlation_uses_complete_pairs(make):
    df = make("x double, y double", [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, None), (5.0, 6.0)])
    r = sm.pearson_cor_test(df, [("x", "y")]).collect()[0]
    want = np.corrcoef([1, 2, 3, 5], [2, 1, 5, 6])[0, 1]
    assert (r.r, r.n, r.df) == (pytest.approx(want), 4, 2)
    assert r.t == pytest.approx(want * np.sqrt(2 / (1 - want**2)))
    assert r.p == pytest.approx(summed(r.t, 2), rel=1e-6)
    assert (r.low, r.high) == pytest.approx((math.tanh(math.atanh(want) - 1.959963984540054),
                                             math.tanh(math.atanh(want) + 1.959963984540054)))
    same = sm.pearson_cor_test(df.withColumn("y", F.col("x")), [("x", "y")]).collect()[0]
    assert same.r == pytest.approx(1.0) and (same.low is None or same.low > 0.99)
