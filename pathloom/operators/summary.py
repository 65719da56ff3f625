"""Grouped summaries: sums, exact quantiles at any group size, distribution and test statistics."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import col, relative_change, sum_or_zero
from pathloom.functions.student import normal_quantile, two_sided_p, two_sided_quantile
from pathloom.operators.reshape import stack_rows
from pathloom.operators.selection import folded, order_statistics, values

ACCURACY = 10_000  # rank error of the opt-in sketch is rows/ACCURACY


def sum_variables(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("scen_id", "year"),
                  value: str = "value", out: str = "value") -> DataFrame:
    """Sum a list of variables per scenario and year (partial sums before the shuffle)."""
    return df.where(F.col("Variable").isin(list(variables))).groupBy(*keys).agg(sum_or_zero(value).alias(out))


def sums_at(df: DataFrame, years: Sequence[int], keys: Sequence[str] = ("scen_id",), value: str = "value") -> DataFrame:
    """Sum per key at each listed year, 0 where the key reports nothing that year: long (keys, year, value).

    The key set is every key in ``df``, whatever years it reports. One aggregation makes the listed years as
    columns; no year grid is joined.
    """
    names = [f"_{y}" for y in years]
    wide = df.groupBy(*keys).agg(
        *[sum_or_zero(F.when(F.col("year") == y, F.col(value))).alias(n) for y, n in zip(years, names)]
    )
    return stack_rows(wide, keys, {n: {"year": y} for y, n in zip(years, names)})


def quantiles(df: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str = "value",
              count: str | None = None) -> DataFrame:
    """Exact quantiles, linear between order statistics, missing values skipped: (keys, one column per prob).

    ``count`` names a further column with the number of values in the group. Groups of any number and size are
    treated alike, see ``selection``.
    """
    got = order_statistics(values(df, keys, col(value)), keys, probs)
    return got.select(*keys, *probs, *([F.col("_n").alias(count)] if count else []))


def quantile_rows(df: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str = "value",
                  label: str = "perc") -> DataFrame:
    """As ``quantiles`` but one row per probability, labelled."""
    q = quantiles(df, keys, probs, value)
    return q.unpivot(list(keys), list(probs), label, "value")


def median(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "value",
           count: str | None = None) -> DataFrame:
    return quantiles(df, keys, {out: 0.5}, value, count)


def approx_quantiles(df: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str = "value",
                     accuracy: int = ACCURACY) -> DataFrame:
    """Opt-in one-pass quantiles with a rank error of 1/accuracy (no interpolation)."""
    ps = list(probs.values())
    q = df.groupBy(*keys).agg(F.percentile_approx(value, ps, accuracy).alias("_a"))
    return q.select(*keys, *[F.col("_a")[i].alias(n) for i, n in enumerate(probs)])


def interquartile_band(df: DataFrame, keys: Sequence[str], value: str = "value", low: str = "c1_25",
                       high: str = "c1_75") -> DataFrame:
    return quantiles(df, keys, {low: 0.25, high: 0.75}, value)


def add_total(df: DataFrame, label: str, total: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each row (unique by ``label`` and ``keys``) and a row with their sum, from one pass over the input.

    Every row also counts under the total's label, so the input is not evaluated a second time.
    """
    both = df.withColumn(label, F.explode(F.array(F.col(label), F.lit(total))))
    return both.groupBy(label, *keys).agg(*[F.sum(v).alias(v) for v in values])


def change_columns(df: DataFrame, years: Sequence[int], base: int = 2020, prefix: str = "y",
                   out: str = "percch_") -> DataFrame:
    """Relative change of milestone columns against the base year."""
    return df.withColumns({f"{out}{y}": relative_change(f"{prefix}{base}", f"{prefix}{y}") for y in years})


class Boxplots(NamedTuple):
    stats: DataFrame     # keys, q1, q2, q3, whisker_low, whisker_high, n_outliers, n and the shares asked for
    outliers: DataFrame  # keys, value, n: the distinct values outside the fences


def boxplots(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, Column] | None = None) -> Boxplots:
    """Quartiles, whiskers at the last value within 1.5 IQR and what lies beyond them, per group.

    ``shares`` adds the share of the group's non-missing rows for which a condition on the keys and the value
    holds. The input is read once: everything comes from its distinct values with their counts.
    """
    rows = folded(values(df, keys, col(value)), keys)
    q = order_statistics(rows, keys, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    fences = q.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "q1", "q2", "q3",
                      (F.col("q1") - fence).alias("_lo"), (F.col("q3") + fence).alias("_hi"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    x, c = F.col(value), F.col("_c")
    # the fold is keyed by the value too, so a group's rows are spread; AQE splits a large group's side of the join
    fenced = rows.withColumnRenamed("_x", value).join(fences, on)
    ok = x.between(F.col("_lo"), F.col("_hi"))
    stats = fenced.groupBy(*keys, "q1", "q2", "q3").agg(
        F.min(F.when(ok, x)).alias("whisker_low"), F.max(F.when(ok, x)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~ok, c)), F.lit(0)).alias("n_outliers"), F.sum(c).alias("n"),
        *[(F.sum(F.when(held, c).otherwise(0)) / F.sum(c)).alias(n) for n, held in (shares or {}).items()],
    )
    return Boxplots(stats, fenced.where(~ok).select(*keys, value, c.alias("n")))


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, Column] | None = None) -> DataFrame:
    return boxplots(df, keys, value, shares).stats


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per equal bin [low + i*w, low + (i+1)*w); bin 0 and bins+1 hold what lies outside."""
    b = F.width_bucket(col(value), F.lit(float(low)), F.lit(float(high)), F.lit(int(bins)))
    return (
        df.where(col(value).isNotNull())
        .groupBy(*keys, b.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_from", F.lit(float(low)) + (F.col("bin") - 1) * F.lit((high - low) / bins))
    )


def welch_t_test(df: DataFrame, group: str, a: str, b: str, values: Sequence[str], level: float = 0.95) -> DataFrame:
    """Two-group mean comparison with unequal variances, one row per tested column, from one aggregation.

    t, degrees of freedom, two-sided p and the interval of the difference of means at ``level``; missing where a group
    has fewer than two values or nothing varies.
    """
    aggs = []
    for i, v in enumerate(values):
        for tag, g in (("a", a), ("b", b)):
            x = F.when(F.col(group) == g, F.col(v))
            aggs += [F.avg(x).alias(f"_m{tag}{i}"), F.var_samp(x).alias(f"_v{tag}{i}"), F.count(x).alias(f"_n{tag}{i}")]
    one = df.agg(*aggs)
    rows = one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("metric"),
                        *[F.col(f"_{s}{t}{i}").alias(f"{n}_{t}") for t in "ab"
                          for s, n in (("m", "mean"), ("v", "var"), ("n", "n"))],
                    )
                    for i, v in enumerate(values)
                ]
            )
        ).alias("r")
    ).select("r.*")
    sa, sb = F.col("var_a") / F.nullif("n_a", F.lit(0)), F.col("var_b") / F.nullif("n_b", F.lit(0))
    spread = F.nullif(sa + sb, F.lit(0.0))
    df_ = spread * spread / (
        sa * sa / F.nullif(F.col("n_a") - 1, F.lit(0)) + sb * sb / F.nullif(F.col("n_b") - 1, F.lit(0))
    )
    gap = F.col("mean_a") - F.col("mean_b")
    out = rows.select("metric", "mean_a", "mean_b", "n_a", "n_b", gap.alias("_gap"), F.sqrt(spread).alias("_error"),
                      df_.alias("df"))
    out = out.withColumns({
        "t": F.col("_gap") / F.col("_error"), "_reach": two_sided_quantile(F.col("df"), level) * F.col("_error")})
    return out.select(
        "metric", "mean_a", "mean_b", "n_a", "n_b", "t", "df", two_sided_p(F.col("t"), F.col("df")).alias("p"),
        (F.col("_gap") - F.col("_reach")).alias("low"), (F.col("_gap") + F.col("_reach")).alias("high"))


def pearson_cor_test(df: DataFrame, pairs: Sequence[tuple[str, str]], level: float = 0.95) -> DataFrame:
    """Correlation, t, degrees of freedom and two-sided p on pairwise complete rows; all pairs in one aggregation.

    The interval at ``level`` is that of Fisher's z; it needs four rows and a correlation below 1.
    """
    aggs = []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        aggs += [F.corr(F.when(both, F.col(x)), F.when(both, F.col(y))).alias(f"_r{i}"), F.count_if(both).alias(f"_n{i}")]
    rows = df.agg(*aggs).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"_r{i}").alias("r"),
                             F.col(f"_n{i}").alias("n"))
                    for i, (x, y) in enumerate(pairs)
                ]
            )
        ).alias("p")
    ).select("p.*")
    r, n = F.col("r"), F.col("n")
    out = rows.withColumns({
        "df": n - 2, "t": r * F.sqrt((n - 2) / F.nullif((1 - r) * (1 + r), F.lit(0.0))),
        "_z": F.when((n > 3) & (F.abs(r) < 1), F.atanh(r)), "_reach": normal_quantile(level) / F.sqrt(n - 3),
    })
    return out.select(
        "x", "y", "r", "n", "df", "t", two_sided_p(F.col("t"), F.col("df")).alias("p"),
        F.tanh(F.col("_z") - F.col("_reach")).alias("low"), F.tanh(F.col("_z") + F.col("_reach")).alias("high"))


def scatter_vs_identity(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """How a pair of variables lies against y = x per group."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(both).groupBy(*keys).agg(
        F.avg(F.col(y) - F.col(x)).alias("mean_gap"),
        F.count_if(F.col(y) > F.col(x)).alias("n_above"),
        F.count(F.lit(1)).alias("n"),
    )
