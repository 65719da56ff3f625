"""Exact order statistics by narrowing ranges, at any group size.

A first pass counts the rows of each group in narrow bins, ranges of values whose logarithms lie close together, and
finds from running counts in which bins the wanted ranks lie. A second pass folds the rows of these bins to distinct
values with counts. Every double has a place among all doubles: the number its 64 bits spell when they are ordered by
value. The leading bits of the place narrow each bin to ranges in which the last bits alone differ; the running counts of
what is left give the statistics.

No task holds a group. A window orders the counted bins of one group or the distinct values of one range: 2^23 at most
in each step, whatever the number of rows. Rows of one bin fold to counts before the shuffle, so a value that a third of
all rows share is one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_BITS = 21  # of a place that the last step leaves to single values
BINS_PER_OCTAVE = 1 << 11


def coarse(x: Column) -> Column:
    """A number that never falls as the value grows, from one logarithm: equal within a 2^11th of an octave."""
    size = F.abs(x)
    octave = F.least(F.log2(size), F.lit(1024.0)) + F.lit(1075.0)  # above 0 from the smallest double on
    bin_ = F.floor(octave * BINS_PER_OCTAVE) + 1
    return F.when(x > 0, bin_).when(x < 0, -bin_).otherwise(F.lit(0).cast("long"))


def place(x: Column) -> Column:
    """Where a double stands among all doubles, as a long: the order of values is the order of places.

    The exponent comes from the logarithm and is put right where that was rounded; the mantissa is what is left.
    """
    size = F.abs(x)
    rough = F.floor(F.least(F.greatest(F.log2(F.nullif(size, F.lit(0.0))), F.lit(-1022.0)), F.lit(1023.0)))
    base = F.pow(F.lit(2.0), rough)
    exponent = F.greatest(rough + F.when(size >= base * 2, 1).when(size < base, -1).otherwise(0), F.lit(-1022))
    bits = (exponent + 1022) * F.lit(2**52) + F.floor(size / F.pow(F.lit(2.0), exponent) * F.lit(2.0**52))
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 * 2**52)).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def _among(ranks: Sequence[Column], c: Column) -> Column:
    """Whether one of the ranks falls into a row with ``c`` rows that end at ``_upto``."""
    return reduce(Column.__or__, [(F.col("_upto") > r) & (F.col("_upto") - c <= r) for r in ranks])


def _same(keys: Sequence[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]


def _keys_of(df: DataFrame, keys: Sequence[str], *more: str | Column) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *more)


def values(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Rows ``keys, _x, _c`` that count one each; missing values are left out."""
    x = value.cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_x"), F.lit(1).cast("long").alias("_c"))


def folded(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each distinct value of a group with its count."""
    return rows.groupBy(*keys, "_x").agg(F.sum("_c").alias("_c"))


def order_statistics(rows: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """``keys, _n`` and one column per probability: linear between the two order statistics around (n - 1) * p.

    ``rows``: keys, ``_x`` and ``_c``, how often the value counts.
    """
    position = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ranks = [f(pos) for pos in position.values() for f in (F.floor, F.ceil)]
    c = F.col("_c")

    # the bins of each group that hold a rank
    bins = rows.groupBy(*keys, coarse(F.col("_x")).alias("_bin")).agg(F.sum("_c").alias("_c"))
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("_upto", F.sum("_c").over(so_far)).withColumn("_n", F.sum("_c").over(group))
    hit = _keys_of(bins.where(_among(ranks, c)), keys, F.col("_bin").alias("_hit"), "_n", (F.col("_upto") - c).alias("_below"))
    inside = rows.withColumn("_at", coarse(F.col("_x"))).join(hit, [*_same(keys), F.col("_at").eqNullSafe(F.col("_hit"))])
    own = [*keys, "_n", "_at", "_below"]
    inside = inside.groupBy(*own, "_x").agg(F.sum("_c").alias("_c"))  # read twice, shuffled once

    # the leading bits of their values
    fine = F.shiftright(place(F.col("_x")), LAST_BITS).alias("_fine")
    ranges = inside.groupBy(*own, fine).agg(F.sum("_c").alias("_c"))
    so_far = Window.partitionBy(*own).orderBy("_fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumn("_upto", F.col("_below") + F.sum("_c").over(so_far))
    hit = _keys_of(ranges.where(_among(ranks, c)), keys, F.col("_fine").alias("_hit"), (F.col("_upto") - c).alias("_under"))
    left = inside.withColumn("_fine", fine).join(hit, [*_same(keys), F.col("_fine").eqNullSafe(F.col("_hit"))])

    # single values
    so_far = Window.partitionBy(*keys, "_fine").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.withColumn("_upto", F.col("_under") + F.sum("_c").over(so_far))

    def statistic(rank: Column) -> Column:
        return F.max(F.when(_among([rank], c), F.col("_x")))

    found = left.groupBy(*keys, "_n").agg(
        *[statistic(f(pos)).alias(f"_{side}_{name}") for name, pos in position.items()
          for side, f in (("low", F.floor), ("high", F.ceil))])
    # between two infinite statistics of one sign there is nothing to interpolate
    def between(name: str, pos: Column) -> Column:
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos))).alias(name)

    return found.select(*keys, "_n", *[between(name, pos) for name, pos in position.items()])
