"""Long <-> wide. Long is canonical; wide only at file and report edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import nan_as_missing


def unpivot_years(df: DataFrame, ids: Sequence[str], years: Sequence[str], value: str = "value",
                  keep_missing: bool = False, strip: str = "") -> DataFrame:
    """Year columns -> (year INT, value). ``strip`` removes a name prefix such as ``y``."""
    out = df.unpivot(list(ids), list(years), "year", value)
    year = F.expr(f"cast(substr(year, {len(strip) + 1}) as int)") if strip else F.col("year").cast("int")
    out = out.withColumn("year", year).withColumn(value, nan_as_missing(value))
    return out if keep_missing else out.where(F.col(value).isNotNull())


def stack_rows(df: DataFrame, keys: Sequence[str], items: dict[str, dict], value: str = "value") -> DataFrame:
    """Columns -> rows: ``items`` maps a column to the label columns its rows get.

    Same result as ``unpivot`` with relabelling, but as a generator, which keeps the partitioning of the keys: a
    join or aggregation by the same key afterwards needs no shuffle.
    """
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in labels.items()], F.col(c).alias(value)) for c, labels in items.items()]
    return df.select(*keys, F.inline(F.array(*rows)))


def pivot_years(df: DataFrame, keys: Sequence[str], years: Sequence[int], value: str = "value",
                prefix: str = "y") -> DataFrame:
    """(year, value) -> one column per listed year. One aggregation; no pass to find the years."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col("year") == y, F.col(value))).alias(f"{prefix}{y}") for y in years]
    )


def pivot_variables(df: DataFrame, keys: Sequence[str], variables: dict[str, str], value: str = "value") -> DataFrame:
    """One column per listed variable: ``variables`` maps Variable -> column name."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col("Variable") == v, F.col(value))).alias(n) for v, n in variables.items()]
    )


def pivot_multi_value(df: DataFrame, keys: Sequence[str], variables: dict[str, str],
                      values: Sequence[str]) -> DataFrame:
    """Several value columns at once, named ``<value>_<variable>``."""
    return df.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("Variable") == v, F.col(c))).alias(f"{c}_{n}")
            for c in values
            for v, n in variables.items()
        ]
    )


def transpose(df: DataFrame, label: str, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Swap rows and columns of a small summary: the values of ``label`` named in ``names`` become columns."""
    long = df.unpivot([label], list(columns), "item", "value")
    return long.groupBy("item").agg(*[F.max(F.when(F.col(label) == n, F.col("value"))).alias(n) for n in names])
