"""Id sets, cohorts and alignment.

Id sets grow with the data, so nothing here hints a broadcast on them: on a table bucketed by the id these
joins run without a shuffle, otherwise the adaptive planner picks by measured size. ``small_side`` hints one where
the measured size of what a table is read from allows it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of what a plan reads: the sizes that its leaves report, which for files are those on disk."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def small_side(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a table that is read from few bytes; otherwise the planner decides."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def lookup_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """Small frame from constants: a local relation in the plan, of known size, that needs no job."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows))
    table = pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(fields, columns)})
    return spark.createDataFrame(table)


def in_ids(df: DataFrame, ids: DataFrame, on: str = "scen_id") -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def not_in_ids(df: DataFrame, ids: DataFrame, on: str = "scen_id") -> DataFrame:
    return df.join(ids.select(on), on, "left_anti")


def distinct_ids(df: DataFrame, on: str = "scen_id") -> DataFrame:
    return df.select(on).distinct()


def union_ids(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def intersect_ids(a: DataFrame, b: DataFrame, on: str = "scen_id") -> DataFrame:
    return in_ids(distinct_ids(a, on), b, on)


def difference_ids(a: DataFrame, b: DataFrame, on: str = "scen_id") -> DataFrame:
    return not_in_ids(distinct_ids(a, on), b, on)


def flag_members(df: DataFrame, ids: DataFrame, name: str = "filtered", on: str = "scen_id") -> DataFrame:
    """0/1 membership column."""
    marked = ids.select(on).distinct().withColumn("_in", F.lit(1))
    return df.join(marked, on, "left").withColumn(name, F.coalesce("_in", F.lit(0))).drop("_in")


def align(*frames: DataFrame, on: str = "scen_id") -> DataFrame:
    """Full outer alignment of per-key metrics; missing where a frame lacks the key."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), frames)


def cohort_table(members: DataFrame, cohorts: dict[str | int, Column], on: str = "scen_id",
                 name: str = "cohort") -> DataFrame:
    """One row per scenario with the array of cohorts whose condition holds there."""
    # a condition that is missing counts as not a member
    tags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in cohorts.items()]))
    return members.select(on, tags.alias(name))


def by_cohort(df: DataFrame, members: DataFrame, on: str = "scen_id", name: str = "cohort") -> DataFrame:
    """Repeat each row for every cohort its scenario is in; the rows multiply after the join, not in it."""
    return df.join(members.select(on, F.col(name).alias("_cohorts")), on).withColumn(
        name, F.explode("_cohorts")
    ).drop("_cohorts")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def recode(df: DataFrame, column: str, levels: Sequence[tuple[str, str]], label: str, order: str) -> DataFrame:
    """Map codes to labels with a defined order; other codes become missing."""
    spark = df.sparkSession
    table = lookup_table(spark, [(c, t, i) for i, (c, t) in enumerate(levels)],
                         f"{column} string, {label} string, {order} int")
    return df.join(small_side(table), column, "left")
