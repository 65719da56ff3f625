"""Near-term target records: domain checks on the arguments and stacking of the methods' records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import fixed
from pathloom.functions.columns import number_or_missing
from pathloom.operators.joins import lookup_table, small_side, union_all

DOMAINS = {"sector": fixed.TARGET_SECTORS, "ty_activity_type": fixed.TARGET_ACTIVITY_TYPES}


def domain_table(spark: SparkSession, domains: dict[str, Iterable[str]] = DOMAINS) -> DataFrame:
    """Allowed values as rows (domain, allowed)."""
    return lookup_table(spark, [(c, v) for c, values in domains.items() for v in values], "domain string, allowed string")


def domain_check(df: DataFrame, allowed: DataFrame, columns: Iterable[str],
                 observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns all lie in their domain, violations with the offending columns listed).

    ``allowed``: rows (domain, allowed), the domain being the column's name; a column without rows allows nothing, a
    missing value lies in no domain. ``observation`` counts the rows and the violations of each domain while an action
    runs over either result.
    """
    columns = list(columns)
    known = allowed.where(F.col("allowed").isNotNull()).select("domain", "allowed").distinct()
    tagged = df
    for i, c in enumerate(columns):
        own = known.where(F.col("domain") == c).select(F.col("allowed").alias(f"_allowed{i}"))
        tagged = tagged.join(small_side(own), F.col(c).cast("string") == F.col(f"_allowed{i}"), "left")
    outside = {c: F.col(f"_allowed{i}").isNull() for i, c in enumerate(columns)}
    if observation is not None:
        tagged = tagged.observe(observation, F.count(F.lit(1)).alias("rows"),
                                *[F.count_if(o).alias(f"outside_{c}") for c, o in outside.items()])
    bad = F.array_compact(F.array(*[F.when(o, F.lit(c)) for c, o in outside.items()]))
    tagged = tagged.withColumn("violations", F.concat_ws(",", bad)).select(*df.columns, "violations")
    return tagged.where(F.col("violations") == "").drop("violations"), tagged.where(F.col("violations") != "")


def numeric_arguments(df: DataFrame, columns: list[str], sentinel: str = "NA") -> DataFrame:
    return df.withColumns({c: number_or_missing(c, sentinel) for c in columns})


def target_record(args: DataFrame, method: str, ty_scope1: Column, ty_scope2: Column, key: str = "company") -> DataFrame:
    """One method's record: its two target values (given by the caller), the target year and the method."""
    if method not in fixed.TARGET_METHODS:
        raise ValueError(f"method must be one of {fixed.TARGET_METHODS}")
    return args.select(
        key, ty_scope1.alias("ty_scope1"), ty_scope2.alias("ty_scope2"), "target_year", F.lit(method).alias("method")
    )


def target_records_union(*records: DataFrame) -> DataFrame:
    return union_all(*records)
