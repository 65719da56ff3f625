"""Scenario tables derived from the given star schema.

A scenario is a supplier, so the number of scenarios grows with the data while the rows per scenario stay
the same. Its 30 variables come from the part key, its years 2010-2092 from the shipping month; rows of
line status O snap to the decade, which leaves milestones well reported and the years between gappy.
An older, sparser generation of scenarios comes from orders, one scenario per customer.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import fixed
from pathloom.functions.columns import joined_key
from pathloom.operators.joins import lookup_table, small_side
from pathloom.session import shared_dir
from pathloom.sources.tables import ScenarioDb, ingest

FIRST_YEAR, LAST_YEAR = 2010, 2092

# exact integer sums are scaled by primes, so no derived value lies on a rounding tie
UNIT, OLDER_UNIT, TICK_UNIT = 9999991.0, 99991.0, 97.0

# variable order = slot number
VARIABLES = (
    (fixed.NET_TOTAL, "Mt CO2/yr"), (fixed.NET_ENERGY, "Mt CO2/yr"), (fixed.NET_INDUSTRY, "Mt CO2/yr"),
    (fixed.BECCS, "Mt CO2/yr"), (fixed.DIRECT_AIR, "Mt CO2/yr"), (fixed.WEATHERING, "Mt CO2/yr"),
    (fixed.CCS, "Mt CO2/yr"), (fixed.CCS_FOSSIL, "Mt CO2/yr"), (fixed.CCS_INDUSTRY, "Mt CO2/yr"),
    (fixed.LAND_USE, "Mt CO2/yr"), (fixed.AFFORESTATION, "Mt CO2/yr"),
    (fixed.AFOLU_CO2, "Mt CO2/yr"), (fixed.AFOLU_CH4, "Mt CH4/yr"), (fixed.AFOLU_N2O, "kt N2O/yr"),
    ("Emissions|N2O|Energy", "kt N2O/yr"), ("Emissions|N2O|Industrial Processes", "kt N2O/yr"),
    ("Emissions|N2O|Other", "kt N2O/yr"), ("Emissions|N2O|Waste", "kt N2O/yr"),
    ("Emissions|CH4|Energy", "Mt CH4/yr"), ("Emissions|CH4|Industrial Processes", "Mt CH4/yr"),
    (fixed.BIOENERGY, "EJ/yr"),
    ("Emissions|CH4|Other", "Mt CH4/yr"), ("Emissions|CH4|Waste", "Mt CH4/yr"),
    (fixed.PRIMARY_ENERGY, "EJ/yr"), (fixed.RENEWABLES, "EJ/yr"), (fixed.FINAL_ENERGY, "EJ/yr"),
    ("Emissions|HFC", "kt HFC134a-equiv/yr"), ("Emissions|PFC", "kt CF4-equiv/yr"),
    ("Emissions|SF6", "kt SF6/yr"), ("Emissions|Kyoto Gases", "Mt CO2-equiv/yr"),
)

# older generation: order priority -> variable
OLDER_VARIABLES = (
    ("1-URGENT", fixed.NET_TOTAL), ("2-HIGH", fixed.BECCS), ("3-MEDIUM", fixed.N2O_ENERGY),
    ("4-NOT SPECIFIED", fixed.AFOLU_CO2), ("5-LOW", fixed.AFOLU_CH4),
)

# screening limits in the value range of these tables (the same at every scale factor)
LIMITS = fixed.Limits(
    bioenergy=200.0, afforestation=200.0, total_ccs=3500.0, removals_2020=300.0, land_sector=-10000.0,
    beccs_high=160.0, beccs_medium=120.0, fossil_ccs_high=160.0, fossil_ccs_medium=120.0, land_use=160.0,
)
HISTORY = (("World", fixed.HARMONISE_YEAR, 50.0),)
FOCAL = (("NZE", 250.0, 180.0, 90.0, 20.0), ("CWF", 240.0, 200.0, 120.0, 60.0), ("OECM", 230.0, 150.0, 70.0, 10.0))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scenario_long(spark: SparkSession, sf: str) -> DataFrame:
    """Long table straight from the star schema.

    Line items are summed to cells before any join, so a supplier holding a third of them is folded to at
    most variables x years rows per map task.
    """
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    year = F.lit(2010) + month
    li = read(spark, sf, "lineitem").select(
        "l_suppkey",
        (F.col("l_partkey") % 30).cast("int").alias("slot"),
        F.when(F.col("l_linestatus") == "O", year - (year % 10)).otherwise(year).cast("int").alias("year"),
        # whole cents times whole percents: sums are exact in any order
        (
            F.rint(F.col("l_extendedprice") * 100).cast("bigint")
            * (F.lit(100) - F.rint(F.col("l_discount") * 100)).cast("bigint")
        ).alias("amount"),
    )
    cells = li.groupBy("l_suppkey", "slot", "year").agg((F.sum("amount").cast("double") / UNIT).alias("v"))
    nation = read(spark, sf, "nation").join(
        small_side(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    scen = read(spark, sf, "supplier").join(small_side(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    slots = lookup_table(
        spark, [(i, v, u) for i, (v, u) in enumerate(VARIABLES)], "slot int, Variable string, Unit string"
    )
    removal, v = F.col("slot").isin(3, 4, 5), F.col("v")
    value = (
        F.when(removal & F.col("n_nationkey").isin(0, 7, 14, 21), -v)  # wrong-signed sequestration
        .when(removal & F.col("year").isin(2025, 2050, 2075), F.lit(0.0))  # zero = unreported
        .when(F.col("slot") == 11, -20 * v)
        .otherwise(v)
    )
    return (
        cells.join(scen, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(small_side(slots), "slot")
        .where(~((F.col("slot") == 0) & (F.col("r_name") == "AFRICA")))  # models that do not report the total
        .select(
            joined_key("n_name", "s_name").alias("scen_id"), F.col("n_name").alias("Model"),
            F.col("s_name").alias("Scenario"), F.lit("World").alias("Region"), "Variable", "Unit", "year",
            value.alias("value"),
        )
    )


def scenario_key(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation").join(
        small_side(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    scen = read(spark, sf, "supplier").join(small_side(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    bal = F.col("s_acctbal")
    return scen.select(
        joined_key("n_name", "s_name").alias("scen_id"), F.col("n_name").alias("Model"),
        F.col("s_name").alias("Scenario"),
        F.when(bal >= 3000, "C1").when(bal >= 1000, "C2").otherwise("C3").alias("Category"),
        F.when((bal >= 3000) & F.col("r_name").isin("ASIA", "AFRICA"), "C1a_NZGHGs").alias("Category_subset"),
        F.when(bal < 3000, None)
        .when(F.col("n_nationkey").isin(1, 4, 10), "SP")
        .when(F.col("n_nationkey").isin(2, 5, 13), "LD")
        .when(F.col("n_nationkey").isin(3, 15, 19), "Ren").alias("IMP_marker"),
        F.when(F.col("r_name") == "EUROPE", "ENGAGE").alias("Project_study"),
        F.concat(F.lit("Study of "), "n_name").alias("Literature_reference"),
        F.when(bal >= 6000, 1).otherwise(0).alias("in_list_a"),
        F.when((bal >= 4000) & (bal < 8000), 1).otherwise(0).alias("in_list_b"),
    )


def older_long(spark: SparkSession, sf: str) -> DataFrame:
    """Older generation: ids without a separator, ten-yearly values."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    cells = (
        read(spark, sf, "orders")
        .select(
            "o_custkey", "o_orderpriority", (F.lit(2010) + F.floor(month / 8) * 10).cast("int").alias("year"),
            F.rint(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        )
        .groupBy("o_custkey", "o_orderpriority", "year")
        .agg((F.sum("cents").cast("double") / OLDER_UNIT).alias("v"))
    )
    names = lookup_table(spark, OLDER_VARIABLES, "o_orderpriority string, Variable string")
    cust = read(spark, sf, "customer")
    return (
        cells.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(small_side(names), "o_orderpriority")
        .select(
            joined_key("c_mktsegment", "c_name", sep="").alias("scen_id"), F.col("c_mktsegment").alias("Model"),
            F.col("c_name").alias("Scenario"), "Variable", "year", "v",
        )
        .withColumnRenamed("v", "value")
    )


def older_key(spark: SparkSession, sf: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return read(spark, sf, "customer").select(
        joined_key("c_mktsegment", "c_name", sep="").alias("scen_id"),
        F.col("c_mktsegment").alias("model"), F.col("c_name").alias("scenario"),
        F.when(bal >= 7000, "Below 1.5C").when(bal >= 4000, "1.5C low overshoot").otherwise("Higher").alias("category"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", "in range").otherwise("out of range").alias("kyoto_2010"),
    )


_DBS: dict[str, ScenarioDb] = {}


def _db(spark: SparkSession, sf: str, name: str, long, key) -> ScenarioDb:
    """Ingest once per session and input folder: both tables bucketed by scen_id in the shared folder."""
    tag = json.dumps([spark.sparkContext.applicationId, shared_dir(spark), sf, name])
    if tag not in _DBS:
        _DBS[tag] = ingest(long(spark, sf), key(spark, sf), name)
    return _DBS[tag]


def db(spark: SparkSession, sf: str) -> ScenarioDb:
    return replace(_db(spark, sf, "scen", scenario_long, scenario_key), years=tuple(range(FIRST_YEAR, LAST_YEAR + 1)))


def older_db(spark: SparkSession, sf: str) -> ScenarioDb:
    """The years are those that the table reports."""
    return _db(spark, sf, "older", older_long, older_key)


def focal(spark: SparkSession) -> DataFrame:
    return lookup_table(spark, FOCAL, "Source string, y2020 double, y2030 double, y2040 double, y2050 double")


def history(spark: SparkSession) -> DataFrame:
    return lookup_table(spark, HISTORY, "Region string, year int, value double")


def event_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Another time axis: one trajectory per user and event type, the day of month as its step."""
    return (
        read(spark, sf, "events")
        .select("user_id", "event_type", F.dayofmonth("ts").alias("year"), F.rint(F.col("value") * 100).cast("bigint").alias("c"))
        .groupBy("user_id", "event_type", "year")
        .agg((F.sum("c").cast("double") / TICK_UNIT).alias("value"))
    )


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """Target-tool arguments, one row per customer, with NA markers where a figure is not available."""
    seg = F.col("c_mktsegment")
    orders = (
        read(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.rint(F.col("o_totalprice") * 100).cast("bigint")).alias("s"),
        )
    )
    cust = read(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    na = F.lit("NA")
    return cust.select(
        F.col("c_name").alias("company"),
        F.when(seg == "BUILDING", "buildings_res").when(seg == "FURNITURE", "buildings_serv")
        .when(seg == "MACHINERY", "cement").when(seg == "AUTOMOBILE", "power").otherwise("household").alias("sector"),
        F.lit(2020).alias("base_year"), F.lit(2030).alias("target_year"),
        F.when(F.col("c_acctbal") >= 0, "fixed_market_share").when(F.col("c_acctbal") >= -500, "ty_output")
        .otherwise("other").alias("ty_activity_type"),
        F.coalesce(F.col("n").cast("string"), na).alias("by_activity"),
        F.coalesce(F.col("s").cast("string"), na).alias("by_scope1"),
        F.when(F.col("c_acctbal") < 0, na).otherwise(F.rint(F.col("c_acctbal") * 100).cast("bigint").cast("string")).alias("by_scope2"),
    )
