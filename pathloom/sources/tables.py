"""Reading wide year-column files and scenario metadata, and the ingest into the canonical tables."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.columns import joined_key, nan_as_missing
from pathloom.operators.joins import measured_bytes
from pathloom.sources.staging import Staging

#: Quotes are doubled inside quoted text, which may hold line breaks, as common CSV readers and writers have it.
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"'}
#: Cells of a year column that say that nothing is reported.
MISSING_CELLS = ("", "NA", "N/A", "n/a", "#N/A", "#NA", "NaN", "nan", "NULL", "null", "None")
HEADERS_AT_ONCE = 64


def discover_year_columns(columns: Iterable[str], pattern: str = r"2\d{3}") -> list[str]:
    """Year columns by name. The default skips years before 2000; ``\\d+`` takes every numeric name."""
    return [c for c in columns if re.fullmatch(pattern, c)]


def _as_path(listed: str) -> str:
    """A path to read from the name that ``inputFiles`` lists, in which signs are encoded; none of them is a wildcard."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(listed))


def first_line(spark: SparkSession, file: str) -> DataFrame:
    """The first line of a file as ``value``.

    A text scan splits a large file, and the limit then takes whichever split's line comes first over the network. A
    multi-line scan reads a file from its start in one task, which ends after that line: no sign parts or quotes here.
    """
    whole = spark.read.schema("value string").options(sep="\uffff", quote="", multiLine=True, header=False)
    return whole.csv(file).limit(1)


def headers(spark: SparkSession, path: str | Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The column names of each file under ``path``. Reads the first line of each, many files in one job."""
    files = sorted(map(_as_path, spark.read.text(path).inputFiles()))
    out = {}
    for i in range(0, len(files), HEADERS_AT_ONCE):
        some = files[i:i + HEADERS_AT_ONCE]
        firsts = [first_line(spark, f).select(F.lit(f).alias("file"), "value") for f in some]
        for row in reduce(DataFrame.unionAll, firsts).collect():
            names = tuple(next(csv.reader([row["value"].removeprefix("\ufeff")])))
            if len(set(names)) < len(names):
                raise ValueError(f"a column name stands twice in the header of {row['file']}")
            out[row["file"]] = names
    return out


def _rejected(cell: Column) -> Column:
    """Whether a cell is neither a number nor a sign that nothing is reported."""
    return cell.try_cast("double").isNull() & ~F.coalesce(F.trim(cell), F.lit("")).isin(*MISSING_CELLS)


def _number(cell: Column, column: Column) -> Column:
    """The number in a cell, missing where nothing is reported; anything else fails the job."""
    said = F.concat(F.lit("no number in column "), column, F.lit(": "), cell)
    return nan_as_missing(F.coalesce(cell.try_cast("double"), F.when(_rejected(cell), F.raise_error(said).cast("double"))))


def _text_scan(spark: SparkSession, path: str | Sequence[str], pattern: str, multiline: bool) -> DataFrame:
    """All files under ``path`` with text in every column, the year columns last and in order."""
    groups = defaultdict(list)
    for file, names in headers(spark, path).items():
        groups[names].append(file)
    if not groups:
        raise ValueError(f"no files with a header under {path}")

    def scan(names: tuple[str, ...], files: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        return spark.read.schema(schema).options(
            **CSV_DIALECT, multiLine=multiline, enforceSchema=False, mode="FAILFAST").csv(files)

    frames = [scan(names, files) for names, files in groups.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    years = discover_year_columns(every.columns, pattern)
    return every.select(*[F.col(f"`{c}`") for c in every.columns if c not in years],
                        *[F.col(f"`{c}`") for c in sorted(years, key=int)])


def scan_wide_csv(spark: SparkSession, path: str | Sequence[str], pattern: str = r"2\d{3}", multiline: bool = True,
                  rejects: str | None = None) -> DataFrame:
    """Wide CSV files: year columns double, everything else text.

    Files are grouped by their header and each group is scanned with its own columns, then brought together by
    name, so files may order their columns differently or lack some. Quoted text may hold line breaks; a file is then
    read by one task, ``multiline=False`` splits large files that are known to have none. Rows with too many or too
    few cells fail the scan.

    A cell of a year column that is no number and does not stand for a missing value fails the scan, unless
    ``rejects`` names a further column: there the cell is missing and that column lists (year, text) of such cells.
    """
    rows = _text_scan(spark, path, pattern, multiline)
    years = discover_year_columns(rows.columns, pattern)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in years]
    if rejects is None:
        return rows.select(*kept, *[_number(F.col(f"`{c}`"), F.lit(c)).alias(c) for c in years])
    bad = [F.when(_rejected(F.col(f"`{c}`")), F.struct(F.lit(c).alias("year"), F.col(f"`{c}`").alias("text")))
           for c in years]
    listed = (F.array_compact(F.array(*bad)) if bad else F.array()).cast("array<struct<year:string,text:string>>")
    numbers = [nan_as_missing(F.col(f"`{c}`").try_cast("double")).alias(c) for c in years]
    return rows.select(*kept, *numbers, listed.alias(rejects))


def scan_metadata(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """One sheet of scenario metadata, staged as CSV or Parquet."""
    if fmt == "csv":
        return spark.read.options(**CSV_DIALECT, multiLine=True, mode="FAILFAST").csv(path)
    return spark.read.format(fmt).load(path)


@dataclass(frozen=True)
class ScenarioDb:
    """Canonical pair: the long table and one metadata row per scenario.

    ``long``: scen_id, Model, Scenario, Region, Variable, Unit, year, value of one region, with at most one row per
    (scen_id, Variable, year). A missing value is an absent row. ``years``: the years of the table, in order.
    """

    long: DataFrame
    key: DataFrame
    years: tuple[int, ...]
    scenarios: int | None = None
    buckets: int | None = None  # how both tables are bucketed by scen_id, for intermediates joined to them

    @property
    def first_year(self) -> int:
        return self.years[0]

    @property
    def last_year(self) -> int:
        return self.years[-1]


ROW_KEY = ("scen_id", "Region", "Variable", "year")
BUCKET_BYTES = 10 << 20  # of measured input a bucket takes; its rows fill some 30 times that in a sort


def bucket_count(spark: SparkSession, size: int) -> int:
    """Buckets that keep one bucket in a task's memory, and at least one per core."""
    return min(100_000, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))


def unique_rows(df: DataFrame, keys: Sequence[str], partitioned_by: str, n: int) -> DataFrame:
    """``df`` in ``n`` hash partitions of a column that is one of the keys; a key that comes twice fails the job.

    Rows of one key lie in one partition and follow each other in it, so the check needs no exchange of its own and
    compares each row with the one before.
    """
    rest = [k for k in keys if k != partitioned_by]
    before = Window.partitionBy(partitioned_by).orderBy(*(sorted(rest) or [partitioned_by]))
    text = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    twice = F.raise_error(F.concat(F.lit("two rows for "), text))
    last = F.lag(F.struct(F.lit(1).alias("_any"), *rest)).over(before)
    again = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_last.{k}")) for k in rest], F.col("_last").isNotNull())
    checked = df.repartition(n, partitioned_by).withColumn("_last", last)
    return checked.where(F.when(again, twice.cast("boolean")).otherwise(True)).drop("_last")


def ingest(long: DataFrame, key: DataFrame, name: str = "scen", years: Sequence[int] | None = None,
           region: str | None = None, staging: Staging | None = None) -> ScenarioDb:
    """Write both tables bucketed by ``scen_id``: one exchange each.

    The row key is (scen_id, Region, Variable, year); two rows for one key fail the job. Scenario operators work on
    one region: it is named by ``region`` or the only one there is, anything else is refused. A table without a
    Region column is of one region. ``years`` are the year columns of a wide source; without them the years are
    those reported.
    """
    spark = long.sparkSession
    own = staging or Staging.of(spark)
    keys = [k for k in ROW_KEY if k in long.columns]
    if region is not None:
        long = long.where(F.col("Region") == region)
    n = bucket_count(spark, measured_bytes(long))
    rows = own.written(unique_rows(long, keys, "scen_id", n), f"{name}_long", "scen_id", ("Variable", "scen_id", "year"), n,
                       dealt=True)
    metadata = own.written(unique_rows(key, ["scen_id"], "scen_id", n), f"{name}_key", "scen_id", ("scen_id",), n,
                           dealt=True)
    wanted = [F.collect_set("year").alias("years")] + [F.collect_set("Region").alias("regions")] * ("Region" in keys)
    found = rows.agg(*wanted).first()
    if "Region" in keys and len(found["regions"]) > 1:
        raise ValueError(f"rows of several regions, name one: {', '.join(sorted(found['regions']))}")
    return ScenarioDb(rows, metadata, tuple(sorted(int(y) for y in years or found["years"])), metadata.count(), n)


def read_scenario_db(spark: SparkSession, data_path: str | Sequence[str], meta_path: str, meta_fmt: str = "csv",
                     sep: str = " ", region: str | None = None, multiline: bool = True,
                     staging: Staging | None = None) -> ScenarioDb:
    """Wide files and their metadata, read once and ingested."""
    wide = _text_scan(spark, data_path, r"2\d{3}", multiline)
    years = discover_year_columns(wide.columns)
    cells = wide.unpivot([c for c in wide.columns if c not in years], years, "year", "cell")
    long = cells.withColumns({"value": _number(F.col("cell"), F.col("year")), "year": F.col("year").cast("int"),
                              "scen_id": joined_key("Model", "Scenario", sep=sep)})
    long = long.drop("cell").where(F.col("value").isNotNull())
    key = scan_metadata(spark, meta_path, meta_fmt).withColumn("scen_id", joined_key("Model", "Scenario", sep=sep))
    return ingest(long, key, "read", [int(y) for y in years], region, staging)


def duplicate_rows(df: DataFrame, keys: Sequence[str] = ("scen_id", "Variable", "year")) -> DataFrame:
    """Keys that break the one-row-per-key contract, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header row, no row index; one file per partition."""
    df.write.mode(mode).options(**CSV_DIALECT).csv(path)
    return path
