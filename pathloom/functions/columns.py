"""Scalar column expressions (all stay inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions import fixed


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_key(*parts: str | Column, sep: str = " ") -> Column:
    """Composite label; missing if any part is missing."""
    pieces = []
    for i, part in enumerate(parts):
        if i and sep:
            pieces.append(F.lit(sep))
        pieces.append(col(part))
    return F.concat(*pieces)


def nan_as_missing(c: str | Column) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def zero_as_missing(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def number_or_missing(c: str | Column, sentinel: str = "NA") -> Column:
    """Text holding a number or a not-available marker -> double."""
    return F.nullif(col(c), F.lit(sentinel)).try_cast("double")


def positive_where(condition: Column, c: str | Column) -> Column:
    """Undo wrong signs on the rows where the quantity cannot be negative."""
    return F.when(condition, F.abs(col(c))).otherwise(col(c))


def scaled(c: str | Column, factor: float) -> Column:
    return col(c) * F.lit(float(factor))


def relative_change(base: str | Column, later: str | Column) -> Column:
    return (col(later) - col(base)) / F.nullif(col(base), F.lit(0.0))


def share_of(part: str | Column, whole: str | Column) -> Column:
    return col(part) / F.nullif(col(whole), F.lit(0.0))


def apply_change(anchor: float, change: str | Column) -> Column:
    """Anchor moved by a relative change."""
    return F.lit(float(anchor)) + F.lit(float(anchor)) * col(change)


def co2e_factor(gas: str, vintage: str = "AR6") -> float:
    """Reported unit of one gas -> Mt CO2e."""
    return fixed.WARMING_FACTORS[(vintage, gas)] * fixed.GAS_UNIT_TO_MT[gas]


def co2e(c: str | Column, gas: str, vintage: str = "AR6") -> Column:
    return scaled(c, co2e_factor(gas, vintage))


def land_sector_co2e(variable: str | Column, value: str | Column, vintage: str = "AR5",
                     convert: bool = True) -> Column:
    """Weight of each land-sector gas row in CO2e; NULL for other variables.

    ``convert=False`` adds the gases in their own units.
    """
    v = col(variable)
    ch4 = co2e_factor("CH4", vintage) if convert else 1.0
    n2o = co2e_factor("N2O", vintage) if convert else 1.0
    return (
        F.when(v == fixed.AFOLU_CO2, col(value))
        .when(v == fixed.AFOLU_CH4, scaled(value, ch4))
        .when(v == fixed.AFOLU_N2O, scaled(value, n2o))
    )


def any_true(condition: Column) -> Column:
    """Aggregate: did the condition hold on any row (missing counts as no)."""
    return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))


def sum_or_zero(c: str | Column) -> Column:
    """Aggregate: sum where a group without values is 0, not missing."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def value_when(condition: Column, c: str | Column = "value") -> Column:
    """Aggregate: the one value on the rows where the condition holds."""
    return F.max(F.when(condition, col(c)))
