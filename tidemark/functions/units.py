"""Units are brought to base units."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0
CO2 = 12e-6 * DAY

#: Base unit -> {unit: factor}, in lower case; value in the base unit = value * factor.
FACTORS: dict[str, dict[str, float]] = {
    "gc m-2 day-1": {
        "gc m-2 s-1": DAY, "g c m-2 s-1": DAY, "g c m-2 day-1": 1.0, "kg c m-2 s-1": 1000 * DAY, "kgc m-2 s-1": 1000 * DAY, "g m-2 s-1": DAY, "mol m-2 s-1": DAY * 12.01,
        "mumolco2 m-2 s-1": CO2, "umol/m2/s": CO2, "umol m-2 s-1": CO2, "umol m^-2 s^-1": CO2, "umolco2 m-2 s-1": CO2, "umol co2 m-2 s-1": CO2, "µmol/m2/s": CO2, "μmol/m2/s": CO2,
    },
    "mm": {"kg m-2": 1.0, "kg/m2": 1.0, "kg m**-2": 1.0, "cm of equivalent water thickness": 10.0, "cm of water": 10.0, "cm water equivalent": 10.0},
    "mm day-1": {
        "kg m-2 s-1": DAY, "kg/m2/s": DAY, "mm s-1": DAY, "mm h2o/s": DAY, "mm h2o s-1": DAY, "mm hr-1": 24.0, "mm h-1": 24.0, "mm hour-1": 24.0,
        "w m-2 heat": DAY / 2.5e6, "mm 3hour-1": 8.0, "mm 3h-1": 8.0, "m hr-1": 24000.0, "m day-1": 1000.0, "m d-1": 1000.0,
    },
    "w m-2": {"w/m2": 1.0, "watt/m2": 1.0, "watt m-2": 1.0, "w m**-2": 1.0, "mj m-2 day-1": 11.574074074074074, "mj m-2 d-1": 11.574074074074074},
    "unitless": {
        "percent": 0.01, "percentage": 0.01, "%": 0.01, "g kg-1": 0.001, "kg kg-1": 1.0, "kg/kg": 1.0, "fraction": 1.0, "m3 m-3": 1.0, "m2 m-2": 1.0, "g g-1": 1.0, "1": 1.0, "0": 1.0, "-": 1.0, "none": 1.0,
    },
    "k": {"c": 1.0, "degc": 1.0, "degreec": 1.0, "degree c": 1.0, "degree_celsius": 1.0, "celsius": 1.0, "kelvin": 1.0, "f": 5 / 9, "degf": 5 / 9, "degreef": 5 / 9, "degree f": 5 / 9, "fahrenheit": 5 / 9},
    "m3 s-1": {"m3 day-1": 1 / DAY, "m3 d-1": 1 / DAY, "l s-1": 0.001},
    "mcm": {"m3": 1e-6, "km3": 1000.0, "million cubic meters": 1.0},
    "mm year-1": {"m year-1": 1000.0, "cm year-1": 10.0},
    "m": {"cm": 0.01},
    "pa": {"hpa": 100.0, "mbar": 100.0, "mb": 100.0},
    "km2": {"m2": 1e-6},
    "m s-1": {"km h-1": 1 / 3.6, "m s**-1": 1.0},
    "t ha-1": {"kg ha-1": 0.001},
    "kg c m-2": {"g c m-2": 0.001},
    "kgc m-2": {"gc m-2": 0.001},
}
#: What is added after the factor.
OFFSETS = {u: 273.15 for u in ("c", "degc", "degreec", "degree c", "degree_celsius", "celsius")} | {u: 273.15 - 32 * 5 / 9 for u in ("f", "degf", "degreef", "degree f", "fahrenheit")}
#: Units per month, whose factor is the number of days in the month, and the factor without a date.
PER_MONTH, MEAN_MONTH, MEAN_YEAR = ("mm mon-1", "mm month-1"), 30.4375, 365.25


@functools.cache
def table() -> dict[str, tuple[str, float, float]]:
    """unit -> (base, factor, offset). A base unit is itself; the first of two meanings holds."""
    out = {base: (base, 1.0, 0.0) for base in FACTORS}
    for base, units in FACTORS.items():
        for unit, factor in units.items():
            out.setdefault(unit, (base, factor, OFFSETS.get(unit, 0.0)))
    return out


def key(unit: Column) -> Column:
    return F.lower(F.trim(unit))


def _lookup(unit: Column, part: int) -> Column:
    """One constant map, found by key: no join and no chain of conditions."""
    return F.create_map(*(x for u, v in table().items() for x in (F.lit(u), F.lit(v[part]))))[key(unit)]


def base_unit(unit: Column) -> Column:
    """The base unit; an unknown unit stays as it is."""
    return F.when(key(unit).isin(*PER_MONTH), "mm day-1").otherwise(F.coalesce(_lookup(unit, 0), unit))


def to_base(value: Column, unit: Column, time: Column | None = None) -> Column:
    """The value in its base unit; of an unknown unit as it is. Months count their own days if there is a time."""
    days = F.lit(MEAN_MONTH) if time is None else F.day(F.last_day(time)).cast("double")
    return F.when(key(unit).isin(*PER_MONTH), value / days).otherwise(value * F.coalesce(_lookup(unit, 1), F.lit(1.0)) + F.coalesce(_lookup(unit, 2), F.lit(0.0)))


def per_day_to_per_year(value: Column, time: Column | None = None) -> Column:
    """mm/day as mm/year: times 365 or 366, or 365.25 without a time."""
    return value * (F.lit(MEAN_YEAR) if time is None else F.dayofyear(F.make_date(F.year(time), F.lit(12), F.lit(31))))


def normalise(df: DataFrame, value: str = "value", unit: str = "unit", time: str | None = "time") -> DataFrame:
    """df with value and unit in base units."""
    t = F.col(time) if time else None
    return df.withColumns({value: to_base(F.col(value), F.col(unit), t), unit: base_unit(F.col(unit))})
