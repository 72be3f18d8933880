"""From a source's own table to series: names, expressions, levels, patches, user filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import finite, ratio

#: Names of coordinates, in any case.
SYNONYMS = {
    "lon": ("longitude", "lon", "long", "lon_cama", "lon_ucat", "lon0", "x", "xlong", "nav_lon", "west_east"),
    "lat": ("latitude", "lat", "lat_cama", "lat_ucat", "lat0", "y", "xlat", "nav_lat", "south_north"),
    "time": ("time", "t", "xtime"),
    "level": ("level", "bottom_top"),
    "soil": ("soil", "soil_layers_stag"),
    "elev": ("elev", "elevation", "height", "z", "h", "alt", "altitude"),
}
FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def find(df: DataFrame, name: str) -> str | None:
    """The column of that name, in any case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def rename_coordinates(df: DataFrame) -> DataFrame:
    """Synonyms of coordinates under their canonical names, where those aren't taken."""
    names = {}
    for canonical, others in SYNONYMS.items():
        found = next((c for o in others if (c := find(df, o)) is not None), None)
        if found and canonical not in df.columns:
            names[found] = canonical
    return df.withColumnsRenamed(names)


def select_variable(df: DataFrame, name: str, choices: Sequence[Mapping[str, str]], keep: Sequence[str], sentinels: Sequence[float] = ()) -> DataFrame:
    """(keep, value, unit): the first choice (varname, unit, convert) that the table has, else the variable by its own name, else the only other column.

    A choice brings its unit and its conversion, an expression over value and the other columns. The
    choice is one per source, not per row.
    """
    rest = [c for c in df.columns if c not in keep]
    for choice in [*choices, {"varname": name}]:
        if (column := find(df, choice["varname"])) is not None:
            break
    else:
        if len(rest) != 1:
            raise ValueError(f"none of {[c['varname'] for c in choices]} is in {df.columns}")
        column, choice = rest[0], {}
    out = df.withColumn("value", F.col(column))
    if choice.get("convert"):
        out = out.withColumn("value", F.expr(choice["convert"]))
    return out.select(*keep, finite("value", sentinels).alias("value"), F.lit(choice.get("unit")).alias("unit"))


def derive(df: DataFrame, steps: str, name: str = "value") -> DataFrame:
    """Steps in SQL, "a = x + y; a * 2": assignments add columns, the last expression is the value. A step "if a, b: ..." needs those columns, else it is left out."""
    out, last = df, None
    for step in filter(None, map(str.strip, steps.split(";"))):
        if m := re.match(r"if ([\w, ]+):(.*)", step):
            if not all(find(out, c.strip()) for c in m[1].split(",")):
                continue
            step = m[2].strip()
        if m := re.match(r"(\w+)\s*=(?!=)(.*)", step):
            out = out.withColumn(m[1], F.expr(m[2]))
        else:
            last = F.expr(step)
    if last is None:
        raise ValueError(f"no expression in {steps!r}")
    return out.withColumn(name, last)


def at_level(df: DataFrame, values: str, level: int, name: str = "value") -> DataFrame:
    """One element of a level axis kept as an array; NULL beyond its end."""
    return df.withColumn(name, F.get(values, F.lit(level)))


def over_levels(df: DataFrame, values: str, thickness: str, name: str = "value") -> DataFrame:
    """The mean over a level axis, weighted by another array."""
    add = lambda a, x: a + x
    total = F.aggregate(F.zip_with(values, thickness, lambda v, w: v * w), F.lit(0.0), add)
    return df.withColumn(name, ratio(total, F.aggregate(thickness, F.lit(0.0), add)))


def over_patches(df: DataFrame, keys: Sequence[str], value: str = "value", fraction: str = "fraction") -> DataFrame:
    """The mean over the patches of a cell by their fractions; a missing fraction is 0."""
    f = F.coalesce(F.col(fraction), F.lit(0.0))
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(value) * f), F.sum(F.when(F.col(value).isNotNull(), f))).alias(value))


def register_filter(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    FILTERS[name] = f


def apply_filter(df: DataFrame, name: str) -> DataFrame:
    """The filter of that name, or of the name without its trailing version; df itself if there is none."""
    found = FILTERS.get(name) or FILTERS.get(re.sub(r"[_-]?[vV]?\d+(\.\d+)*$", "", name))
    return found(df) if found else df
