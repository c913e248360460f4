"""Units: aliases, factors and the conversion to millilitres."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of each unit.
UNIT_ALIASES = {
    "ounce": ("ounce", "ounces", "oz", "oz."),
    "tablespoon": ("tablespoon", "tablespoons", "tbsp", "tbsp.", "tablespoonful", "tablespoonfuls"),
    "barspoon": ("barspoon", "barspoons", "bar spoon", "bar spoons"),
    "teaspoon": ("teaspoon", "teaspoons", "tsp", "tsp.", "teaspoonful", "teaspoonfuls"),
    "cup": ("cup", "cups"),
    "pint": ("pint", "pints", "pt", "pt."),
    "quart": ("quart", "quarts", "qt", "qt."),
    "gallon": ("gallon", "gallons", "gal", "gal."),
    "ml": ("milliliter", "milliliters", "ml", "ml."),
    "cl": ("centiliter", "centiliters", "cl", "cl."),
    "l": ("liter", "liters", "l", "l."),
    "dash": ("dash", "dashes"),
    "drop": ("drop", "drops"),
    "part": ("part", "parts"),
    "splash": ("splash", "splashes"),
    "pinch": ("pinch", "pinches"),
    "piece": ("piece", "pieces", "shoulder"),
    "slice": ("slice", "slices"),
    "wedge": ("wedge", "wedges"),
    "whole": ("whole",),
    "cube": ("cube", "cubes"),
}

# Millilitres per unit.
ML_PER_UNIT = {
    "ml": 1.0, "cl": 10.0, "l": 1000.0,
    "ounce": 29.5735, "cup": 236.588, "pint": 473.176, "tablespoon": 14.7868,
    "barspoon": 7.39, "teaspoon": 4.92892, "quart": 946.353, "gallon": 3785.41,
    "dash": 0.616, "splash": 5.0, "drop": 0.05, "pinch": 0.31, "part": 30.0,
}

# Units that have no volume, and those with one volume whatever
# the amount.
NO_VOLUME = (
    "cube", "piece", "slice", "wedge", "whole", "each", "clove", "sprig", "leaf",
    "leaves", "twist", "peel", "garnish", "rim", "float",
)
SET_VOLUME = {"as needed": 0.0, "to top": 90.0, "to taste": 0.0}


def unit_rows() -> list[tuple[str, str, str, float]]:
    """(alias, unit, kind, factor) for every spelling and every rule."""
    unit_of = {alias: unit for unit, aliases in UNIT_ALIASES.items() for alias in aliases}
    for known in (*ML_PER_UNIT, *NO_VOLUME, *SET_VOLUME):
        unit_of.setdefault(known, known)
    rows = []
    for alias, unit in unit_of.items():
        if unit in SET_VOLUME:
            rows.append((alias, unit, "set", SET_VOLUME[unit]))
        elif unit in NO_VOLUME:
            rows.append((alias, unit, "none", 0.0))
        else:
            rows.append((alias, unit, "factor", ML_PER_UNIT[unit]))
    return rows


def unit_table(spark: SparkSession) -> DataFrame:
    """The rules as a table, to be joined or extended by the caller."""
    return spark.createDataFrame(
        unit_rows(), "alias string, unit string, kind string, factor double"
    )


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def unit_alias(word: Column) -> Column:
    """Unit of a spelling, NULL where there is none."""
    aliases = {a: unit for unit, spellings in UNIT_ALIASES.items() for a in spellings}
    return F.element_at(_literal_map(aliases), F.btrim(F.lower(word), F.lit(".")))


def normalize_unit(unit: Column) -> Column:
    """Standard name of a unit; an unknown one is kept, lower case, without dots."""
    return F.coalesce(unit_alias(unit), F.btrim(F.lower(unit), F.lit(".")))


def to_ml(amount: Column, unit: Column, top_ml: float | None = None) -> Column:
    """Volume in ml: NULL without amount or unit, 0 for an unknown unit.

    ``top_ml`` gives "to top" that volume even where the amount is missing, as
    is usual when the amount of a filler is never written down.
    """
    name = normalize_unit(unit)
    volume = (
        F.when(amount.isNull() | unit.isNull(), F.lit(None).cast("double"))
        .when(amount == 0, F.lit(0.0))
        .when(name.isin(*SET_VOLUME), F.element_at(_literal_map(SET_VOLUME), name))
        .otherwise(F.coalesce(amount * F.element_at(_literal_map(ML_PER_UNIT), name), F.lit(0.0)))
    )
    if top_ml is not None:
        volume = F.when(name == "to top", F.lit(float(top_ml))).otherwise(volume)
    return volume


def volume_ml(amount: Column, unit: Column, conversion: Column, top_ml: float | None = 90.0) -> Column:
    """Volume by a stored conversion factor."""
    product = amount * conversion
    if top_ml is None:
        return product
    return F.when(unit == "to top", F.lit(float(top_ml))).otherwise(product)


def amount_with_default(amount: Column, conversion: Column) -> Column:
    """Converted amount, else the plain amount, else 1."""
    return F.coalesce(amount * conversion, amount, F.lit(1.0))
