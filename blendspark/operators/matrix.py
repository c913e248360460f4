"""Recipe x ingredient matrices as long tables (recipe_id, ingredient_id, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendspark.functions.units import amount_with_default
from blendspark.operators.lineage import dense_index


def normalize_rows(cells: DataFrame, row: str = "recipe_id", weight: str = "w") -> DataFrame:
    """Divide by the row total; rows and cells that are zero fall away."""
    totals = cells.groupBy(row).agg(F.sum(weight).alias("_total"))
    return (
        cells.join(totals, row)
        .withColumn(weight, F.try_divide(F.col(weight), F.col("_total")))
        .where(F.col(weight) != 0)
        .drop("_total")
    )


def recipe_matrix(facts: DataFrame, item: str = "ingredient_id") -> DataFrame:
    """Share of every item in its recipe."""
    cells = facts.groupBy("recipe_id", item).agg(
        F.sum(amount_with_default(F.col("amount"), F.col("conversion_to_ml"))).alias("w")
    )
    return normalize_rows(cells)


def boolean_matrix(matrix: DataFrame) -> DataFrame:
    """Which cells are filled."""
    return matrix.where("w > 0").withColumn("w", F.lit(1.0))


def collapse_columns(cells: DataFrame, boolean: bool = False) -> DataFrame:
    """Sum three-level columns (category, specific_type, brand) over the brand and
    normalise; the boolean form keeps any filled cell."""
    keys = ("recipe_id", "category", "specific_type")
    if boolean:
        return cells.groupBy(*keys).agg(F.bool_or(F.col("w") > 0).alias("present")).where("present")
    return normalize_rows(cells.groupBy(*keys).agg(F.sum("w").alias("w")))


def matrix_index(matrix: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells by row and column number, row registry, column registry)."""
    rows = dense_index(matrix.select("recipe_id").distinct(), "recipe_id", name="row")
    columns = dense_index(matrix.select("ingredient_id").distinct(), "ingredient_id", name="col")
    cells = matrix.join(rows, "recipe_id").join(columns, "ingredient_id").select("row", "col", "w")
    return cells, rows, columns
