"""Fact rows, volumes, units and key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendspark.functions import trees
from blendspark.functions import units as U


def load_recipe_facts(recipes: DataFrame, uses: DataFrame, ingredients: DataFrame, units: DataFrame) -> DataFrame:
    """One row per use: recipe and ingredient must exist, the unit may be missing."""
    return (
        uses.join(recipes.select("recipe_id", "recipe_name"), "recipe_id")
        .join(
            ingredients.select(
                "ingredient_id",
                "ingredient_name",
                F.col("path").alias("ingredient_path"),
                F.coalesce("substitution_level", F.lit(0)).alias("substitution_level"),
            ),
            "ingredient_id",
        )
        .join(units.select("unit_name", "conversion_to_ml"), "unit_name", "left")
        .select(
            "recipe_id", "recipe_name", "ingredient_id", "ingredient_name", "ingredient_path",
            "substitution_level", "amount", "unit_name", "conversion_to_ml",
        )
    )


def load_ingredient_tree(ingredients: DataFrame) -> DataFrame:
    """Ingredients with their path taken apart; no substitution level means 0."""
    nodes = trees.path_nodes(F.col("path"))
    return (
        ingredients.withColumn("substitution_level", F.coalesce("substitution_level", F.lit(0)))
        .withColumn("nodes", nodes)
        .withColumn("parent_path", trees.parent_path(F.col("path")))
        .withColumn("depth", F.size("nodes"))
    )


def facts_with_ml(uses: DataFrame, recipes: DataFrame, ingredients: DataFrame, top_ml: float | None = None) -> DataFrame:
    """Uses with names and their volume by the unit rules; the originals stay."""
    return (
        uses.join(recipes.select("recipe_id", "recipe_name"), "recipe_id")
        .join(ingredients.select("ingredient_id", "ingredient_name"), "ingredient_id")
        .withColumn("amount_ml", U.to_ml(F.col("amount"), F.col("unit_name"), top_ml))
    )


def with_volume(facts: DataFrame, top_ml: float | None = 90.0) -> DataFrame:
    return facts.withColumn(
        "volume_ml",
        U.volume_ml(F.col("amount"), F.col("unit_name"), F.col("conversion_to_ml"), top_ml),
    )


def volume_fraction(facts: DataFrame, volume: str = "volume_ml") -> DataFrame:
    """Share of each use in its recipe.  Totals are summed before the shuffle and
    joined back, so that a recipe of any size is never sorted in one task."""
    totals = facts.groupBy("recipe_id").agg(F.sum(volume).alias("_total"))
    return (
        facts.join(totals, "recipe_id")
        .withColumn("volume_fraction", F.try_divide(F.col(volume), F.col("_total")))
        .drop("_total")
    )


def list_units(uses: DataFrame) -> DataFrame:
    return uses.where(F.col("unit_name").isNotNull()).select("unit_name").distinct()


def unit_coverage(uses: DataFrame, rules: DataFrame) -> DataFrame:
    """Units in use that no rule covers, compared by their standard name."""
    known = rules.select(F.col("unit").alias("_unit")).distinct()
    return (
        list_units(uses)
        .withColumn("_unit", F.trim(U.normalize_unit(F.col("unit_name"))))
        .join(known, "_unit", "left_anti")
        .select("unit_name")
    )


def check_keys(
    tables: dict[str, DataFrame],
    unique: list[tuple[str, tuple[str, ...]]],
    references: list[tuple[str, str, str, str]],
) -> DataFrame:
    """Violations as rows (check_name, key, n).

    ``unique`` lists (table, columns); ``references`` lists (table, column,
    target table, target column).  NULL keys break no rule.
    """
    found = []
    for table, columns in unique:
        rows = tables[table].dropna(subset=list(columns))
        found.append(
            rows.groupBy(*columns)
            .agg(F.count("*").alias("n"))
            .where("n > 1")
            .select(
                F.lit(f"unique {table}({', '.join(columns)})").alias("check_name"),
                F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).alias("key"),
                "n",
            )
        )
    for table, column, target, target_column in references:
        keys = tables[target].select(F.col(target_column).alias(column)).distinct()
        found.append(
            tables[table]
            .dropna(subset=[column])
            .groupBy(column)
            .agg(F.count("*").alias("n"))
            .join(keys, column, "left_anti")
            .select(
                F.lit(f"reference {table}({column})").alias("check_name"),
                F.col(column).cast("string").alias("key"),
                "n",
            )
        )
    return reduce(DataFrame.unionByName, found)


def assign_ingredient_ids(names: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name) for every name: known ids are kept, new names follow the highest
    id in alphabetical order."""
    from blendspark.operators.lineage import dense_index

    wanted = names.select("name").where(F.col("name").isNotNull()).distinct()
    new = wanted.join(known.select("name"), "name", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    numbered = dense_index(new, "name").select((F.col("idx") + top + 1).alias("id"), "name")
    return known.select("id", "name").unionByName(numbered)


def check_recipe_documents(documents: DataFrame) -> DataFrame:
    """Documents with the list of what they lack."""
    empty_name = F.nullif(F.trim("name"), F.lit("")).isNull()
    return documents.withColumn(
        "errors",
        F.array_compact(
            F.array(
                F.when(empty_name, F.lit("name is required")),
                F.when(F.col("ingredients").isNull(), F.lit("ingredients is required")),
                F.when(F.size("ingredients") == 0, F.lit("ingredients is empty")),
            )
        ),
    )


def check_category_cover(uses: DataFrame, categories: DataFrame) -> DataFrame:
    """What breaks a cover, as rows (kind, id, category, n): a recipe with several items
    of a category; how many categories a recipe is missing; an item without one or
    two categories.  Only what is present is listed, never recipes by categories."""
    per = (
        uses.select("recipe_id", "ingredient_id")
        .distinct()
        .join(categories.where("category is not null").distinct(), "ingredient_id")
        .groupBy("recipe_id", "category")
        .agg(F.count("*").alias("n"))
    )
    wanted = categories.agg(F.count_distinct("category").alias("_all"))
    present = per.groupBy("recipe_id").agg(F.count("*").alias("_c"))
    none = F.lit(None).cast("string")
    often = per.where("n > 1").select(F.lit("recipe").alias("kind"), F.col("recipe_id").alias("id"), "category", "n")
    missing = (
        uses.select("recipe_id").distinct().join(present, "recipe_id", "left").join(F.broadcast(wanted))  # one number
        .select(
            F.lit("missing").alias("kind"), F.col("recipe_id").alias("id"), none.alias("category"),
            (F.col("_all") - F.coalesce("_c", F.lit(0))).alias("n"),
        )
        .where("n > 0")
    )
    items = (
        uses.select("ingredient_id")
        .distinct()
        .join(categories.distinct(), "ingredient_id", "left")
        .groupBy("ingredient_id")
        .agg(F.count("category").alias("n"))
        .where("n not between 1 and 2")
        .select(F.lit("ingredient").alias("kind"), F.col("ingredient_id").alias("id"), none.alias("category"), "n")
    )
    return often.unionByName(missing).unionByName(items)
