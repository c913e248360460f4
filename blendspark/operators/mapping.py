"""Mapping tables, status logs and the batch gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendspark.functions import text as T

# Fixed value: the instructions every mapped recipe gets.
STANDARD_INSTRUCTIONS = "Shake all ingredients with ice and strain into a cocktail or coupe glass"
DONE = ("accepted", "rejected", "auto_ingested")


def variation_groups(names: DataFrame) -> DataFrame:
    """(key, name): the distinct spellings under their shared key."""
    return (
        names.select(F.trim("name").alias("name"))
        .where("name <> ''")
        .distinct()
        .select(T.match_key(F.col("name")).alias("key"), "name")
    )


def variation_sets(names: DataFrame) -> DataFrame:
    """(key, n, variations) per key; spellings of one key are few."""
    return variation_groups(names).groupBy("key").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("variations")
    )


def unmapped_names(names: DataFrame, mapping: DataFrame, new_names: DataFrame) -> DataFrame:
    """(key, name) of groups where no spelling is mapped or listed as new."""
    groups = variation_groups(names)
    decided = mapping.select("name").unionByName(new_names.select("name")).distinct()
    settled = groups.join(decided, "name", "left_semi").select("key").distinct()
    return groups.join(settled, "key", "left_anti")


def map_group(names: DataFrame, decisions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Decisions (name, type, ingredient_id) spread over all spellings of a name.

    Rows (name, type, mapped_id, mapped_name): ``existing`` needs a catalogue
    entry, ``new`` covers the group, ``skip`` only the name itself.  A name that
    is unknown to the table is its own group.
    """
    keyed = decisions.withColumn("key", T.match_key(F.col("name"))).withColumnRenamed("name", "decided")
    groups = variation_groups(names)
    spread = keyed.join(groups, "key", "left").withColumn("name", F.coalesce("name", "decided"))
    entries = catalogue.select(F.col("id").alias("ingredient_id"), F.col("name").alias("mapped_name"))
    existing = spread.where("type = 'existing'").join(entries, "ingredient_id").select(
        "name", "type", F.col("ingredient_id").alias("mapped_id"), "mapped_name"
    )
    nothing = (F.lit(None).cast("long").alias("mapped_id"), F.lit(None).cast("string").alias("mapped_name"))
    new = spread.where("type = 'new'").select("name", "type", *nothing)
    skipped = keyed.where("type = 'skip'").select(F.col("decided").alias("name"), "type", *nothing)
    return existing.unionByName(new).unionByName(skipped).distinct()


def apply_mapping(uses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Uses with mapped names where there is one; optional items fall away."""
    mapped = mapping.select(F.col("name").alias("_name"), "mapped_name")
    return (
        uses.withColumn("_name", F.trim("ingredient_name"))
        .where(~T.is_optional(F.col("_name")))
        .join(mapped, "_name", "left")
        .withColumn("ingredient_name", F.coalesce("mapped_name", "ingredient_name"))
        .drop("_name", "mapped_name")
    )


def rebuild_recipes(mapped_uses: DataFrame, recipes: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    """Recipe documents from mapped uses: list in line order, fixed instructions,
    the known address or one derived from the name.  A list is as long as its recipe."""
    lists = mapped_uses.groupBy("recipe_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line", "ingredient_name", "amount", "unit_name"))),
            lambda x: x.dropFields("line"),
        ).alias("ingredients")
    )
    known = F.col("source_url") if "source_url" in recipes.columns else F.lit(None).cast("string")
    return recipes.join(lists, "recipe_id").select(
        "recipe_id",
        "recipe_name",
        F.lit("").alias("description"),
        F.lit(STANDARD_INSTRUCTIONS).alias("instructions"),
        "ingredients",
        F.coalesce(F.nullif(known, F.lit("")), T.source_url(F.col("recipe_name"), prefix, suffix)).alias("source_url"),
    )


def unmapped_uses(uses: DataFrame, mapping: DataFrame) -> DataFrame:
    """(recipe_id, ingredient_name): required uses that have no mapping."""
    required = uses.select("recipe_id", F.trim("ingredient_name").alias("ingredient_name")).where(
        (F.col("ingredient_name") != "") & ~T.is_optional(F.col("ingredient_name"))
    )
    return required.join(mapping.select(F.col("name").alias("ingredient_name")), "ingredient_name", "left_anti")


def mappable_recipes(uses: DataFrame, mapping: DataFrame) -> DataFrame:
    """(recipe_id, mappable, n_unmapped) for every recipe; the names themselves are
    the rows of ``unmapped_uses``."""
    open_uses = unmapped_uses(uses, mapping).groupBy("recipe_id").agg(F.count("*").alias("n_unmapped"))
    return (
        uses.select("recipe_id")
        .distinct()
        .join(open_uses, "recipe_id", "left")
        .select(
            "recipe_id",
            F.col("n_unmapped").isNull().alias("mappable"),
            F.coalesce("n_unmapped", F.lit(0)).alias("n_unmapped"),
        )
    )


def unprocessed(recipes: DataFrame, status_log: DataFrame) -> DataFrame:
    """Recipes whose (source, name) has no final status."""
    done = status_log.where(F.col("status").isin(*DONE)).select("source", "recipe_name")
    return recipes.join(done, ["source", "recipe_name"], "left_anti")


def batch_gate(recipes: DataFrame, uses: DataFrame, mapping: DataFrame, status_log: DataFrame) -> DataFrame:
    """(recipe_id, outcome): what happens to each parsed recipe.

    Outcomes: processed, shot, short, needs_review, auto_ingested, repeated.
    Among mappable recipes of one source and name the first path is ingested.
    """
    done = status_log.where(F.col("status").isin(*DONE)).select("source", "recipe_name").distinct()
    counts = uses.groupBy("recipe_id").agg(F.count("*").alias("_n"))
    state = (
        recipes.join(done.withColumn("_done", F.lit(True)), ["source", "recipe_name"], "left")
        .join(counts, "recipe_id", "left")
        .join(mappable_recipes(uses, mapping).select("recipe_id", "mappable"), "recipe_id", "left")
    )
    shot = F.upper("instructions").contains("SHOT GLASS") | F.col("recipe_name").contains("Shot")
    gated = state.withColumn(
        "outcome",
        F.when(F.col("_done"), "processed")
        .when(F.coalesce(shot, F.lit(False)), "shot")
        .when(F.coalesce("_n", F.lit(0)) <= 2, "short")
        .when(~F.coalesce("mappable", F.lit(True)), "needs_review")
        .otherwise("auto_ingested"),
    )
    first = gated.where("outcome = 'auto_ingested'").groupBy("source", "recipe_name").agg(
        F.min(F.struct("path", "recipe_id")).alias("_first")
    )
    return (
        gated.join(first, ["source", "recipe_name"], "left")
        .withColumn(
            "outcome",
            F.when(
                (F.col("outcome") == "auto_ingested") & (F.col("recipe_id") != F.col("_first.recipe_id")), "repeated"
            ).otherwise(F.col("outcome")),
        )
        .select("recipe_id", "source", "recipe_name", "outcome")
    )


def merge_mappings(primary: DataFrame, secondary: DataFrame, prefer_primary: bool = True) -> DataFrame:
    """(name, mapped_id, mapped_name, origin, conflict): both tables as one."""
    fields = ("mapped_id", "mapped_name")
    a = primary.select("name", F.struct(*fields).alias("_p"))
    b = secondary.select("name", F.struct(*fields).alias("_s"))
    order = ("_p", "_s") if prefer_primary else ("_s", "_p")
    origin = (
        F.when(F.col("_p").isNotNull() & F.col("_s").isNotNull(), "both")
        .when(F.col("_p").isNotNull(), "primary")
        .otherwise("secondary")
    )
    conflict = F.coalesce(~F.col("_p").eqNullSafe(F.col("_s")) & (origin == "both"), F.lit(False))
    return a.join(b, "name", "full_outer").select(
        "name",
        *(F.coalesce(*(F.col(side) for side in order))[f].alias(f) for f in fields),
        origin.alias("origin"),
        conflict.alias("conflict"),
    )


def merge_counts(merged: DataFrame) -> DataFrame:
    origin = F.col("origin")
    return merged.agg(
        F.count_if(origin != "secondary").alias("primary_keys"),
        F.count_if(origin != "primary").alias("secondary_keys"),
        F.count("*").alias("merged_keys"),
        F.count_if("conflict").alias("conflicts"),
        F.count_if(origin == "secondary").alias("added_from_secondary"),
    )


def update_status(status_log: DataFrame, decisions: DataFrame) -> DataFrame:
    """One status per (source, recipe_name): a decision replaces what was logged;
    among several decisions the latest by ``at`` counts."""
    keys = ("source", "recipe_name")
    latest = decisions.groupBy(*keys).agg(F.max_by("status", "at").alias("status"))
    kept = status_log.select(*keys, "status").join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest)


def reset_status(status_log: DataFrame, source: str) -> DataFrame:
    return status_log.where(F.col("source") != source)


def recipes_using(uses: DataFrame, recipes: DataFrame, top: int = 5) -> DataFrame:
    """(ingredient_name, rank, recipe_id, recipe_name): the first recipes of each
    ingredient by id."""
    first = Window.partitionBy("ingredient_name").orderBy("recipe_id")
    return (
        uses.select(F.trim("ingredient_name").alias("ingredient_name"), "recipe_id")
        .distinct()
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= top)
        .join(recipes.select("recipe_id", "recipe_name"), "recipe_id")
        .select("ingredient_name", "rank", "recipe_id", "recipe_name")
    )


def lookup_recipe_id(pages: DataFrame, recipes: DataFrame) -> DataFrame:
    """Pages with the id and name of the recipe stored under their short path."""
    known = recipes.select(F.col("source_file").alias("_file"), "recipe_id", "recipe_name")
    return pages.withColumn("_file", T.db_path(F.col("path"))).join(known, "_file", "left").drop("_file")


def assign_class(recipes: DataFrame, classes: DataFrame, default: str = "other") -> DataFrame:
    """Recipes with their class; a name in several classes takes the last one."""
    last = classes.groupBy("recipe_name").agg(F.max_by("class", "ord").alias("class"))
    return recipes.join(last, "recipe_name", "left").withColumn("class", F.coalesce("class", F.lit(default)))
