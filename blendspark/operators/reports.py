"""Counts, rankings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendspark.functions.numeric import hash_key
from blendspark.operators.bags import copies_of, near_overlaps
from blendspark.operators.lineage import cut, prefix_sum
from blendspark.operators.lines import parse_lines
from blendspark.operators.neighbours import nearest_bags


def ingredient_usage(uses: DataFrame, ingredients: DataFrame, recipes: DataFrame, minimum: int = 1, samples: int = 3) -> DataFrame:
    """(ingredient_id, ingredient_name, recipe_count, sample_recipes), most used first.
    Samples are the first distinct recipe names in alphabetical order."""
    pairs = uses.select("ingredient_id", "recipe_id").distinct()
    counts = pairs.groupBy("ingredient_id").agg(F.count("*").alias("recipe_count")).where(
        F.col("recipe_count") >= minimum
    )
    by_name = Window.partitionBy("ingredient_id").orderBy("recipe_name")
    names = (
        pairs.join(recipes.select("recipe_id", "recipe_name"), "recipe_id")
        .select("ingredient_id", "recipe_name")
        .distinct()
        .withColumn("_r", F.row_number().over(by_name))
        .where(F.col("_r") <= samples)
        .groupBy("ingredient_id")
        .agg(F.array_sort(F.collect_list("recipe_name")).alias("sample_recipes"))
    )
    return (
        counts.join(ingredients.select("ingredient_id", "ingredient_name"), "ingredient_id")
        .join(names, "ingredient_id")
        .orderBy(F.desc("recipe_count"), "ingredient_id")
    )


def unmapped_top(unmapped_uses: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent unmapped names."""
    return (
        unmapped_uses.groupBy("ingredient_name")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "ingredient_name")
        .limit(top)
    )


def match_report(cascade: DataFrame) -> DataFrame:
    """One row: names per stage of a match cascade, and the share matched."""
    stage = F.col("stage")
    return cascade.agg(
        F.count("*").alias("names"),
        *(F.count_if(stage == s).alias(s) for s in ("dictionary", "cache", "external")),
        F.count_if(stage == "none").alias("unmatched"),
        F.try_divide(F.count_if(stage != "none"), F.count("*")).alias("rate"),
    )


def rationalization_stats(
    uses: DataFrame, mapping: DataFrame, unmapped: DataFrame, processed: DataFrame, new_names: DataFrame, catalogue: DataFrame
) -> DataFrame:
    """One row of counts, summed from one labelled row set per table."""
    def counted(df: DataFrame, label: str, what: Column | None = None) -> DataFrame:
        return df.select(F.lit(label).alias("what"), (F.lit(1) if what is None else what).cast("string").alias("key"))

    rows = counted(uses, "total_recipes", F.col("recipe_id")).unionByName(
        counted(uses, "total_unique_ingredients", F.trim("ingredient_name"))
    ).distinct()
    for df, label in (
        (mapping, "mapped_ingredients"), (unmapped, "unmapped_ingredients"),
        (processed.where("status = 'processed'"), "processed"), (processed.where("status = 'skipped'"), "skipped"),
        (new_names, "new_ingredients"), (catalogue, "catalogue_entries"),
    ):
        rows = rows.unionByName(counted(df, label))
    labels = (
        "total_recipes", "total_unique_ingredients", "mapped_ingredients", "unmapped_ingredients",
        "processed", "skipped", "new_ingredients", "catalogue_entries",
    )
    return rows.agg(*(F.count_if(F.col("what") == name).alias(name) for name in labels))


def status_counts(status_log: DataFrame) -> DataFrame:
    """Accepted, rejected and all decided recipes per source."""
    status = F.col("status")
    return status_log.groupBy("source").agg(
        F.count_if(status == "accepted").alias("accepted"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(status.isin("accepted", "rejected")).alias("total"),
    )


def facet_values(listing: DataFrame, facets: dict[str, str]) -> DataFrame:
    """(facet, value, n) for the named columns; an array column counts its items."""
    kinds = dict(listing.dtypes)
    entries = [
        F.struct(
            F.lit(name).alias("facet"),
            (F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))).alias("values"),
        )
        for name, c in facets.items()
    ]
    return (
        listing.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.facet", F.explode("e.values").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n"))
    )


def recipe_string(cells: DataFrame, boolean: bool = False, empty: str = "No ingredients") -> DataFrame:
    """(recipe_id, description): names with shares, largest first, or names alone in
    order.  The text is as long as its recipe."""
    entry = F.struct((-F.col("w")).alias("_o"), "ingredient_name", "w")
    if boolean:
        entry = F.struct("ingredient_name", "w")
    listed = cells.groupBy("recipe_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("w") > 0, entry))).alias("_e")
    )
    show = (lambda x: x["ingredient_name"]) if boolean else (
        lambda x: F.format_string("%s: %.3f", x["ingredient_name"], x["w"])
    )
    text = F.concat_ws(" | ", F.transform("_e", show))
    return listed.select("recipe_id", F.when(F.size("_e") > 0, text).otherwise(F.lit(empty)).alias("description"))


def distance_summary(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """(n_pairs, min_d, max_d, mean_d) of a pair table.  With ``n`` items the mean is
    that of the square matrix, zero diagonal and both halves included."""
    mean = F.avg("d") if n is None else 2 * F.sum("d") / F.lit(float(n) ** 2)
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.min("d").alias("min_d"), F.max("d").alias("max_d"), mean.alias("mean_d")
    )


def all_pairs_summary(bags: DataFrame, members: DataFrame) -> DataFrame:
    """(n_pairs, min_d, max_d, mean_d) of the Manhattan distances of all pairs of recipes,
    out of collapsed bags whose weights add up to 1; no pair is listed.

    The mean needs the sum of all overlaps, which is a sum over items: of the weights of an
    item, sorted, each is the lesser one for all behind it.  The least distance is 0 where
    there are copies, else that of the nearest bags.  The greatest is 2 where some pair shares
    nothing, which is told by the number of sharing pairs; where all share, items are few
    enough in common that the pairs are looked at.
    """
    copies = cut(copies_of(members))
    n, alike = copies.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    pairs = n * (n - 1) // 2
    cells = bags.join(copies.select(F.col("bag_id").alias("recipe_id"), "copies"), "recipe_id")
    steps = cells.groupBy("ingredient_id", F.round("w", 12).alias("w")).agg(F.sum("copies").alias("c"))
    # Equal weights of an item are one row; the rest is a running count over distinct weights.
    ranked = prefix_sum(
        steps.withColumn("_k", F.struct("ingredient_id", F.col("w").alias("w"))).select("_k", "ingredient_id", "w", "c"), "_k", "c", "_before"
    )
    totals = steps.groupBy("ingredient_id").agg(F.sum("c").alias("_all"))
    firsts = ranked.groupBy("ingredient_id").agg(F.min("_before").alias("_first"))
    c, behind = F.col("c"), F.col("_all") - (F.col("_before") - F.col("_first")) - F.col("c")
    overlap = ranked.join(totals, "ingredient_id").join(firsts, "ingredient_id").agg(F.sum(F.col("w") * (c * (c - 1) / 2 + c * behind))).first()[0]
    return bags.sparkSession.range(1).select(
        F.lit(pairs).cast("long").alias("n_pairs"), F.lit(_least(bags, n, alike)).cast("double").alias("min_d"),
        F.lit(_greatest(bags, n)).cast("double").alias("max_d"), F.lit(2 - 2 * (overlap or 0.0) / pairs if pairs else None).cast("double").alias("mean_d"),
    )


def _least(bags: DataFrame, n: int, alike: int) -> float | None:
    if n < 2:
        return None
    if alike > 1:
        return 0.0
    return nearest_bags(bags, 1).agg(F.coalesce(F.min("d"), F.lit(2.0))).first()[0]


def _greatest(bags: DataFrame, n: int) -> float | None:
    """Some pair shares nothing unless every two bags meet: then each bag shares something
    with each of the smallest ones, so a bag that misses one of these settles it."""
    if n < 2:
        return None
    sizes = bags.groupBy("recipe_id").agg(F.count("*").alias("k"))
    count, smallest = sizes.agg(F.count("*"), F.min_by("recipe_id", F.struct("k", "recipe_id"))).first()
    own = bags.where(F.col("recipe_id") == smallest).select("ingredient_id")
    met = bags.join(own, "ingredient_id", "left_semi").select("recipe_id").distinct().count()
    if met < count:
        return 2.0
    found = near_overlaps(bags, lambda t: F.lit(0.0), lambda a, b: F.lit(0.0)).agg(F.count("*").alias("n"), F.min("overlap").alias("o")).first()
    if found.n < count * (count - 1) // 2:
        return 2.0
    return 2 - 2 * found.o if found.n else 0.0


def column_summary(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Mean, population deviation, minimum and maximum per vector position."""
    return (
        vectors.select(F.posexplode(column).alias("position", "x"))
        .groupBy("position")
        .agg(
            F.avg(F.col("x").cast("double")).alias("mean"),
            F.stddev_pop(F.col("x").cast("double")).alias("std"),
            F.min("x").cast("double").alias("min"),
            F.max("x").cast("double").alias("max"),
        )
    )


def flag_matches(recipes: DataFrame, search: str, name: str = "recipe_name") -> DataFrame:
    return recipes.withColumn("matches", F.contains(F.lower(name), F.lower(F.lit(search))))


def flag_count(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count_if("matches").alias("matching"), F.count("*").alias("total"))


def sample_lines(lines: DataFrame, n: int, seed: int = 42, text: str = "text") -> DataFrame:
    """The lines of n recipes picked at random by hash, parsed."""
    picked = (
        lines.select("recipe_id").distinct().orderBy(hash_key(seed, F.col("recipe_id"))).limit(n)
    )
    return parse_lines(lines.join(picked, "recipe_id", "left_semi"), text)


def match_split(usage: DataFrame, matches: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(matched with confidence, unmatched) of the used names, with their counts."""
    matched = usage.join(matches, usage["ingredient_name"] == matches[text])
    unmatched = usage.join(matches, usage["ingredient_name"] == matches[text], "left_anti")
    return matched, unmatched


def match_split_report(usage: DataFrame, matches: DataFrame, text: str = "text") -> DataFrame:
    """(confidence, names, uses, name_share, use_share); NULL confidence is unmatched."""
    scored = usage.join(
        matches.select(F.col(text).alias("ingredient_name"), "confidence"), "ingredient_name", "left"
    )
    per = scored.groupBy("confidence").agg(F.count("*").alias("names"), F.sum("recipe_count").alias("uses"))
    everything = Window.partitionBy()  # one row per confidence level
    return per.select(
        "confidence", "names", "uses",
        (F.col("names") / F.sum("names").over(everything)).alias("name_share"),
        (F.col("uses") / F.sum("uses").over(everything)).alias("use_share"),
    )


def compare_annotators(annotations: DataFrame, annotators: list[str]) -> DataFrame:
    """(item, one column per annotator, agree): labels of the same items side by side."""
    columns = [
        F.min(F.when(F.col("annotator") == a, F.col("label"))).alias(a) for a in annotators
    ]
    wide = annotations.groupBy("item").agg(*columns)
    agree = F.lit(True)
    for name in annotators[1:]:
        agree = agree & F.col(annotators[0]).eqNullSafe(F.col(name))
    return wide.withColumn("agree", agree)
