"""k medoids of weighted bags by Manhattan distance, without a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendspark.functions.numeric import hash_unit
from blendspark.operators.lineage import cut


def nearest_medoid(bags: DataFrame, medoids: list[int]) -> DataFrame:
    """(id, medoid, d) of every bag; ties go to the lowest medoid.

    Bags that share something with a medoid meet its cells; of the medoids that a bag
    shares nothing with, the one of the least total is nearest."""
    cells = bags.where(F.col("recipe_id").isin(*medoids)).select(F.col("recipe_id").alias("medoid"), "ingredient_id", F.col("w").alias("_m"))
    cells = F.broadcast(cells)  # k bags
    totals = bags.groupBy(F.col("recipe_id").alias("id")).agg(F.sum("w").alias("total"))
    weights = cells.groupBy("medoid").agg(F.sum("_m").alias("weight"))
    far = weights.agg(F.min(F.struct(F.round("weight", 9).alias("weight"), "medoid")).alias("far"))
    met = bags.join(cells, "ingredient_id").groupBy(F.col("recipe_id").alias("id"), "medoid").agg(F.sum(F.least("w", "_m")).alias("o"))
    seen = met.join(F.broadcast(weights), "medoid").join(totals, "id").select(
        "id", "medoid", F.round(F.col("total") + F.col("weight") - 2 * F.col("o"), 9).alias("d")
    )
    unseen = totals.join(F.broadcast(far)).select("id", F.col("far.medoid").alias("medoid"), F.round(F.col("total") + F.col("far.weight"), 9).alias("d"))
    best = seen.unionByName(unseen).groupBy("id").agg(F.min(F.struct("d", "medoid")).alias("b"))
    return best.select("id", "b.medoid", F.greatest(F.col("b.d"), F.lit(0.0)).alias("d"))


def first_medoids(bags: DataFrame, k: int, seed: int = 42) -> list[int]:
    """k starting medoids: the first at random, each further one at random with odds
    by its squared distance to the nearest so far, which is carried on.

    The draw is a race of hashed exponential times, so it needs one maximum.
    """
    items = bags.select(F.col("recipe_id").alias("id")).distinct()
    first = items.agg(F.min_by("id", hash_unit(seed, F.col("id")))).first()[0]
    medoids = [] if first is None else [first]
    near = cut(nearest_medoid(bags, medoids)) if medoids else items
    while 0 < len(medoids) < k:
        time = -F.log(hash_unit(f"{seed}.{len(medoids)}", F.col("id")) + 1e-15) / F.pow("d", F.lit(2))
        drawn = near.where("d > 0").select("id", time.alias("t")).agg(F.min_by("id", "t")).first()[0]
        if drawn is None:
            break
        medoids.append(drawn)
        near = cut(near.unionByName(nearest_medoid(bags, [drawn])).groupBy("id").agg(F.min(F.struct("d", "medoid")).alias("b")).select("id", "b.*"))
    return medoids


def best_centres(bags: DataFrame, labels: DataFrame, copies: DataFrame) -> DataFrame:
    """(medoid, new, total): per cluster the bag with the least sum of distances to all
    recipes of the cluster; the old medoid wins ties, then the lowest id.

    That sum is n t + T - 2 o with the cluster's recipes n and totals T, and o the sum
    of minima, which needs running sums over the sorted weights of each ingredient and
    no pairs.  Equal weights of an ingredient are one row."""
    placed = bags.join(labels.select(F.col("id").alias("recipe_id"), "medoid"), "recipe_id").join(
        copies.select(F.col("bag_id").alias("recipe_id"), "copies"), "recipe_id"
    )
    placed = cut(placed.withColumn("w", F.round("w", 9)))
    steps = placed.groupBy("medoid", "ingredient_id", "w").agg(F.sum("copies").alias("n"))
    below = Window.partitionBy("medoid", "ingredient_id").orderBy("w")
    sums = steps.select(
        "medoid", "ingredient_id", "w", F.sum(F.col("n") * F.col("w")).over(below).alias("under"),
        (F.sum("n").over(below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum("n").over(below)).alias("over"),
    )
    shared = placed.join(sums, ["medoid", "ingredient_id", "w"]).groupBy("medoid", "recipe_id").agg(
        F.sum(F.col("under") + F.col("w") * F.col("over")).alias("o"), F.sum("w").alias("t"), F.max("copies").alias("copies")
    )
    whole = shared.groupBy("medoid").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("t")).alias("all"))
    total = F.round(F.col("n") * F.col("t") + F.col("all") - 2 * F.col("o"), 6)
    scored = shared.join(F.broadcast(whole), "medoid").select("medoid", "recipe_id", total.alias("total"))
    best = F.min(F.struct("total", (F.col("recipe_id") != F.col("medoid")).alias("other"), "recipe_id")).alias("b")
    return scored.groupBy("medoid").agg(best).select("medoid", F.col("b.recipe_id").alias("new"), "b.total")


def kmedoids(bags: DataFrame, copies: DataFrame, k: int = 30, seed: int = 42, rounds: int = 50) -> DataFrame:
    """(id, cluster, medoid, d): bags (recipe_id, ingredient_id, w) around k medoids;
    copies (bag_id, copies) says how many recipes each bag stands for.

    Only the k medoid ids reach the driver.
    """
    bags = cut(bags.select("recipe_id", "ingredient_id", "w"))
    medoids = sorted(first_medoids(bags, k, seed))
    if not medoids:
        return bags.select(F.col("recipe_id").alias("id"), F.lit(0).alias("cluster"), F.col("recipe_id").alias("medoid"), F.lit(0.0).alias("d"))
    labels = cut(nearest_medoid(bags, medoids))
    for _ in range(rounds):
        new = sorted(r["new"] for r in best_centres(bags, labels, copies).collect())
        if new == medoids:
            break
        medoids = new
        labels = cut(nearest_medoid(bags, medoids))
    places = F.array(*(F.lit(m) for m in medoids))
    return labels.select("id", (F.array_position(places, F.col("medoid")) - 1).cast("int").alias("cluster"), "medoid", "d")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("n"))
