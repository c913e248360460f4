"""Distances that follow the ingredient tree.

Trees are tables (ingredient_id, path, nodes, parent_path, substitution_level) as
``load_ingredient_tree`` returns them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.functions import pairwise, trees
from blendspark.operators import bags as B


def substitution_tokens(tree: DataFrame) -> DataFrame:
    """(ingredient_id, token): two ingredients can stand in for each other exactly
    when they share a token.

    A token is a path: the own one, and the parent's when the level is 1.  Level-1
    siblings meet at their parent's path, a level-1 child meets its parent there.
    The table has at most two rows per ingredient, where the pairs it stands for
    grow with the square of a family.
    """
    own = tree.select("ingredient_id", F.col("path").alias("token"))
    parents = tree.where("substitution_level = 1 and parent_path is not null").select(
        "ingredient_id", F.col("parent_path").alias("token")
    )
    return own.unionByName(parents)


def substitutable_pairs(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """Given pairs (id1, id2) with ``substitutable``."""
    side = tree.select("ingredient_id", "path", "parent_path", (F.col("substitution_level") == 1).alias("free"))
    first = side.select(*(F.col(c).alias(f"{c}1") for c in side.columns)).withColumnRenamed("ingredient_id1", "id1")
    second = side.select(*(F.col(c).alias(f"{c}2") for c in side.columns)).withColumnRenamed("ingredient_id2", "id2")
    siblings = F.col("free1") & F.col("free2") & (F.col("parent_path1") == F.col("parent_path2"))
    child = F.col("free1") & (F.col("parent_path1") == F.col("path2"))
    parent = F.col("free2") & (F.col("parent_path2") == F.col("path1"))
    yes = F.coalesce(siblings, F.lit(False)) | F.coalesce(child, F.lit(False)) | F.coalesce(parent, F.lit(False))
    return pairs.join(first, "id1").join(second, "id2").select("id1", "id2", yes.alias("substitutable"))


def with_levels(tree: DataFrame) -> DataFrame:
    """(ingredient_id, nodes, levels): the level of every node on the path; a node
    without an entry has level 0.  Paths are short."""
    level = tree.select(F.col("ingredient_id").alias("_node"), F.col("substitution_level").alias("_level"))
    return (
        tree.select("ingredient_id", "nodes", F.posexplode("nodes").alias("_pos", "_node"))
        .join(level, "_node", "left")
        .groupBy("ingredient_id", "nodes")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_level", F.lit(0)).alias("l")))).alias("_l"))
        .select("ingredient_id", "nodes", F.transform("_l", lambda x: x["l"]).alias("levels"))
    )


def with_ones(tree: DataFrame) -> DataFrame:
    """(ingredient_id, nodes, ones): how many of the first k nodes of the path have level 1,
    for k from 0."""
    ones = F.array_insert(trees.level_counts(F.col("nodes"), F.col("levels")), 1, F.lit(0))
    return with_levels(tree).select("ingredient_id", "nodes", ones.alias("ones"))


def with_links(met: DataFrame, *others: str) -> DataFrame:
    """Rows with two paths (n1, o1, n2, o2: nodes and ones) get ``substitutable`` and
    ``other``: the edges up to the common ancestor, by the level of the node below each."""
    met = met.withColumn("_c", trees.common_depth(F.col("n1"), F.col("n2")))

    def below(ones: str, nodes: str) -> Column:
        return F.get(ones, F.size(nodes)) - F.get(ones, F.col("_c"))

    free = below("o1", "n1") + below("o2", "n2")
    edges = F.size("n1") + F.size("n2") - 2 * F.col("_c")
    return met.select(*others, free.alias("substitutable"), (edges - free).alias("other"))


def tree_distance_pairs(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id1, id2, substitutable, other): edges from both ingredients up to their
    common ancestor, by the level of the node below each edge."""
    counted = with_ones(tree)
    first = counted.select(F.col("ingredient_id").alias("id1"), F.col("nodes").alias("n1"), F.col("ones").alias("o1"))
    second = counted.select(F.col("ingredient_id").alias("id2"), F.col("nodes").alias("n2"), F.col("ones").alias("o2"))
    others = [c for c in pairs.columns if c not in ("id1", "id2")]
    return with_links(pairs.join(first, "id1").join(second, "id2"), "id1", "id2", *others)


def exp_tree_distance_pairs(tree: DataFrame, pairs: DataFrame, base: float = 3.0) -> DataFrame:
    """(id1, id2, d): base to the number of edges, 0 for the same ingredient."""
    steps = F.col("substitutable") + F.col("other")
    d = F.when(steps == 0, F.lit(0.0)).otherwise(F.pow(F.lit(float(base)), steps))
    return tree_distance_pairs(tree, pairs).select("id1", "id2", d.alias("d"))


def linear(weight: float) -> Callable[[Column], Column]:
    return lambda links: links * F.lit(float(weight))


def ingredient_costs(
    uses: DataFrame,
    pairs: DataFrame,
    tree: DataFrame,
    f: Callable[[Column], Column] = linear(1),
    g: Callable[[Column], Column] = linear(1),
    volume: str = "volume_fraction",
) -> DataFrame:
    """(r1, r2, i, j, v1, v2, k): every ingredient of one recipe against every one of
    the other, for given recipe pairs (id1, id2); k is the cost per unit volume.

    Recipes carry the paths of their ingredients, so the tree cost is told where the pair
    is, and no row per pair of ingredients is shuffled.
    """
    cells = uses.where(F.col(volume).isNotNull()).groupBy("recipe_id", "ingredient_id").agg(F.sum(volume).alias("v"))
    met = B.with_sides(pairs, cells.join(with_ones(tree), "ingredient_id"), "ingredient_id", "v", "nodes", "ones")
    ids = [F.col("id1").alias("r1"), F.col("id2").alias("r2")]
    half = met.select(*ids, F.inline("first").alias("i", "v1", "n1", "o1"), "second")
    cells = half.select("r1", "r2", "i", "v1", "n1", "o1", F.inline("second").alias("j", "v2", "n2", "o2"))
    k = f(F.col("substitutable")) + g(F.col("other"))
    return with_links(cells, "r1", "r2", "i", "j", "v1", "v2").select("r1", "r2", "i", "j", "v1", "v2", k.cast("double").alias("k"))


def weighted_volume_cost(costs: DataFrame) -> DataFrame:
    """Cost rows with ``cost``: volume difference scaled by the tree cost, plus the
    tree cost itself."""
    cost = F.abs(F.col("v1") - F.col("v2")) * (F.col("k") + 1) + F.col("k")
    return costs.withColumn("cost", cost)


def node_masses(bags: DataFrame, tree: DataFrame, free: float = 1.0, other: float = 1.0) -> DataFrame:
    """(recipe_id, ingredient_id, w): weighted share of each recipe at or below every
    tree node, the node id in ``ingredient_id``."""
    weights = tree.select(
        F.col("ingredient_id").alias("_node"),
        F.when(F.col("substitution_level") == 1, F.lit(float(free))).otherwise(F.lit(float(other))).alias("_w"),
    )
    return (
        bags.join(tree.select("ingredient_id", "nodes"), "ingredient_id")
        .select("recipe_id", "w", F.explode("nodes").alias("_node"))
        .groupBy("recipe_id", "_node")
        .agg(F.sum("w").alias("w"))
        .join(weights, "_node", "left")
        .select("recipe_id", F.col("_node").alias("ingredient_id"), (F.col("w") * F.coalesce("_w", F.lit(float(other)))).alias("w"))
        .where("w > 0")
    )


def tree_emd_pairs(
    bags: DataFrame,
    tree: DataFrame,
    max_distance: float | None = None,
    pairs: DataFrame | None = None,
    free: float = 1.0,
    other: float = 1.0,
    smallest_total: float | None = None,
) -> DataFrame:
    """(id1, id2, d): earth mover's distance of two share distributions on the tree.

    With an edge cost of ``free`` or ``other``, moving shares along the tree costs
    the weighted difference of the shares below each node, so the distance is the
    Manhattan distance of the node masses: exact, and without a transport plan.
    """
    masses = node_masses(bags, tree, free, other)
    if smallest_total is None:
        smallest_total = min(free, other)  # every share sits below a top-level node
    return B.manhattan_pairs(masses, max_distance, pairs, smallest_total)


def tree_emd_flows(
    bags: DataFrame, tree: DataFrame, pairs: DataFrame, free: float = 1.0, other: float = 1.0, least: float = 1e-10
) -> DataFrame:
    """(id1, id2, i, j, flow, cost): a cheapest plan that moves the shares of recipe id1 to
    those of id2 along the tree, for given pairs; flows above ``least``.

    From the leaves up, what a node's subtree has of supply and demand is matched below it
    as far as it goes, and the rest is handed to the parent: on a tree no plan is cheaper.
    Inside a node the two sides are laid end to end by ingredient, so a flow is where two
    stretches overlap.  A pair without a common item is matched at the root.  All of that is
    done where the pair is, in stacks of pairs (``pairwise.tree_flows``).
    """
    paths = tree.select("ingredient_id", "nodes").join(with_ones(tree), ["ingredient_id", "nodes"], "left")
    cells = bags.join(paths, "ingredient_id").select(
        "recipe_id", F.col("ingredient_id").cast("long").alias("ingredient_id"), F.col("w").cast("double").alias("w"), "nodes", "ones"
    )

    @F.arrow_udf("array<struct<i:long,j:long,flow:double,cost:double>>")
    def plans(first: pa.Array, second: pa.Array) -> pa.Array:
        return pairwise.tree_flows(first, second, float(free), float(other), least)

    met = B.with_sides(pairs, cells, "ingredient_id", "w", "nodes", "ones")
    # Not deterministic, to Spark: else it is done twice, first to see whether a plan is empty.
    plan = plans.asNondeterministic()("first", "second")
    return met.select("id1", "id2", plan.alias("plan")).select("id1", "id2", F.inline("plan"))


def substitution_weighted_pairs(
    bags: DataFrame,
    tree: DataFrame,
    max_distance: float | None = None,
    pairs: DataFrame | None = None,
    weight: float = 0.5,
) -> DataFrame:
    """(id1, id2, d): Manhattan distance in which a column may also be compared
    together with a column that can stand in for it, at ``weight`` of the price.

    A column takes the smaller of its plain difference and the weighted difference
    of the joint amounts, over all partners that are present crosswise.
    """
    tokens = substitution_tokens(tree)
    if pairs is None:
        if max_distance is None or not 0 <= max_distance < 2:
            raise ValueError("pass pairs or a max_distance below 2")
        # What is outside shared families counts in full on either side, so at least 1 - bound
        # of either recipe lies in families that the other one has, too, and what both lack of
        # that is no more than the bound.
        families = (
            bags.join(tokens, "ingredient_id")
            .groupBy("recipe_id", F.col("token").alias("ingredient_id"))
            .agg(F.sum("w").alias("w"))
        )
        need = max(1.0 - max_distance, B.SLACK * 2)
        pairs = B.near_overlaps(families, lambda _: F.lit(need), lambda _, __: F.lit(need), max_distance).select("id1", "id2")
    stand_ins = tokens.groupBy("ingredient_id").agg(F.collect_set("token").alias("tokens"))
    cells = bags.join(stand_ins, "ingredient_id", "left").select(
        "recipe_id", F.col("ingredient_id").cast("long").alias("ingredient_id"), F.col("w").cast("double").alias("w"), "tokens"
    )

    @F.arrow_udf("double")
    def distances(first: pa.Array, second: pa.Array) -> pa.Array:
        return pairwise.swap_distances(first, second, float(weight))

    met = B.with_sides(pairs, cells, "ingredient_id", "w", "tokens", how="left").where("first is not null or second is not null")
    # Not deterministic, to Spark: else it is done twice, first to see whether it is within the bound.
    out = met.select("id1", "id2", distances.asNondeterministic()("first", "second").alias("d"))
    return out if max_distance is None else out.where(F.col("d") <= max_distance + B.SLACK)
