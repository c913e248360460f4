"""Distances between bags of weighted items.

A full distance table has a row for every pair of recipes.  Here a distance is
asked for either a given table of pairs, or for all pairs up to a bound.  Two
exact steps keep the second form small:

* equal bags are collapsed first, so a crowd of copies is one bag with a count;
* a pair is only looked at when both bags hold a shared item among their rare
  ones.  If two bags must overlap by at least ``need``, the rarest item they
  share has to come before the point where the rest of a bag weighs less than
  ``need``.  Items that are in every bag rarely come that early.

Tables: bags and matrices are (recipe_id, ingredient_id, w).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendspark.operators.lineage import cut

SLACK = 1e-9
#: Decimals of the weights by which equal bags are told.
PLACES = 10


def collapse_copies(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bags, members): one bag per distinct content under its lowest recipe id,
    and (recipe_id, bag_id, copies) for every recipe.

    Contents are compared by two 64-bit digests that are combined without order,
    so no bag is ever collected.  Weights enter them with ``PLACES`` decimals: sums of
    the same amounts in another order differ behind those.  The matrix and the bags are read again and again
    by what follows, so both are kept in the checkpoint folder.
    """
    matrix = cut(matrix)
    weight = F.round(F.col("w").cast("double"), PLACES) + F.lit(0.0)  # no negative zero
    digests = matrix.groupBy("recipe_id").agg(
        F.bit_xor(F.xxhash64(F.lit(1), "ingredient_id", weight)).alias("_x"),
        F.bit_xor(F.xxhash64(F.lit(2), "ingredient_id", weight)).alias("_y"),
        F.count("*").alias("_n"),
    )
    groups = digests.groupBy("_x", "_y", "_n").agg(
        F.min("recipe_id").alias("bag_id"), F.count("*").alias("copies")
    )
    members = cut(digests.join(groups, ["_x", "_y", "_n"]).select("recipe_id", "bag_id", "copies"))
    kept = members.where("recipe_id = bag_id").select("recipe_id")
    return cut(matrix.join(kept, "recipe_id", "left_semi")), members


def copies_of(members: DataFrame) -> DataFrame:
    return members.where("recipe_id = bag_id").select("bag_id", "copies")


def totals_of(bags: DataFrame) -> DataFrame:
    return bags.groupBy("recipe_id").agg(F.sum("w").alias("total"))


#: Bags of an item that meet in one place; a more frequent item is split into tiles.
TILE = 2048


def ranked_cells(bags: DataFrame) -> DataFrame:
    """(recipe_id, ingredient_id, n, total, rest, items, weights): the cells with the number
    of bags of their item, what the bag weighs from there on when its items are taken
    rarest first (ties by id), and the whole bag in that order."""
    uses = bags.groupBy("ingredient_id").agg(F.count("*").alias("n"))
    own = Window.partitionBy("recipe_id").orderBy("n", "ingredient_id")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bags.join(uses, "ingredient_id").select(
        "recipe_id", "ingredient_id", "n", F.sum("w").over(whole).alias("total"),
        F.sum("w").over(own.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.collect_list("ingredient_id").over(whole).alias("items"), F.collect_list("w").over(whole).alias("weights"),
    )


def meet(left: DataFrame, right: DataFrame, wanted: Column) -> DataFrame:
    """(id1, id2, t1, t2, overlap, s1, s2) of the bags that meet on a cell of both sides and
    fit ``wanted`` (a condition on id1, id2, t1, t2, r1, r2 and other columns of the left side;
    those of cells that meet themselves are also there as of the right, with a 2 behind);
    s1 and s2 are what either bag weighs on the items of both.

    Bags come with their cells, so a pair is told at once whether this item is the first
    that they share (any later one is passed over, so no pair is met twice), and how much
    they overlap: nothing is joined again.  An item of more than ``TILE`` bags is dealt to
    tiles of a block of the left and a block of the right.  Cells that meet themselves are
    dealt to two blocks whatever their order, so both sides are the same rows and move once."""
    blocks = F.greatest(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("recipe_id"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))

    def side(cells: DataFrame, k: int, own: str, other: str) -> DataFrame:
        more = [c for c in cells.columns if c not in ("recipe_id", "ingredient_id", "n", "total", "rest", "items", "weights")]
        return cells.select(
            F.col("recipe_id").alias(f"id{k}"), "ingredient_id", F.col("total").alias(f"t{k}"), F.col("rest").alias(f"r{k}"),
            F.col("items").alias(f"items{k}"), F.col("weights").alias(f"weights{k}"), *more, mine.alias(own), every.alias(other),
        )

    if left is right:
        tiled = side(left, 1, "_own", "_other").withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other"))
        tiled = tiled.drop("_other").repartition("ingredient_id", "_a", "_b")
        names = {c: c.removesuffix("1") + "2" for c in tiled.columns if c not in ("ingredient_id", "_a", "_b")}
        met = tiled.join(tiled.withColumnsRenamed(names), ["ingredient_id", "_a", "_b"])
        met = met.where(((F.col("_a") == F.col("_b")) | (F.col("_own") != F.col("_own2"))) & wanted)
    else:
        met = side(left, 1, "_a", "_b").join(side(right, 2, "_b", "_a"), ["ingredient_id", "_a", "_b"]).where(wanted)
    shared = F.array_intersect("items1", "items2")
    weight = lambda k, x: F.get(f"weights{k}", F.array_position(f"items{k}", x) - 1)
    met = met.withColumn("_shared", shared).where(F.get("_shared", F.lit(0)) == F.col("ingredient_id"))
    overlap = F.aggregate("_shared", F.lit(0.0), lambda s, x: s + F.least(weight(1, x), weight(2, x)).cast("double"))
    held = lambda k: F.aggregate("_shared", F.lit(0.0), lambda s, x: s + weight(k, x).cast("double")).alias(f"s{k}")
    return met.select("id1", "id2", "t1", "t2", overlap.alias("overlap"), held(1), held(2))


def near_overlaps(
    bags: DataFrame,
    need: Callable[[Column], Column],
    need_pair: Callable[[Column, Column], Column],
    lost: float | None = None,
) -> DataFrame:
    """(id1, id2, t1, t2, overlap, s1, s2), id1 < id2: every pair whose overlap can reach what
    is needed.  Such bags share an item from where on both weigh that much.  ``lost``: how
    much of 1 the two may lack together on the items of both (s1, s2); others fall away."""
    rare = cut(ranked_cells(bags).where(F.col("rest") >= need(F.col("total")) - SLACK))
    reach = F.least("r1", "r2") >= need_pair(F.col("t1"), F.col("t2")) - SLACK
    if lost is None:
        return meet(rare, rare, (F.col("id1") < F.col("id2")) & reach)
    # What they share begins where they first meet, so there is no more of it than the rests.
    lacking = lambda a, b: F.greatest(1 - F.col(a), F.lit(0.0)) + F.greatest(1 - F.col(b), F.lit(0.0))
    met = meet(rare, rare, (F.col("id1") < F.col("id2")) & reach & (lacking("r1", "r2") <= lost + SLACK * 4))
    return met.where(lacking("s1", "s2") <= lost + SLACK * 4)


def _shared(bags: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """``overlap`` (sum of minima) of the pairs that share something."""
    first = bags.select(F.col("recipe_id").alias("id1"), "ingredient_id", F.col("w").alias("w1"))
    second = bags.select(F.col("recipe_id").alias("id2"), "ingredient_id", F.col("w").alias("w2"))
    return (
        pairs.join(first, "id1")
        .join(second, ["id2", "ingredient_id"])
        .groupBy("id1", "id2", *keys)
        .agg(F.sum(F.least("w1", "w2")).alias("overlap"))
    )


def pair_overlaps(bags: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for given pairs; those that share nothing stay, with overlap 0."""
    shared = _shared(bags, pairs)
    totals = totals_of(bags)
    return (
        pairs.join(shared, ["id1", "id2"], "left")
        .join(totals.select(F.col("recipe_id").alias("id1"), F.col("total").alias("t1")), "id1")
        .join(totals.select(F.col("recipe_id").alias("id2"), F.col("total").alias("t2")), "id2")
        .withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
        .select("id1", "id2", "t1", "t2", "overlap")
    )


def with_sides(pairs: DataFrame, cells: DataFrame, *fields: str, how: str = "inner") -> DataFrame:
    """Given pairs (id1, id2) with ``first`` and ``second``: the cells of either recipe, as an
    array of structs of the fields.

    A pair is one row, so only one side moves with it, and no row per pair of cells does.
    Rows end dealt by id1: what is grouped by both ids afterwards stays where it is.
    """
    whole = cells.groupBy("recipe_id").agg(F.collect_list(F.struct(*fields)).alias("_cells"))
    side = lambda k, name: whole.select(F.col("recipe_id").alias(f"id{k}"), F.col("_cells").alias(name))
    met = pairs.select("id1", "id2").join(side(2, "second"), "id2", how).join(side(1, "first"), "id1", how)
    return met.select("id1", "id2", "first", "second")


def _needed(max_distance: float, smallest_total: float) -> Callable[[Column], Column]:
    """Overlap that any pair within the bound has, seen from one of its rows."""
    if max_distance >= 2 * smallest_total:
        raise ValueError(
            "a bound of twice the smallest row total or more also takes pairs that share "
            "nothing; pass the pairs you want instead"
        )

    def need(total: Column) -> Column:
        checked = F.when(
            total < smallest_total - 1e-6, F.raise_error(F.lit("a row total is below smallest_total"))
        ).otherwise(total)
        partner = F.greatest(checked - max_distance, F.lit(float(smallest_total)))
        return (checked + partner - max_distance) / 2

    return need


def manhattan_pairs(
    bags: DataFrame,
    max_distance: float | None = None,
    pairs: DataFrame | None = None,
    smallest_total: float = 1.0,
) -> DataFrame:
    """(id1, id2, d): sum of absolute differences, for given pairs or up to a bound."""
    if pairs is not None:
        overlaps = pair_overlaps(bags, pairs)
    elif max_distance is not None:
        overlaps = near_overlaps(
            bags,
            _needed(max_distance, smallest_total),
            lambda t1, t2: (t1 + t2 - max_distance) / 2,
        )
    else:
        raise ValueError("pass pairs or max_distance")
    d = F.col("t1") + F.col("t2") - 2 * F.col("overlap")
    out = overlaps.select("id1", "id2", F.greatest(d, F.lit(0.0)).alias("d"))
    return out if max_distance is None else out.where(F.col("d") <= max_distance + SLACK)


def _as_sets(bags: DataFrame) -> DataFrame:
    return bags.where("w > 0").select("recipe_id", "ingredient_id").distinct().withColumn("w", F.lit(1.0))


def jaccard_pairs(bags: DataFrame, max_distance: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(id1, id2, d): 1 - shared / united items."""
    sets = _as_sets(bags)
    if pairs is not None:
        overlaps = pair_overlaps(sets, pairs)
    elif max_distance is not None and 0 <= max_distance < 1:
        least = 1 - max_distance
        overlaps = near_overlaps(
            sets, lambda n: n * least, lambda n1, n2: (n1 + n2) * (least / (1 + least))
        )
    else:
        raise ValueError("pass pairs or a max_distance below 1")
    d = 1 - F.col("overlap") / (F.col("t1") + F.col("t2") - F.col("overlap"))
    out = overlaps.select("id1", "id2", d.alias("d"))
    return out if max_distance is None else out.where(F.col("d") <= max_distance + SLACK)


#: Sets of up to so many items, and bounds up to so many edits, are joined on what is left
#: when some items are taken away; others meet on their rare items.
MOST_ITEMS, MOST_EDITS = 32, 3


def _choices(items: Column, k: int) -> Column:
    """All ways to take k of the items, in their order."""
    if k == 0:
        return F.array(F.slice(items, 1, 0))
    return F.flatten(F.transform(items, lambda x, i: F.transform(
        _choices(F.slice(items, i + 2, F.size(items)), k - 1), lambda rest: F.concat(F.array(x), rest)
    )))


def _left_overs(sets: DataFrame, most: int) -> DataFrame:
    """(recipe_id, n, x, y, kept, gone): every set with up to ``most`` items taken away and
    at least one kept; x and y are digests of what is kept."""
    digest = lambda k, item: F.xxhash64(F.lit(k), item)
    whole = sets.groupBy("recipe_id").agg(
        F.count("*").alias("n"), F.bit_xor(digest(1, "ingredient_id")).alias("_x"), F.bit_xor(digest(2, "ingredient_id")).alias("_y"),
        F.array_sort(F.collect_list("ingredient_id")).alias("items"),
    )
    ways = F.concat(*(_choices(F.col("items"), k) for k in range(most + 1)))
    rows = whole.select("recipe_id", "n", "_x", "_y", F.explode(ways).alias("gone")).withColumn("kept", F.col("n") - F.size("gone"))
    less = lambda k, start: F.aggregate("gone", F.col(start), lambda h, g: h.bitwiseXOR(digest(k, g)))
    return rows.where("kept > 0").select("recipe_id", "n", less(1, "_x").alias("x"), less(2, "_y").alias("y"), "kept", "gone")


def _edited(sets: DataFrame, max_distance: int) -> DataFrame:
    """(id1, id2, n1, n2, only1, only2): pairs of sets that share something and differ in up
    to ``max_distance`` items, with the items that each has alone.

    Both sets without their own items are the same set, so the pair meets on its digest,
    and only there with nothing common among what was taken away: no pair is met twice.
    """
    rows = _left_overs(sets, max_distance)
    left = rows.select(F.col("recipe_id").alias("id1"), F.col("n").alias("n1"), "x", "y", "kept", F.col("gone").alias("only1"))
    right = rows.select(F.col("recipe_id").alias("id2"), F.col("n").alias("n2"), "x", "y", "kept", F.col("gone").alias("only2"))
    met = left.join(right, ["x", "y", "kept"]).where("id1 < id2").where(F.size("only1") + F.size("only2") <= max_distance)
    return met.where(~F.arrays_overlap("only1", "only2")).select("id1", "id2", "n1", "n2", "only1", "only2")


def edit_distance_pairs(bags: DataFrame, max_distance: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(id1, id2, n1, n2, d): size of the symmetric difference of the item sets.

    With a bound, pairs that share at least one item; two sets that share nothing are
    ``n1 + n2`` apart and are told by ``apart_classes``, one row a set and size.
    """
    sets = _as_sets(bags)
    if pairs is None and max_distance is None:
        raise ValueError("pass pairs or max_distance")
    if pairs is not None:
        overlaps = pair_overlaps(sets, pairs)
    else:
        sizes = totals_of(sets)
        short = max_distance <= MOST_EDITS
        long = sizes.where(F.col("total") > (MOST_ITEMS - max_distance if short else 0))
        overlaps = near_overlaps(
            sets.join(long.select("recipe_id"), "recipe_id", "left_semi"),
            lambda n: F.greatest(n - max_distance, F.lit(1.0)),
            lambda n1, n2: F.greatest((n1 + n2 - max_distance) / 2, F.lit(1.0)),
        )
        if short:
            overlaps = overlaps.where(F.greatest("t1", "t2") > MOST_ITEMS)
    out = overlaps.select(
        "id1",
        "id2",
        F.col("t1").cast("long").alias("n1"),
        F.col("t2").cast("long").alias("n2"),
        (F.col("t1") + F.col("t2") - 2 * F.col("overlap")).cast("long").alias("d"),
    )
    if max_distance is None:
        return out
    out = out.where(F.col("d") <= max_distance)
    if not short:
        return out
    few = sets.join(sizes.where(F.col("total") <= MOST_ITEMS).select("recipe_id"), "recipe_id", "left_semi")
    near = _edited(few, max_distance)
    return near.select("id1", "id2", "n1", "n2", (F.size("only1") + F.size("only2")).cast("long").alias("d")).unionByName(out)


def apart_classes(bags: DataFrame, max_distance: int) -> DataFrame:
    """(recipe_id, n, partner_n, d, apart): for every set and partner size within the
    bound, how many other sets of this size share nothing with it; those lie d = n +
    partner_n apart.  The sets of a size are the members of the class, so pairs that
    share nothing need no list of their own."""
    sets = _as_sets(bags)
    sizes = cut(totals_of(sets).where(F.col("total") < max_distance).select("recipe_id", F.col("total").cast("long").alias("n")))
    small = sets.join(sizes.select("recipe_id"), "recipe_id", "left_semi")
    near = edit_distance_pairs(small, max_distance).where(F.col("n1") + F.col("n2") <= max_distance)
    sharing = (
        near.select(F.col("id1").alias("recipe_id"), F.col("n2").alias("partner_n"))
        .unionByName(near.select(F.col("id2").alias("recipe_id"), F.col("n1").alias("partner_n")))
        .groupBy("recipe_id", "partner_n").agg(F.count("*").alias("_sharing"))
    )
    classes = sizes.groupBy(F.col("n").alias("partner_n")).agg(F.count("*").alias("_all"))
    own = (F.col("n") == F.col("partner_n")).cast("long")
    return (
        sizes.withColumn("partner_n", F.explode(F.sequence(F.lit(1).cast("long"), max_distance - F.col("n"))))
        .join(classes, "partner_n").join(sharing, ["recipe_id", "partner_n"], "left")
        .select("recipe_id", "n", "partner_n", (F.col("n") + F.col("partner_n")).alias("d"), (F.col("_all") - own - F.coalesce("_sharing", F.lit(0))).alias("apart"))
        .where("apart > 0")
    )


def hamming_pairs(bags: DataFrame, max_columns: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(id1, id2, d): share of all columns in which two item sets differ; up to a bound,
    of sets that share an item (the others: ``apart_classes``)."""
    columns = bags.where("w > 0").select(F.countDistinct("ingredient_id").alias("m")).first()["m"]
    out = edit_distance_pairs(bags, max_columns, pairs)
    return out.select("id1", "id2", (F.col("d") / F.lit(float(max(columns, 1)))).alias("d"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Every pair from the view of each of its ends."""
    others = [c for c in pairs.columns if c not in ("id1", "id2")]
    turned = pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), *others)
    return pairs.select("id1", "id2", *others).unionByName(turned)


def edit_distance_counts(bags: DataFrame, members: DataFrame, distance: int = 2) -> DataFrame:
    """(recipe_id, n_pairs): how many recipes are exactly ``distance`` edits away.

    Sharing pairs are counted with their copies.  Sets that share nothing are
    that far away when their sizes add up to it: all recipes of the fitting size,
    less those that do share something.
    """
    sets = _as_sets(bags)
    near = edit_distance_pairs(sets, distance)
    copies = copies_of(members)
    sizes = (
        totals_of(sets)
        .select(F.col("recipe_id").alias("bag_id"), F.col("total").cast("long").alias("n"))
        .join(copies, "bag_id")
    )
    seen = both_ways(near.select("id1", "id2", "d", F.col("n1").alias("_a"), F.col("n2").alias("_b")))
    sharing = (
        seen.join(copies.withColumnRenamed("bag_id", "id2"), "id2")
        .groupBy(F.col("id1").alias("bag_id"))
        .agg(
            F.sum(F.when(F.col("d") == distance, F.col("copies")).otherwise(0)).alias("_at"),
            F.sum(F.when(F.col("_a") + F.col("_b") == distance, F.col("copies")).otherwise(0)).alias("_fits"),
        )
    )
    by_size = sizes.groupBy((F.lit(distance) - F.col("n")).alias("n")).agg(F.sum("copies").alias("_all"))
    own = F.when(F.col("n") * 2 == distance, F.col("copies")).otherwise(0)
    zero = F.lit(0)
    per_bag = (
        sizes.join(sharing, "bag_id", "left")
        .join(by_size, "n", "left")
        .select(
            "bag_id",
            (
                F.coalesce("_at", zero) + F.coalesce("_all", zero) - F.coalesce("_fits", zero)
                - F.when(F.col("_all").isNotNull(), own).otherwise(zero)
            ).alias("n_pairs"),
        )
    )
    return members.join(per_bag, "bag_id").select("recipe_id", "n_pairs")


def hamming_counts(bags: DataFrame, max_columns: int) -> DataFrame:
    """(recipe_id, near): how many other sets differ in at most so many columns, whether
    they share an item or not."""
    sets = _as_sets(bags)
    near = both_ways(edit_distance_pairs(sets, max_columns).select("id1", "id2", "d"))
    counts = near.groupBy(F.col("id1").alias("recipe_id")).agg(F.count("*").alias("_near")).unionByName(
        apart_classes(sets, max_columns).groupBy("recipe_id").agg(F.sum("apart").alias("_near"))
    )
    every = sets.select("recipe_id").distinct().withColumn("_near", F.lit(0).cast("long"))
    return counts.unionByName(every).groupBy("recipe_id").agg(F.sum("_near").alias("near"))


def one_swap_edges(bags: DataFrame, distance: int = 2) -> DataFrame:
    """(id1, id2, only1, only2): sharing pairs at exactly that distance with the
    items each has alone.  Sets that share nothing: ``apart_classes``."""
    sets = _as_sets(bags)
    if distance <= MOST_EDITS:
        sizes = totals_of(sets)
        few = sets.join(sizes.where(F.col("total") <= MOST_ITEMS).select("recipe_id"), "recipe_id", "left_semi")
        near = _edited(few, distance).where(F.size("only1") + F.size("only2") == distance).select("id1", "id2", "only1", "only2")
        many = sizes.where(F.col("total") > MOST_ITEMS - distance).select("recipe_id", "total")
        sets = sets.join(many.select("recipe_id"), "recipe_id", "left_semi")
    edges = edit_distance_pairs(sets, distance).where(F.col("d") == distance)
    if distance <= MOST_EDITS:
        edges = edges.where(F.greatest("n1", "n2") > MOST_ITEMS)
    edges = edges.select("id1", "id2")
    first = sets.select(F.col("recipe_id").alias("id1"), "ingredient_id", F.lit(1).alias("side"))
    second = sets.select(F.col("recipe_id").alias("id2"), "ingredient_id", F.lit(2).alias("side"))
    alone = (
        edges.join(first, "id1")
        .unionByName(edges.join(second, "id2"))
        .groupBy("id1", "id2", "ingredient_id")
        .agg(F.count("*").alias("_n"), F.min("side").alias("side"))
        .where("_n = 1")
    )
    # At most ``distance`` items per edge are gathered here.
    listed = alone.groupBy("id1", "id2").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("ingredient_id")))).alias("only1"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 2, F.col("ingredient_id")))).alias("only2"),
    )
    return near.unionByName(listed) if distance <= MOST_EDITS else listed


def named_swaps(edges: DataFrame, items: DataFrame, recipes: DataFrame) -> DataFrame:
    """(id1, id2, recipe_name1, recipe_name2, item_names): swap edges with the names of both
    recipes and of the items that only one of them has, by id."""
    differing = edges.select("id1", "id2", F.explode(F.concat("only1", "only2")).alias("ingredient_id"))
    names = (
        differing.join(items.select("ingredient_id", "ingredient_name"), "ingredient_id").groupBy("id1", "id2")
        .agg(F.array_sort(F.collect_list(F.struct("ingredient_id", "ingredient_name"))).alias("_items"))
    )
    name = lambda k: recipes.select(F.col("recipe_id").alias(f"id{k}"), F.col("recipe_name").alias(f"recipe_name{k}"))
    named = names.join(name(1), "id1").join(name(2), "id2")
    return named.select("id1", "id2", "recipe_name1", "recipe_name2", F.transform("_items", lambda x: x["ingredient_name"]).alias("item_names"))


def edits_from(bags: DataFrame, recipe_id: int, distance: int) -> DataFrame:
    """Recipes exactly ``distance`` edits from one recipe, by id."""
    sets = _as_sets(bags)
    own = sets.where(F.col("recipe_id") == recipe_id).select("ingredient_id")
    mine = own.agg(F.count("*").alias("n")).first()["n"]
    shared = sets.join(own, "ingredient_id", "left_semi").groupBy("recipe_id").agg(F.count("*").alias("c"))
    d = (F.col("total") + mine - 2 * F.coalesce("c", F.lit(0))).cast("long")
    return (
        totals_of(sets)
        .join(shared, "recipe_id", "left")
        .select("recipe_id", d.alias("d"))
        .where((F.col("d") == distance) & (F.col("recipe_id") != recipe_id))
    )
