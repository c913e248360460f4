"""Queries over the ingredient tree, transport plans and learned costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendspark.functions.numeric import r6
from blendspark.operators import bags as B
from blendspark.operators import costs as C
from blendspark.operators import neighbours as N
from blendspark.operators import transport as TP
from blendspark.operators import trees as TR
from blendspark.operators.lineage import cut
from blendspark.plans import standins as S
from blendspark.plans.registry import query
from blendspark.plans.standins import r6 as sql6
from blendspark.plans.tables import bags_of, nearest_recipes

# The tree is three levels deep: type, brand, part.
LEVELS = """
    SELECT item_id AS id, type_id, brand_id, item_path, brand_path, brand_no % 2 AS brand_level,
           coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size % 2 END, 0) AS leaf_level FROM parts"""
EDGES = """
    SELECT id1, id2, CASE WHEN a.id = b.id THEN 0 ELSE a.leaf_level + b.leaf_level
            + CASE WHEN a.brand_id <> b.brand_id THEN a.brand_level + b.brand_level ELSE 0 END END AS substitutable,
        CASE WHEN a.id = b.id THEN 0 WHEN a.brand_id = b.brand_id THEN 2 WHEN a.type_id = b.type_id THEN 4 ELSE 6 END AS edges
    FROM {pairs} JOIN levels a ON a.id = id1 JOIN levels b ON b.id = id2"""


@query(
    "substitution_tokens",
    S.sql("""SELECT ingredient_id, path AS token FROM tree UNION ALL
        SELECT ingredient_id, parent_path FROM tree WHERE substitution_level = 1 AND parent_path IS NOT NULL"""),
)
def substitution_tokens(spark, sf):
    return TR.substitution_tokens(S.tree(spark, sf))


_PAIRS_AND_PARENTS = """SELECT id1, id2 FROM item_pairs UNION SELECT ingredient_id, parent_id FROM ingredients WHERE parent_id IS NOT NULL"""


def family_pairs(spark, sf):
    own = S.ingredients(spark, sf).where("parent_id is not null").select(
        F.col("ingredient_id").alias("id1"), F.col("parent_id").alias("id2")
    )
    return S.item_pairs(spark, sf).unionByName(own).distinct()


@query(
    "substitutable_pairs",
    S.sql(
        """SELECT id1, id2, coalesce(a.substitution_level = 1 AND b.substitution_level = 1 AND a.parent_path = b.parent_path, FALSE)
            OR coalesce(a.substitution_level = 1 AND a.parent_path = b.path, FALSE)
            OR coalesce(b.substitution_level = 1 AND b.parent_path = a.path, FALSE) AS substitutable
        FROM family_pairs JOIN tree a ON a.ingredient_id = id1 JOIN tree b ON b.ingredient_id = id2""",
        family_pairs=_PAIRS_AND_PARENTS,
    ),
)
def substitutable_pairs(spark, sf):
    return TR.substitutable_pairs(S.tree(spark, sf), family_pairs(spark, sf))


_E = {"levels": LEVELS, "edges": EDGES.format(pairs="item_pairs")}


@query("tree_distance_pairs", S.sql("SELECT id1, id2, substitutable, edges - substitutable AS other FROM edges", **_E))
def tree_distance_pairs(spark, sf):
    return TR.tree_distance_pairs(S.tree(spark, sf), S.item_pairs(spark, sf))


@query("exp_tree_distance_pairs", S.sql("SELECT id1, id2, CASE WHEN edges = 0 THEN 0.0 ELSE pow(3.0, edges) END AS d FROM edges", **_E))
def exp_tree_distance_pairs(spark, sf):
    return TR.exp_tree_distance_pairs(S.tree(spark, sf), S.item_pairs(spark, sf))


def volume_cells(spark, sf):
    return cut(
        S.fractions(spark, sf).where("volume_fraction is not null")
        .groupBy("recipe_id", "ingredient_id").agg(F.sum("volume_fraction").alias("volume_fraction"))
    )


_COSTS = {
    "levels": LEVELS,
    "volume_cells": "SELECT recipe_id, ingredient_id, sum(volume_fraction) AS v FROM fractions WHERE volume_fraction IS NOT NULL GROUP BY ALL",
    "met": """SELECT id1 AS r1, id2 AS r2, a.ingredient_id AS id1, b.ingredient_id AS id2, a.v AS v1, b.v AS v2
        FROM recipe_pairs JOIN volume_cells a ON a.recipe_id = id1 JOIN volume_cells b ON b.recipe_id = id2""",
    "kinds": "SELECT DISTINCT id1, id2 FROM met",
    "edges": EDGES.format(pairs="kinds"),
    "costs": "SELECT r1, r2, id1 AS i, id2 AS j, v1, v2, 2.0 * edges - substitutable AS k FROM met JOIN edges USING (id1, id2)",
}


def costs_of(spark, sf):
    return TR.ingredient_costs(volume_cells(spark, sf), S.recipe_pairs(spark, sf), S.tree(spark, sf), TR.linear(1), TR.linear(2))


@query(
    "weighted_volume_cost",
    S.sql(f"SELECT r1, r2, i, j, k, {sql6('abs(v1 - v2) * (k + 1) + k')} AS cost FROM costs", **_COSTS),
)
def weighted_volume_cost(spark, sf):
    out = TR.weighted_volume_cost(costs_of(spark, sf))
    return out.select("r1", "r2", "i", "j", "k", r6(F.col("cost")).alias("cost"))


@query("assignment_distance_pairs")
def assignment_distance_pairs(spark, sf):
    out = TP.assignment_distance_pairs(TR.weighted_volume_cost(costs_of(spark, sf)))
    out = out.select("r1", "r2", "d", F.size("matches").alias("n_matches"))  # no list moves on
    out = TP.with_empty_sides(out, S.recipe_pairs(spark, sf), S.fractions(spark, sf))
    return out.select("r1", "r2", r6(F.col("d")).alias("d"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


@query("entropic_ot_pairs")
def entropic_ot_pairs(spark, sf):
    out = TP.entropic_ot_pairs(costs_of(spark, sf), "k", eps=0.1, iterations=500)
    out = out.select("r1", "r2", "d", F.size("plan").alias("n_flows"))
    out = TP.with_empty_sides(out, S.recipe_pairs(spark, sf), S.fractions(spark, sf))
    return out.select("r1", "r2", r6(F.col("d")).alias("d"), F.coalesce("n_flows", F.lit(0)).alias("n_flows"))


# What holds for any transport: every given pair has a distance, and one without a
# volume on either side pays what the other side has.
_SIDES = {
    "held": "SELECT recipe_id, count(DISTINCT ingredient_id) AS n, sum(volume_fraction) AS t FROM fractions WHERE volume_fraction IS NOT NULL GROUP BY ALL",
    "one_sided": f"""SELECT id1 AS r1, id2 AS r2, {sql6('coalesce(a.t, 0) + coalesce(b.t, 0)')} AS d FROM recipe_pairs
        LEFT JOIN held a ON a.recipe_id = id1 LEFT JOIN held b ON b.recipe_id = id2 WHERE a.n IS NULL OR b.n IS NULL""",
}


@query("one_sided_pairs", S.sql("SELECT r1, r2, d FROM one_sided", **_SIDES))
def one_sided_pairs(spark, sf):
    return assignment_distance_pairs(spark, sf).where("n_matches = 0").select("r1", "r2", "d")


_EMD = {
    "levels": LEVELS,
    "masses": """SELECT recipe_id, node, any_value(weight) * sum(w) AS w FROM (
            SELECT recipe_id, w, type_id AS node, 2.0 AS weight FROM {m} JOIN levels ON id = ingredient_id
            UNION ALL SELECT recipe_id, w, brand_id, 2.0 - brand_level FROM {m} JOIN levels ON id = ingredient_id
            UNION ALL SELECT recipe_id, w, id, 2.0 - leaf_level FROM {m} JOIN levels ON id = ingredient_id) GROUP BY recipe_id, node""",
    "mass_totals": "SELECT recipe_id, sum(w) AS t FROM masses GROUP BY recipe_id",
}


@query(
    "tree_emd_pairs",
    S.sql(
        f"""SELECT id1, id2, {sql6('d')} AS d FROM (SELECT id1, id2, greatest(a.t + b.t - 2 * o, 0) AS d FROM (
            SELECT x.recipe_id AS id1, y.recipe_id AS id2, sum(least(x.w, y.w)) AS o
            FROM masses x JOIN masses y ON x.node = y.node AND x.recipe_id < y.recipe_id
            WHERE (x.recipe_id, y.recipe_id) IN (SELECT (x.recipe_id, y.recipe_id) FROM masses x JOIN masses y
                ON x.node = y.node AND x.node > 1000 AND x.recipe_id < y.recipe_id) GROUP BY ALL)
            JOIN mass_totals a ON a.recipe_id = id1 JOIN mass_totals b ON b.recipe_id = id2) WHERE d <= 0.8 + 1e-9""",
        **{**_EMD, "masses": _EMD["masses"].format(m="bags")},
    ),
)
def tree_emd_pairs(spark, sf):
    bags, _ = bags_of(spark, sf)
    out = TR.tree_emd_pairs(bags, S.tree(spark, sf), 0.8, free=1.0, other=2.0, smallest_total=4.0)
    return out.withColumn("d", r6(F.col("d")))


@query(
    "tree_emd_given_pairs",
    S.sql(
        f"""SELECT id1, id2, {sql6('greatest(a.t + b.t - 2 * coalesce(o, 0), 0)')} AS d FROM recipe_pairs
        LEFT JOIN (SELECT id1, id2, sum(least(x.w, y.w)) AS o FROM recipe_pairs JOIN masses x ON x.recipe_id = id1
            JOIN masses y ON y.recipe_id = id2 AND x.node = y.node GROUP BY ALL) USING (id1, id2)
        JOIN mass_totals a ON a.recipe_id = id1 JOIN mass_totals b ON b.recipe_id = id2""",
        **{**_EMD, "masses": _EMD["masses"].format(m="matrix")},
    ),
)
def tree_emd_given_pairs(spark, sf):
    out = TR.tree_emd_pairs(
        cut(S.matrix(spark, sf)), S.tree(spark, sf), pairs=S.recipe_pairs(spark, sf), free=1.0, other=2.0
    )
    return out.withColumn("d", r6(F.col("d")))


def flows_of(spark, sf):
    return TR.tree_emd_flows(cut(S.matrix(spark, sf)), S.tree(spark, sf), S.recipe_pairs(spark, sf), free=1.0, other=2.0)


@query(
    "tree_emd_flow_totals",
    S.sql(
        f"""SELECT id1, id2, {sql6('greatest(a.t + b.t - 2 * coalesce(o, 0), 0)')} AS d, 1.0 AS moved FROM recipe_pairs
        LEFT JOIN (SELECT id1, id2, sum(least(x.w, y.w)) AS o FROM recipe_pairs JOIN masses x ON x.recipe_id = id1
            JOIN masses y ON y.recipe_id = id2 AND x.node = y.node GROUP BY ALL) USING (id1, id2)
        JOIN mass_totals a ON a.recipe_id = id1 JOIN mass_totals b ON b.recipe_id = id2""",
        **{**_EMD, "masses": _EMD["masses"].format(m="matrix")},
    ),
)
def tree_emd_flow_totals(spark, sf):
    """The rows of the plans add up to the distance, and move everything."""
    totals = flows_of(spark, sf).groupBy("id1", "id2").agg(F.sum("cost").alias("d"), F.sum("flow").alias("moved"))
    return totals.select("id1", "id2", r6(F.col("d")).alias("d"), r6(F.col("moved")).alias("moved"))


@query(
    "tree_emd_flow_sides",
    S.sql(
        f"""SELECT id1, id2, ingredient_id, {sql6('sum(a)')} AS gives, {sql6('sum(b)')} AS takes FROM (
            SELECT id1, id2, ingredient_id, w AS a, 0.0 AS b FROM recipe_pairs JOIN matrix ON recipe_id = id1
            UNION ALL SELECT id1, id2, ingredient_id, 0.0, w FROM recipe_pairs JOIN matrix ON recipe_id = id2)
        WHERE id1 IN (SELECT recipe_id FROM matrix) AND id2 IN (SELECT recipe_id FROM matrix) GROUP BY ALL""",
    ),
)
def tree_emd_flow_sides(spark, sf):
    """What each ingredient gives and takes in a plan: its shares in the two recipes."""
    flows, zero = flows_of(spark, sf), F.lit(0.0)
    both = F.array(
        F.struct(F.col("i").alias("ingredient_id"), F.col("flow").alias("a"), zero.alias("b")),
        F.struct(F.col("j").alias("ingredient_id"), zero.alias("a"), F.col("flow").alias("b")),
    )
    sides = flows.select("id1", "id2", F.inline(both))
    sums = sides.groupBy("id1", "id2", "ingredient_id").agg(F.sum("a").alias("gives"), F.sum("b").alias("takes"))
    return sums.select("id1", "id2", "ingredient_id", r6(F.col("gives")).alias("gives"), r6(F.col("takes")).alias("takes"))


_SWAPS = {
    "tokens": """SELECT ingredient_id, path AS token FROM tree UNION ALL
        SELECT ingredient_id, parent_path FROM tree WHERE substitution_level = 1 AND parent_path IS NOT NULL""",
    "pair_cells": """SELECT id1, id2, ingredient_id, sum(a) AS a, sum(b) AS b FROM (
            SELECT id1, id2, ingredient_id, w AS a, 0.0 AS b FROM wanted JOIN {m} ON recipe_id = id1
            UNION ALL SELECT id1, id2, ingredient_id, 0.0, w FROM wanted JOIN {m} ON recipe_id = id2) GROUP BY ALL""",
    "swaps": """SELECT x.id1, x.id2, x.ingredient_id AS i, y.ingredient_id AS j, 0.1 * abs(x.a + y.a - x.b - y.b) AS s
        FROM pair_cells x JOIN pair_cells y ON x.id1 = y.id1 AND x.id2 = y.id2 AND x.ingredient_id <> y.ingredient_id
            AND ((x.a > 0 AND y.b > 0) OR (y.a > 0 AND x.b > 0))
        WHERE EXISTS (SELECT 1 FROM tokens s JOIN tokens t ON s.token = t.token
            WHERE s.ingredient_id = x.ingredient_id AND t.ingredient_id = y.ingredient_id)""",
    "swap_distances": """SELECT c.id1, c.id2, sum(least(abs(a - b), coalesce(m, abs(a - b)))) AS d FROM pair_cells c
        LEFT JOIN (SELECT id1, id2, i, min(s) AS m FROM swaps GROUP BY ALL) s ON s.id1 = c.id1 AND s.id2 = c.id2 AND s.i = c.ingredient_id GROUP BY ALL""",
}


@query(
    "substitution_weighted_given_pairs",
    S.sql(
        f"SELECT id1, id2, {sql6('d')} AS d FROM swap_distances",
        **{**_SWAPS, "pair_cells": _SWAPS["pair_cells"].format(m="matrix")},
        wanted="SELECT * FROM recipe_pairs",
    ),
)
def substitution_weighted_given_pairs(spark, sf):
    out = TR.substitution_weighted_pairs(
        cut(S.matrix(spark, sf)), S.tree(spark, sf), pairs=S.recipe_pairs(spark, sf), weight=0.1
    )
    return out.withColumn("d", r6(F.col("d")))


@query(
    "substitution_weighted_pairs",
    S.sql(
        f"SELECT id1, id2, {sql6('d')} AS d FROM swap_distances WHERE d <= 0.25 + 1e-9",
        **{**_SWAPS, "pair_cells": _SWAPS["pair_cells"].format(m="bags")},
        families="SELECT recipe_id, token, sum(w) AS w FROM bags JOIN tokens USING (ingredient_id) GROUP BY ALL",
        wanted="""SELECT x.recipe_id AS id1, y.recipe_id AS id2 FROM families x JOIN families y
            ON x.token = y.token AND x.recipe_id < y.recipe_id GROUP BY ALL HAVING sum(x.w) > 0.7 AND sum(y.w) > 0.7""",
    ),
)
def substitution_weighted_pairs(spark, sf):
    bags, _ = bags_of(spark, sf)
    out = TR.substitution_weighted_pairs(bags, S.tree(spark, sf), 0.25, weight=0.1)
    return out.withColumn("d", r6(F.col("d")))


_FLOWS = """SELECT l_orderkey AS r1, l_suppkey AS r2, l_partkey AS i, l_linenumber AS j, sum(l_quantity) AS flow FROM lineitem GROUP BY ALL"""


@query(
    "sparsify_plan",
    S.sql("""SELECT r1, r2, i, j, flow FROM (SELECT *, sum(flow) OVER (PARTITION BY r1, r2) AS whole FROM (
        SELECT *, row_number() OVER (PARTITION BY r1, r2, i ORDER BY flow DESC, j) AS r FROM flows) WHERE r <= 2) WHERE flow >= whole * 0.3""", flows=_FLOWS),
)
def sparsify_plan(spark, sf):
    flows = S.table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("r1"), F.col("l_suppkey").alias("r2"), F.col("l_partkey").alias("i"), F.col("l_linenumber").alias("j")
    ).agg(F.sum("l_quantity").alias("flow"))
    return TP.sparsify_plan(flows, 2, 0.3)


# Matches: the product plan of every near pair stands in for a transport plan.
_LEARN = {
    "levels": LEVELS,
    "near": "SELECT least(id, neighbour) AS id1, greatest(id, neighbour) AS id2, any_value(d) AS d FROM nearest GROUP BY ALL",
    "plan": """SELECT id1 AS r1, id2 AS r2, x.ingredient_id AS i, y.ingredient_id AS j, round(x.w * y.w, 9) AS flow
        FROM near JOIN matrix x ON x.recipe_id = id1 JOIN matrix y ON y.recipe_id = id2""",
    "two_way": "SELECT id1, id2, d FROM near UNION ALL SELECT id2, id1, d FROM near",
    "lists": """SELECT id1 AS r1, id2 AS r2, exp(-6.0 * (d - min(d) OVER (PARTITION BY id1))) AS e FROM (
        SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS r FROM two_way) WHERE r <= 10""",
    "weights": "SELECT r1, r2, e / (sum(e) OVER (PARTITION BY r1) + 1e-12) AS weight FROM lists",
    "ways": "SELECT r1, r2, i, j, flow FROM plan UNION ALL SELECT r2, r1, j, i, flow FROM plan",
    "topped": """SELECT * FROM (SELECT w.*, weight, row_number() OVER (PARTITION BY r1, r2, i ORDER BY flow DESC, j) AS r
        FROM ways w JOIN weights USING (r1, r2)) WHERE r <= 2""",
    "kept": "SELECT * FROM (SELECT *, sum(flow) OVER (PARTITION BY r1, r2) AS whole FROM topped) WHERE flow >= whole * 1e-3",
    "matches": """SELECT i, j, sum(t) AS t FROM (SELECT i, j, flow * weight / 2 AS t FROM kept
        UNION ALL SELECT j, i, flow * weight / 2 FROM kept) GROUP BY ALL""",
    "grid": """SELECT DISTINCT i AS id1, j AS id2 FROM plan UNION SELECT DISTINCT j, i FROM plan
        UNION SELECT DISTINCT ingredient_id, ingredient_id FROM matrix""",
    "grid_edges": EDGES.format(pairs="grid"),
    "prior": "SELECT id1 AS i, id2 AS j, 10.0 * edges - 9.0 * substitutable AS cost FROM grid_edges",
}


def near_pairs(spark, sf):
    """The matrix, and the pairs of every recipe with its ten nearest."""
    lists = nearest_recipes(spark, sf)
    pairs = lists.groupBy(F.least("id", "neighbour").alias("id1"), F.greatest("id", "neighbour").alias("id2")).agg(F.min("d").alias("d"))
    return cut(S.matrix(spark, sf)), cut(pairs)


def matches_of(spark, sf, whole=False):
    """Matches, and the costs they start from: of the ingredient pairs that near recipes bring
    together, or of every two ingredients."""
    bags, near = near_pairs(spark, sf)
    first = bags.select(F.col("recipe_id").alias("r1"), F.col("ingredient_id").alias("i"), F.col("w").alias("v1"))
    second = bags.select(F.col("recipe_id").alias("r2"), F.col("ingredient_id").alias("j"), F.col("w").alias("v2"))
    plan = (
        near.select(F.col("id1").alias("r1"), F.col("id2").alias("r2")).join(first, "r1").join(second, "r2")
        .withColumn("flow", F.round(F.col("v1") * F.col("v2"), 9))
    )
    tree = S.tree(spark, sf)
    prior = C.square_cost(tree, bags) if whole else C.met_cost(tree, bags, near)
    return C.expected_matches(near, plan), prior


@query("expected_matches", S.sql(f"SELECT i, j, {sql6('t')} AS t FROM matches", **_LEARN))
def expected_matches(spark, sf):
    return matches_of(spark, sf)[0].withColumn("t", r6(F.col("t")))


@query("initial_cost", S.sql("SELECT i, j, cost FROM prior", **_LEARN))
def initial_cost(spark, sf):
    return matches_of(spark, sf)[1]


# A lopsided table, to see the symmetric part being taken.
_LOPSIDED = "SELECT i, j, cost / 7 + CASE WHEN i < j THEN 0.5 ELSE 0 END AS cost FROM prior"
_SQL = {
    **_LEARN,
    "lopsided": _LOPSIDED,
    "projected": """SELECT a.i, a.j, CASE WHEN a.i = a.j THEN 0.0 ELSE least(greatest((a.cost + b.cost) / 2, 0.0), 8.0) END AS cost
        FROM lopsided a JOIN lopsided b ON a.i = b.j AND a.j = b.i""",
    "grid_cells": """SELECT p.i, p.j, p.cost AS prior, p.cost AS cost, coalesce(t, 0) AS t FROM prior p LEFT JOIN matches m ON m.i = p.i AND m.j = p.j""",
    "blosum": """SELECT *, -ln((t + 2) / ((sum(t) OVER (PARTITION BY i) + 2) * (sum(t) OVER (PARTITION BY j) + 2)
        / (sum(t) OVER () + 2 * (SELECT count(DISTINCT i) FROM grid_cells) ** 2) + 1e-12) + 1e-12) AS proposal FROM grid_cells""",
    "convex": "SELECT *, prior - t / 0.02 AS proposal FROM grid_cells",
}
_STABLE = {
    "first_projection": """SELECT a.i, a.j, a.prior, a.cost, CASE WHEN a.i = a.j THEN 0.0 ELSE least(greatest((a.proposal + b.proposal) / 2, 0.0), 8.0) END AS p
        FROM {step} a JOIN {step} b ON a.i = b.j AND a.j = b.i""",
    "second_projection": """SELECT i, j, CASE WHEN i = j THEN 0.0 ELSE least(greatest(0.75 * cost + 0.25 * (0.6 * p + 0.4 * prior), 0.0), 8.0) END AS cost
        FROM first_projection""",
    "rescaled": """SELECT i, j, cost / ((SELECT median(cost) FROM second_projection WHERE i <> j) / (1 + 1e-12) + 1e-12) AS cost FROM second_projection""",
}


def lopsided(spark, sf):
    prior = matches_of(spark, sf)[1]
    return prior.withColumn("cost", F.col("cost") / 7 + F.when(F.col("i") < F.col("j"), 0.5).otherwise(0.0))


@query("project_cost", S.sql(f"SELECT i, j, {sql6('cost')} AS cost FROM projected", **_SQL))
def project_cost(spark, sf):
    return C.project_cost(lopsided(spark, sf)).withColumn("cost", r6(F.col("cost")))


@query(
    "median_rescale",
    S.sql(f"SELECT i, j, {sql6('cost / (SELECT median(cost) FROM lopsided WHERE i <> j)')} AS cost FROM lopsided", **_SQL),
)
def median_rescale(spark, sf):
    return C.median_rescale(cut(lopsided(spark, sf))).withColumn("cost", r6(F.col("cost")))


_SQUARE = {
    "levels": LEVELS,
    "leaf_pairs": "SELECT a.item_id AS id1, b.item_id AS id2 FROM parts a JOIN parts b ON a.item_id <> b.item_id",
    "leaf_edges": EDGES.format(pairs="leaf_pairs"),
    "square_costs": "SELECT CAST(substitutable + 10 * (edges - substitutable) AS DOUBLE) AS cost FROM leaf_edges",
}


def square_of(spark, sf):
    items = S.parts(spark, sf).select(F.col("item_id").alias("ingredient_id"))
    return C.square_classes(S.tree(spark, sf), items)


@query("square_classes", S.sql("SELECT cost, count(*) AS n FROM square_costs GROUP BY cost", **_SQUARE))
def square_classes(spark, sf):
    return square_of(spark, sf)


@query(
    "square_rescale",
    S.sql(f"SELECT i, j, {sql6('cost / (SELECT median(cost) FROM square_costs)')} AS cost FROM lopsided", **_SQL, **{k: v for k, v in _SQUARE.items() if k not in _SQL}),
)
def square_rescale(spark, sf):
    """Rescaled by the median of the whole square of parts."""
    return C.median_rescale(cut(lopsided(spark, sf)), square=square_of(spark, sf)).withColumn("cost", r6(F.col("cost")))


@query("square_dummy", S.sql(f"SELECT {sql6('quantile_cont(cost, 0.85)')} AS price FROM square_costs", **_SQUARE))
def square_dummy(spark, sf):
    price = C.class_quantile(square_of(spark, sf), C.DUMMY_QUANTILE)
    return spark.range(1).select(r6(F.lit(price).cast("double")).alias("price"))


@query(
    "dummy_item",
    S.sql(
        """SELECT i, j, cost FROM prior UNION ALL SELECT DISTINCT i, -1, (SELECT quantile_cont(cost, 0.85) FROM prior) FROM prior
        UNION ALL SELECT DISTINCT -1, i, (SELECT quantile_cont(cost, 0.85) FROM prior) FROM prior UNION ALL SELECT -1, -1, 0.0""",
        **_SQL,
    ),
)
def dummy_item(spark, sf):
    from blendspark.operators.lineage import quantile

    prior = cut(matches_of(spark, sf)[1])
    return C.fix_dummy(prior, quantile(prior, "cost", 0.85))


def _step_sql(step: str, **tables: str) -> str:
    stable = {**_STABLE, "first_projection": _STABLE["first_projection"].format(step=step)}
    return S.sql(f"SELECT i, j, {sql6('cost')} AS cost FROM rescaled", **{**_SQL, **stable, **tables})


_EVERY_TWO = "SELECT a.ingredient_id AS id1, b.ingredient_id AS id2 FROM held_items a CROSS JOIN held_items b"


@query("blosum_cost", _step_sql("blosum", held_items="SELECT DISTINCT ingredient_id FROM matrix", grid=_EVERY_TWO))
def blosum_cost(spark, sf):
    """Over every two ingredients, whether or not near recipes bring them together."""
    matches, prior = matches_of(spark, sf, whole=True)
    prior = cut(prior)
    return C.blosum_cost(cut(matches), prior, prior).withColumn("cost", r6(F.col("cost")))


@query("convex_cost", _step_sql("convex"))
def convex_cost(spark, sf):
    matches, prior = matches_of(spark, sf)
    prior = cut(prior)
    return C.convex_cost(cut(matches), prior, prior).withColumn("cost", r6(F.col("cost")))


@query("fit_costs")
def fit_costs(spark, sf):
    """At the reference's settings: costs of every two ingredients, and the nearest out of all
    recipes under the costs of each round."""
    bags = cut(S.matrix(spark, sf))
    return C.fit_costs(bags, None, C.square_cost(S.tree(spark, sf), bags))[0]
