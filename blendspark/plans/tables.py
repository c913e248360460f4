"""Queries over facts, units, matrices and bag distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendspark.functions import units as U
from blendspark.functions.numeric import r6
from blendspark.operators import bags as B
from blendspark.operators import facts as FO
from blendspark.operators import matrix as M
from blendspark.operators import neighbours as N
from blendspark.operators.lineage import cut
from blendspark.plans import standins as S
from blendspark.plans.registry import query
from blendspark.plans.standins import r6 as sql6
from blendspark.plans.standins import sql


@query("recipe_facts", sql("SELECT * FROM facts"))
def recipe_facts(spark, sf):
    return S.facts(spark, sf)


@query(
    "ingredient_tree",
    sql("""SELECT ingredient_id, path, substitution_level, parent_path, len(nodes) AS depth,
        array_to_string(nodes, '>') AS chain FROM tree"""),
)
def ingredient_tree(spark, sf):
    return S.tree(spark, sf).select(
        "ingredient_id", "path", "substitution_level", "parent_path", F.col("depth").cast("long").alias("depth"),
        F.concat_ws(">", F.col("nodes").cast("array<string>")).alias("chain"),
    )


_ML = """CASE WHEN {top} WHEN amount IS NULL OR unit_name IS NULL THEN NULL WHEN amount = 0 THEN 0.0
    WHEN kind = 'set' THEN factor WHEN kind = 'factor' THEN amount * factor ELSE 0.0 END"""
_NAMED = "FROM uses LEFT JOIN rules ON lower(unit_name) = alias"


@query("to_ml", sql(f"SELECT recipe_id, ingredient_id, line, {sql6(_ML.format(top='FALSE THEN NULL'))} AS ml {_NAMED}"))
def to_ml(spark, sf):
    ml = U.to_ml(F.col("amount"), F.col("unit_name"))
    return S.uses(spark, sf).select("recipe_id", "ingredient_id", "line", r6(ml).alias("ml"))


_TOP = _ML.format(top="unit = 'to top' THEN 90.0")


@query(
    "facts_with_ml",
    sql(f"""SELECT recipe_id, recipe_name, u.ingredient_id, ingredient_name, line, amount, unit_name, {sql6('ml')} AS amount_ml
        FROM (SELECT *, {_TOP} AS ml {_NAMED}) u JOIN recipes USING (recipe_id)
        JOIN ingredients i ON i.ingredient_id = u.ingredient_id"""),
)
def facts_with_ml(spark, sf):
    out = FO.facts_with_ml(S.uses(spark, sf), S.recipes(spark, sf), S.ingredients(spark, sf), top_ml=90.0)
    return out.select(
        "recipe_id", "recipe_name", "ingredient_id", "ingredient_name", "line", "amount", "unit_name",
        r6(F.col("amount_ml")).alias("amount_ml"),
    )


@query(
    "volume_ml",
    sql(f"SELECT recipe_id, ingredient_id, amount, unit_name, {sql6('volume_ml')} AS volume_ml FROM volumes"),
)
def volume_ml(spark, sf):
    return FO.with_volume(S.facts(spark, sf)).select(
        "recipe_id", "ingredient_id", "amount", "unit_name", r6(F.col("volume_ml")).alias("volume_ml")
    )


@query(
    "amount_with_default",
    sql(f"SELECT recipe_id, ingredient_id, {sql6('coalesce(amount * conversion_to_ml, amount, 1.0)')} AS amount_ml FROM facts"),
)
def amount_with_default(spark, sf):
    amount = U.amount_with_default(F.col("amount"), F.col("conversion_to_ml"))
    return S.facts(spark, sf).select("recipe_id", "ingredient_id", r6(amount).alias("amount_ml"))


@query("list_units", sql("SELECT DISTINCT unit_name FROM uses WHERE unit_name IS NOT NULL"))
def list_units(spark, sf):
    return FO.list_units(S.uses(spark, sf))


@query(
    "unit_coverage",
    sql("""SELECT DISTINCT unit_name FROM uses WHERE unit_name IS NOT NULL
        AND lower(unit_name) NOT IN (SELECT alias FROM rules)"""),
)
def unit_coverage(spark, sf):
    return FO.unit_coverage(S.uses(spark, sf), U.unit_table(spark))


@query(
    "check_keys",
    sql("""SELECT 'unique recipes(recipe_name)' AS check_name, recipe_name AS key, count(*) AS n FROM recipes GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT 'unique uses(recipe_id, ingredient_id)', recipe_id || '|' || ingredient_id, count(*)
            FROM uses GROUP BY recipe_id, ingredient_id HAVING count(*) > 1
        UNION ALL SELECT 'reference labels(doc_id)', CAST(doc_id AS VARCHAR), count(*) FROM labels
            WHERE doc_id NOT IN (SELECT c_custkey FROM customer) GROUP BY doc_id
        UNION ALL SELECT 'reference uses(ingredient_id)', CAST(ingredient_id AS VARCHAR), count(*) FROM uses
            WHERE ingredient_id NOT IN (SELECT o_custkey + 100000 FROM orders) GROUP BY ingredient_id"""),
)
def check_keys(spark, sf):
    orders = S.table(spark, sf, "orders")
    return FO.check_keys(
        {
            "recipes": S.recipes(spark, sf),
            "uses": S.uses(spark, sf),
            "labels": S.table(spark, sf, "labels"),
            "customers": S.table(spark, sf, "customer"),
            "buyers": orders.select((F.col("o_custkey") + 100000).alias("ingredient_id")),
        },
        unique=[("recipes", ("recipe_name",)), ("uses", ("recipe_id", "ingredient_id"))],
        references=[("labels", "doc_id", "customers", "c_custkey"), ("uses", "ingredient_id", "buyers", "ingredient_id")],
    )


@query(
    "assign_ingredient_ids",
    sql("""SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name FROM supplier
        UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY name), name
        FROM (SELECT DISTINCT p_name AS name FROM part)"""),
)
def assign_ingredient_ids(spark, sf):
    known = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return FO.assign_ingredient_ids(S.table(spark, sf, "part").select(F.col("p_name").alias("name")), known)


_DOCS = """SELECT o_orderkey AS recipe_id, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderpriority END AS name,
    count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""


@query(
    "check_recipe_documents",
    sql("""SELECT recipe_id, concat_ws(', ', CASE WHEN trim(name) = '' THEN 'name is required' END,
        CASE WHEN n = 0 THEN 'ingredients is required' END) AS errors FROM documents_of_orders""", documents_of_orders=_DOCS),
)
def check_recipe_documents(spark, sf):
    lists = S.uses(spark, sf).groupBy("recipe_id").agg(F.collect_list("ingredient_id").alias("ingredients"))
    name = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority"))
    documents = (
        S.table(spark, sf, "orders")
        .select(F.col("o_orderkey").alias("recipe_id"), name.alias("name"))
        .join(lists, "recipe_id", "left")
    )
    return FO.check_recipe_documents(documents).select("recipe_id", F.concat_ws(", ", "errors").alias("errors"))


@query(
    "check_category_cover",
    sql(
        """SELECT 'recipe' AS kind, recipe_id AS id, category, n FROM counted WHERE n > 1
        UNION ALL SELECT 'missing', recipe_id, NULL, (SELECT count(DISTINCT category) FROM categories) - coalesce(c, 0)
        FROM (SELECT DISTINCT recipe_id FROM uses) LEFT JOIN (SELECT recipe_id, count(*) AS c FROM counted GROUP BY ALL) USING (recipe_id)
        WHERE coalesce(c, 0) < (SELECT count(DISTINCT category) FROM categories)
        UNION ALL SELECT 'ingredient', ingredient_id, NULL, count(category) FROM (SELECT DISTINCT ingredient_id FROM uses)
        LEFT JOIN categories USING (ingredient_id) GROUP BY ingredient_id HAVING count(category) NOT BETWEEN 1 AND 2""",
        categories="SELECT item_id AS ingredient_id, CASE WHEN p_size > 2 THEN p_type END AS category FROM parts",
        counted="""SELECT recipe_id, category, count(DISTINCT ingredient_id) AS n FROM uses JOIN categories USING (ingredient_id)
            WHERE category IS NOT NULL GROUP BY ALL""",
    ),
)
def check_category_cover(spark, sf):
    category = F.when(F.col("p_size") > 2, F.col("p_type"))
    categories = S.parts(spark, sf).select(F.col("item_id").alias("ingredient_id"), category.alias("category"))
    return FO.check_category_cover(S.uses(spark, sf), categories)


@query(
    "volume_fraction",
    sql(f"""SELECT recipe_id, ingredient_id, {sql6('volume_ml')} AS volume_ml, {sql6('volume_fraction')} AS volume_fraction
        FROM fractions"""),
)
def volume_fraction(spark, sf):
    return S.fractions(spark, sf).select(
        "recipe_id", "ingredient_id", r6(F.col("volume_ml")).alias("volume_ml"),
        r6(F.col("volume_fraction")).alias("volume_fraction"),
    )


@query("recipe_matrix", sql(f"SELECT recipe_id, ingredient_id, {sql6('w')} AS w FROM matrix"))
def recipe_matrix(spark, sf):
    return S.matrix(spark, sf).withColumn("w", r6(F.col("w")))


@query("boolean_matrix", sql("SELECT recipe_id, ingredient_id, 1.0 AS w FROM matrix WHERE w > 0"))
def boolean_matrix(spark, sf):
    return M.boolean_matrix(S.matrix(spark, sf)).select("recipe_id", "ingredient_id", "w")


def three_levels(spark, sf):
    p = S.parts(spark, sf).select(
        F.col("item_id").alias("ingredient_id"), F.col("p_type").alias("category"),
        F.substring_index("p_name", " ", -1).alias("specific_type"), F.col("p_brand").alias("brand"),
    )
    return S.matrix(spark, sf).join(p, "ingredient_id").select("recipe_id", "category", "specific_type", "brand", "w")


_LEVELS = """SELECT recipe_id, p_type AS category, string_split(p_name, ' ')[-1] AS specific_type, p_brand AS brand, w
    FROM matrix JOIN parts ON item_id = ingredient_id"""


@query(
    "collapse_columns",
    sql(f"""SELECT recipe_id, category, specific_type, {sql6('s / sum(s) OVER (PARTITION BY recipe_id)')} AS w
        FROM (SELECT recipe_id, category, specific_type, sum(w) AS s FROM levels GROUP BY ALL)""", levels=_LEVELS),
)
def collapse_columns(spark, sf):
    return M.collapse_columns(three_levels(spark, sf)).withColumn("w", r6(F.col("w")))


@query(
    "collapse_columns_boolean",
    sql("SELECT DISTINCT recipe_id, category, specific_type, TRUE AS present FROM levels WHERE w > 0", levels=_LEVELS),
)
def collapse_columns_boolean(spark, sf):
    return M.collapse_columns(three_levels(spark, sf), boolean=True)


@query(
    "matrix_index",
    sql(f"""SELECT dense_rank() OVER (ORDER BY recipe_id) - 1 AS row, dense_rank() OVER (ORDER BY ingredient_id) - 1 AS col,
        {sql6('w')} AS w FROM matrix"""),
)
def matrix_index(spark, sf):
    return M.matrix_index(S.matrix(spark, sf))[0].withColumn("w", r6(F.col("w")))


def bags_of(spark, sf):
    return B.collapse_copies(S.matrix(spark, sf))


@query("collapse_copies", sql("SELECT recipe_id, bag_id, copies FROM members"))
def collapse_copies(spark, sf):
    return bags_of(spark, sf)[1]


@query("manhattan_pairs", sql(f"SELECT id1, id2, {sql6('d')} AS d FROM manhattan"))
def manhattan_pairs(spark, sf):
    bags, _ = bags_of(spark, sf)
    return B.manhattan_pairs(bags, 1.0).withColumn("d", r6(F.col("d")))


@query(
    "manhattan_given_pairs",
    sql(f"""SELECT id1, id2, {sql6('greatest(2 - 2 * coalesce(o, 0), 0)')} AS d
        FROM recipe_pairs JOIN (SELECT DISTINCT recipe_id AS id1 FROM matrix) USING (id1)
        JOIN (SELECT DISTINCT recipe_id AS id2 FROM matrix) USING (id2)
        LEFT JOIN (SELECT id1, id2, sum(least(x.w, y.w)) AS o FROM recipe_pairs
            JOIN matrix x ON x.recipe_id = id1 JOIN matrix y ON y.recipe_id = id2 AND x.ingredient_id = y.ingredient_id
            GROUP BY ALL) USING (id1, id2)"""),
)
def manhattan_given_pairs(spark, sf):
    return B.manhattan_pairs(S.matrix(spark, sf), pairs=S.recipe_pairs(spark, sf)).withColumn("d", r6(F.col("d")))


@query(
    "jaccard_pairs",
    sql(f"SELECT id1, id2, {sql6('1 - c / (n1 + n2 - c)')} AS d FROM set_pairs WHERE 1 - c / (n1 + n2 - c) <= 0.7 + 1e-9"),
)
def jaccard_pairs(spark, sf):
    bags, _ = bags_of(spark, sf)
    return B.jaccard_pairs(bags, 0.7).withColumn("d", r6(F.col("d")))


@query(
    "hamming_pairs",
    sql("""SELECT id1, id2, round(d / (SELECT count(DISTINCT ingredient_id) FROM bags), 9) AS d FROM set_pairs WHERE d <= 3"""),
)
def hamming_pairs(spark, sf):
    bags, _ = bags_of(spark, sf)
    return B.hamming_pairs(bags, 3).withColumn("d", F.round("d", 9))


@query("edit_distance_pairs", sql("SELECT id1, id2, n1, n2, d FROM set_pairs WHERE d <= 2"))
def edit_distance_pairs(spark, sf):
    bags, _ = bags_of(spark, sf)
    return B.edit_distance_pairs(bags, 2)


def set_bags_of(spark, sf):
    return B.collapse_copies(M.boolean_matrix(S.matrix(spark, sf)).select("recipe_id", "ingredient_id", "w"))


_SET_MEMBERS = {
    "set_keys": """SELECT recipe_id, string_agg(CAST(ingredient_id AS VARCHAR), ',' ORDER BY ingredient_id) AS content
        FROM matrix GROUP BY recipe_id""",
    "set_members": """SELECT recipe_id, min(recipe_id) OVER (PARTITION BY content) AS bag_id,
        count(*) OVER (PARTITION BY content) AS copies FROM set_keys""",
    "all_sizes": "SELECT recipe_id, count(*) AS n FROM matrix GROUP BY recipe_id",
    "all_set_pairs": """SELECT x.recipe_id AS id1, y.recipe_id AS id2, count(*) AS c
        FROM matrix x JOIN matrix y ON x.ingredient_id = y.ingredient_id AND x.recipe_id <> y.recipe_id GROUP BY ALL""",
}


@query(
    "edit_distance_counts",
    sql(
        """SELECT s.recipe_id, CAST(coalesce(p.k, 0) + CASE WHEN s.n = 1 THEN (SELECT count(*) FROM all_sizes WHERE n = 1) - 1 - coalesce(q.k, 0) ELSE 0 END AS BIGINT) AS n_pairs
        FROM all_sizes s
        LEFT JOIN (SELECT id1, count(*) AS k FROM all_set_pairs JOIN all_sizes a ON a.recipe_id = id1
            JOIN all_sizes b ON b.recipe_id = id2 WHERE a.n + b.n - 2 * c = 2 GROUP BY id1) p ON p.id1 = s.recipe_id
        LEFT JOIN (SELECT id1, count(*) AS k FROM all_set_pairs JOIN all_sizes b ON b.recipe_id = id2
            WHERE b.n = 1 GROUP BY id1) q ON q.id1 = s.recipe_id""",
        **_SET_MEMBERS,
    ),
)
def edit_distance_counts(spark, sf):
    bags, members = set_bags_of(spark, sf)
    return B.edit_distance_counts(bags, members, 2)


@query(
    "one_swap_edges",
    sql(
        """SELECT id1, id2,
            (SELECT string_agg(CAST(x.ingredient_id AS VARCHAR), '+' ORDER BY x.ingredient_id) FROM bags x WHERE x.recipe_id = id1 AND x.ingredient_id NOT IN
                (SELECT y.ingredient_id FROM bags y WHERE y.recipe_id = id2)) AS only1,
            (SELECT string_agg(CAST(x.ingredient_id AS VARCHAR), '+' ORDER BY x.ingredient_id) FROM bags x WHERE x.recipe_id = id2 AND x.ingredient_id NOT IN
                (SELECT y.ingredient_id FROM bags y WHERE y.recipe_id = id1)) AS only2
        FROM set_pairs WHERE d = 2""",
    ),
)
def one_swap_edges(spark, sf):
    bags, _ = bags_of(spark, sf)
    join = lambda c: F.nullif(F.concat_ws("+", F.col(c).cast("array<string>")), F.lit("")).alias(c)
    return B.one_swap_edges(bags).select("id1", "id2", join("only1"), join("only2"))


_ALL_PAIRS = {
    "set_distances": """SELECT a.recipe_id AS id1, b.recipe_id AS id2, a.n AS n1, b.n AS n2, a.n + b.n - 2 * coalesce(c, 0) AS d, coalesce(c, 0) AS c
        FROM sizes a JOIN sizes b ON abs(a.n - b.n) <= 3 AND a.recipe_id <> b.recipe_id
        LEFT JOIN (SELECT id1, id2, c FROM set_pairs UNION ALL SELECT id2, id1, c FROM set_pairs) s ON s.id1 = a.recipe_id AND s.id2 = b.recipe_id
        WHERE a.n + b.n - 2 * coalesce(c, 0) <= 3""",
}


@query(
    "apart_classes",
    sql("SELECT id1 AS recipe_id, n1 AS n, n2 AS partner_n, d, count(*) AS apart FROM set_distances WHERE c = 0 GROUP BY ALL", **_ALL_PAIRS),
)
def apart_classes(spark, sf):
    return B.apart_classes(bags_of(spark, sf)[0], 3)


@query(
    "hamming_counts",
    sql("SELECT recipe_id, count(id2) AS near FROM sizes LEFT JOIN set_distances ON id1 = recipe_id GROUP BY recipe_id", **_ALL_PAIRS),
)
def hamming_counts(spark, sf):
    return B.hamming_counts(bags_of(spark, sf)[0], 3)


@query(
    "named_swaps",
    sql(
        """SELECT e.id1, e.id2, a.recipe_name AS recipe_name1, b.recipe_name AS recipe_name2,
            string_agg(i.ingredient_name, ' <-> ' ORDER BY i.ingredient_id) AS item_names
        FROM (SELECT id1, id2, ingredient_id FROM (
            SELECT id1, id2, ingredient_id FROM set_pairs JOIN bags ON recipe_id = id1 WHERE d = 2
            UNION ALL SELECT id1, id2, ingredient_id FROM set_pairs JOIN bags ON recipe_id = id2 WHERE d = 2) GROUP BY ALL HAVING count(*) = 1) e
        JOIN ingredients i ON i.ingredient_id = e.ingredient_id JOIN recipes a ON a.recipe_id = e.id1 JOIN recipes b ON b.recipe_id = e.id2
        GROUP BY ALL""",
    ),
)
def named_swaps(spark, sf):
    edges = B.one_swap_edges(bags_of(spark, sf)[0])
    out = B.named_swaps(edges, S.ingredients(spark, sf), S.recipes(spark, sf))
    return out.withColumn("item_names", F.concat_ws(" <-> ", "item_names"))


@query(
    "edits_from",
    sql("""SELECT s.recipe_id, s.n + m.n - 2 * coalesce(c, 0) AS d FROM (SELECT recipe_id, count(*) AS n FROM matrix GROUP BY ALL) s
        CROSS JOIN (SELECT count(*) AS n FROM matrix WHERE recipe_id = 7) m
        LEFT JOIN (SELECT recipe_id, count(*) AS c FROM matrix WHERE ingredient_id IN
            (SELECT ingredient_id FROM matrix WHERE recipe_id = 7) GROUP BY ALL) USING (recipe_id)
        WHERE s.n + m.n - 2 * coalesce(c, 0) = 4 AND s.recipe_id <> 7"""),
)
def edits_from(spark, sf):
    return B.edits_from(S.matrix(spark, sf), 7, 4)


@query(
    "knn",
    sql(
        f"""SELECT id, neighbour, rank, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM (
            SELECT id, neighbour, {sql6('d')} AS d FROM bag_sharing
            UNION ALL SELECT a.recipe_id, b.recipe_id, 2.0 FROM sizes a JOIN lowest_bags b ON a.recipe_id <> b.recipe_id
                WHERE (a.recipe_id, b.recipe_id) NOT IN (SELECT (id, neighbour) FROM bag_sharing))) WHERE rank <= 5""",
        bag_sharing="""SELECT x.recipe_id AS id, y.recipe_id AS neighbour, greatest(2 - 2 * sum(least(x.w, y.w)), 0) AS d
            FROM bags x JOIN bags y ON x.ingredient_id = y.ingredient_id AND x.recipe_id <> y.recipe_id GROUP BY ALL""",
        lowest_bags="SELECT recipe_id FROM sizes ORDER BY recipe_id LIMIT 40",
    ),
)
def knn(spark, sf):
    """Five nearest of every distinct bag out of all others, from a pair table that holds
    them: each bag's own list, told from both ends."""
    bags, _ = bags_of(spark, sf)
    alone = bags.select("recipe_id").distinct().select("recipe_id", F.col("recipe_id").alias("bag_id"), F.lit(1).cast("long").alias("copies"))
    lists = N.nearest_recipes(bags, cut(alone), 5)
    pairs = lists.select(F.least("id", "neighbour").alias("id1"), F.greatest("id", "neighbour").alias("id2"), "d").distinct()
    return N.knn(cut(pairs), 5)


def nearest_recipes(spark, sf, k=10):
    bags, members = bags_of(spark, sf)
    return N.nearest_recipes(bags, members, k)


@query("knn_recipes", sql("SELECT id, neighbour, rank, d FROM nearest"))
def knn_recipes(spark, sf):
    return nearest_recipes(spark, sf)


_DOT = "list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))"


@query(
    "cosine_topk",
    sql(
        f"""SELECT query, id, rank, {sql6('similarity')} AS similarity FROM (
            SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, id) AS rank FROM (
            SELECT b.vec_id AS query, a.vec_id AS id, {_DOT} / sqrt(a.n * b.n) AS similarity
            FROM vectors a JOIN vectors b ON b.vec_id IN (0, 1, 2) AND a.vec_id <> b.vec_id)) WHERE rank <= 5""",
        vectors="""SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
            list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS n FROM embeddings""",
    ),
)
def cosine_topk(spark, sf):
    out = N.cosine_topk(S.table(spark, sf, "embeddings"), [0, 1, 2], 5)
    return out.withColumn("similarity", r6(F.col("similarity")))
