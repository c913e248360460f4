"""Queries over clusters, factors, graphs and link prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendspark.functions.numeric import hash_key, r6
from blendspark.operators import bags as B
from blendspark.operators import clusters as CL
from blendspark.operators import embeddings as E
from blendspark.operators import factors as FA
from blendspark.operators import graphs as G
from blendspark.operators import neighbours as N
from blendspark.operators.lineage import cut
from blendspark.plans import standins as S
from blendspark.plans.registry import query
from blendspark.plans.standins import r6 as sql6
from blendspark.plans.tables import bags_of, nearest_recipes

# --- clusters and factors -------------------------------------------------------


@query("kmedoids")
def kmedoids(spark, sf):
    bags, members = bags_of(spark, sf)
    return CL.kmedoids(bags, B.copies_of(members)).withColumn("d", r6(F.col("d")))


_START = {
    "start": """SELECT recipe_id AS medoid FROM (SELECT DISTINCT recipe_id FROM bags)
        ORDER BY md5('42|' || recipe_id), recipe_id LIMIT 30""",
    "tot": "SELECT recipe_id, sum(w) AS t FROM bags GROUP BY recipe_id",
    "to_all": """SELECT a.recipe_id AS id, medoid, round(a.t + m.t - 2 * coalesce(o, 0), 9) AS d
        FROM tot a CROSS JOIN start JOIN tot m ON m.recipe_id = medoid
        LEFT JOIN (SELECT x.recipe_id AS xid, y.recipe_id AS yid, sum(least(x.w, y.w)) AS o FROM bags x JOIN bags y
            ON x.ingredient_id = y.ingredient_id WHERE y.recipe_id IN (SELECT medoid FROM start) GROUP BY ALL) ON xid = a.recipe_id AND yid = medoid""",
    "labelled_bags": "SELECT id, medoid, d, copies FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, medoid) AS r FROM to_all) JOIN members ON recipe_id = id WHERE r = 1",
    "inner_sums": """SELECT a.id, a.medoid, round(n * t.t + whole - 2 * coalesce(o, 0), 6) AS total FROM labelled_bags a JOIN tot t ON t.recipe_id = a.id
        JOIN (SELECT medoid, sum(copies) AS n, sum(copies * t) AS whole FROM labelled_bags JOIN tot ON recipe_id = id GROUP BY medoid) USING (medoid)
        LEFT JOIN (SELECT p.id, sum(q.copies * least(x.w, y.w)) AS o FROM labelled_bags p JOIN bags x ON x.recipe_id = p.id
            JOIN bags y ON x.ingredient_id = y.ingredient_id JOIN labelled_bags q ON q.id = y.recipe_id AND q.medoid = p.medoid GROUP BY p.id) USING (id)""",
}


@query("kmedoids_labels", S.sql(f"SELECT id, medoid, {sql6('greatest(d, 0)')} AS d FROM labelled_bags", **_START))
def kmedoids_labels(spark, sf):
    return first_step(spark, sf)[1].withColumn("d", r6(F.col("d")))


@query(
    "kmedoids_centres",
    S.sql("SELECT medoid, id AS new, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY medoid ORDER BY total, id <> medoid, id) AS r FROM inner_sums) WHERE r = 1", **_START),
)
def kmedoids_centres(spark, sf):
    bags, labels, members = first_step(spark, sf)
    return CL.best_centres(bags, labels, B.copies_of(members)).withColumn("total", F.round("total", 4))


def first_step(spark, sf):
    """Bags, their nearest of thirty hashed medoids, members."""
    bags, members = bags_of(spark, sf)
    ids = bags.select("recipe_id").distinct().orderBy(hash_key(42, F.col("recipe_id")), "recipe_id").limit(30)
    return bags, cut(CL.nearest_medoid(bags, sorted(r[0] for r in ids.collect()))), members


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf):
    return CL.cluster_sizes(S.table(spark, sf, "embeddings").withColumnRenamed("label", "cluster"))


def type_matrix(spark, sf):
    """Recipes by type and brand: fewer columns than parts."""
    p = S.parts(spark, sf).select(F.col("item_id").alias("ingredient_id"), "brand_id")
    return (
        S.matrix(spark, sf).join(p, "ingredient_id").groupBy("recipe_id", F.col("brand_id").alias("ingredient_id")).agg(F.sum("w").alias("w"))
    )


@query("nmf_kl")
def nmf_kl(spark, sf):
    rows, _, _ = FA.nmf_kl(type_matrix(spark, sf), k=4, rounds=5)
    return FA.factor_rows(rows, "recipe_id")


@query("nmf_sweep")
def nmf_sweep(spark, sf):
    return FA.nmf_sweep(type_matrix(spark, sf), [2, 4], rounds=3)


@query(
    "dominant_factor",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS k, CAST(list_max(embedding) AS DOUBLE) AS value FROM embeddings",
)
def dominant_factor(spark, sf):
    return FA.dominant_factor(S.table(spark, sf, "embeddings"), "vec_id", "embedding")


@query(
    "top_per_factor",
    """SELECT k, rank, vec_id, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY value DESC, vec_id) AS rank FROM (
        SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)) WHERE rank <= 10""",
)
def top_per_factor(spark, sf):
    rows = FA.factor_rows(S.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return FA.top_per_factor(rows.withColumn("value", F.col("value").cast("double")), "vec_id", 10)


@query("project_2d")
def project_2d(spark, sf):
    doubles = F.col("embedding").cast("array<double>").alias("f")
    return FA.project_2d(S.table(spark, sf, "embeddings").select("vec_id", doubles), "vec_id")


@query("fuzzy_edges")
def fuzzy_edges(spark, sf):
    return FA.fuzzy_edges(nearest_recipes(spark, sf)).withColumn("weight", r6(F.col("weight")))


# --- graphs ---------------------------------------------------------------------

GRAPH = {
    "links": """SELECT DISTINCT 'r:' || o_custkey AS src, 'i:' || item_id AS dst
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON p_partkey = l_partkey""",
    "edges": "SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links",
    "hashed": "SELECT src, dst, md5('42|' || src || '|' || dst) AS h FROM links",
    "numbered": "SELECT *, row_number() OVER (ORDER BY h, src, dst) - 1 AS idx, count(*) OVER () AS total FROM hashed",
    "sources": "SELECT src, row_number() OVER (ORDER BY src) - 1 AS s FROM (SELECT DISTINCT src FROM links)",
    "targets": "SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS t FROM (SELECT DISTINCT dst FROM links)",
    "draws": """SELECT DISTINCT CAST(floor(CAST('0x' || substr(md5('42.s|' || src || '|' || dst || '|' || n), 1, 12) AS BIGINT) / 281474976710656.0 * (SELECT count(*) FROM sources)) AS BIGINT) AS s,
            CAST(floor(CAST('0x' || substr(md5('42.t|' || src || '|' || dst || '|' || n), 1, 12) AS BIGINT) / 281474976710656.0 * (SELECT count(*) FROM targets)) AS BIGINT) AS t
        FROM links CROSS JOIN (SELECT unnest([1, 2, 3]) AS n)""",
    "absent": """SELECT src, dst FROM draws JOIN sources USING (s) JOIN targets USING (t) WHERE (src, dst) NOT IN (SELECT (src, dst) FROM links)""",
    "negatives": """SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || src || '|' || dst), src, dst) AS r FROM absent)
        WHERE r <= (SELECT least(count(*), (SELECT count(*) FROM sources) * (SELECT count(*) FROM targets) - count(*)) FROM links)""",
    "labelled": "SELECT *, 1 AS label FROM links UNION ALL SELECT *, 0 FROM negatives",
}


def customer_matrix(spark, sf):
    """Customers as recipes, parts as ingredients."""
    p = S.parts(spark, sf).select(F.col("p_partkey").alias("l_partkey"), "item_id")
    return (
        S.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(p, "l_partkey")
        .groupBy(F.col("o_custkey").alias("recipe_id"), F.col("item_id").alias("ingredient_id"))
        .agg(F.sum("l_quantity").alias("w"))
    )


def edges_of(spark, sf):
    return cut(G.bipartite_edges(customer_matrix(spark, sf)))


def links_of(spark, sf):
    return cut(G.forward_edges(G.bipartite_edges(customer_matrix(spark, sf))))


def labelled_of(spark, sf):
    links = links_of(spark, sf)
    absent = G.negative_edges(links, links)
    return links.withColumn("label", F.lit(1)).unionByName(absent.withColumn("label", F.lit(0)))


@query("bipartite_edges", S.sql("SELECT * FROM edges", **GRAPH))
def bipartite_edges(spark, sf):
    return edges_of(spark, sf)


@query(
    "graph_size",
    S.sql("SELECT count(DISTINCT src) AS recipes, count(DISTINCT dst) AS ingredients, 2 * count(*) AS edges FROM links", **GRAPH),
)
def graph_size(spark, sf):
    return G.graph_size(edges_of(spark, sf))


@query(
    "split_edges",
    S.sql("SELECT src, dst, CASE WHEN idx < CAST(floor(total * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM numbered", **GRAPH),
)
def split_edges(spark, sf):
    return G.split_edges(G.forward_edges(edges_of(spark, sf)))


@query("negative_edges", S.sql("SELECT * FROM negatives", **GRAPH))
def negative_edges(spark, sf):
    links = links_of(spark, sf)
    return G.negative_edges(links, links)


@query("random_walks")
def random_walks(spark, sf):
    """At the reference's settings: 10 walks of 20 a node, p 1, q 0.5."""
    walks = G.random_walks(edges_of(spark, sf), p=1.0, q=0.5)
    return walks.withColumn("nodes", F.concat_ws(" ", "nodes"))


WALKS = {
    **GRAPH,
    "numbered_edges": "SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge FROM edges",
    "degrees": "SELECT src, min(edge) AS first, count(*) AS degree FROM numbered_edges GROUP BY src",
    "walk0": "SELECT src || '#' || n AS walk, src AS node FROM degrees CROSS JOIN (SELECT unnest(range(1, 6)) AS n) WHERE src LIKE 'r:%'",
    **{
        f"walk{k}": f"""SELECT walk, dst AS node FROM walk{k - 1} JOIN degrees ON src = node JOIN numbered_edges e ON e.edge = first
            + CAST(floor(CAST('0x' || substr(md5('42.{k}.0|' || walk || '|1'), 1, 12) AS BIGINT) / 281474976710656.0 * degree) AS BIGINT)"""
        for k in range(1, 10)
    },
    "walk_steps": " UNION ALL ".join(f"SELECT walk, {k} AS step, node FROM walk{k}" for k in range(10)),
}


@query("metapath_walks", S.sql("SELECT walk, string_agg(node, ' ' ORDER BY step) AS nodes FROM walk_steps GROUP BY walk", **WALKS))
def metapath_walks(spark, sf):
    return G.metapath_walks(edges_of(spark, sf)).withColumn("nodes", F.concat_ws(" ", "nodes"))


MEETINGS = {
    **WALKS,
    "meetings": """SELECT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b, count(*) AS n FROM walk_steps x
        JOIN walk_steps y ON x.walk = y.walk AND y.step > x.step AND y.step <= x.step + 5 GROUP BY ALL""",
    "sides": "SELECT a, b, sum(n) AS n FROM (SELECT * FROM meetings UNION ALL SELECT b, a, n FROM meetings) GROUP BY ALL",
    "sums": "SELECT a, sum(n) AS t FROM sides GROUP BY a",
}


@query("cooccurrences", S.sql("SELECT a, b, n FROM meetings", **MEETINGS))
def cooccurrences(spark, sf):
    return E.cooccurrences(G.metapath_walks(edges_of(spark, sf)), window=5)


@query(
    "association",
    S.sql(f"""SELECT s.a, s.b, {sql6('m')} AS m FROM (SELECT s.a, s.b, ln(CAST(n AS DOUBLE) * (SELECT sum(t) FROM sums) / x.t / y.t) AS m
        FROM sides s JOIN sums x ON x.a = s.a JOIN sums y ON y.a = s.b) s WHERE m > 1e-12""", **MEETINGS),
)
def association(spark, sf):
    met = E.cooccurrences(G.metapath_walks(edges_of(spark, sf)), window=5)
    return E.association(met).withColumn("m", r6(F.col("m")))


@query("train_embeddings")
def train_embeddings(spark, sf):
    """64 dimensions from windows of 10 over the walks of ``random_walks``."""
    vectors = E.train_embeddings(G.random_walks(edges_of(spark, sf), p=1.0, q=0.5))
    return vectors.select("node", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


def node_vectors(spark, sf):
    """A given vector for every customer and part: that of its number modulo their count."""
    vectors = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    every = F.lit(vectors.count())
    items = S.parts(spark, sf).select("item_id", (F.col("item_id") % every).alias("vec_id"))
    customers = S.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % every).alias("vec_id"))
    return customers.join(vectors, "vec_id").select(G.recipe_node(F.col("c_custkey")).alias("node"), "embedding").unionByName(
        items.join(vectors, "vec_id").select(G.ingredient_node(F.col("item_id")).alias("node"), "embedding")
    )


FEATURES = {
    **GRAPH,
    "vectors": """SELECT 'r:' || c_custkey AS node, CAST(embedding AS DOUBLE[]) AS v FROM customer JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings) UNION ALL
        SELECT 'i:' || item_id, CAST(embedding AS DOUBLE[]) FROM parts JOIN embeddings ON vec_id = item_id % (SELECT count(*) FROM embeddings)""",
    "features": """SELECT l.src, l.dst, label, list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]) AS f
        FROM labelled l JOIN vectors a ON a.node = src JOIN vectors b ON b.node = dst""",
    "norms": "SELECT label, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS norm FROM features",
    "cutoff": "SELECT (avg(norm) FILTER (label = 1) + avg(norm) FILTER (label = 0)) / 2 AS m FROM norms",
}


def features_of(spark, sf):
    return G.edge_features(labelled_of(spark, sf), node_vectors(spark, sf))


@query(
    "edge_features",
    S.sql(f"""SELECT src, dst, label, len(f) AS n, {sql6('f[1]')} AS first_value, {sql6('list_sum(f)')} AS total FROM features""", **FEATURES),
)
def edge_features(spark, sf):
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return features_of(spark, sf).select(
        "src", "dst", "label", F.size("features").cast("long").alias("n"),
        r6(F.get("features", F.lit(0))).alias("first_value"), r6(total).alias("total"),
    )


@query(
    "norm_report",
    S.sql(f"""SELECT {sql6('(SELECT m FROM cutoff)')} AS threshold, {sql6('avg(CASE WHEN label = 1 THEN (norm > (SELECT m FROM cutoff))::INT ELSE (norm < (SELECT m FROM cutoff))::INT END)')} AS accuracy FROM norms""", **FEATURES),
)
def norm_report(spark, sf):
    out = G.norm_report(features_of(spark, sf))
    return out.select(r6(F.col("threshold")).alias("threshold"), r6(F.col("accuracy")).alias("accuracy"))


@query("link_classifier")
def link_classifier(spark, sf):
    features = cut(features_of(spark, sf))
    parts = G.split_edges(features.select("src", "dst"))
    train = features.join(parts.where("part = 'train'"), ["src", "dst"])
    test = features.join(parts.where("part = 'test'"), ["src", "dst"])
    return G.link_scores(train, test).select("src", "dst", "label", r6(F.col("score")).alias("score"))


@query("link_prediction")
def link_prediction(spark, sf):
    """The whole path: split, walk on the training part, embed, score held-out edges."""
    links = G.forward_edges(edges_of(spark, sf))
    parts = cut(G.split_edges(links))
    known = parts.where("part = 'train'").select("src", "dst")
    both_ways = known.unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    walks = G.metapath_walks(cut(both_ways))
    vectors = cut(E.train_embeddings(walks, window=5))
    absent = cut(G.split_edges(G.negative_edges(links, links)))
    rows = parts.withColumn("label", F.lit(1)).unionByName(absent.withColumn("label", F.lit(0)))
    features = cut(G.edge_features(G.valid_edges(rows), vectors))
    train, test = features.where("part = 'train'"), features.where("part = 'test'")
    return G.train_test_gap(G.link_scores(train, train), G.link_scores(train, test))


_AUC = """SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
        / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc,
    count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives
    FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {scored})"""
SCORED = {
    "scored": "SELECT doc_id, CAST(n_chars // 100 AS DOUBLE) AS score, quality AS label FROM documents JOIN labels USING (doc_id)",
    "long_docs": "SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)",
    "toxic_docs": "SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
}


def scored_docs(spark, sf):
    return (
        S.table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).cast("double").alias("score"))
        .join(S.table(spark, sf, "labels"), "doc_id").withColumnRenamed("quality", "label")
    )


def _auc_sql(scored: str) -> str:
    return f"SELECT {sql6('auc')} AS auc, positives, negatives FROM ({_AUC.format(scored=scored)})"


@query("auc", S.sql(_auc_sql("scored"), **SCORED))
def auc(spark, sf):
    return G.auc(scored_docs(spark, sf)).withColumn("auc", r6(F.col("auc")))


@query(
    "threshold_report",
    S.sql(
        f"""SELECT {sql6('avg(((score > 10) = (label = 1))::INT)')} AS accuracy, {sql6('avg(score) FILTER (label = 1)')} AS positive_mean,
        {sql6('stddev_pop(score) FILTER (label = 1)')} AS positive_std, {sql6('avg(score) FILTER (label = 0)')} AS negative_mean,
        {sql6('stddev_pop(score) FILTER (label = 0)')} AS negative_std FROM scored""",
        **SCORED,
    ),
)
def threshold_report(spark, sf):
    out = G.threshold_report(scored_docs(spark, sf), 10.0)
    return out.select(*(r6(F.col(c)).alias(c) for c in out.columns))


@query(
    "train_test_gap",
    S.sql(
        f"""SELECT {sql6('a')} AS train_auc, {sql6('b')} AS test_auc, {sql6('a - b')} AS gap,
            CASE WHEN a - b > 0.05 THEN 'overfitting' WHEN abs(a - b) < 0.02 THEN 'good' ELSE 'moderate' END AS verdict
        FROM (SELECT (SELECT auc FROM train_auc) AS a, (SELECT auc FROM test_auc) AS b)""",
        **SCORED,
        train_auc=_AUC.format(scored="long_docs"),
        test_auc=_AUC.format(scored="toxic_docs"),
    ),
)
def train_test_gap(spark, sf):
    docs = scored_docs(spark, sf)
    out = G.train_test_gap(docs.where("toxic = 0"), docs.where("toxic = 1"))
    return out.select(*(r6(F.col(c)).alias(c) for c in ("train_auc", "test_auc", "gap")), "verdict")


@query(
    "random_baseline",
    S.sql(
        _auc_sql("rolled"), **GRAPH,
        rolled="SELECT label, CAST('0x' || substr(md5('7|' || src || '|' || dst), 1, 12) AS BIGINT) AS score FROM labelled",
    ),
)
def random_baseline(spark, sf):
    return G.random_baseline(labelled_of(spark, sf), seed=7).withColumn("auc", r6(F.col("auc")))


@query(
    "edge_type_audit",
    S.sql(
        """SELECT label, CASE WHEN src[1] <> dst[1] THEN 'valid' WHEN src[1] = 'r' THEN 'recipe-recipe' ELSE 'ingredient-ingredient' END AS kind, count(*) AS n
        FROM mixed GROUP BY ALL""",
        **GRAPH,
        mixed="""SELECT src, dst, 1 AS label FROM edges UNION ALL SELECT 'r:' || l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'r:' ELSE 'i:' END || l_partkey, 0 FROM lineitem
            UNION ALL SELECT 'i:' || l_partkey, 'i:' || l_suppkey, 0 FROM lineitem""",
    ),
)
def edge_type_audit(spark, sf):
    lines = S.table(spark, sf, "lineitem")
    other = F.when(F.col("l_returnflag") == "N", G.recipe_node(F.col("l_partkey"))).otherwise(G.ingredient_node(F.col("l_partkey")))
    random_pairs = lines.select(G.recipe_node(F.col("l_orderkey")).alias("src"), other.alias("dst")).unionByName(
        lines.select(G.ingredient_node(F.col("l_partkey")).alias("src"), G.ingredient_node(F.col("l_suppkey")).alias("dst"))
    )
    return G.edge_type_audit(
        edges_of(spark, sf).withColumn("label", F.lit(1)).unionByName(random_pairs.withColumn("label", F.lit(0)))
    )
