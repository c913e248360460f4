"""Recipe-ingredient graphs: edges, walks, embeddings and link prediction.

Nodes are strings with a type prefix (``r:12``, ``i:7``), so that ids of the two
kinds never meet.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.functions.numeric import hash_key, hash_unit
from blendspark.operators.lineage import cut, dealt, dense_index, prefix_sum


def recipe_node(recipe_id: Column) -> Column:
    return F.concat(F.lit("r:"), recipe_id.cast("string"))


def ingredient_node(ingredient_id: Column) -> Column:
    return F.concat(F.lit("i:"), ingredient_id.cast("string"))


def bipartite_edges(matrix: DataFrame) -> DataFrame:
    """(src, dst): an edge each way for every filled cell."""
    edges = matrix.where("w <> 0").select(
        recipe_node(F.col("recipe_id")).alias("src"), ingredient_node(F.col("ingredient_id")).alias("dst")
    ).distinct()
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: nodes of each type, and edges."""
    nodes = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n"))).distinct()
    kinds = nodes.select(F.substring("n", 1, 1).alias("kind")).unionByName(edges.select(F.lit("edge").alias("kind")))
    names = {"r": "recipes", "i": "ingredients", "edge": "edges"}
    return kinds.agg(*(F.count_if(F.col("kind") == kind).alias(name) for kind, name in names.items()))


def forward_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").startswith("r:") & F.col("dst").startswith("i:"))


def split_edges(edges: DataFrame, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Edges with ``part``: the first share in a hashed order is ``train``, the rest
    ``test``."""
    ordered = dense_index(edges.withColumn("_h", hash_key(seed, F.col("src"), F.col("dst"))), "_h", "src", "dst")
    n = ordered.count()
    part = F.when(F.col("idx") < int(n * train), "train").otherwise("test")
    return ordered.withColumn("part", part).select("src", "dst", "part")


def negative_edges(positives: DataFrame, known: DataFrame, seed: int = 42, draws: int = 3) -> DataFrame:
    """(src, dst): as many absent recipe-ingredient pairs as there are positives, or all
    there are.

    Each positive draws a few random pairs by hash; known edges and repeats are
    thrown out, and the first ones in a hashed order are kept.  Only draws that can be among
    these are moved on; should they be too few after all, more are.  Where that leaves too few,
    as in a graph that has most of its pairs, they are taken by rank among the absent
    pairs instead (``absent_by_rank``).
    """
    ends = cut(known.select("src", "dst").distinct())
    sources = cut(dense_index(ends.select("src").distinct(), "src"))
    targets = cut(dense_index(ends.select("dst").distinct(), "dst"))
    n_sources, n_targets, n_known, n = sources.count(), targets.count(), ends.count(), positives.count()
    wanted = min(n, n_sources * n_targets - n_known)
    drawn = positives.select("src", "dst", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_t"))
    place = lambda side, n: F.floor(hash_unit(f"{seed}.{side}", F.col("src"), F.col("dst"), F.col("_t")) * n)
    picks = drawn.select(place("s", n_sources).alias("s"), place("t", n_targets).alias("t"))
    named = picks.join(sources.select(F.col("idx").alias("s"), "src"), "s").join(targets.select(F.col("idx").alias("t"), "dst"), "t")
    share = _share_of_draws(n_sources * n_targets, n_known, n * draws, wanted)
    while True:
        # Those below a share of the hashes come before all others, so if they are enough the rest is not needed.
        low = named.where(_order(seed) < share).select("src", "dst").distinct()
        absent = cut(low.join(ends, ["src", "dst"], "left_anti"))
        enough = absent.count() >= wanted
        if enough or share >= 1:
            break
        share = min(1.0, 2 * share)
    return _lowest(absent, wanted, seed) if enough else absent_by_rank(ends, sources, targets, n_targets, wanted, seed)


def _order(seed: int) -> Column:
    """The hashed order of edges as a number from 0 to 1."""
    return hash_unit(seed, F.col("src"), F.col("dst"))


def _share_of_draws(pairs: int, known: int, drawn: int, wanted: int) -> float:
    """What share of all draws is likely to hold ``wanted`` distinct absent pairs, and some."""
    distinct = pairs * -math.expm1(-drawn / pairs) * (1 - known / pairs) if pairs else 0.0
    return min(1.0, (1.05 * wanted + 1000) / distinct) if distinct > 0 else 1.0


def _lowest(edges: DataFrame, wanted: int, seed: int) -> DataFrame:
    """The first ``wanted`` of at least as many distinct edges in the hashed order: whole
    stretches of hashes, and of the stretch where the count is reached the first ones."""
    stretches = max(1, wanted // 1000)
    placed = edges.withColumn("_s", F.floor(_order(seed) * stretches))
    ranked = prefix_sum(placed.groupBy("_s").agg(F.count("*").alias("n")), "_s", "n", "before")
    reached = ranked.where((F.col("before") < wanted) & (F.col("before") + F.col("n") >= wanted)).first()
    if reached is None:
        return edges.limit(0)
    inside = placed.where(F.col("_s") == reached["_s"]).orderBy(hash_key(seed, F.col("src"), F.col("dst")), "src", "dst")
    whole = placed.where(F.col("_s") < reached["_s"]).select("src", "dst")
    return whole.unionByName(inside.limit(wanted - reached["before"]).select("src", "dst"))


def absent_by_rank(ends: DataFrame, sources: DataFrame, targets: DataFrame, n_targets: int, wanted: int, seed: int = 42) -> DataFrame:
    """(src, dst): ``wanted`` distinct absent pairs, one at random from each of as many equal
    runs of all absent pairs in order.

    sources and targets are numbered (idx).  A source with g known targets has n - g absent
    ones.  The j-th known target t (from 0) has t - j absent ones before it, so the q-th
    absent target is q plus the number of known ones with t - j <= q: a running count over
    known targets and questions in one order, along ranges, so that a source with very
    many edges is no task of its own.  Nothing is drawn twice, however full the graph is.
    """
    numbered = ends.join(sources.select("src", F.col("idx").alias("s")), "src").join(targets.select("dst", F.col("idx").alias("t")), "dst")
    known = cut(dense_index(numbered.select("s", "t"), "s", "t", name="edge"))
    held = known.groupBy("s").agg(F.count("*").alias("n"), F.min("edge").alias("first"))
    free = cut(prefix_sum(held.withColumn("free", n_targets - F.col("n")), "s", "free", "start"))
    total = free.agg(F.coalesce(F.sum("free"), F.lit(0))).first()[0]
    if not wanted:
        return ends.limit(0)
    # Run k of the absent pairs is [k total / wanted, (k + 1) total / wanted).
    run = F.explode(F.sequence(F.expr(f"start * {wanted} div {total}"), F.expr(f"(start + free - 1) * {wanted} div {total}")))
    asked = free.where("free > 0").withColumn("k", run)
    begin, end = F.expr(f"(k * {total} + {wanted - 1}) div {wanted}"), F.expr(f"((k + 1) * {total} + {wanted - 1}) div {wanted}")
    rank = begin + F.floor(hash_unit(f"{seed}.rank", F.col("k")) * (end - begin)).cast("long")
    asked = asked.withColumn("q", rank - F.col("start")).where("q >= 0 and q < free").select("s", "q", "k")
    gaps = known.join(held.select("s", "first"), "s").select("s", (F.col("t") - (F.col("edge") - F.col("first"))).alias("q"), F.col("t").alias("k"))
    order = lambda kind: F.struct("s", "q", F.lit(kind).alias("kind"), "k")
    both = gaps.select(order(0).alias("at"), F.lit(1).cast("long").alias("one")).unionByName(asked.select(order(1).alias("at"), F.lit(0).cast("long").alias("one")))
    counted = prefix_sum(both, "at", "one", "before").where("at.kind = 1").select(F.col("at.s").alias("s"), F.col("at.q").alias("q"), "before")
    found = counted.join(held.select("s", "first"), "s").select("s", (F.col("q") + F.col("before") - F.col("first")).alias("t"))
    return found.join(sources.select(F.col("idx").alias("s"), "src"), "s").join(targets.select(F.col("idx").alias("t"), "dst"), "t").select("src", "dst")


def _adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge number -> neighbour, its first edge number and degree), and the same of
    every node.  Any neighbour of any node is then one look-up by number, however many it
    has.  The look-up table is written dealt by its key, so that steps only move walks."""
    numbered = cut(dense_index(edges.select("src", "dst").distinct(), "src", "dst", name="edge"))
    nodes = cut(numbered.groupBy("src").agg(F.min("edge").alias("first"), F.count("*").alias("degree")))
    ends = nodes.select(F.col("src").alias("dst"), F.col("first").alias("next_first"), F.col("degree").alias("next_degree"))
    by_number = numbered.join(ends, "dst", "left").select("edge", F.col("dst").alias("next"), "next_first", "next_degree")
    return dealt(by_number, "edge"), nodes


def random_walks(
    edges: DataFrame,
    walk_length: int = 20,
    walks_per_node: int = 10,
    p: float = 1.0,
    q: float = 1.0,
    seed: int = 42,
    start_prefix: str = "",
) -> DataFrame:
    """(walk, nodes): second-order walks from every node.

    A step weighs its neighbours: 1/p for the way back, 1 when next to the previous
    node, 1/q otherwise.  It first decides by weight whether to go back; if not, it
    draws neighbours evenly and keeps the first that passes a coin of its weight.
    Walks without one draw again, more at a time; a draw is only made if the ones before it
    came to nothing.  So a step never lists the
    neighbours of a node, however many there are.  A walk ends early at a node without
    edges of its own.
    """
    by_number, nodes = _adjacency(edges)
    top = max(1.0, 1 / q)
    one_neighbour = p == 1 and q == 1
    state = ["walk", "cur", "first", "degree"]
    start = nodes.where(F.col("src").startswith(start_prefix)).select(
        F.explode(F.sequence(F.lit(1), F.lit(walks_per_node))).alias("_n"), F.col("src").alias("cur"), "first", "degree"
    )
    at = cut(start.select(F.concat_ws("#", "cur", "_n").alias("walk"), F.lit(None).cast("string").alias("prev"), "cur", "first", "degree"))
    if not one_neighbour:
        linked = dealt(edges.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(True).alias("_linked")).distinct(), "prev", "next")
    steps = [at.select("walk", F.lit(0).alias("step"), F.col("cur").alias("node"))]
    for step in range(1, walk_length):
        moved = []
        open_walks, attempt, first = at.where("degree is not null"), 0, 1
        simple = one_neighbour or step == 1
        while True:
            mark = f"{seed}.{step}.{attempt}"
            # Most walks take the first draw; only those that do not are given the rest of the attempt.
            last = 1 if first == 1 and not attempt else 8 * 4**attempt
            placed = open_walks.withColumn("_t", F.explode(F.sequence(F.lit(first), F.lit(last))))
            u = hash_unit(mark, F.col("walk"), F.col("_t"))
            drawn = placed.withColumn("edge", F.col("first") + F.floor(u * F.col("degree")).cast("long")).join(by_number, "edge")
            onward = [F.col("next").alias("cur"), F.col("next_first").alias("first"), F.col("next_degree").alias("degree")]
            if simple:  # without weights nobody asks where a walk came from
                moved.append(drawn.select("walk", *([] if one_neighbour else [F.col("cur").alias("prev")]), *onward))
                break
            weight = F.when(F.col("_linked"), F.lit(1.0)).otherwise(F.lit(1 / q)) / top
            back = hash_unit(f"{mark}.back", F.col("walk"), F.col("_t")) < F.lit(1 / p) / (
                F.lit(1 / p) + F.col("degree") * top  # an attempt ahead draws among all neighbours
            )
            kept = (F.col("next") != F.col("prev")) & (hash_unit(f"{mark}.coin", F.col("walk"), F.col("_t")) < weight)
            behind = F.struct("_t", F.col("prev").alias("cur"), F.col("prev_first").alias("first"), F.col("prev_degree").alias("degree"))
            chosen = F.when(back, behind).when(kept, F.struct("_t", *onward))
            held = ["walk", "prev", "prev_first", "prev_degree", *state[1:]]
            drawn = drawn.join(linked, ["prev", "next"], "left")
            drawn = cut(drawn.select(*held, chosen.alias("_step")) if first == last else drawn.groupBy(*held).agg(F.min(chosen).alias("_step")))
            moved.append(drawn.where("_step is not null").select("walk", F.col("cur").alias("prev"), *(F.col(f"_step.{c}") for c in state[1:]), F.col("first").alias("prev_first"), F.col("degree").alias("prev_degree")))
            open_walks = drawn.where("_step is null").drop("_step")
            first, attempt = (2, attempt) if last == 1 else (1, attempt + 1)
            if open_walks.isEmpty():
                break
        union = moved[0]
        for more in moved[1:]:
            union = union.unionByName(more)
        if not one_neighbour and step == 1:  # back at the start
            union = union.join(nodes.select(F.col("src").alias("prev"), F.col("first").alias("prev_first"), F.col("degree").alias("prev_degree")), "prev")
        at = cut(union) if simple else union  # what later steps moved is written already
        steps.append(at.select("walk", F.lit(step).alias("step"), F.col("cur").alias("node")))
    rows = steps[0]
    for more in steps[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("walk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda x: x["node"]).alias("nodes")
    )


def metapath_walks(edges: DataFrame, walk_length: int = 10, walks_per_node: int = 5, seed: int = 42) -> DataFrame:
    """Walks that start at recipes and alternate between recipes and ingredients."""
    typed = edges.where(F.substring("src", 1, 2) != F.substring("dst", 1, 2))
    return random_walks(typed, walk_length, walks_per_node, seed=seed, start_prefix="r:")


def edge_features(edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Edges with ``features``: the element-wise product of both ends, in either
    direction.  An edge with an unknown end falls away."""
    first = embeddings.select(F.col("node").alias("src"), F.col("embedding").alias("_a"))
    second = embeddings.select(F.col("node").alias("dst"), F.col("embedding").alias("_b"))
    product = F.zip_with("_a", "_b", lambda x, y: x.cast("double") * y.cast("double"))
    return edges.join(first, "src").join(second, "dst").withColumn("features", product).drop("_a", "_b")


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges between a recipe and an ingredient."""
    return edges.where(F.substring("src", 1, 2) != F.substring("dst", 1, 2))


def link_scores(train: DataFrame, test: DataFrame, rounds: int = 1000, fit_on_eval: bool = False) -> DataFrame:
    """Test rows with ``score``: logistic regression on features and label (0 / 1).
    ``fit_on_eval`` fits on the rows that are scored, as a ceiling."""
    def vectors(df: DataFrame) -> DataFrame:
        return df.withColumn("_v", array_to_vector("features")).withColumn("_y", F.col("label").cast("double"))

    fitted = LogisticRegression(featuresCol="_v", labelCol="_y", predictionCol="_p", probabilityCol="_prob", maxIter=rounds).fit(
        vectors(test if fit_on_eval else train)
    )
    scored = fitted.transform(vectors(test))
    return scored.withColumn("score", F.get(vector_to_array("_prob"), F.lit(1))).drop("_v", "_y", "_p", "_prob", "rawPrediction")


def auc(scored: DataFrame) -> DataFrame:
    """One row (auc, positives, negatives) from (score, label), ties count half.

    Rows are counted per distinct score first; the running count of negatives is
    summed along range partitions, not in one sorted window.
    """
    label = F.col("label")
    counts = scored.groupBy("score").agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("n"))
    ranked = prefix_sum(counts, "score", "n", "below")
    won = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return ranked.agg(won.alias("w"), F.sum("p").alias("positives"), F.sum("n").alias("negatives")).select(
        F.try_divide(F.col("w"), F.col("positives") * F.col("negatives").cast("double")).alias("auc"), "positives", "negatives"
    )


def threshold_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: accuracy at the threshold, mean and deviation of the scores by class."""
    hit = (F.col("score") > threshold).cast("int") == F.col("label")
    by = lambda fn, label: fn(F.when(F.col("label") == label, F.col("score")))
    return scored.agg(
        F.avg(hit.cast("double")).alias("accuracy"),
        by(F.avg, 1).alias("positive_mean"), by(F.stddev_pop, 1).alias("positive_std"),
        by(F.avg, 0).alias("negative_mean"), by(F.stddev_pop, 0).alias("negative_std"),
    )


def norm_report(features: DataFrame) -> DataFrame:
    """Accuracy when the feature norm is cut halfway between the class means."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
    rows = cut(features.select("label", norm.alias("norm")))
    means = rows.agg(
        F.avg(F.when(F.col("label") == 1, F.col("norm"))).alias("a"), F.avg(F.when(F.col("label") == 0, F.col("norm"))).alias("b")
    ).first()
    middle = ((means["a"] or 0.0) + (means["b"] or 0.0)) / 2
    right = F.when(F.col("label") == 1, F.col("norm") > middle).otherwise(F.col("norm") < middle)
    return rows.agg(F.avg(right.cast("double")).alias("accuracy")).select(
        F.lit(float(middle)).alias("threshold"), "accuracy"
    )


def random_baseline(edges: DataFrame, seed: int = 42) -> DataFrame:
    """AUC of hashed scores on labelled edges; about one half."""
    score = hash_unit(seed, F.col("src"), F.col("dst"))
    return auc(edges.select(score.alias("score"), "label"))


def edge_type_audit(edges: DataFrame) -> DataFrame:
    """(label, kind, n): recipe-recipe, ingredient-ingredient and valid edges."""
    a, b = F.substring("src", 1, 1), F.substring("dst", 1, 1)
    kind = F.when(a != b, "valid").when(a == "r", "recipe-recipe").otherwise("ingredient-ingredient")
    return edges.select("label", kind.alias("kind")).groupBy("label", "kind").agg(F.count("*").alias("n"))


def train_test_gap(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row (train_auc, test_auc, gap, verdict) from scored rows of both parts."""
    both = auc(train).select(F.lit("train").alias("part"), "auc").unionByName(
        auc(test).select(F.lit("test").alias("part"), "auc")
    )
    gap = F.col("train_auc") - F.col("test_auc")
    # Above 0.05 is overfitting, within 0.02 is good.
    verdict = F.when(gap > 0.05, "overfitting").when(F.abs(gap) < 0.02, "good").otherwise("moderate")
    return (
        both.agg(*(F.max(F.when(F.col("part") == part, F.col("auc"))).alias(f"{part}_auc") for part in ("train", "test")))
        .withColumn("gap", gap)
        .withColumn("verdict", verdict)
    )
