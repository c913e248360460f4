"""Distances against brute force on random small matrices."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blendspark.operators import bags as B
from blendspark.operators import facts as FO
from blendspark.operators import neighbours as N
from blendspark.operators import transport as TP
from blendspark.operators import trees as TR

PATHS = {1: "/1/", 2: "/2/", 5: "/1/5/", 6: "/1/6/", 7: "/1/7/", 8: "/2/8/", 9: "/2/9/", 11: "/1/5/11/", 12: "/1/5/12/"}
LEVEL = {1: 0, 2: 0, 5: 1, 6: 1, 7: 1, 8: 0, 9: 0, 11: 1, 12: 0}


def random_recipes(seed, n=40, hot=5):
    """A third of the recipes are copies, most hold the same hot item."""
    rng = random.Random(seed)
    out = {}
    for r in range(n):
        if r % 3 == 0:
            out[r] = {hot: 0.5, 6: 0.5}
            continue
        items = rng.sample(sorted(PATHS), rng.randint(1, 4))
        if rng.random() < 0.6 and hot not in items:
            items.append(hot)
        cuts = [rng.randint(1, 6) for _ in items]
        out[r] = {i: c / sum(cuts) for i, c in zip(items, cuts)}
    return out


def matrix_of(spark, recipes):
    rows = [(r, i, w) for r, items in recipes.items() for i, w in items.items()]
    return spark.createDataFrame(rows, "recipe_id long, ingredient_id long, w double")


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(i, str(i), p, LEVEL[i]) for i, p in PATHS.items()]
    return FO.load_ingredient_tree(
        spark.createDataFrame(rows, "ingredient_id long, ingredient_name string, path string, substitution_level int")
    ).cache()


def nodes(i):
    return [int(x) for x in PATHS[i].strip("/").split("/")]


def links(i, j):
    a, b = nodes(i), nodes(j)
    c = 0
    while c < min(len(a), len(b)) and a[c] == b[c]:
        c += 1
    rest = a[c:] + b[c:]
    free = sum(LEVEL[x] == 1 for x in rest)
    return free, len(rest) - free


def swappable(i, j):
    a, b = nodes(i), nodes(j)
    both = LEVEL[i] == 1 and LEVEL[j] == 1 and len(a) > 1 and a[:-1] == b[:-1]
    return both or (LEVEL[i] == 1 and a[:-1] == b) or (LEVEL[j] == 1 and b[:-1] == a)


def manhattan(x, y):
    return sum(abs(x.get(i, 0) - y.get(i, 0)) for i in x.keys() | y.keys())


def swapped(x, y, weight):
    total = 0.0
    for c in PATHS:
        best = abs(x.get(c, 0) - y.get(c, 0))
        for j in PATHS:
            if j != c and swappable(c, j):
                if (x.get(c, 0) > 0 and y.get(j, 0) > 0) or (x.get(j, 0) > 0 and y.get(c, 0) > 0):
                    best = min(best, weight * abs(x.get(c, 0) + x.get(j, 0) - y.get(c, 0) - y.get(j, 0)))
        total += best
    return total


def tree_distance(x, y, free, other):
    total = 0.0
    for node in PATHS:
        def below(r):
            return sum(w for i, w in r.items() if node in nodes(i))
        total += (free if LEVEL[node] == 1 else other) * abs(below(x) - below(y))
    return total


def expected_pairs(bag_ids, recipes, fn, bound):
    found = {}
    for a, b in itertools.combinations(sorted(bag_ids), 2):
        d = fn(recipes[a], recipes[b])
        if d <= bound + 1e-9:
            found[a, b] = d
    return found


def check(got_rows, want):
    got = {(r["id1"], r["id2"]): r["d"] for r in got_rows}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_pairs_are_complete(spark, tree, seed):
    recipes = random_recipes(seed)
    bags, members = B.collapse_copies(matrix_of(spark, recipes))
    ids = [r[0] for r in bags.select("recipe_id").distinct().collect()]
    copies = {r["recipe_id"]: r for r in members.collect()}
    assert all(recipes[r] == recipes[m["bag_id"]] for r, m in copies.items()) and len(copies) == len(recipes)
    for bound in (0.4, 1.0, 1.9):
        check(B.manhattan_pairs(bags, bound).collect(), expected_pairs(ids, recipes, manhattan, bound))
    for bound in (0.0, 0.5, 0.9):
        jaccard = lambda x, y: 1 - len(x.keys() & y.keys()) / len(x.keys() | y.keys())
        check(B.jaccard_pairs(bags, bound).collect(), expected_pairs(ids, recipes, jaccard, bound))
    sharing = lambda x, y: len(x.keys() ^ y.keys()) if x.keys() & y.keys() else 99
    check(B.edit_distance_pairs(bags, 3).collect(), expected_pairs(ids, recipes, sharing, 3))
    for bound, weight in ((0.3, 0.1), (1.2, 0.5)):
        fn = lambda x, y: swapped(x, y, weight)
        check(TR.substitution_weighted_pairs(bags, tree, bound, weight=weight).collect(), expected_pairs(ids, recipes, fn, bound))
    for bound in (0.9, 1.7):
        fn = lambda x, y: tree_distance(x, y, 1, 2)
        check(TR.tree_emd_pairs(bags, tree, bound, free=1, other=2).collect(), expected_pairs(ids, recipes, fn, bound))


def test_a_bound_that_takes_everything_is_refused(spark):
    bags = matrix_of(spark, {1: {5: 1.0}})
    with pytest.raises(ValueError):
        B.manhattan_pairs(bags, 2.0)
    with pytest.raises(ValueError):
        B.manhattan_pairs(bags)


def test_given_pairs_may_share_nothing(spark):
    bags = matrix_of(spark, {1: {5: 1.0}, 2: {6: 1.0}, 3: {5: 0.5, 6: 0.5}})
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id1 long, id2 long")
    check(B.manhattan_pairs(bags, pairs=pairs).collect(), {(1, 2): 2.0, (1, 3): 1.0})


def test_edit_counts_and_edges(spark):
    recipes = random_recipes(4)
    recipes.update({100: {5: 1.0}, 101: {8: 1.0}, 102: {8: 1.0}, 103: {9: 1.0}})
    sets = {r: dict.fromkeys(items, 1.0) for r, items in recipes.items()}
    bags, members = B.collapse_copies(matrix_of(spark, sets))
    got = {r["recipe_id"]: r["n_pairs"] for r in B.edit_distance_counts(bags, members, 2).collect()}
    want = {r: sum(len(sets[r].keys() ^ sets[q].keys()) == 2 for q in sets if q != r) for r in sets}
    assert got == want
    for edge in B.one_swap_edges(bags).collect():
        a, b = sets[edge["id1"]].keys(), sets[edge["id2"]].keys()
        assert edge["only1"] == sorted(a - b) and edge["only2"] == sorted(b - a) and len(a ^ b) == 2


def test_sets_that_share_nothing_are_classes(spark):
    recipes = random_recipes(6) | {100: {5: 1.0}, 101: {8: 1.0}, 102: {9: 1.0}, 103: {1: 0.5, 2: 0.5}, 104: {8: 0.5, 9: 0.5}}
    sets = {r: set(items) for r, items in recipes.items()}
    matrix = matrix_of(spark, {r: dict.fromkeys(items, 1.0) for r, items in sets.items()})
    apart, near = {}, dict.fromkeys(sets, 0)
    for a, b in itertools.permutations(sets, 2):
        d = len(sets[a] ^ sets[b])
        near[a] += d <= 3
        if d <= 3 and not sets[a] & sets[b]:
            key = (a, len(sets[a]), len(sets[b]), d)
            apart[key] = apart.get(key, 0) + 1
    got = {(r["recipe_id"], r["n"], r["partner_n"], r["d"]): r["apart"] for r in B.apart_classes(matrix, 3).collect()}
    assert got == apart
    assert {r["recipe_id"]: r["near"] for r in B.hamming_counts(matrix, 3).collect()} == near


@pytest.mark.parametrize("most", [0, 2, 32])
def test_deletion_keys_and_long_sets(spark, monkeypatch, most):
    """Sets taken apart, sets that are too long for it, and pairs of both."""
    monkeypatch.setattr(B, "MOST_ITEMS", most)
    rng = random.Random(7)
    sets = {r: set(rng.sample(range(8), rng.randint(1, 6))) for r in range(50)}
    matrix = matrix_of(spark, {r: dict.fromkeys(items, 1.0) for r, items in sets.items()})
    for bound in (1, 2, 3, 4):
        got = {(r["id1"], r["id2"]): (r["n1"], r["n2"], r["d"]) for r in B.edit_distance_pairs(matrix, bound).collect()}
        want = {
            (a, b): (len(sets[a]), len(sets[b]), len(sets[a] ^ sets[b]))
            for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and len(sets[a] ^ sets[b]) <= bound
        }
        assert got == want
    edges = B.one_swap_edges(matrix).collect()
    assert {(e["id1"], e["id2"]) for e in edges} == {p for p, x in want.items() if x[2] == 2}
    assert all(e["only1"] == sorted(sets[e["id1"]] - sets[e["id2"]]) and e["only2"] == sorted(sets[e["id2"]] - sets[e["id1"]]) for e in edges)


def test_tiles_of_hot_items_lose_nothing(spark, monkeypatch):
    recipes = random_recipes(8)
    bags, members = B.collapse_copies(matrix_of(spark, recipes))
    whole = sorted(map(tuple, B.manhattan_pairs(bags, 1.5).collect()))
    lists = sorted(map(tuple, N.nearest_recipes(bags, members, 3).collect()))
    monkeypatch.setattr(B, "TILE", 3)
    assert whole and sorted(map(tuple, B.manhattan_pairs(bags, 1.5).collect())) == whole
    assert sorted(map(tuple, N.nearest_recipes(bags, members, 3).collect())) == lists


@pytest.mark.parametrize("tile", [2048, 3])
def test_cells_that_meet_themselves_move_once(spark, monkeypatch, tile):
    monkeypatch.setattr(B, "TILE", tile)
    recipes = random_recipes(5)
    bags, _ = B.collapse_copies(matrix_of(spark, recipes))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = B.manhattan_pairs(bags, 1.0)
        got = {(r["id1"], r["id2"]): r["d"] for r in out.collect()}
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    kept = {r[0] for r in bags.select("recipe_id").distinct().collect()}
    d = {(a, b): sum(abs(recipes[a].get(i, 0) - recipes[b].get(i, 0)) for i in PATHS) for a, b in itertools.combinations(sorted(kept), 2)}
    assert got == {k: pytest.approx(v) for k, v in d.items() if v <= 1 + 1e-9}
    assert out.count() == len(got)
    near = {(r["id1"], r["id2"]): r["d"] for r in N.nearest_bags(bags, 3).collect()}
    both = {**d, **{(b, a): v for (a, b), v in d.items()}}
    for a in kept:
        want = sorted((round(v, 6), y) for (x, y), v in both.items() if x == a and v < 2 - 1e-9)[:3]
        assert [(pytest.approx(v, abs=1e-6), y) for v, y in want] == sorted((v, y) for (x, y), v in near.items() if x == a)


def test_copies_are_told_by_rounded_weights(spark):
    matrix = matrix_of(spark, {1: {5: 0.1 + 0.2, 6: 0.7}, 2: {5: 0.3, 6: 0.7}, 3: {5: 0.3001, 6: 0.6999}})
    _, members = B.collapse_copies(matrix)
    assert {r["recipe_id"]: r["bag_id"] for r in members.collect()} == {1: 1, 2: 1, 3: 3}


def test_knn_with_many_copies(spark):
    recipes = random_recipes(5)
    bags, members = B.collapse_copies(matrix_of(spark, recipes))
    got = {}
    for r in N.nearest_recipes(bags, members, 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (round(r["d"], 6), r["neighbour"])
    for r in recipes:
        near = sorted((round(manhattan(recipes[r], recipes[q]), 6), q) for q in recipes if q != r)[:4]
        assert got[r] == {i + 1: x for i, x in enumerate(near)}


def test_tree_distances(spark, tree):
    every = [(i, j) for i in PATHS for j in PATHS]
    pairs = spark.createDataFrame(every, "id1 long, id2 long")
    got = {(r["id1"], r["id2"]): (r["substitutable"], r["other"]) for r in TR.tree_distance_pairs(tree, pairs).collect()}
    assert got == {(i, j): links(i, j) for i, j in every}
    assert got[5, 6] == (2, 0) and got[5, 1] == (1, 0) and got[8, 9] == (0, 2)
    flags = {(r["id1"], r["id2"]): r["substitutable"] for r in TR.substitutable_pairs(tree, pairs).collect()}
    assert all(flags[i, j] == swappable(i, j) for i, j in every if i != j)
    tokens = {}
    for r in TR.substitution_tokens(tree).collect():
        tokens.setdefault(r["ingredient_id"], set()).add(r["token"])
    assert all(bool(tokens[i] & tokens[j]) == swappable(i, j) for i, j in every if i != j)


def test_known_values(spark, tree):
    uses = spark.createDataFrame(
        [(1, 5, 30.0), (2, 6, 15.0), (3, 5, 15.0), (4, 6, 30.0)], "recipe_id long, ingredient_id long, volume_fraction double"
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "id1 long, id2 long")
    costs = TR.weighted_volume_cost(TR.ingredient_costs(uses, pairs, tree))
    assert {r["r2"]: r["cost"] for r in costs.collect()} == {2: 47.0, 3: 15.0, 4: 2.0}
    bags = matrix_of(spark, {1: {5: 0.6, 6: 0.4}, 2: {5: 0.3, 7: 0.7}})
    pair = spark.createDataFrame([(1, 2)], "id1 long, id2 long")
    assert TR.tree_emd_pairs(bags, tree, pairs=pair, free=1, other=2).first()["d"] == pytest.approx(1.4)


def test_assignment_against_permutations(spark, tree):
    recipes = {r: v for r, v in random_recipes(7, 14).items()}
    uses = matrix_of(spark, recipes).withColumnRenamed("w", "volume_fraction")
    every = list(itertools.combinations(recipes, 2))
    costs = TR.weighted_volume_cost(TR.ingredient_costs(uses, spark.createDataFrame(every, "id1 long, id2 long"), tree))
    got = {(r["r1"], r["r2"]): r for r in TP.assignment_distance_pairs(costs).collect()}
    for a, b in every:
        x, y = sorted(recipes[a].items()), sorted(recipes[b].items())
        n = max(len(x), len(y))
        square = np.zeros((n, n))
        for i, j in itertools.product(range(n), range(n)):
            if i < len(x) and j < len(y):
                k = sum(links(x[i][0], y[j][0]))
                square[i, j] = abs(x[i][1] - y[j][1]) * (k + 1) + k
            elif i < len(x):
                square[i, j] = x[i][1]
            elif j < len(y):
                square[i, j] = y[j][1]
        best = min(sum(square[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert got[a, b]["d"] == pytest.approx(best)
        assert len(got[a, b]["matches"]) == n


def test_assignment_solver_on_large_random_squares():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        to = TP.cheapest_assignment(cost)
        assert sorted(to) == list(range(n)) and cost[np.arange(n), to].sum() == pytest.approx(best)


@pytest.mark.parametrize("most", [10, 2])
def test_assignments_of_a_stack_are_those_of_its_squares(monkeypatch, most):
    monkeypatch.setattr(TP, "MOST_ROWS", most)
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        costs = rng.integers(0, 5, (40, n, n)).astype(float)  # with ties
        for cost, to in zip(costs, TP.cheapest_assignments(costs)):
            best = TP.cheapest_assignment(cost)
            assert sorted(to) == list(range(n)) and cost[np.arange(n), to].sum() == pytest.approx(cost[np.arange(n), best].sum())


def test_tree_flows_are_plans_of_the_distance(spark, tree):
    recipes = random_recipes(9, n=15)
    bags = matrix_of(spark, recipes)
    pairs = spark.createDataFrame([(a, b) for a in (0, 1, 2, 4) for b in recipes if a != b], "id1 long, id2 long")
    want = {(r["id1"], r["id2"]): r["d"] for r in TR.tree_emd_pairs(bags, tree, pairs=pairs, free=1.0, other=2.0).collect()}
    cost, out, into = {}, {}, {}
    for r in TR.tree_emd_flows(bags, tree, pairs, free=1.0, other=2.0).collect():
        key = (r["id1"], r["id2"])
        cost[key] = cost.get(key, 0) + r["cost"]
        out[key, r["i"]] = out.get((key, r["i"]), 0) + r["flow"]
        into[key, r["j"]] = into.get((key, r["j"]), 0) + r["flow"]
    assert cost.keys() == want.keys() and all(v == pytest.approx(want[k]) for k, v in cost.items())
    for a, b in want:
        for i in PATHS:
            assert out.get(((a, b), i), 0) == pytest.approx(recipes[a].get(i, 0), abs=1e-8)
            assert into.get(((a, b), i), 0) == pytest.approx(recipes[b].get(i, 0), abs=1e-8)


def test_cost_grid_tells_pairs_one_way(spark):
    from blendspark.operators import costs as C

    recipes = random_recipes(4)
    pairs = [(a, b) for a in range(8) for b in range(12) if a < b]
    grid = C.cost_grid(matrix_of(spark, recipes), spark.createDataFrame(pairs, "id1 long, id2 long"))
    met = {(i, j) for a, b in pairs for i in recipes[a] for j in recipes[b]}
    rows = [tuple(r) for r in grid.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == met | {(j, i) for i, j in met} | {(i, i) for items in recipes.values() for i in items}
    assert "least(i" in grid._jdf.queryExecution().optimizedPlan().toString()


def test_costs_are_told_where_ingredients_meet(spark, tree):
    """The same rows as the grid joined with the tree, and no join with it after the pairs."""
    from blendspark.operators import costs as C

    bags = matrix_of(spark, random_recipes(4))
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(12) if a < b], "id1 long, id2 long")
    got = C.met_cost(tree, bags, pairs)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r) for r in C.initial_cost(tree, C.cost_grid(bags, pairs)).collect()) and len(rows) > 20
    assert got.dtypes == [("i", "bigint"), ("j", "bigint"), ("cost", "double")]
    assert C.met_cost(tree, bags, pairs.limit(0)).count() == bags.select("ingredient_id").distinct().count()


def test_pairs_move_as_one_row(spark, tree):
    """Costs that are grouped by pair are not shuffled again; flows and swaps are told where
    the pair is, and nothing is written for them."""
    bags = matrix_of(spark, random_recipes(3))
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(30) if a != b], "id1 long, id2 long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shuffles = lambda df: plan(df).count("Exchange hashpartitioning")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        costs = TR.ingredient_costs(bags.withColumnRenamed("w", "volume_fraction"), pairs, tree)
        assert shuffles(costs.groupBy("r1", "r2").agg(F.sum("k"))) == shuffles(costs) > 0
        for out in (TR.tree_emd_flows(bags, tree, pairs), TR.substitution_weighted_pairs(bags, tree, pairs=pairs)):
            assert plan(out).split("Exchange")[0].count("ArrowEvalPython") == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_pairs_with_one_or_no_known_side(spark, tree):
    bags = matrix_of(spark, {1: {5: 0.6, 6: 0.4}, 2: {5: 0.3, 99: 0.7}})  # 99 is not in the tree
    pairs = spark.createDataFrame([(1, 2), (1, 77), (77, 2), (78, 79)], "id1 long, id2 long")
    got = {(r["id1"], r["id2"]): r["d"] for r in TR.substitution_weighted_pairs(bags, tree, pairs=pairs, weight=0.1).collect()}
    # 5 and 6 are siblings at level 1: both take the joint difference, 0.1 * |0.3 + 0.4|
    assert got == {(1, 2): pytest.approx(0.7 + 0.07 + 0.07), (1, 77): pytest.approx(1.0), (77, 2): pytest.approx(1.0)}
    assert {(r["id1"], r["id2"]) for r in TR.tree_emd_flows(bags, tree, pairs).collect()} <= {(1, 2)}


def test_all_pairs_summary(spark):
    from blendspark.operators import reports as R

    alone = {r: {5: 0.5 + r / 100, 6: 0.5 - r / 100} for r in range(6)}
    for recipes in (random_recipes(10), alone, {1: {5: 1.0}, 2: {5: 1.0}}, {1: {5: 1.0}}, {1: {5: 1.0}, 2: {6: 1.0}}):
        bags, members = B.collapse_copies(matrix_of(spark, recipes))
        row = R.all_pairs_summary(bags, members).first()
        every = [manhattan(recipes[a], recipes[b]) for a, b in itertools.combinations(recipes, 2)]
        assert row["n_pairs"] == len(every)
        got, want = (row["min_d"], row["max_d"], row["mean_d"]), (min(every), max(every), sum(every) / len(every)) if every else (None,) * 3
        assert got == (pytest.approx(want[0], abs=2e-6), pytest.approx(want[1]), pytest.approx(want[2])) if every else got == want


def test_entropic_plans(spark, tree):
    recipes = random_recipes(8, 8)
    uses = matrix_of(spark, recipes).withColumnRenamed("w", "volume_fraction")
    every = list(itertools.combinations(recipes, 2))
    costs = TR.ingredient_costs(uses, spark.createDataFrame(every, "id1 long, id2 long"), tree)
    rows = TP.entropic_ot_pairs(costs, "k", eps=0.02, iterations=3000).collect()
    assert len(rows) == len(every)
    for r in rows:
        x, y = recipes[r["r1"]], recipes[r["r2"]]
        exact = tree_distance(x, y, 1, 1)
        assert exact - 1e-3 <= r["d"] <= exact + 0.1
        out, into = {}, {}
        for f in r["plan"]:
            out[f["i"]] = out.get(f["i"], 0) + f["flow"]
            into[f["j"]] = into.get(f["j"], 0) + f["flow"]
        assert all(out[i] == pytest.approx(w, abs=5e-3) for i, w in x.items())
        assert all(into[j] == pytest.approx(w, abs=5e-3) for j, w in y.items())


def test_small_eps_does_not_underflow():
    a, b = np.array([[0.5, 0.5]]), np.array([[0.5, 0.5]])
    cost = np.array([[[8.0, 7.0], [6.0, 8.0]]])
    plan = TP.entropic_plans(a, b, cost, 3e-3, 500, None)
    assert plan.sum() == pytest.approx(1.0) and plan[0, 0, 1] == pytest.approx(0.5, abs=1e-3)
    soft = TP.entropic_plans(a, b, cost, 3e-3, 500, 0.1)
    assert 0 <= soft.sum() < 1


def test_families_that_lack_too_much_are_no_candidates(spark):
    """Either side has 0.8 in the shared family: enough alone, not for both at a bound of 0.25."""
    recipes = {1: {1: 0.8, 2: 0.2}, 2: {1: 0.8, 3: 0.2}, 3: {1: 0.9, 4: 0.1}, 4: {1: 0.9, 5: 0.1}}
    bags = matrix_of(spark, recipes)
    need = lambda *_: F.lit(0.75)
    pairs = {(r["id1"], r["id2"]) for r in B.near_overlaps(bags, need, need, 0.25).collect()}
    assert pairs == {(3, 4)}
