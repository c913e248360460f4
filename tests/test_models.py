"""Learned costs, clusters, factors and graphs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blendspark.operators import bags as B
from blendspark.operators import clusters as CL
from blendspark.operators import costs as C
from blendspark.operators import factors as FA
from blendspark.operators import facts as FO
from blendspark.operators import embeddings as E
from blendspark.operators import graphs as G
from blendspark.operators import neighbours as N
from blendspark.operators import transport as TP
from blendspark.operators.lineage import dealt

M = 6


@pytest.fixture(scope="module")
def toy(spark):
    """20 x 6 random rows, items in three groups of two, prior 0.3 within and 1.2 across."""
    rng = np.random.default_rng(7)
    a = rng.random((20, M))
    a /= a.sum(axis=1, keepdims=True)
    bags = spark.createDataFrame([(r, i, float(a[r, i])) for r in range(20) for i in range(M)], "recipe_id long, ingredient_id long, w double")
    prior = [(i, j, 0.0 if i == j else 0.3 if i // 2 == j // 2 else 1.2) for i in range(M) for j in range(M)]
    pairs = spark.createDataFrame([(r, s) for r in range(20) for s in range(r + 1, 20)], "id1 long, id2 long")
    return bags.cache(), spark.createDataFrame(prior, "i long, j long, cost double").cache(), pairs.cache()


def square(cost, n=M):
    out = np.full((n, n), np.nan)
    for r in cost.collect():
        out[r["i"], r["j"]] = r["cost"]
    return out


def stabilised(proposal, cost, prior):
    def project(x):
        x = (x + x.T) / 2
        np.fill_diagonal(x, 0)
        return np.clip(x, 0, 8)

    out = project(0.75 * cost + 0.25 * (0.6 * project(proposal) + 0.4 * prior))
    return out / np.median(out[~np.eye(len(out), dtype=bool)])


def test_cost_steps_match_dense_formulas(spark, toy):
    _, prior, _ = toy
    rng = np.random.default_rng(1)
    t = rng.random((M, M))
    t = (t + t.T) / 2
    t[0, 3] = t[3, 0] = 0.0
    matches = spark.createDataFrame([(i, j, float(t[i, j])) for i in range(M) for j in range(M) if t[i, j]], "i long, j long, t double")
    c0 = square(prior)
    expected = (t.sum(1, keepdims=True) + 2) @ (t.sum(0, keepdims=True) + 2) / (t.sum() + 2 * t.size)
    want = stabilised(-np.log((t + 2) / expected), c0, c0)
    assert np.allclose(square(C.blosum_cost(matches, prior, prior)), want, atol=1e-6)
    want = stabilised(c0 - t / 0.02, c0, c0)
    assert np.allclose(square(C.convex_cost(matches, prior, prior)), want, atol=1e-6)
    want = stabilised(c0 - 0.1 * t, c0, c0)
    assert np.allclose(square(C.convex_cost(matches, prior, prior, one_step=True)), want, atol=1e-6)


def test_expected_matches_are_symmetric_and_weighted(spark):
    d = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.3), (2, 3, 0.6)], "id1 long, id2 long, d double")
    plans = spark.createDataFrame(
        [(1, 2, 5, 6, 0.7), (1, 2, 5, 5, 0.3), (1, 3, 5, 7, 1.0), (2, 3, 6, 7, 1.0)], "r1 long, r2 long, i long, j long, flow double"
    )
    got = {(r["i"], r["j"]): r["t"] for r in C.expected_matches(d, plans, k=1, beta=2.0).collect()}
    # nearest: 1 -> 2, 2 -> 1, 3 -> 1, each with weight 1
    want = {(5, 6): 0.7, (6, 5): 0.7, (5, 5): 0.6, (5, 7): 0.5, (7, 5): 0.5}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_fit_keeps_the_table_sane(spark, toy):
    bags, prior, pairs = toy
    cost, changes = C.fit_costs(bags, pairs, prior, rounds=2, smoothing=0.05, iterations=200, k=5)
    got = square(cost)
    assert np.allclose(got, got.T) and np.all(np.diag(got) == 0) and np.all(got >= 0)
    assert np.median(got[~np.eye(M, dtype=bool)]) == pytest.approx(1.0) and 1 <= len(changes) <= 2
    same, different = got[0, 1], got[0, 2]
    assert same < different


def test_fit_ranks_all_pairs_anew(spark, toy):
    """Without given pairs, the same as with all of them."""
    bags, prior, pairs = toy
    given, changes = C.fit_costs(bags, pairs, prior, rounds=2, smoothing=0.05, iterations=100, k=3)
    every, same = C.fit_costs(bags, None, prior, rounds=2, smoothing=0.05, iterations=100, k=3)
    assert np.allclose(square(every), square(given), atol=1e-9) and same == pytest.approx(changes)


def test_no_nearest_recipe_escapes_the_bound(spark, monkeypatch):
    monkeypatch.setattr(TP, "AT_ONCE", 64)
    rng = np.random.default_rng(3)
    n, m, k = 60, 12, 4
    weights = [{int(i): float(w) for i, w in zip(rng.choice(m, 3, replace=False), rng.dirichlet(np.ones(3)))} for _ in range(n)]
    bags = spark.createDataFrame([(r, i, w) for r, row in enumerate(weights) for i, w in row.items()], "recipe_id long, ingredient_id long, w double")
    c = rng.random((m, m)) * 2
    c = c + c.T
    np.fill_diagonal(c, 0)
    cost = spark.createDataFrame([(i, j, float(c[i, j])) for i in range(m) for j in range(m)], "i long, j long, cost double")
    all_pairs = spark.createDataFrame([(r, s) for r in range(n) for s in range(r + 1, n)], "id1 long, id2 long")
    whole = TP.entropic_ot_pairs(C.pair_costs(bags, all_pairs, cost), "k", 0.05, 100)
    bounded = C.nearest_by_transport(bags, cost, k, 0.05, 100)
    lists = lambda rows: {(r["id"], r["rank"]): (r["neighbour"], round(r["d"], 9)) for r in N.knn(rows.selectExpr("r1 id1", "r2 id2", "d"), k).collect()}
    assert lists(bounded) == lists(whole) and len(lists(whole)) == n * k
    assert bounded.count() < n * (n - 1) / 2


def test_square_cost_has_every_two_items(spark):
    """Also those that no near recipes bring together, and at the same price."""
    rows = [(1, "t", "/1/", 0), (2, "u", "/2/", 0), (11, "a", "/1/11/", 1), (12, "b", "/1/12/", 0), (21, "c", "/2/21/", 1)]
    tree = FO.load_ingredient_tree(spark.createDataFrame(rows, "ingredient_id long, ingredient_name string, path string, substitution_level int"))
    items = spark.createDataFrame([(11,), (12,), (21,), (11,)], "ingredient_id long")
    got = {(r["i"], r["j"]): r["cost"] for r in C.square_cost(tree, items).collect()}
    grid = spark.createDataFrame([(a, b) for a in (11, 12, 21) for b in (11, 12, 21)], "id1 long, id2 long")
    want = {(r["i"], r["j"]): r["cost"] for r in C.initial_cost(tree, grid).collect()}
    assert got == want and got[11, 12] == 11.0 and got[11, 21] == 22.0 and len(got) == 9


def test_fit_with_dummy(spark, toy):
    bags, prior, pairs = toy
    cost, _ = C.fit_costs(bags, pairs, prior, rounds=1, smoothing=0.1, iterations=50, dummy=2.0)
    dummy = {(r["i"], r["j"]): r["cost"] for r in cost.where("i = -1 or j = -1").collect()}
    assert dummy[-1, -1] == 0 and all(v == pytest.approx(1.96) for k, v in dummy.items() if k != (-1, -1)) and len(dummy) == 2 * M + 1


def test_kmedoids_finds_clear_groups(spark):
    """Three groups on items of their own, the first with a crowd of copies in one bag."""
    share = {0: (0, 0.9), 1: (0, 0.8), 2: (0, 0.7), 3: (2, 0.6), 4: (2, 0.5), 5: (2, 0.4), 6: (4, 0.9), 7: (4, 0.8)}
    cells = [(r, i + k, x) for r, (i, w) in share.items() for k, x in enumerate((w, 1 - w))]
    bags = spark.createDataFrame(cells, "recipe_id long, ingredient_id long, w double")
    crowd = {r: 10 if r == 0 else 1 for r in share}
    copies = spark.createDataFrame(list(crowd.items()), "bag_id long, copies long")
    got = CL.kmedoids(bags, copies, k=3)
    rows, groups = got.collect(), {}
    for r in rows:
        groups.setdefault((r["cluster"], r["medoid"]), set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5], [6, 7]]

    def total(medoid, group):  # Manhattan distance of two such bags is twice the shift
        return sum(crowd[r] * 2 * abs(share[r][1] - share[medoid][1]) for r in group)

    for (_, medoid), group in groups.items():
        assert total(medoid, group) == pytest.approx(min(total(m, group) for m in group))
    assert all(r["d"] == pytest.approx(2 * abs(share[r["id"]][1] - share[r["medoid"]][1])) for r in rows)
    assert sorted(r["n"] for r in CL.cluster_sizes(got).collect()) == [2, 3, 3]


def test_nmf_lowers_the_error(spark):
    rng = np.random.default_rng(5)
    x = rng.random((12, 2)) @ rng.random((2, 7))
    rows = [(r, i, float(x[r, i])) for r in range(12) for i in range(7)]
    matrix = spark.createDataFrame(rows, "recipe_id long, ingredient_id long, w double")
    w, h, error = FA.nmf_kl(matrix, k=2, rounds=4)
    left = np.array([r["f"] for r in w.orderBy("recipe_id").collect()])
    right = np.array([r["f"] for r in h.orderBy("ingredient_id").collect()]).T
    fit = left @ right
    assert error == pytest.approx(np.sqrt(2 * np.sum(x * np.log(x / fit) - x + fit)), abs=1e-6)
    # After a step of H the fitted columns add up to the given ones.
    assert np.allclose(fit.sum(axis=0), x.sum(axis=0))
    assert error < FA.nmf_kl(matrix, k=2, rounds=1)[2]


def test_square_classes_against_all_pairs(spark):
    """Items at every level of the tree, two roots, and one that the tree does not have."""
    paths = {1: "/1/", 2: "/2/", 5: "/1/5/", 6: "/1/6/", 8: "/2/8/", 11: "/1/5/11/", 12: "/1/5/12/", 13: "/1/6/13/"}
    level = {1: 0, 2: 1, 5: 1, 6: 0, 8: None, 11: 1, 12: 0, 13: 1}
    rows = [(i, str(i), p, level[i]) for i, p in paths.items()]
    tree = FO.load_ingredient_tree(spark.createDataFrame(rows, "ingredient_id long, ingredient_name string, path string, substitution_level int"))
    items = spark.createDataFrame([(i,) for i in [*paths, 5, 99]], "ingredient_id long")
    grid = spark.createDataFrame([(i, j) for i in paths for j in paths], "id1 long, id2 long")
    costs = [r["cost"] for r in C.initial_cost(tree, grid).collect() if r["i"] != r["j"]]
    classes = C.square_classes(tree, items)
    got = {r["cost"]: r["n"] for r in classes.collect()}
    assert got == {c: costs.count(c) for c in set(costs)}
    for q in (0.0, 0.3, 0.5, 0.85, 1.0):
        assert C.class_quantile(classes, q) == pytest.approx(np.quantile(costs, q))
    assert C.class_quantile(classes.limit(0), 0.5) is None


def test_fuzzy_edges(spark):
    lists = spark.createDataFrame(
        [(0, 1, 1, 0.1), (0, 2, 2, 0.4), (0, 3, 3, 0.5), (1, 0, 1, 0.1), (1, 2, 2, 0.2), (1, 3, 3, 0.9)],
        "id long, neighbour long, rank int, d double",
    )
    got = {(r["id1"], r["id2"]): r["weight"] for r in FA.fuzzy_edges(lists).collect()}
    assert got[0, 1] == pytest.approx(1.0)
    assert got[0, 1] + got[0, 2] + got[0, 3] == pytest.approx(np.log2(3), abs=1e-6)
    assert all(0 < v <= 1 for v in got.values())


def test_scales_of_lists_without_spark_rows():
    lists = pa.array([[0.1, 0.4, 0.5], [], [2.0], [0.3] * 4], pa.list_(pa.float64()))
    first, none, one, same = FA._scales(lists, 64).to_pylist()
    assert sum(np.exp(-(d - 0.1) / first) for d in (0.1, 0.4, 0.5)) == pytest.approx(np.log2(3), abs=1e-9)
    assert none is None and one == pytest.approx(1e-6) and same == pytest.approx(1e-6)


def star(spark):
    """One hub ingredient in every recipe, some others."""
    rows = [(r, 0, 1.0) for r in range(12)] + [(r, 1 + r % 3, 1.0) for r in range(12)]
    return G.bipartite_edges(spark.createDataFrame(rows, "recipe_id long, ingredient_id long, w double"))


@pytest.mark.parametrize("p, q", [(1.0, 1.0), (4.0, 0.25)])
def test_walks_follow_edges(spark, p, q):
    edges = star(spark)
    known = {(r["src"], r["dst"]) for r in edges.collect()}
    walks = G.random_walks(edges, walk_length=6, walks_per_node=3, p=p, q=q).collect()
    assert len(walks) == 3 * (12 + 4) and all(len(w["nodes"]) == 6 for w in walks)
    assert all(step in known for w in walks for step in zip(w["nodes"], w["nodes"][1:]))
    again = G.random_walks(edges, walk_length=6, walks_per_node=3, p=p, q=q).collect()
    assert sorted(map(tuple, (w["nodes"] for w in walks))) == sorted(map(tuple, (w["nodes"] for w in again)))


def test_return_odds(spark):
    """With a tiny return weight a walk hardly ever goes straight back."""
    walks = G.random_walks(star(spark), walk_length=4, walks_per_node=20, p=1000.0, q=1.0, start_prefix="r:").collect()
    back = sum(w["nodes"][2] == w["nodes"][0] for w in walks)
    assert back <= len(walks) * 0.02
    often = G.random_walks(star(spark), walk_length=4, walks_per_node=20, p=0.01, q=1.0, start_prefix="r:").collect()
    assert sum(w["nodes"][2] == w["nodes"][0] for w in often) >= len(often) * 0.8


def test_exact_step_odds(spark):
    """Paths a-b-c (degree 2) and a-b-{c,d} (degree 3), p = 1, q = 0.5: going back weighs
    1, going on 2 each."""
    for ahead in (1, 2):
        links = [(f"r:{i}", f"i:{i}") for i in range(3000)] + [(f"i:{i}", f"r:{i}.{n}") for i in range(3000) for n in range(ahead)]
        edges = spark.createDataFrame(links + [(b, a) for a, b in links], "src string, dst string")
        walks = G.random_walks(edges, walk_length=3, walks_per_node=1, p=1.0, q=0.5, start_prefix="r:")
        firsts = [w["nodes"] for w in walks.collect() if "." not in w["nodes"][0]]
        back = sum(n[2] == n[0] for n in firsts) / len(firsts)
        assert len(firsts) == 3000 and abs(back - 1 / (1 + 2 * ahead)) < 0.03


def test_a_walk_draws_on_only_where_nothing_came_of_the_first(spark, monkeypatch):
    """One draw a walk, then the rest of the attempt for those that still stand."""
    edges, made, sequence = star(spark), [], F.sequence
    monkeypatch.setattr(G.F, "sequence", lambda *ends: made.append(str(sequence(*ends))) or sequence(*ends))
    walks = G.random_walks(edges, walk_length=3, walks_per_node=3, p=4.0, q=0.25).collect()
    assert {len(w["nodes"]) for w in walks} == {3}
    ends = [m[m.index("(") + 1 : m.index(")")].replace(" ", "") for m in made]
    assert "1,1" in ends and "2,8" in ends and "1,8" not in ends


def test_metapath_starts_at_recipes_and_alternates(spark):
    for w in G.metapath_walks(star(spark), 5, 2).collect():
        assert [n[0] for n in w["nodes"]] == ["r", "i", "r", "i", "r"]


def test_splits_and_negatives(spark):
    links = G.forward_edges(star(spark))
    parts = [r["part"] for r in G.split_edges(links).collect()]
    assert len(parts) == 24 and parts.count("train") == 19
    known = {tuple(r) for r in links.collect()}
    absent = [tuple(r) for r in G.negative_edges(links, links).collect()]
    assert len(absent) == len(set(absent)) == 24 and not known & set(absent)
    one_missing = links.where("not (src = 'r:0' and dst = 'i:1')")
    full = one_missing.select("src").distinct().crossJoin(one_missing.select("dst").distinct()).where("not (src = 'r:0' and dst = 'i:1')")
    assert [tuple(r) for r in G.negative_edges(links, full).collect()] == [("r:0", "i:1")]


@pytest.mark.parametrize("missing", [1, 7, 60])
def test_absent_pairs_of_dense_graphs(spark, missing):
    """A graph with nearly all of its pairs: the absent ones are found by rank."""
    import random

    every = [(f"r:{r}", f"i:{i}") for r in range(40) for i in range(30)]
    gone = set(random.Random(missing).sample(every, missing))
    known = [e for e in every if e not in gone]
    links = spark.createDataFrame(known, "src string, dst string")
    got = [tuple(r) for r in G.negative_edges(links, links).collect()]
    assert len(got) == missing and set(got) == gone
    some = [tuple(r) for r in G.negative_edges(links.limit(5), links).collect()]
    assert len(some) == len(set(some)) == min(5, missing) and set(some) <= gone


def test_negatives_are_the_first_draws(spark, monkeypatch):
    """The first in the hashed order of all draws, of which only these and a few more are written."""
    import hashlib

    links = spark.range(6000).selectExpr("concat('r:', id % 3000) src", "concat('i:', (id * 7919) % 2503) dst").distinct()
    known = {tuple(r) for r in links.collect()}
    sources, targets = (sorted({e[k] for e in known}) for k in (0, 1))
    unit = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:12], 16) / 16**12
    drawn = {
        (sources[int(unit("42.s", *e, t) * len(sources))], targets[int(unit("42.t", *e, t) * len(targets))]) for e in known for t in (1, 2, 3)
    } - known
    want = sorted(drawn, key=lambda e: (hashlib.md5("|".join(("42", *e)).encode()).hexdigest(), *e))[:len(known)]
    written, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(real(df)) or written[-1])
    got = [tuple(r) for r in G.negative_edges(links, links).collect()]
    assert len(got) == len(want) and set(got) == set(want)
    assert max(df.count() for df in written) < 1.5 * len(known)
    monkeypatch.setattr(G, "_share_of_draws", lambda *_: 0.01)  # too few at first: more are taken
    assert {tuple(r) for r in G.negative_edges(links, links).collect()} == set(want)


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(2)
    score, label = rng.integers(0, 8, 60) / 8, rng.integers(0, 2, 60)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    row = G.auc(df).first()
    assert row["auc"] == pytest.approx(want) and row["positives"] == len(pos)
    assert G.auc(df.where("label = 1")).first()["auc"] is None


def test_link_scores_separate_clear_classes(spark):
    rows = [(f"r:{i}", f"i:{i}", [float(i % 2), 0.1 * i], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "src string, dst string, features array<double>, label int")
    scored = G.link_scores(df.where("src < 'r:3'"), df, rounds=50)
    assert G.auc(scored).first()["auc"] == 1.0 and G.threshold_report(scored).first()["accuracy"] == 1.0
    assert G.auc(G.link_scores(df, df, 50, fit_on_eval=True)).first()["auc"] == 1.0


def test_meetings_and_association(spark):
    rng = np.random.default_rng(4)
    walks = [[f"n{x}" for x in rng.integers(0, 6, rng.integers(1, 12))] for _ in range(40)] + [["n0"] * 5, []]
    df = spark.createDataFrame([(str(i), w) for i, w in enumerate(walks)], "walk string, nodes array<string>")
    want = {}
    for w in walks:
        for i, x in enumerate(w):
            for y in w[i + 1:i + 4]:
                key = (min(x, y), max(x, y))
                want[key] = want.get(key, 0) + 1
    met = E.cooccurrences(df, window=3)
    assert {(r["a"], r["b"]): r["n"] for r in met.collect()} == want
    names = sorted({x for k in want for x in k})
    sides = np.zeros((len(names), len(names)))
    for (a, b), n in want.items():
        sides[names.index(a), names.index(b)] += n
        sides[names.index(b), names.index(a)] += n
    with np.errstate(divide="ignore"):
        m = np.log(sides * sides.sum() / np.outer(sides.sum(1), sides.sum(1))) - np.log(1.2)
    got = {(r["a"], r["b"]): r["m"] for r in E.association(met, negatives=1.2).collect()}
    assert got.keys() == {(names[i], names[j]) for i, j in np.argwhere(m > 1e-12)}
    assert all(v == pytest.approx(m[names.index(a), names.index(b)]) for (a, b), v in got.items())


@pytest.mark.parametrize("rank", [3, 40])
def test_leading_vectors_against_numpy(spark, rank):
    """A symmetric matrix of rank 5: its best approximation, and zeros beyond its rank."""
    rng = np.random.default_rng(1)
    left = rng.normal(size=(30, 5)) * [5, 4, 3, 2, 1]
    matrix = (left * [1, -1, 1, 1, -1]) @ left.T
    cells = [(i, j, float(matrix[i, j])) for i in range(30) for j in range(30)]
    vectors, caught = E.leading_vectors(spark.createDataFrame(cells, "i long, j long, m double"), rank, tolerance=1e-9, rounds=60)
    got = np.array([r["v"] for r in vectors.orderBy("id").collect()])
    values = np.sort(np.abs(np.linalg.eigvalsh(matrix)))[::-1][:rank]
    assert got.shape == (30, rank)
    assert np.allclose((got**2).sum(axis=0), np.concatenate([values[:5], np.zeros(max(0, rank - 5))])[:rank], rtol=1e-3, atol=1e-6)
    assert caught[-1] == pytest.approx((values**2).sum() / (matrix**2).sum(), rel=1e-3) and caught == sorted(caught)


def test_embeddings_tell_groups_apart(spark):
    """Two sets of recipes on items of their own, joined by one item."""
    cells = [(r, i + 10 * (r % 2), 1.0) for r in range(20) for i in range(4) if (r + i) % 3] + [(r, 99, 1.0) for r in (0, 1)]
    edges = G.bipartite_edges(spark.createDataFrame(cells, "recipe_id long, ingredient_id long, w double"))
    vectors = E.train_embeddings(G.metapath_walks(edges, 10, 20), dimensions=8, window=5)
    got = {r["node"]: np.array(r["embedding"]) for r in vectors.collect()}
    assert len(got) == 29 and all(len(v) == 8 for v in got.values())
    near = np.mean([got[f"r:{r}"] @ got[f"i:{i + 10 * (r % 2)}"] for r in range(20) for i in range(4)])
    far = np.mean([got[f"r:{r}"] @ got[f"i:{i + 10 * (1 - r % 2)}"] for r in range(20) for i in range(4)])
    assert near > far + 0.2
    assert E.train_embeddings(spark.createDataFrame([], "walk string, nodes array<string>"), 4).count() == 0


def test_dealt_rows_stay_where_they_are(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    left = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("one"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    out = left.join(dealt(rows, "k").hint("merge"), "k")
    assert out.count() == 1000 and spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1, plan
