"""Hard negatives against a plain search over Python lists."""

import math
import random

from pyspark.sql import functions as F

from blendspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, k=5):
    """rows: (vec_id, vector, label); the same rows in the same order of keys."""
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(ok):
        if i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, b, z) for b, (j, w, z) in enumerate(ok) if b != a)
        for s, j, _, z in [x for x in scored if x[3] == y][:k]:
            near = [x for x in scored if x[3] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(near)]
    return sorted(out)


def mined(spark, rows):
    vectors = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], SCHEMA).repartition(3)
    found = negatives.hard_negatives(negatives.usable(vectors), F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in found.collect())


def random_rows(n, width=6, seed=1):
    r = random.Random(seed)
    return [(i, [r.randint(-2, 6) / 4 for _ in range(width)], r.randint(0, 2)) for i in range(n)]


def test_against_plain_search_with_ties(spark):
    rows = random_rows(450)
    assert plain(rows) and mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = random_rows(120) + [(200, [1.0] * 6, 1)] * 3 + [(201, [1.0] * 6, 1)] * 9 + [
        (300, None, 1), (301, [None] * 6, 1), (302, [math.nan] + [0.0] * 5, 1), (303, [math.inf] * 6, 1), (304, [1.0] * 6, None),
        (None, [1.0] * 6, 1), (400, [], 1), (401, [2.0, 1.0], 0), (402, [1.0] * 9, 2),
    ]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 2.0**30 for x in v], y) for i, v, y in random_rows(120, width=3)]
    scale = [r for r in plain(rows) if abs(r[4]) < 2**63]
    assert len(scale) == len(plain(rows)) or scale != plain(rows)
    small = [(i, [x * 2.0**18 for x in v], y) for i, v, y in random_rows(120, width=3)]
    assert mined(spark, small) == plain(small)


def test_grid_gives_the_same(spark, monkeypatch):
    """Anchors too many to broadcast, several blocks of them and of rows."""
    monkeypatch.setattr(negatives, "MOST_BYTES", 0)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rows = random_rows(700, seed=2)
    assert mined(spark, rows) == plain(rows)
