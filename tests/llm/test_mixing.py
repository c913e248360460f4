"""Mixing against plain Python."""

import pytest

from blendspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, copies string"


def level_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def docs_of(spark, counts):
    rows, n = [], 0
    for source, texts in counts.items():
        for words in texts:
            rows.append((n, " ".join(["w"] * words) if words else (None if n % 2 else ""), source, 0, "x"))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("counts", [
    {"a": [5] * 40, "b": [3] * 10, None: [2] * 5, "é": [1]},
    {"a": [400] * 30, "b": [1], "c": [2, 0], "d": []},
    {"only": [7, 7, 0]}, {"empty": [0, 0], "": [0]},
])
def test_targets_and_takes(spark, counts):
    docs = docs_of(spark, {s: t for s, t in counts.items() if t})
    got = mixing.plan(docs).collect()
    sizes = {s: sum(t) for s, t in counts.items() if t}
    want = level_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert len(got) == sum(len(t) for t in counts.values())
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(counts[s]) / 2 + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.plan(docs).collect()))


def test_mix_keeps_columns_and_repeats(spark, tmp_path):
    docs_of(spark, {"a": [5] * 40, "b": [3] * 4}).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    weights = spark.createDataFrame([(0, 1.0), (1, 0.25)], "doc_id long, quality_weight double")
    mixed, times = mixing.mix(docs, weights), {r.doc_id: r.copies for r in mixing.plan(docs, weights).collect()}
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: n for d, n in times.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_good_documents_come_first(spark):
    docs = docs_of(spark, {"a": [5] * 400, "b": [1] * 10})
    weights = spark.createDataFrame([(i, 100.0 if i < 200 else 0.01) for i in range(400)], "doc_id long, quality_weight double")
    rows = [r for r in mixing.plan(docs.where("source = 'a' or doc_id % 2 = 0"), weights).collect() if r.source == "a"]
    assert all(r.copies >= min(x.copies for x in rows) for r in rows)
