"""Classifiers: exactness of the search, the density against its formula, held-out accuracy."""

import os

import numpy as np
import pyarrow as pa
import pytest

from blendspark.llm import frames, quality, toxicity, words
from blendspark.llm import labels as L

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def held_rows(spark, name, column):
    from blendspark.llm.queries import QUERIES

    got = QUERIES[name](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [L.fold(d) == 0 for d in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{DATA}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    return both.score.to_numpy(), both[column].to_numpy(), both.predicted.to_numpy()


@needs_data
def test_quality_held_out(spark):
    score, y, predicted = held_rows(spark, "op8_quality", "quality")
    assert auc(score, y) > 0.95 and (predicted == y).mean() > 0.9


@needs_data
def test_toxicity_held_out(spark):
    score, y, predicted = held_rows(spark, "op9_toxicity", "toxic")
    assert auc(score, y) > 0.85 and (predicted == y).mean() > 0.9


def random_index(seed=0, n=700, terms=300):
    rng = np.random.default_rng(seed)
    dense = rng.poisson(0.08, (n, terms)) * rng.integers(1, 4, (n, terms))
    row, term = np.nonzero(dense)
    idf = np.where(rng.random(terms) < 0.1, 0, rng.random(terms) * 5)
    y = (rng.random(n) < 0.5).astype(int)
    index = toxicity.build(np.arange(n), y, toxicity.Vocabulary(np.arange(terms, dtype=np.uint64)), idf, (row, term, dense[row, term]), 0.3)
    unit = np.sqrt(dense) * idf
    return index, unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12), dense


def test_search_is_exact():
    index, unit, dense = random_index()
    rng = np.random.default_rng(5)
    for k in (1, 3, 80):
        for _ in range(40):
            count = rng.poisson(0.1, dense.shape[1])
            term = np.flatnonzero(count)
            rows, cosines = index.nearest(*index.weights(term, count[term]), k=k)
            query = np.sqrt(count) * index.idf
            want = np.sort(unit @ (query / max(np.linalg.norm(query), 1e-12)))[::-1][:k]
            np.testing.assert_allclose(cosines, want[want > 1e-12][:len(cosines)], atol=1e-9)
            assert len(rows) == min(k, (want > 1e-12).sum())


def test_many_blocks_are_scored_in_one_pass(monkeypatch):
    """Where the bounds skip few blocks, only the first look goes by runs; the scores are the same to the last bit."""
    index, _, dense = random_index()
    blocks, looks, by_runs = -(-len(index.labels) // toxicity.BLOCK), [], toxicity.Index._scores
    monkeypatch.setattr(toxicity.Index, "_scores", lambda self, *a: looks.append(len(a[2])) or by_runs(self, *a))
    count = np.random.default_rng(5).poisson(0.1, dense.shape[1])
    term, w = index.weights(np.flatnonzero(count), count[count > 0])
    index.nearest(term, w, k=80)
    assert looks == [1]
    runs = index.run_of[term + 1] - index.run_of[term]
    run, frequent = toxicity._ranges(index.run_of[term], runs), index.frequent([(term, w)])[0]
    for chosen in (np.arange(blocks), np.array([blocks - 1])):
        whole = index._whole(term, w, chosen, blocks, frequent)
        assert (whole == by_runs(index, run, np.repeat(w, runs), chosen, blocks, frequent)).all()


def test_search_without_terms():
    index, _, _ = random_index()
    none = np.zeros(0, np.int64)
    rows, _ = index.nearest(*index.weights(none, none))
    assert len(rows) == 0 and index.vote(rows, np.zeros(0)) == pytest.approx(0.3)


DOCS = "doc_id long, text string, score string"


def odd(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 60000, "a"), (None, "x y z", "a"), (5, "é!!! |||", "a"), (5, "é!!! |||", "a")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("known", [[], [(1, 1, 1), (2, None, None), (None, 1, 1)], [(i, i % 2, i % 2) for i in range(9)]])
def test_odd_rows(spark, known):
    docs, marks = odd(spark), spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    for got in (quality.classify(docs, marks), toxicity.score(docs, toxicity.fit(docs, marks))):
        scores = [r.score for r in got.collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    none = docs.limit(0)
    assert quality.classify(none, marks).count() == 0
    assert toxicity.score(none, toxicity.fit(none, marks)).count() == 0


def test_density_against_formula():
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    x = rng.standard_normal((5, d)) * 3 + 1
    cov = np.cov(rng.standard_normal((d, 200)))
    low = np.linalg.cholesky(cov)
    model = quality.Model(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d), np.linalg.inv(low)]), np.array([0.0, -np.log(np.diag(low)).sum()]))
    want = [-0.5 * v @ np.linalg.inv(cov) @ v - 0.5 * np.linalg.slogdet(cov)[1] + 0.5 * v @ v for v in x]
    np.testing.assert_allclose(model.log_odds(x), want, rtol=1e-8)


@needs_data
def test_toxic_copies_of_a_third_of_all_rows(spark):
    """A group of near copies that holds a third of the rows keeps its terms' weight."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    first, n = docs.agg({"doc_id": "max"}).first()[0] + 1, docs.count() // 2
    insult = " ".join(f"grubworm{chr(97 + i)} vilefool{chr(97 + i)}" for i in range(20))
    copies = [(first + i, f"{insult} number{i % 7}") for i in range(n)]
    # Every tenth copy is labelled.
    known = spark.createDataFrame([(d, 1) for d, _ in copies[::10]], "doc_id long, toxic int")
    both = docs.unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    index = toxicity.fit(both, marks.unionByName(known.select("doc_id", "toxic")))
    assert (index.idf > 0).all()
    scored = {r.doc_id: r.score for r in toxicity.score(both, index).where(f"doc_id >= {first}").collect()}
    assert len(scored) == n and min(scored.values()) > 0.5
    assert toxicity.keep_clean(both, index).where(f"doc_id >= {first}").count() == 0


def test_frequent_terms_leave_the_search_exact():
    index, unit, dense = random_index(n=600, terms=60)
    rng = np.random.default_rng(6)
    held = rng.random((600, 60)) < 0.4
    row, term = np.nonzero(held)
    index = toxicity.build(np.arange(600), np.arange(600) % 2, index.vocabulary, index.idf + 0.01, (row, term, np.ones(len(row))), 0.3)
    assert len(index.full) == 60
    unit = held * index.idf
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    for i in range(40):
        term = np.flatnonzero(held[i])
        _, cosines = index.nearest(*index.weights(term, np.ones(len(term))), k=20)
        np.testing.assert_allclose(cosines, np.sort(unit @ unit[i])[::-1][:20], atol=1e-9)


def test_clean_rows_come_slice_by_slice(monkeypatch):
    index = random_index()[0]
    monkeypatch.setattr(words, "SLICE", 64)
    rows = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([None, "", "abc " * 9, "d"] * 10)], ["doc_id", "text"])
    parts = list(toxicity._clean(index, iter([rows]), 1, 2.0))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([rows])) and max(len(p) for p in parts) < 10
    assert sum(len(p) for p in toxicity._clean(index, iter([rows]), 1, 0.0)) == 0


def test_a_task_gives_free_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(frames, "trim", lambda: done.append(True))
    assert list(frames.tidied(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and done == [True]
