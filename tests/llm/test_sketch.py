"""Sketches against brute force over plain Python sets."""

import hashlib
import os
import re

import pytest

from blendspark.llm import sketch
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_against_brute_force(spark):
    from blendspark.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = sorted(texts)
    got = {r.doc_id: r for r in QUERIES["op4_scaled_sketch"](spark, DATA).collect()}
    assert sorted(got) == ids
    errors = []
    for here, after in zip(ids, ids[1:] + ids[:1]):
        text, donor, row = texts[here], texts[after], got[here]
        half = len(text) // 2
        changed = text[:len(text) - half] + donor[:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = shingles(text), shingles(changed)
        errors.append(abs(row.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
        assert 0 <= row.near_next <= 1
    assert sum(errors) / len(errors) < 0.1
    same = {}
    for i in ids:
        assert same.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "a b c d e f g"), (9, "w " * 30000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sketch string")
    got = sketch.fingerprints(docs).collect()
    assert len(got) == len(rows)
    assert {r.near_edited for r in got if r.doc_id in (1, 2)} == {1.0}
    assert sketch.fingerprints(docs.limit(0)).count() == 0


def test_next_rows_over_ranges(spark):
    """Many ranges, null and repeated ids; columns of the text come with the next row."""
    rows = [(i, f"t{i}") for i in range(0, 400, 2)] + [(None, "b"), (None, "a"), (10, "t0"), (398, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {(r.doc_id, r.text): r for r in sketch.with_next(docs, big=F.upper).collect()}
    assert len(got) == len(want)
    for here, after in zip(want, want[1:] + want[:1]):
        row = got[here]
        assert row.big == here[1].upper() and tuple(row.next) == (*after, after[1].upper())


def test_whole_scale_is_exact_and_merges(spark):
    a, b = "a b c d e f g h i", "c d e f g h i j k"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        sketch.sketch(F.col("a"), scale=1).alias("a"), sketch.sketch(F.col("b"), scale=1).alias("b")
    ).select("a", "b", sketch.likeness(F.col("a"), F.col("b")).alias("near"), sketch.containment(F.col("a"), F.col("b")).alias("held")).first()
    assert row.near == pytest.approx(3 / 7) and row.held == pytest.approx(3 / 5)
    both = spark.createDataFrame([(row.a,), (row.b,)], "s struct<tag: long, hashes: array<long>>")
    assert set(both.agg(sketch.merge(F.col("s")).alias("m")).first().m) == set(row.a.hashes) | set(row.b.hashes)
