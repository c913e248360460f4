"""Exact duplicates against grouping in plain Python."""

import hashlib
import random

from blendspark.llm import exact
from pyspark.sql import functions as F


def plain(rows):
    """(doc_id, keep_id, group_size, kept) of every row, sorted."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for ids in groups.values():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        left = 1
        for i in sorted(ids, key=lambda i: i != keep):
            kept = i == keep and left == 1
            left -= kept
            out.append((str(i), str(keep), len(ids), kept))
    return sorted(out)


def grouped(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row_id int, full string").repartition(3)
    carry = {"digest": F.sha2(F.coalesce("text", F.lit("")), 256)}
    got = exact.duplicate_groups(docs, carry).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(str(i), set()).add(hashlib.sha256((t or "").encode()).hexdigest())
    assert all(r.digest in texts[str(r.doc_id)] for r in got)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got)


def test_against_plain_groups(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab") * r.randint(0, 4) + "x" * r.choice([0, 300])) for i in range(300)]
    assert grouped(spark, rows) == plain(rows)


def test_odd_rows(spark):
    long = "é" * 200_000
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (None, "a"), (3, "a"), (4, long + "a"), (5, long + "b"), (6, long + "a"), (7, "A"), (8, " a"), (9, "alone")]
    rows += [(100 + i, "crowd") for i in range(500)]
    assert grouped(spark, rows) == plain(rows)
    assert grouped(spark, [(None, None)] * 3) == plain([(None, None)] * 3)
    assert grouped(spark, []) == []
