"""Benchmark passages against a plain search over word lists."""

import random
import re

import pytest

from blendspark.llm import leaks

DOCS = "doc_id long, text string, items string, row int"
BENCH = "item_id long, text string, window string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    known = {}
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            known.setdefault(tuple(w[j:j + m]), set()).add(i)
    sizes = {len(k) for k in known}
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                found = known.get(tuple(w[j:j + m]))
                if found:
                    hit |= set(range(j, j + m))
                    ids |= {str(x) for x in found if x is not None}
        out.append((str(i), len(w), len(hit), tuple(sorted(ids))))
    return sorted(out)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
    return sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.items)) for r in leaks.contamination(d, b).collect())


def random_case(seed, alphabet, short):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(alphabet) for _ in range(n))
    items = [(k, say(r.randint(1 if short else 10, 25))) for k in range(12)]
    docs = [(k, say(r.randint(0, 60))) for k in range(40)]
    docs += [(100 + k, f"{say(5)}, {items[k][1].upper()}! {say(7)} {items[-k][1][:60]}") for k in range(12)]
    return docs, items


@pytest.mark.parametrize("seed, alphabet, short", [(1, "abcdefgh", False), (2, "ab", False), (3, "abcdefghijklmnop", True), (4, "äbçdé1漢", True)])
def test_against_plain_search(spark, seed, alphabet, short):
    docs, items = random_case(seed, alphabet, short)
    assert found(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    say = " ".join(f"w{i}" for i in range(30))
    items = [(1, None), (2, ""), (3, "..."), (10, say), (9, say), (9, say), (None, say + " z"), (7, "w3 w4")]
    docs = [(1, None), (2, ""), (3, "-- !"), (4, say), (4, say), (None, say[:50]), (5, "W3-w4 w3"), (6, " ".join(f"w{i}" for i in range(9)))]
    docs.append((8, ("x y " * 5000 + say + " ") * 3))  # windows over the ends of segments
    docs.append((11, "y " * (leaks.SEGMENT - 5) + say + " y" * 3000 + " " + say))
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == plain(docs, []) and found(spark, docs, items[:3]) == plain(docs, [])


def test_every_long_shared_span_is_met(spark):
    """Whatever stands around it, a shared span of ten words gives a common fingerprint."""
    r = random.Random(5)
    span = [r.choice("abc") for _ in range(10)]
    rows = [([r.choice("abc") for _ in range(r.randint(0, 30))] + span + [r.choice("abc") for _ in range(r.randint(0, 30))],) for _ in range(200)]
    from pyspark.sql import functions as F

    prints = [set(x[0]) for x in spark.createDataFrame(rows + [(span,)], "w array<string>").select(leaks.fingerprints(F.col("w"), [10])).collect()]
    assert all(p & prints[-1] for p in prints)
