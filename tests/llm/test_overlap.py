"""The Jaccard join against all pairs."""

import os
import random
import re

import pytest

from blendspark.llm import overlap
from blendspark.llm.components import components

DATA = "/root/testdata/sf0.01"


def brute(texts):
    """{key: (n_shingles, component)} by comparing every pair that shares a shingle."""
    sets = {}
    for k, t in texts.items():
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders, parent = {}, {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    tried = set()
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in texts}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_against_all_pairs(spark):
    from blendspark.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op7_ngram_jaccard"](spark, DATA).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def edited_texts():
    """Chains of edits around the threshold, copies, templates, short and empty texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = [None, "", "  \n", "One two", "one TWO", "one two three four five", "É x", "é x"]
    template = [word() for _ in range(60)]
    for _ in range(25):
        texts.append(" ".join(template + [word() for _ in range(rng.choice([4, 8, 12, 16]))]))
    for size in (6, 25, 26, 40, 90, 300):
        base = [word() for _ in range(size)]
        for _ in range(14):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
            texts.append(" ".join(base[:rng.randrange(len(base) * 3 // 4, len(base) + 1)]))
    return dict(enumerate(texts))


def test_odd_rows(spark, tmp_path):
    texts = edited_texts()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, row string, n long")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = overlap.overlap_components(docs).collect()
    want = brute(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = overlap.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_no_rows_and_repeats(spark):
    docs = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_shingles, str(r.doc_id), str(r.component_id)) for r in overlap.overlap_components(docs).collect())
    assert got == [(0, "None", "None"), (2, "7", "7"), (2, "7", "7"), (2, "None", "7")]
    assert overlap.overlap_components(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(1049, 1060), (5, 5), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in [*range(1000, 1050), 1060]}
