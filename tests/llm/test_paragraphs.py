"""Repeated paragraphs: planted passages, and all pairs of paragraphs by brute force."""

import os
import random
import re

import pytest

from blendspark.llm import paragraphs as P

DATA = "/root/testdata/sf0.01"


def tokens(text):
    """(start, stop, word in small letters) of each word."""
    low = lambda w: re.sub("[A-Z]", lambda m: m.group().lower(), w)
    return [(m.start(), m.end(), low(m.group())) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]


def lines_of(text, least=P.LEAST):
    """(start, stop, shingles) of each line of so many words."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        found = tokens(line)
        if len(found) >= max(least, 5):
            low = [w for _, _, w in found]
            out.append((at + found[0][0], at + found[-1][1], frozenset(tuple(low[k:k + 5]) for k in range(len(low) - 4))))
        at += len(line) + 1
    return out


def near_lines(texts, least=P.LEAST):
    """{(doc, start, stop)} of the lines in components that a smaller doc has a line of."""
    nodes = [(d, *w) for d, t in sorted(texts.items()) for w in lines_of(t, least)]
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, x in enumerate(nodes):
        for s in x[3]:
            holders.setdefault(s, []).append(i)
    tried = set()
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(nodes[a][3] & nodes[b][3])
                    if 100 * both >= 80 * (len(nodes[a][3]) + len(nodes[b][3]) - both):
                        parent[max(root(a), root(b))] = min(root(a), root(b))
    least_doc = {}
    for i, x in enumerate(nodes):
        least_doc[root(i)] = min(least_doc.get(root(i), x[0]), x[0])
    return {(x[0], x[1], x[2]) for i, x in enumerate(nodes) if x[0] > least_doc[root(i)]}


def repeated(texts, n):
    """{(doc, start, stop)} of every run of n words that a smaller doc has too."""
    first, out = {}, set()
    for d, t in sorted(texts.items()):
        found = tokens(t)
        for i in range(len(found) - n + 1):
            run = tuple(w for _, _, w in found[i:i + n])
            if first.setdefault(run, d) < d:
                out.add((d, found[i][0], found[i + n - 1][1]))
    return out


def check(texts, rows, bar=0.95):
    """Of what 50 words in a row repeat, nearly all goes (but up to four words at either
    end); nothing goes that does not repeat.  Returns the share of the characters of
    repeated runs that goes."""
    black = lambda cs: {(d, i) for d, i in cs if not texts[d][i].isspace()}
    got = black(chars((r.doc_id, r.start, r.stop) for r in rows))
    lines = black(chars(near_lines(texts)))
    assert len(got & lines) >= 0.97 * len(lines)
    assert got <= lines | black(chars(repeated(texts, P.RUN)))
    runs = black(chars(repeated(texts, P.GAP + P.RUN - 1)))
    assert {d for d, _ in runs} <= {d for d, _ in got}
    share = len(got & runs) / len(runs)
    assert share >= bar
    return share


def chars(rows):
    return {(d, i) for d, a, b in rows for i in range(a, b)}


def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(5))

    def sentence():
        return " ".join([word().capitalize(), *[word() for _ in range(rng.randrange(4, 12))]]) + "."

    passages = [" ".join(sentence() for _ in range(12)) for _ in range(3)]
    texts = {}
    for d in range(40):
        lines = [" ".join(sentence() for _ in range(rng.randrange(1, 8))) for _ in range(5)]
        if d % 4:
            body = passages[d % 3].split()
            if d % 5 == 0:
                body[30] = word()
            lines[2] = lines[2].rstrip(".") + " " + " ".join(body) + " " + lines[3].lower()
        texts[d] = "\n".join(lines)
    return texts, {d for d in texts if d % 4}


def test_planted_passages(spark, tmp_path):
    texts, holders = planted()
    texts |= {100: None, 101: "", 102: "x " * 40000, 103: texts[1]}
    docs = spark.createDataFrame([(d, t, "a", 0) for d, t in texts.items()], "doc_id long, text string, row string, n int")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = P.repeated_spans(docs).collect()
    named = {r.doc_id for r in got} | {r.kept_doc_id for r in got}
    assert named == holders | {103}
    check(texts, got)
    covered = chars((r.doc_id, r.start, r.stop) for r in got)
    cleaned = {r.doc_id: r.text for r in P.without_repeats(docs).collect()}
    for d, t in texts.items():
        gone = {i for k, i in covered if k == d}
        assert cleaned[d] == (t if t is None else "".join(c for i, c in enumerate(t) if i not in gone))
    assert P.repeated_spans(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_against_all_pairs(spark):
    from blendspark.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    print("share of repeated runs removed", check(texts, QUERIES["op5_paragraph_minhash"](spark, DATA).collect()))


def write(spark, folder, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(folder))
    return spark.read.parquet(str(folder))


@pytest.mark.parametrize("letters", ["abcdefg", "абвгдежз", "の本日人大中国"])
def test_passages_without_sentences_in_any_script(spark, tmp_path, letters):
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    passages = [make(50) for _ in range(20)]
    texts = {d: f"{make(rng.randrange(60))} {passages[d % 20]} {make(rng.randrange(60))}" for d in range(60)}
    texts |= {100 + d: make(100) for d in range(10)}
    rows = P.repeated_spans(write(spark, tmp_path / "d", texts)).collect()
    assert {r.doc_id for r in rows} == set(range(20, 60)) and all(r.kept_doc_id == r.doc_id % 20 for r in rows)
    check(texts, rows, bar=0.9)


def test_edited_lines_and_short_lines(spark, tmp_path):
    rng = random.Random(6)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = make(80)
    edited = [*base[:40], "other", *base[41:]]
    short = " ".join(make(8))
    texts = {
        1: " ".join(base) + "\n" + short, 2: " ".join(make(40)) + "\n" + " ".join(edited), 3: short + "\n" + " ".join(make(40)), 4: " ".join(make(9)),
        5: None, 6: "", 7: "x " * 200_000,
    }
    docs = write(spark, tmp_path / "d", texts)
    rows = P.repeated_spans(docs).collect()
    assert [(r.doc_id, r.kept_doc_id, texts[2][r.start:r.stop]) for r in rows] == [(2, 1, " ".join(edited))]
    assert {r.doc_id for r in P.repeated_spans(docs, least=5).collect()} == {2, 3}


def test_rows_without_an_id(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (4, text), (None, text), (4, text)], "doc_id long, text string").repartition(1)
    docs.write.parquet(str(tmp_path / "d"))
    rows = P.repeated_spans(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "None", "None"] and {r.kept_doc_id for r in rows} == {4}
    assert {(r.start, r.stop) for r in rows} == {(0, len(text))}


def test_bands_reach_the_recall():
    n = P.bands()
    assert 1 - (1 - 0.8**P.ROWS) ** n >= P.RECALL > 1 - (1 - 0.8**P.ROWS) ** (n - 1)
