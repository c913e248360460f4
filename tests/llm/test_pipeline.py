"""The pipeline, each stage against a plain version of it."""

import hashlib
import math
import os
from collections import Counter

import pytest

from tests.llm.test_mixing import level_targets
from tests.llm.test_overlap import brute

DATA = "/root/testdata/sf0.001"


def plain_mix(rows, quality):
    """How often each doc_id is taken."""
    size = {r.doc_id: len((r.text or "").split()) for r in rows}
    by_source = {}
    for r in rows:
        digest = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16)
        weight = {None: 0.5, 0: 0.25, 1: 1.0}[quality.get(r.doc_id)]
        by_source.setdefault(r.source, []).append((-math.log((digest + 0.5) / 2**52) / weight, r.doc_id))
    sums = {s: sum(size[d] for _, d in x) for s, x in by_source.items()}
    taken = Counter()
    for source, target in level_targets(sums).items():
        epochs = int(target // sums[source]) if sums[source] else 1
        left, before = target - epochs * sums[source], 0
        for _, d in sorted(by_source[source]):
            taken[d] += epochs + (size[d] > 0 and before + size[d] / 2 <= left)
            before += size[d]
    return +taken


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark, tmp_path):
    import corpus_pipeline
    from blendspark.llm.queries import QUERIES

    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    kept.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    raw, clean, unique, apart, mixed, packed = kept
    ids = lambda rows: {r.doc_id for r in rows}
    text = {r.doc_id: r.text for r in raw}

    toxic = {r.doc_id for r in QUERIES["op9_toxicity"](spark, DATA).collect() if r.predicted}
    assert ids(clean) == ids(raw) - toxic

    last = {}
    for r in clean:
        last[r.text or ""] = max(last.get(r.text or "", r.doc_id), r.doc_id)
    assert ids(unique) == set(last.values())

    groups = brute({r.doc_id: r.text for r in unique})
    assert ids(apart) == {c for _, c in groups.values()}

    labels = {}
    for r in spark.read.parquet(f"{DATA}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    assert Counter(r.doc_id for r in mixed) == plain_mix(apart, labels)
    assert all(r.text == text[r.doc_id] for r in mixed)

    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    once = {r.doc_id: r.doc_tokens for r in packed}
    assert whole == Counter({d: once[d] * n for d, n in Counter(r.doc_id for r in mixed).items()})
    for sequence in {r.sequence_id for r in packed}:
        pieces = sorted((r.offset, r.length) for r in packed if r.sequence_id == sequence)
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]

    rerun = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in rerun if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0)


def test_empty_and_null_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some words here", None, None, 15), (3, "w " * 50000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for n, given in enumerate((docs, docs.limit(0))):
        given.write.parquet(str(tmp_path / f"{n}-documents"))
        given = spark.read.parquet(str(tmp_path / f"{n}-documents"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, given, str(tmp_path)).write.parquet(str(tmp_path / f"{n}-{k}"))
            given = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
