"""Packing: an exact round trip, and the curve against its definition."""

import itertools
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from blendspark.llm import packing

DATA = "/root/testdata/sf0.001"


def check(rows, texts):
    """Every id in one piece, sequences gapless and at most 2048, no padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[d][at:at + r.length], dtype="<u4")
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part.tobytes()), len(ids[d]))
            at += r.length
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \n\t<|endoftext|> don't  😀é x", 4: "long " * 50000, 5: "x" * 30000}
    docs = spark.createDataFrame([(d, t, "k") for d, t in texts.items()], "doc_id long, text string, key string")
    check(packing.pack(docs).collect(), texts)
    twice = packing.pack(docs.union(docs)).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in packing.pack(docs).collect())
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a")], "doc_id long, text string")).count() == 1


def test_long_white_space(spark):
    """Ids as those of the vocabulary's own library, and a run that its pattern can't take."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for space in (" " * 5000, "\n" * 4096, " \t\n\u3000\xa0" * 1500, " " * 4999 + "\n", "\x1c" * 5000, "\u2003" * 4500 + " "):
        for text in (space, f"a{space}b", f"{space}'s", f"x {space}<|endoftext|>{space}y", f"{space}.{space}"):
            assert packing.token_ids(text, added=True)[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    texts = {1: " " * 2_000_000, 2: "a" + " " * 1_000_000 + "b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(docs, added=True).collect()
    for d, text in texts.items():
        assert sum(r.length for r in rows if r.doc_id == d) == len(packing.token_ids(text, added=True))


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dimensions, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = packing.hilbert_key(points, bits)
    assert sorted(keys) == list(range(len(points)))
    walked = points[np.argsort(keys)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_query_has_the_ids_of_the_unchanged_vocabulary(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from blendspark.llm.queries import QUERIES

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>  y\n<|endoftext|>\n", "<|endoftext|", "é <|ENDOFTEXT|> don't", "  <|endoftext|>'s", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for got in (QUERIES["op2_hilbert_packing"](spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        by_doc = defaultdict(list)
        for r in got.collect():
            by_doc[r.doc_id].append(r)
        for d, text in enumerate(texts):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                part = np.array(ids[at:at + r.length], dtype="<u4")
                assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part.tobytes()), len(ids))
                at += r.length
            assert at == len(ids)
