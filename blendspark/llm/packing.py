"""Packing along a space-filling curve: neighbours in content become neighbours in sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendspark.llm import words
from blendspark.llm.frames import SAMPLES_PER_RANGE, range_of, ranges_for, text_of, tidied

LENGTH = 2048
#: The token after each document.
END_ID = 1
#: The added tokens of the vocabulary file, which its rank file lacks.
ADDED = {"<|endoftext|>": 50256}
#: White space (as Unicode has it) in runs that the pattern of the vocabulary can't look
#: behind: it steps back from the end of a run, and fails after some hundred thousand.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
#: Size of the hashed vectors, dimensions they are projected to, bits of each.
HASHED, DIMENSIONS, BITS = 1024, 4, 8
#: Ranges are dealt to partitions by a hash; a few for each make these alike in size.
RANGES_PER_PARTITION = 4

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    """The byte-level vocabulary as ranks; where the package lies is asked on each node."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def _encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def token_ids(text: str, path: str | None = None, added: bool = False) -> np.ndarray:
    """The ids of a text, with the end id behind them.  ``added``: strings of added tokens
    get their one id, as the vocabulary file says; otherwise they are ordinary text."""
    encoding = _encoding(path)

    def encoded(part: str) -> list[int]:
        return encoding.encode(part, allowed_special="all") if added else encoding.encode_ordinary(part)

    ids, at = [], 0
    for run in LONG_SPACE.finditer(text):
        # The pattern takes a run as one piece, but for the last blank before other text.
        last = run.end() == len(text) or added and text.startswith(tuple(ADDED), run.end())
        end = run.end() if last else run.end() - 1
        ids += encoded(text[at:run.start()])
        ids += encoding._encode_single_piece(text[run.start():end])
        at = end
    ids += encoded(text[at:])
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def project(vectors: np.ndarray) -> np.ndarray:
    """Rows of counts to ``DIMENSIONS`` whole numbers below 2**BITS: square roots, unit
    length, a fixed random projection, cut at three deviations."""
    damped = np.sqrt(vectors)
    norm = np.sqrt((damped**2).sum(axis=1, keepdims=True))
    matrix = np.random.default_rng(1).standard_normal((vectors.shape[1], DIMENSIONS))
    spread = (damped / np.where(norm > 0, norm, 1)) @ matrix
    side = 1 << BITS
    return np.clip((spread / 3 + 1) * side / 2, 0, side - 1).astype(np.int64)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points (rows of whole numbers below 2**bits) along the Hilbert curve.

    Per level from the top, the axes are exchanged or mirrored so that the cell entered
    lies like the cell left; a Gray code of the result is the place.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(n):
            high = (x[axis] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def curve_keys(texts: pa.Array) -> pa.Array:
    """The place of each text on the curve; texts without words share one."""
    keys = [np.zeros(0, np.int64)]
    for _, data, offsets in words.slices(texts):
        start, end, of = words.words(data, offsets)
        bucket = (words.word_hashes(data, start, end) % np.uint64(HASHED)).astype(np.int64)
        for a in range(0, len(offsets) - 1, 1024):
            b = min(a + 1024, len(offsets) - 1)
            row = np.repeat(np.arange(b - a), np.diff(of[a:b + 1]))
            counts = np.bincount(row * HASHED + bucket[of[a]:of[b]], minlength=(b - a) * HASHED)
            keys.append(hilbert_key(project(counts.reshape(b - a, HASHED))))
    return pa.array(np.concatenate(keys))


def with_keys(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, row) with ``key``: the place on the curve, then a hash of the
    row, so that equal texts spread over as many keys as there are."""
    place = F.arrow_udf(curve_keys, "long")
    tie = F.xxhash64("doc_id", "row").bitwiseAND(F.lit((1 << 31) - 1))
    return rows.withColumn("place", place("text")).withColumn("key", F.shiftleft("place", 31) + tie).drop("place")


def along_the_curve(docs: DataFrame) -> DataFrame:
    """doc_id, text in partitions along the curve, each sorted.

    The bounds of the ranges come from a hashed sample of rows (about
    ``SAMPLES_PER_RANGE`` for each range), so that no text is projected twice just to
    find them; texts are shuffled once."""
    rows = docs.select("doc_id", text_of(docs).alias("text"), F.monotonically_increasing_id().alias("row"))
    partitions, count = ranges_for(docs), docs.count()
    ranges = RANGES_PER_PARTITION * partitions
    step = max(1, count // (ranges * SAMPLES_PER_RANGE))
    sampled = with_keys(rows.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0)).select("key").toArrow()
    keys = np.sort(sampled.column("key").to_numpy())
    bounds = sorted({int(keys[len(keys) * i // ranges]) for i in range(1, ranges)}) if len(keys) else []
    ranged = with_keys(rows).withColumn("range", range_of(F.col("key"), bounds))
    return ranged.repartition(partitions, "range").sortWithinPartitions("range", "key").select("doc_id", "text")


class _Packer:
    """Cuts one stream of token ids into sequences."""

    def __init__(self, partition: int):
        self.next_sequence = partition << 32
        self.open: list[tuple] = []  # pieces of the sequence that is being filled
        self.filled = 0
        self.out: list[tuple] = []

    def _write(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at:at + LENGTH - self.filled]
            self.open.append((doc_id, at, part, len(ids)))
            self.filled += len(part)
            at += len(part)
            if self.filled == LENGTH:
                self._write(self.open)
                self.open, self.filled = [], 0

    def finish(self) -> None:
        """What is left goes to sequences of falling powers of two, without padding."""
        for size in (1 << k for k in reversed(range(LENGTH.bit_length() - 1))):
            if not self.filled & size:
                continue
            now, room = [], size
            while room:
                doc_id, start, ids, total = self.open.pop(0)
                now.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    self.open.insert(0, (doc_id, start + room, ids[room:], total))
                room -= len(now[-1][2])
            self._write(now)

    def batch(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = list(zip(*self.out, strict=True)) if self.out else [[]] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, path: str | None = None, added: bool = False) -> DataFrame:
    """docs: doc_id, text, anything else.  One row per piece of a document: doc_id,
    start and length (in its ids), ids_crc32, doc_tokens, sequence_id, offset.

    Documents follow each other along the curve and are cut freely, so that all
    sequences are full but what a partition has left, which is cut into powers of
    two: nothing is padded.  A null or empty text is its end id alone; rows that
    repeat are packed as often; an empty table gives no rows; a text of any length, also
    one of white space, is cut like any other.  ``added`` as in ``token_ids``; the query
    and the pipeline ask for it.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId())
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(len(texts)):
                packer.add(doc_ids[i].as_py(), token_ids(texts[i].as_py(), path, added))
                if len(packer.out) >= 20_000:
                    yield packer.batch()
        packer.finish()
        yield packer.batch()

    return along_the_curve(docs).mapInArrow(run, PIECES)
