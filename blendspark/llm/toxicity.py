"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendspark.llm import words
from blendspark.llm.frames import listed, release, text_of, tidied
from blendspark.llm.labels import training_labels
from blendspark.llm.packing import curve_keys

#: Labelled examples of each class in the index, and the longest text among them: the
#: bound of what is collected and broadcast, whatever the input.
PER_CLASS, LONGEST = 2000, 32_000
#: Terms are words and their first bytes.
PREFIXES = (4, 5)
#: A term is used if so many examples hold it.
LEAST_EXAMPLES = 3
#: Terms that more than this share of the examples hold are kept as full rows of a matrix
#: and multiplied for many texts at once; their postings would be nearly as long.
OFTEN, AT_ONCE = 0.125, 256
NEIGHBOURS = 80
#: Power of the inverse document frequency: how steeply frequent terms weigh less.
STEEPNESS = 3
#: Rows of a block.  Examples lie in order of the packing curve, so that those of one
#: language or topic share blocks and the bounds tell blocks apart.
BLOCK = 256
#: Votes that stand for the share of toxic labels where there are no near examples.
FAINT = 1e-3


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every term of a slice, in no order, with repeats."""
    start, end, of = words.words(data, offsets, words.LETTERS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
    hashes = [words.word_hashes(data, start, end)]
    hashes += [words.mix(words.word_hashes(data, start, end, most=k) + np.uint64(k)) for k in PREFIXES]
    return np.tile(row, len(hashes)), np.concatenate(hashes)


class Vocabulary:
    """Term hashes in ascending order; a bit table turns most others away at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count), by row, then term."""
        row, h = terms(data, offsets)
        if not len(self.hashes):
            return row[:0], row[:0], row[:0]
        keep = self.near[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        row, h = row[keep], h[keep]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        keep = self.hashes[at] == h
        both, n = np.unique(row[keep] * len(self.hashes) + at[keep], return_counts=True)
        return both // len(self.hashes), both % len(self.hashes), n


@dataclass
class Index:
    """Postings of the examples, term by term, each list in runs of one block of rows.

    ``run_of[t]:run_of[t + 1]`` are the runs of term t; run r lies in block
    ``run_block[r]``, has postings ``post_of[r]:post_of[r + 1]`` and at most the weight
    ``run_max[r]``.  Frequent terms have no runs: ``often[t]`` is their row of ``full``
    (examples in columns), -1 for all others."""

    vocabulary: Vocabulary
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    run_of: np.ndarray
    run_block: np.ndarray
    run_max: np.ndarray
    post_of: np.ndarray
    post_row: np.ndarray
    post_weight: np.ndarray
    often: np.ndarray
    full: np.ndarray
    share: float
    slope: float = 1.0
    base: float = 0.0

    def weights(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms that weigh anything and their weights, of length 1."""
        w = np.sqrt(count) * self.idf[term]
        term, w = term[w > 0], w[w > 0]
        return term, w / max(np.sqrt((w * w).sum()), 1e-12)

    def frequent(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The part of the cosines that frequent terms make: a row for each of the texts
        (term, w), a column for each example."""
        held = np.zeros((len(texts), len(self.full)))
        for i, (term, w) in enumerate(texts):
            at = self.often[term]
            held[i, at[at >= 0]] = w[at >= 0]
        return held @ self.full

    def nearest(
        self, term: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1, frequent: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest examples, ties by row; only examples that
        share a term.  The blocks of highest bound are scored first; what cannot
        reach the k-th best of them is skipped.  ``frequent``: the text's row of
        ``frequent()``, where it is known.  Cosines are rounded to twelve places, as sums
        in another order must not part equal examples."""
        if not len(self.labels):
            return np.zeros(0, np.int64), np.zeros(0)
        if frequent is None:
            frequent = self.frequent([(term, w)])[0]
        runs = self.run_of[term + 1] - self.run_of[term]
        run = _ranges(self.run_of[term], runs)
        by_run = np.repeat(w, runs)
        blocks = -(-len(self.labels) // BLOCK)
        bound = np.maximum.reduceat(frequent, np.arange(0, len(self.labels), BLOCK))
        bound = bound + np.bincount(self.run_block[run], self.run_max[run] * by_run, blocks)
        best_first = np.argsort(-bound, kind="stable")
        first = best_first[:max(1, -(-3 * k // BLOCK))]
        scores = self._scores(run, by_run, first, blocks, frequent)
        least = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        rest = best_first[len(first):]
        rest = rest[bound[rest] >= least - 1e-11]
        if least <= 0 or len(rest):
            rest = rest[bound[rest] > 0]
            most = 2 * len(rest) > blocks
            scores += self._whole(term, w, rest, blocks, frequent) if most else self._scores(run, by_run, rest, blocks, frequent)
        scores = np.round(scores, 12)
        if skip >= 0:
            scores[skip] = 0
        rows = np.flatnonzero(scores > 0)
        if len(rows) > k:
            last = np.partition(scores[rows], -k)[-k]
            above, tied = rows[scores[rows] > last], rows[scores[rows] == last]
            rows = np.concatenate([above, tied[:k - len(above)]])
        rows = rows[np.lexsort((rows, -scores[rows]))]
        return rows, scores[rows]

    def _scores(self, run: np.ndarray, by_run: np.ndarray, chosen: np.ndarray, blocks: int, frequent: np.ndarray) -> np.ndarray:
        """Exact cosines of the rows in the chosen blocks, 0 elsewhere."""
        wanted = np.zeros(blocks, dtype=bool)
        wanted[chosen] = True
        keep = wanted[self.run_block[run]]
        run, by_run = run[keep], by_run[keep]
        n = self.post_of[run + 1] - self.post_of[run]
        post = _ranges(self.post_of[run], n)
        scores = np.bincount(self.post_row[post], self.post_weight[post] * np.repeat(by_run, n), len(self.labels))
        return scores + np.where(np.repeat(wanted, BLOCK)[:len(scores)], frequent, 0)

    def _whole(self, term: np.ndarray, w: np.ndarray, chosen: np.ndarray, blocks: int, frequent: np.ndarray) -> np.ndarray:
        """The same, where most blocks are chosen: a term's postings lie together, so they are
        taken as one range, and the other blocks are left out at the end."""
        wanted = np.zeros(blocks, dtype=bool)
        wanted[chosen] = True
        first, last = self.post_of[self.run_of[term]], self.post_of[self.run_of[term + 1]]
        post = _ranges(first, last - first)
        weight = self.post_weight.take(post)
        weight *= np.repeat(w, last - first)
        scores = np.bincount(self.post_row.take(post), weight, len(self.labels))
        return np.where(np.repeat(wanted, BLOCK)[:len(scores)], scores + frequent, 0)

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic labels among neighbours, by squared cosine."""
        near = cosines * cosines
        return float((near @ self.labels[rows] + FAINT * self.share) / (near.sum() + FAINT))

    def score(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * vote + self.base)))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then first[1], ..."""
    before = np.cumsum(n) - n
    out = np.arange(int(n.sum()))
    out += np.repeat(first - before, n)
    return out


def build(ids: np.ndarray, labels: np.ndarray, vocabulary: Vocabulary, idf: np.ndarray, counts: tuple[np.ndarray, ...], share: float) -> Index:
    """The index of examples whose term counts are (row, term, count), and its calibration.

    The examples are votes of equal classes; ``share`` is that of toxic labels.  Each
    example is scored by the others, and a logistic curve is fitted to those votes with
    the classes weighed back to their shares."""
    row, term, count = counts
    w = np.sqrt(count) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, len(ids)))
    w = w / np.maximum(norm, 1e-12)[row]
    row, term, w = row[w > 0], term[w > 0], w[w > 0]
    many = np.bincount(term, minlength=len(idf)) > OFTEN * len(ids)
    often = np.where(many, np.cumsum(many) - 1, -1)
    full = np.zeros((int(many.sum()), len(ids)))
    full[often[term[many[term]]], row[many[term]]] = w[many[term]]
    row, term, w = row[~many[term]], term[~many[term]], w[~many[term]]
    order = np.lexsort((row, term))
    row, term, w = row[order], term[order], w[order]
    group = term.astype(np.int64) * (len(ids) // BLOCK + 1) + row // BLOCK
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    index = Index(
        vocabulary, idf, labels, ids,
        run_of=np.searchsorted(term[first], np.arange(len(idf) + 1)), run_block=row[first].astype(np.int64) // BLOCK,
        run_max=np.maximum.reduceat(w, first) if len(first) else w, post_of=np.append(first, len(row)),
        post_row=row.astype(np.int64), post_weight=w, often=often, full=full, share=share,
    )
    at = np.searchsorted(counts[0], np.arange(len(ids) + 1))
    every = [index.weights(counts[1][a:b], counts[2][a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    votes = np.array([index.vote(*found) for found in _found(index, every, itself=True)])
    if 0 < labels.sum() < len(labels):
        weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
        index.slope, index.base = _logistic(votes, labels, weight)
    else:  # one class or none: the share itself
        index.slope, index.base = 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    return index


def _found(index: Index, texts: list[tuple[np.ndarray, np.ndarray]], itself: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nearest examples of each of the texts (term, w); ``itself``: the texts are the
    examples, which do not find themselves."""
    for first in range(0, len(texts), AT_ONCE):
        some = texts[first:first + AT_ONCE]
        for i, ((term, w), frequent) in enumerate(zip(some, index.frequent(some), strict=True)):
            yield index.nearest(term, w, skip=first + i if itself else -1, frequent=frequent)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and base of the weighted logistic fit, a little ridge on the slope."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - np.array([0.01, 0.0]) * beta
        curve = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag([0.01, 1e-9])
        step = np.linalg.solve(curve, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Index:
    """The index of up to ``PER_CLASS`` examples of each class (those of lowest hash of
    doc_id, texts up to ``LONGEST`` bytes) from the training fold.

    A term weighs by how many of the documents that are labelled as clean hold it (all of
    them, not the examples alone), and always more than 0.  So a large group of toxic
    copies does not make its own terms common."""
    known = training_labels(labels, column)
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    share = total.toxic / total.n if total.n else 0.0
    draw = F.xxhash64(F.lit(3), "doc_id")
    picked = [known.where(F.col("y") == y).orderBy(draw, "doc_id").limit(PER_CLASS) for y in (1, 0)]
    sample = picked[0].unionByName(picked[1])
    found = (
        docs.select("doc_id", text_of(docs).alias("text")).where(F.octet_length("text") <= LONGEST)
        .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).toArrow()
    ).sort_by("doc_id")
    found = found.take(pa.array(np.argsort(curve_keys(found.column("text")).to_numpy(), kind="stable")))
    ids = found.column("doc_id").to_numpy()
    y = found.column("y").to_numpy().astype(np.int64)
    texts = found.column("text")
    hashes = []
    for _, data, offsets in words.slices(texts):
        row, h = terms(data, offsets)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, bool)
        hashes.append(h[new])
    every, held = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    vocabulary = Vocabulary(every[held >= LEAST_EXAMPLES])
    del hashes, every, held
    clean = listed(known.where("y = 0").select("doc_id"))
    df, n_docs = document_counts(docs.join(clean, "doc_id", "left_semi"), vocabulary)
    idf = np.log((n_docs + 2) / (df + 1)) ** STEEPNESS
    parts = []
    for first, data, offsets in words.slices(texts):
        row, term, count = vocabulary.counts(data, offsets)
        parts.append(tuple(x.astype(np.int32) for x in (row + first, term, count)))
    counts = tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3
    del parts, found, texts
    index = build(ids, y, vocabulary, idf, counts, share)
    del counts
    release(docs.sparkSession)
    return index


def document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """How many documents hold each term of the vocabulary, and how many there are.
    Each task sends one row per term it met; the vocabulary is as large as the sample."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(len(held.value.hashes), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for _, data, offsets in words.slices(batch.column(0)):
                n += np.bincount(held.value.counts(data, offsets)[1], minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(n[met], rows))], ["term", "n"])

    sums = docs.select(text_of(docs).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    df = np.zeros(len(vocabulary.hashes) + 1, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return df[:-1], int(df[-1])


def _votes(index: Index, texts: pa.Array) -> Iterator[tuple[int, Iterator[tuple[float, np.ndarray, np.ndarray]]]]:
    """For each slice its first row and (vote, nearest examples, their cosines) of each text."""
    for first, data, offsets in words.slices(texts):
        row, term, count = index.vocabulary.counts(data, offsets)
        at = np.searchsorted(row, np.arange(len(offsets)))
        weighed = [index.weights(term[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield first, ((index.vote(rows, cosines), rows, cosines) for rows, cosines in _found(index, weighed))


def _clean(index: Index, batches: Iterator[pa.RecordBatch], at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows whose text (column ``at``) scores below the threshold, slice by slice: of a
    batch of long texts no second copy is made."""
    for batch in batches:
        for first, found in _votes(index, batch.column(at)):
            votes = np.array([v for v, *_ in found], dtype=float)
            yield batch.slice(first, len(votes)).filter(pa.array(index.score(votes) < threshold))


def score(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """docs (doc_id, text, anything else): doc_id, score, evidence, one row per row.

    score: the calibrated, distance-weighted vote of the nearest examples for toxic, 0
    to 1.  evidence: the examples nearest of all, array<struct<doc_id, toxic, cosine>>.
    A null or empty text, or one that shares no term with any example, gets what the
    overall share of toxic labels gives.  Rows that repeat are scored alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            votes, seen = [], []
            for vote, rows, cosines in (one for _, found in _votes(index, batch.column("text")) for one in found):
                votes.append(vote)
                seen.append([
                    {"doc_id": int(index.ids[r]), "toxic": int(index.labels[r]), "cosine": float(c)}
                    for r, c in zip(rows[:evidence], cosines[:evidence], strict=True)
                ])
            scores = index.score(np.array(votes, dtype=float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(seen, kind)], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(
        run, "doc_id long, score double, evidence array<struct<doc_id: long, toxic: int, cosine: double>>"
    )


def keep_clean(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns, in place: no
    row is shuffled.  Texts that say nothing (null, empty, no known term) stay unless
    toxic labels are the rule."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _clean(held.value, batches, at, threshold)

    return docs.mapInArrow(run, docs.schema)
