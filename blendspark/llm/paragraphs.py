"""Repeated paragraphs by MinHash banding, and repeated passages wherever they stand.

Lines.  A line of ``LEAST`` words or more is a paragraph: the set of its five-word
shingles.  ``bands()`` bands of ``ROWS`` least hashes are tuned for the recall at a
Jaccard similarity of 0.8.  Equal sets are one class; classes whose bands collide are
verified exactly and joined to components, by hubs first and then between components
(as in the Jaccard join).  Only the sets of colliding classes are built.

Passages.  What is pasted into a line is no paragraph of its own, so runs of ``RUN`` words
are compared too, for equality.  They start at words that the text itself chooses: at the
least shingle hash of any ``GAP`` in a row (all of them, if they tie).  A passage of
``GAP + RUN - 1`` = 50 words chooses the same words in any document and script, and holds
at least one run whole.  A run that repeats is extended over the words around it as far as
they agree with those of the document that keeps it, in steps of ``STEPS`` words; words
are compared by 16 bits of hash a step there, runs by 96.

Of a component of lines, or of equal runs, the first document keeps what it has; in the
others it is removed, and what overlaps or touches is removed as one span.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendspark.llm import words
from blendspark.llm.frames import MOST_BROADCAST, fresh, release, text_of
from blendspark.llm.overlap import MANY, MARKS, OF, WORDS, joined_up, marks_of, tiles_of
from blendspark.operators.lineage import cut

#: Words of the shortest line that counts as a paragraph.  Shorter ones that repeat are
#: headings and set phrases more often than copies.
LEAST = 31
RUN, GAP = 31, 20
#: Words on either side of a run up to which it may be extended, at most GAP - 1.
STEPS = (4, 9, 14, 19)
#: Many rows: lines that share just a common phrase have a similarity of a tenth, and
#: thousands of them must not collide.
ROWS = 6
RECALL = 0.97
#: Stands for a doc_id that is null: behind all others.
LAST = (1 << 63) - 1


def bands(rows: int = ROWS, similarity: float = MANY / OF, recall: float = RECALL) -> int:
    """The fewest bands of so many rows in which two sets of the similarity collide with
    the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _permuted(hashes: np.ndarray, k: int) -> np.ndarray:
    return words.mix(hashes ^ words.mix(np.array([0xA0761D6478BD642F + k], dtype=np.uint64)))


def _odd(k: int) -> np.uint64:
    return words.mix(np.array([0xE7037ED1A0B428DB + k], dtype=np.uint64))[0] | np.uint64(1)


def _sliding(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of() over each run of so many values, by doubling."""
    count, span = len(values) - width + 1, 1
    if count <= 0:
        return values[:0]
    while span * 2 <= width:
        values = of(values[:-span], values[span:])
        span *= 2
    return of(values[:count], values[width - span:width - span + count])


class _Slice:
    """A slice of texts: words (start, end; ``of``: words before each row), the shingle
    hash at each word (those across texts are never asked for), code points before each
    byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.start, self.end, self.of = words.words(data, offsets)
        self.hashes = words.word_hashes(data, self.start, self.end)
        self.shingle, _ = words.shingles(self.hashes, np.array([0, len(self.hashes)]), WORDS)
        self.chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.of, word, side="right") - 1

    def place(self, byte: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Code points of the row's text before the byte."""
        return self.chars[byte] - self.chars[self.offsets[row]]

    def lines(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, word after the last) of the lines of so many words."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        breaks = np.append(0, np.cumsum(self.data == 10))[self.start]
        new = np.ones(len(self.start), dtype=bool)
        new[1:] = breaks[1:] > breaks[:-1]
        counts = np.diff(self.of)
        new[self.of[:-1][counts > 0]] = True
        first = np.flatnonzero(new)
        after = np.append(first[1:], len(new))
        long = after - first >= max(least, WORDS)
        return first[long], after[long]

    def least(self, k: int, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The least k-th hash of the shingles of each line."""
        permuted = np.append(_permuted(self.shingle, k), np.uint64(0))
        bounds = np.stack([first, after - WORDS + 1], axis=1).ravel()
        return np.minimum.reduceat(permuted, bounds)[::2]

    def set_of(self, first: int, after: int) -> np.ndarray:
        return np.unique(self.shingle[first:after - WORDS + 1])

    def runs(self) -> np.ndarray:
        """The words at which a run starts."""
        if len(self.shingle) < GAP:
            return np.zeros(0, np.int64)
        least = _sliding(self.shingle, GAP, np.minimum)
        at = np.arange(len(least))
        least[at + GAP + WORDS - 1 > self.of[self.row_of(at) + 1]] = 0  # across texts
        edge = np.zeros(GAP - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), GAP, np.maximum) == self.shingle)
        return chosen[chosen + RUN <= self.of[self.row_of(chosen) + 1]]

    def digests(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the words of each run."""
        d = np.zeros(len(first), np.uint64)
        for o in (*range(0, RUN - WORDS, WORDS), RUN - WORDS):
            d += self.shingle[first + o] * _odd(o)
        c = sum((self.hashes[first + o] * _odd(100 + o) for o in range(RUN)), np.zeros(len(first), np.uint64))
        return words.mix(d).view(np.int64), (words.mix(c) >> np.uint64(32)).astype(np.int64)

    def around(self, first: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(hash, code points) of the words beside each run, 16 bits for each of ``STEPS``;
        what lies beyond the text is a word of its own."""
        row = self.row_of(first)
        low, high = self.of[row], self.of[row + 1]
        total, marks, reach = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
        for t in range(1, STEPS[-1] + 1):
            word = first + RUN - 1 + t if right else first - t
            beyond = (word < low) | (word >= high)
            total += np.where(beyond, np.uint64(0x5851F42D4C957F2D), self.hashes[np.clip(word, low, high - 1)]) * _odd(200 + t)
            if t in STEPS:
                shift = np.uint64(16 * STEPS.index(t))
                to = np.clip(word, low, high - 1)
                far = self.chars[self.end[to]] - self.chars[self.end[first + RUN - 1]] if right else self.chars[self.start[first]] - self.chars[self.start[to]]
                marks |= (words.mix(total) >> np.uint64(48)) << shift
                reach |= np.where(far < 1 << 16, far, 0).astype(np.uint64) << shift
        return marks.view(np.int64), reach.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("id"), text_of(docs).alias("text")
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Slice, np.ndarray, np.ndarray]]:
    for batch in batches:
        row, doc = (np.asarray(batch.column(c)) for c in ("row", "id"))
        for base, data, offsets in words.slices(batch.column("text")):
            here = slice(base, base + len(offsets) - 1)
            yield _Slice(data, offsets), row[here], doc[here]


def first_runs(docs: DataFrame) -> DataFrame:
    """d, c, docs, first: the digest of each run that documents share, how many do, and
    the first of them (id, row) with what lies around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, row, doc in _slices(batches):
            at = s.runs()
            d, c = s.digests(at)
            of = s.row_of(at)
            order = np.lexsort((of, doc[of], c, d))
            at, d, c, of = at[order], d[order], c[order], of[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
            other = new.copy()
            other[1:] |= of[1:] != of[:-1]
            first = np.flatnonzero(new)
            docs_with = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            left, right = s.around(at[first], False)[0], s.around(at[first], True)[0]
            columns = [d[first], c[first], docs_with, doc[of[first]], row[of[first]], left, right]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["d", "c", "docs", "id", "row", "left", "right"])

    found = _rows(docs).mapInArrow(run, "d long, c long, docs long, id long, row long, left long, right long")
    first = F.min(F.struct("id", "row", "left", "right")).alias("first")
    return found.groupBy("d", "c").agg(F.sum("docs").alias("docs"), first).where("docs > 1")


def all_runs(docs: DataFrame) -> DataFrame:
    """d, c, id, row, start, stop (code points) of every run, with what lies around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, row, doc in _slices(batches):
            at = s.runs()
            of = s.row_of(at)
            columns = [
                *s.digests(at), doc[of], row[of], s.place(s.start[at], of), s.place(s.end[at + RUN - 1], of), *s.around(at, False), *s.around(at, True),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["d", "c", "id", "row", "start", "stop", "left", "before", "right", "after"])

    names = ("d", "c", "id", "row", "start", "stop", "left", "before", "right", "after")
    return _rows(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _agreed(one: Column, other: Column, reach: Column) -> Column:
    """The code points of the longest of ``STEPS`` up to which all hashes agree."""
    differ = one.bitwiseXOR(other)
    part = lambda x, i: F.shiftright(x, 16 * i).bitwiseAND(F.lit(0xFFFF))
    found = F.when(part(differ, 0) != 0, F.lit(0))
    for i in range(1, len(STEPS)):
        found = found.when(part(differ, i) != 0, part(reach, i - 1))
    return found.otherwise(part(reach, len(STEPS) - 1)).cast("long")


def removed_runs(docs: DataFrame) -> DataFrame:
    """row, id, start, stop, keeper (id, row) of the runs that an earlier document has."""
    runs = all_runs(docs).join(first_runs(docs).select("d", "c", "first"), ["d", "c"])
    later = runs.where(F.struct("id", "row") > F.struct("first.id", "first.row"))
    return later.select(
        "row", "id",
        (F.col("start") - _agreed(F.col("left"), F.col("first.left"), F.col("before"))).alias("start"),
        (F.col("stop") + _agreed(F.col("right"), F.col("first.right"), F.col("after"))).alias("stop"),
        F.struct("first.id", "first.row").alias("keeper"),
    )


def paragraphs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The lines of at least so many words: row, id, start, stop (code points), d1, d2
    (digest of the set), keys (its bands)."""
    many = bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, row, doc in _slices(batches):
            first, after = s.lines(least)
            if not len(first):
                continue
            of = s.row_of(first)
            keys = []
            for band in range(many):
                key = np.full(len(first), band, dtype=np.uint64)
                for r in range(ROWS):
                    key = words.mix(key * np.uint64(31) + s.least(band * ROWS + r, first, after))
                keys.append(key)
            spread = [words.mix(s.set_of(a, b) + np.uint64(1)) for a, b in zip(first, after, strict=True)]
            d1 = np.array([x.sum(dtype=np.uint64) for x in spread]).view(np.int64)
            d2 = np.array([words.mix(x ^ np.uint64(0x5555)).sum(dtype=np.uint64) for x in spread]).view(np.int64)
            columns = [row[of], doc[of], s.place(s.start[first], of), s.place(s.end[after - 1], of), d1, d2]
            flat = pa.array(np.stack(keys, axis=1).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(first) + 1, dtype=np.int32) * many, flat)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["row", "id", "start", "stop", "d1", "d2", "keys"])

    return _rows(docs).mapInArrow(run, "row long, id long, start long, stop long, d1 long, d2 long, keys array<long>")


def sets_of(docs: DataFrame, places: DataFrame, least: int = LEAST) -> DataFrame:
    """node, n, hashes and signature of the lines at places (node, row, start)."""
    found = places.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "node"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in words.slices(batch.column("text")):
                s = _Slice(data, offsets)
                first, after = s.lines(least)
                of = s.row_of(first)
                begins = s.place(s.start[first], of)
                nodes, sets = [], []
                for i in range(len(offsets) - 1):
                    a, b = np.searchsorted(of, (i, i + 1))
                    for place in batch.column("at")[base + i].as_py():
                        line = a + int(np.searchsorted(begins[a:b], place["start"]))
                        nodes.append(place["node"])
                        sets.append(s.set_of(first[line], after[line]))
                if nodes:
                    ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), lists, *marks_of(sets)], ["node", "n", "hashes", *MARKS]
                    )

    found = cut(found)
    wanted = F.broadcast(found) if places.count() <= MOST_BROADCAST // 4 else found
    return _rows(docs).select("row", "text").join(wanted, "row").mapInArrow(
        run, "node long, n long, hashes array<long>, " + ", ".join(f"{g} long" for g in MARKS)
    )


def removed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """row, id, start, stop, keeper (id, row) of the lines of a component that an earlier
    document has a line of."""
    found = cut(paragraphs(docs, least))
    release(docs.sparkSession)  # what came before may only go now
    found = found.withColumn("place", F.struct("id", "row"))
    key = ["d1", "d2"]
    # Equal sets have equal keys.  The least place of a class stands for it.
    classes = cut(
        found.groupBy(*key).agg(
            F.min(F.struct("place", "start")).alias("first"), F.max("place").alias("last"), F.any_value("keys").alias("keys")
        ).withColumn("node", F.xxhash64(*key))
    )
    found = cut(found.drop("keys"))
    release(docs.sparkSession)
    keyed = classes.select("node", F.explode("keys").alias("s"))
    colliding = keyed.groupBy("s").agg(F.count("*").alias("sets")).where("sets > 1").select("s")
    keyed = cut(keyed.join(colliding, "s", "left_semi"))
    places = cut(classes.join(keyed.select("node").distinct(), "node", "left_semi").select("node", "first.place.row", "first.start"))
    classes = classes.drop("keys")
    release(docs.sparkSession)
    sets = cut(sets_of(docs, places, least))
    joined = joined_up(cut(tiles_of(keyed, sets)), sets)
    placed = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = placed.groupBy("component").agg(F.min("first.place").alias("keeper"), F.max("last").alias("last")).where("keeper < last")
    gone = placed.join(groups.drop("last"), "component").select(*key, "keeper")
    return found.join(gone, key).where(F.col("place") > F.col("keeper")).select("row", "id", "start", "stop", "keeper")


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs: doc_id, text, anything else.  One row per span to remove: row, doc_id, start,
    stop (code points), kept_doc_id (a document that keeps the passage, the least of
    those of the span).  ``least``: words of the shortest line that is compared.

    Texts of fewer than ``least`` and ``RUN`` words (empty and null too) have nothing to
    compare.  Of equal documents the first by doc_id (null last), then by row, keeps all.
    A passage that repeats inside one document only is left alone.  Whole texts of any
    length are read, in slices; an empty table gives no rows.  docs must read in the same
    order each time (files do).
    """
    runs = cut(removed_runs(docs))
    release(docs.sparkSession)
    lines = cut(removed_lines(docs, least))
    release(docs.sparkSession)
    removed = lines.union(runs)
    by_row = Window.partitionBy("row").orderBy("start", "stop")
    reached = F.max("stop").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    islands = removed.withColumn("new", F.when(F.col("start") <= reached + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_row))
    return islands.groupBy("row", "id", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("keeper").alias("keeper")
    ).select("row", F.nullif(F.col("id"), F.lit(LAST)).alias("doc_id"), "start", "stop", F.nullif(F.col("keeper.id"), F.lit(LAST)).alias("kept_doc_id"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated spans cut out of the texts; other columns stay."""
    row, cuts = fresh(docs, "_row"), fresh(docs, "_cuts")
    spans = repeated_spans(docs).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(cuts))
    spans = spans.withColumnRenamed("row", "_gone")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    joined = numbered.join(spans, numbered[row] == spans["_gone"], "left")
    state = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        cuts, state,
        lambda s, c: F.struct(F.concat(s["kept"], F.substring("text", (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int"))).alias("kept"), c["stop"].alias("at")),
        lambda s: F.concat(s["kept"], F.substring("text", (s["at"] + 1).cast("int"), F.length("text"))),
    )
    return joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(done)).select(*docs.columns)
