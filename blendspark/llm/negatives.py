"""Hard negatives: the limits of the positives cut the scores into disjoint slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendspark.operators.lineage import cut

#: Positives of an anchor, and negatives of a positive.
K = 5
#: A negative scores between LOW and HIGH hundredths of its positive.
LOW, HIGH = 80, 100
#: Anchors of a block; scores held at once in a task; bytes of a block of rows.
ANCHORS, CELLS, BLOCK_BYTES = 2048, 1 << 20, 4 << 20
#: Anchors are broadcast up to so many bytes; more meet the rows by a shuffle.
MOST_BYTES = 32 << 20

ANCHOR = "struct<anchor: long, vec_id: long, label: long, vector: array<double>, limits: array<long>>"


def usable(vectors: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles: floor of scale times each component)
    of the rows that take part: those with id, label, vector and finite components only."""
    def floored(y: Column) -> Column:  # beyond 2**53 a double is whole anyway
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), (vectors["label"] if label is None else label).cast("long").alias("label"),
        F.transform(vectors["embedding"].cast("array<double>"), lambda x: floored(x * scale)).alias("vector"),
    )
    finite = F.forall("vector", lambda y: F.abs(y) < F.lit(float("inf")))  # false for NaN, null for null
    return rows.where("vec_id is not null and label is not null and vector is not null").where(finite)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of lists as a matrix, with zeros behind the shorter ones."""
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to blocks in order of vec_id: the numbers of each as bytes."""
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        vectors = _matrix(batch.column("vector"))
        step = max(1, BLOCK_BYTES // (8 * max(1, vectors.shape[1])))
        for low in range(0, len(ids), step):
            at = low + np.argsort(ids[low:low + step], kind="stable")
            yield pa.RecordBatch.from_pydict({
                "first": [int(ids[at[0]])], "ids": [ids[at].astype("<i8").tobytes()], "labels": [labels[at].astype("<i8").tobytes()],
                "vectors": [vectors[at].astype("<f8").tobytes()],
            })


BLOCK = "first long, ids binary, labels binary, vectors binary"


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by anchors: as long where doubles are exact, else as
    whole numbers of any size."""
    width = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :width], anchors[:, :width]
    if np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, width) < 2.0**53:
        return (rows @ anchors.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(rows).astype(object) @ whole(anchors).astype(object).T


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k allowed scores of each column; of equal ones the
    upper rows."""
    n = len(scores)
    if scores.dtype == object or np.abs(scores).max(initial=0) >= 2**62 // max(1, n):
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape).astype(np.int64)
    lowest = np.iinfo(np.int64).min
    key = np.where(allowed, scores * n + np.arange(n - 1, -1, -1)[:, None], lowest)
    picked = np.argpartition(key, n - k, axis=0)[n - k:] if n > k else np.tile(np.arange(n)[:, None], (1, key.shape[1]))
    columns = np.broadcast_to(np.arange(key.shape[1]), picked.shape)
    real = key[picked, columns] > lowest
    return picked[real], columns[real]


def _as_long(scores: np.ndarray) -> np.ndarray:
    return np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores], dtype=np.int64) if scores.dtype == object else scores


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, labels, scores, anchor numbers, ids, labels, limits, same row?) of tiles."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in ("ids", "labels"))
            vectors = np.frombuffer(batch.column("vectors")[i].as_py(), "<f8").reshape(len(ids), -1)
            anchors = batch.column("anchors")[i].values
            matrix = _matrix(anchors.field("vector"))
            numbers, own, kinds = (anchors.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "vec_id", "label"))
            step = max(1, CELLS // max(1, len(ids)))
            for low in range(0, len(numbers), step):
                part = slice(low, low + step)
                limits = anchors.field("limits")[low:low + step].to_pylist()
                yield ids, labels, vectors, matrix[part], _scores(vectors, matrix[part]), numbers[part], own[part], kinds[part], limits


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first K + 1 of the same label for each anchor and block."""
    for ids, labels, vectors, matrix, scores, numbers, own, kinds, _ in _met(batches):
        at, of = _first(scores, labels[:, None] == kinds, K + 1)
        width = min(vectors.shape[1], matrix.shape[1])
        alike = ids[at] == own[of]
        same = np.zeros(len(at), dtype=bool)
        for x in np.flatnonzero(alike):  # a row or its copies: few
            a, b = vectors[at[x]], matrix[of[x]]
            same[x] = (a[:width] == b[:width]).all() and not a[width:].any() and not b[width:].any()
        yield pa.RecordBatch.from_pydict({"anchor": numbers[of], "id": ids[at], "score": _as_long(scores[at, of]), "same": same})


def _slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first K of other labels for each anchor, slot and block.  Slot j holds the
    scores from limit j down to above limit j + 1, as far as the window of limit j goes."""
    for ids, labels, _, _, scores, numbers, _, kinds, limits in _met(batches):
        other = labels[:, None] != kinds
        for j in range(max((len(x) for x in limits), default=0)):
            has = np.array([len(x) > j for x in limits])
            high = np.array([x[j] if len(x) > j else 0 for x in limits], dtype=scores.dtype)
            after = np.array([len(x) > j + 1 for x in limits])
            low = np.array([x[j + 1] if len(x) > j + 1 else 0 for x in limits], dtype=scores.dtype)
            inside = other & has & (scores * 100 <= high * HIGH) & (scores * 100 >= high * LOW) & (~after | (scores > low))
            at, of = _first(scores, inside.astype(bool), K)
            yield pa.RecordBatch.from_pydict({
                "anchor": numbers[of], "slot": np.full(len(at), j, np.int32), "id": ids[at], "score": _as_long(scores[at, of]),
            })


def _meet(rows: DataFrame, anchors: DataFrame, step, schema: str) -> DataFrame:
    """step over every block of rows with every block of anchors.

    The blocks of anchors are broadcast if they are small, which leaves the rows where
    they are; else both sides are dealt to a grid: each row block goes to every anchor
    block, each anchor block to ``ranges`` groups of row blocks.
    """
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    blocks = max(1, -(-size.n // ANCHORS))
    fits = size.n * (8 * size.width + 100) <= MOST_BYTES
    groups = 1 if fits else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = (
        anchors.withColumn("no", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).groupBy("no")
        .agg(F.collect_list(F.struct("anchor", "vec_id", "label", "vector", "limits").cast(ANCHOR)).alias("anchors"))
    )
    grid = rows.mapInArrow(_blocks, BLOCK).withColumns({
        "no": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "deal": F.pmod(F.xxhash64("first"), F.lit(groups)),
    })
    if fits:
        met = grid.join(F.broadcast(packed), "no")
    else:
        met = grid.join(packed.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))), ["no", "deal"])
    return met.select("ids", "labels", "vectors", "anchors").mapInArrow(step, schema)


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group; Spark cuts them before the shuffle as well."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """For each anchor and each of its first K positives, the first K rows of another
    label that score between LOW and HIGH hundredths of the positive.

    rows: as ``usable`` gives them.  Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.  Scores are inner products; higher
    first, ties by smaller vec_id.  Positives are the other rows of the anchor's label.

    Rows that repeat a vec_id are rows of their own; equal rows that are anchors are scored
    once and returned each.  Components behind the end of the shorter of two vectors count
    as zero.  Scores beyond long stop at its bounds.  Anchors without positives, positives
    without negatives and empty tables give no rows.

    Two scans score blocks against all anchors in numpy.  The first keeps K + 1 rows an
    anchor and block.  The scores of the positives are the upper limits of the windows;
    they cut the scores into disjoint slots, of which the second scan keeps K each.  A
    window is then the start of the slots from its own limit down, so overlapping windows
    need no scan of their own.
    """
    anchors = cut(
        rows.where(is_anchor).groupBy("vec_id", "label", "vector").agg(F.count("*").alias("copies"))
        .withColumn("anchor", F.monotonically_increasing_id())
    )
    near = _meet(rows, anchors.withColumn("limits", F.array().cast("array<bigint>")), _nearest, "anchor long, id long, score long, same boolean")
    ranked = _best(near, ["anchor"], K + 1).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "same"))).alias("near"))
    own = F.array_position(F.transform("near", lambda x: x["same"]), True)
    others = F.filter("near", lambda x, i: (i + 1) != own)  # without the anchor's own row
    positives = cut(ranked.select("anchor", F.slice(F.transform(others, lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))), 1, K).alias("positives")))
    limits = F.array_distinct(F.transform("positives", lambda x: x["score"]))
    led = cut(anchors.join(positives, "anchor").withColumn("limits", limits))
    slotted = _best(_meet(rows, led, _slotted, "anchor long, slot int, id long, score long"), ["anchor", "slot"], K)
    negatives = slotted.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("negatives"))

    each = led.select("anchor", "vec_id", "copies", "limits", F.explode("positives").alias("p")).join(negatives, "anchor")
    slot = F.array_position("limits", F.col("p.score")) - 1
    suffix = F.slice(F.filter("negatives", lambda x: x["slot"] >= slot), 1, K)
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  a hundred times a long
    inside = F.filter(suffix, lambda x: wide(x["score"]) * 100 >= wide(F.col("p.score")) * LOW)
    return (
        each.select("vec_id", "p", F.posexplode(inside).alias("at", "x"), F.expr("sequence(1L, copies)").alias("each"))
        .select("vec_id", "p", "at", "x", F.explode("each"))
        .select(
            F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).alias("rank"),
            F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"),
        )
    )
