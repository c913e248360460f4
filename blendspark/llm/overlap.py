"""Jaccard join on word shingles: size bands, bitmap signatures, exact intersections.

A document is its set of five-word shingles; two link when 100 * shared >= 80 * joint.

1. Equal sets are one class; one document stands for it.
2. Of each set the three tenths of lowest hashes are counted over all classes.  A set with
   a partner lacks at most a fifth of its shingles there, so that a known number of these
   must occur elsewhere; sets that fall short are alone.
3. The others are indexed by a prefix in which shingles that many of them share come
   last.  Two that link share a shingle of their prefixes, and their sizes lie in the
   same or the next band: that pair of values is the tile.  In a tile the number of
   differing bits of the signatures bounds the overlap from above.
4. Tiles first compare every set with a few hubs.  What links is one component; after
   that only sets of different components meet.  No link between components is lost,
   and a crowd of near copies does not make all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.llm import words
from blendspark.llm.components import components
from blendspark.llm.frames import fresh, listed, release, text_of, tidied
from blendspark.operators.lineage import cut

WORDS = 5
#: A link needs shared / joint >= MANY / OF.
MANY, OF = 4, 5
#: One of so many shingles is counted beyond the prefix that a link would need.
SPARE = 10
#: Longs of a signature.
SIGNATURE = 8
#: A shingle of more than this many sets comes late in prefixes; doubled until no more
#: than MOST_FREQUENT are listed, which bounds what is broadcast.
FREQUENT, MOST_FREQUENT = 16, 1 << 20
HUBS = 3


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for _, data, offsets in words.slices(texts):
        start, end, of = words.words(data, offsets)
        yield from words.distinct(*words.shingles(words.word_hashes(data, start, end), of, WORDS))


def missing(n):
    """How many shingles of a set of n its partner may lack, at most."""
    return n - -(-MANY * n // OF)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Longs whose bits are the parities of the hashes that fall to them: each element
    that only one of two sets has changes one bit."""
    bits = np.bincount((hashes % np.uint64(64 * SIGNATURE)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int64()))


def summaries(docs: DataFrame) -> DataFrame:
    """row, doc_id, n, d1, d2, low: number and digest of each row's set, and the part of
    it with the lowest hashes."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, low = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                spread = words.mix(s + np.uint64(1))
                n.append(len(s))
                d1.append(spread.sum(dtype=np.uint64))
                d2.append(words.mix(spread ^ np.uint64(0x5555)).sum(dtype=np.uint64))
                low.append(s[:missing(len(s)) + 1 + len(s) // SPARE])
            digests = [pa.array(np.array(d, dtype=np.uint64).view(np.int64)) for d in (d1, d2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), *digests, _lists(low)],
                ["row", "doc_id", "n", "d1", "d2", "low"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, d1 long, d2 long, low array<long>")


def company(classes: DataFrame) -> DataFrame:
    """node of the classes (node, n, low) that may have a partner: enough of their
    lowest shingles occur in other classes too."""
    low = classes.select("node", F.explode("low").alias("s"))
    common = low.groupBy("s").agg(F.count("*").alias("sets")).where("sets > 1").select("s")
    met = low.join(common, "s", "left_semi").groupBy("node").agg(F.count("*").alias("met"))
    lack = F.col("n") - F.ceil(F.col("n") * MANY / OF)
    taken = F.least(F.col("n"), lack + 1 + F.floor(F.col("n") / SPARE))
    return met.join(classes.select("node", "n"), "node").where(F.col("met") >= taken - lack).select("node")


MARKS = [f"g{i}" for i in range(SIGNATURE)]


def marks_of(sets: list[np.ndarray]) -> list[pa.Array]:
    """The columns of ``MARKS``."""
    signs = np.array([signature(s) for s in sets], dtype=np.int64).reshape(-1, SIGNATURE)
    return [pa.array(signs[:, i]) for i in range(SIGNATURE)]


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, hashes and signature of the given rows of docs."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), size, _lists(sets), *marks_of(sets)], ["node", "n", "hashes", *MARKS])

    rows = docs.select(F.monotonically_increasing_id().alias("node"), text_of(docs).alias("text"))
    return rows.join(nodes, "node", "left_semi").mapInArrow(run, "node long, n long, hashes array<long>, " + ", ".join(f"{g} long" for g in MARKS))


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, number of sets) of the shingles most shared, at most
    ``MOST_FREQUENT`` of them."""
    counts = cut(sets.select(F.explode("hashes").alias("s")).groupBy("s").agg(F.count("*").alias("sets")).where(F.col("sets") > FREQUENT))
    least = FREQUENT
    while counts.where(F.col("sets") > least).count() > MOST_FREQUENT:
        least *= 2
    listed = counts.where(F.col("sets") > least).toArrow()
    hashes, n = listed.column("s").to_numpy().view(np.uint64), listed.column("sets").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def index(sets: DataFrame) -> DataFrame:
    """s, node: a row for each shingle of each set's prefix; written."""
    held = sets.sparkSession.sparkContext.broadcast(frequent(sets))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = held.value
        for batch in batches:
            lists = batch.column("hashes")
            flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            parts = [np.zeros(0, np.uint64)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                s = np.sort(flat[a:b])
                at = np.minimum(np.searchsorted(often, s), max(len(often) - 1, 0))
                sets_with = np.where(often[at] == s, count[at], 0) if len(often) else np.zeros(len(s), np.int64)
                parts.append(s[np.lexsort((s, sets_with))][:missing(len(s)) + 1])
            node = np.repeat(np.asarray(batch.column("node")), [len(p) for p in parts[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(node)], ["s", "node"])

    written = cut(sets.select("node", "hashes").mapInArrow(run, "s long, node long"))
    held.destroy()
    return written


def tiles_of(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """s, node, n, band and signature of the keys (s, node) that two sets share."""
    shared = keys.groupBy("s").agg(F.count("*").alias("sets")).where("sets > 1").select("s")
    band = F.floor(F.log("n") / F.log(F.lit(OF / MANY))).cast("int").alias("band")
    return keys.join(shared, "s", "left_semi").join(sets.select("node", "n", band, *MARKS), "node")


def _may_link(a: str, b: str) -> Column:
    """Sizes and signatures allow a link: shared <= (n + m - differing bits) / 2."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{g}").bitwiseXOR(F.col(f"{b}.{g}"))) for g in MARKS), F.lit(0))
    # shared / joint >= MANY / OF, with joint = n + m - shared
    return (OF * F.least(n, m) >= MANY * F.greatest(n, m)) & ((MANY + OF) * (n + m - differ) >= 2 * MANY * (n + m))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by their exact intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    joint = F.size("x") + F.size("y") - shared
    return pairs.join(left, "a").join(right, "b").where(100 * shared >= 80 * joint).select("a", "b")


def joined_up(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of all sets that link: by hubs first, then between what is
    still apart."""
    found = components(cut(linked(hub_pairs(tiles), sets)))
    release(sets.sparkSession)
    more = cut(linked(cross_pairs(tiles, found), sets))
    release(sets.sparkSession)
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def hub_pairs(tiles: DataFrame) -> DataFrame:
    """Each set with the hub of every shingle and band it is indexed by.  The shingles
    choose hubs by one of ``HUBS`` orders of the sets, so that a crowd has few hubs."""
    order = F.xxhash64(F.pmod("s", F.lit(HUBS)), "node")
    first = F.struct(order.alias("o"), "node", "n", *MARKS)
    hubs = tiles.groupBy("s", "band").agg(F.min(first).alias("h"), F.count("*").alias("sets")).where("sets > 1").select("s", "band", "h.*")
    met = tiles.alias("t").join(hubs.alias("h"), ["s", "band"]).where((F.col("t.node") != F.col("h.node")) & _may_link("t", "h"))
    return met.select(F.least("t.node", "h.node").alias("a"), F.greatest("t.node", "h.node").alias("b")).distinct()


def cross_pairs(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of different components that share a tile and may link.

    A shingle whose sets are all of one component is done.  Each set meets those of its
    own band that are as large or larger, and all of the next band."""
    placed = tiles.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ones = placed.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("s")
    placed = cut(placed.join(open_ones, "s", "left_semi"))
    tile = F.explode(F.array("band", F.col("band") - 1))
    larger = placed.select("s", "node", "n", "component", F.col("band").alias("own"), *MARKS, tile.alias("band"))
    met = placed.alias("a").join(larger.alias("b"), ["s", "band"]).where(
        (F.col("a.component") != F.col("b.component")) & _may_link("a", "b")
        & ((F.col("b.own") > F.col("band")) | (F.struct("b.n", "b.node") > F.struct("a.n", "a.node")))
    )
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def overlap_components(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, anything else.  One row per row: row, doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, the row's own included; null
    only if all are null), first_row (the row of that doc_id; of several the first).

    A text without words (or null) has no set and links with nothing; equal texts link;
    rows that repeat a doc_id are rows of their own.  docs must read in the same order
    each time (files do).
    """
    rows = cut(summaries(docs))
    key = ["n", "d1", "d2"]
    classes = cut(
        rows.where("n > 0").groupBy(*key).agg(
            F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("least")
        )
    )
    copies = rows.where("n > 0").select("row").join(classes.select(F.col("node").alias("row")), "row", "left_anti")
    copies = listed(copies.select(F.col("row").alias("node")))
    low = rows.where("n > 0").select(F.col("row").alias("node"), "n", "low").join(copies, "node", "left_anti")
    nodes = listed(company(low))
    rows = cut(rows.drop("low"))
    del low, copies
    release(docs.sparkSession)
    sets = cut(full_sets(docs, nodes))
    tiles = cut(tiles_of(index(sets), sets))
    release(docs.sparkSession)
    found = joined_up(tiles, sets)
    placed = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = placed.groupBy("component").agg(F.min("least").alias("first"))
    named = cut(placed.join(groups, "component").select(*key, "first"))
    # Rows without a set meet nothing; their number spreads them.
    own = F.struct(F.lit(False).alias("no"), "doc_id", "row")
    keyed = rows.withColumn("d1", F.when(F.col("n") > 0, F.col("d1")).otherwise(F.col("row")))
    return keyed.join(named, key, "left").withColumn("first", F.coalesce("first", own)).select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that are first of their component; columns stay."""
    gone = listed(overlap_components(docs).where("row <> first_row").select(F.col("row").alias("_gone")))
    row = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(gone, numbered[row] == gone["_gone"], "left_anti").drop(row)
