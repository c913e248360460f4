"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendspark.operators.lineage import cut

#: Narrow rows (a few numbers each) are broadcast up to this number.
MOST_BROADCAST = 1 << 20
#: Sampled keys behind each range.
SAMPLES_PER_RANGE = 60


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text as string; null counts as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def listed(ids: DataFrame) -> DataFrame:
    """A list of rows to join with, kept in the shared folder.  It is broadcast if it has
    no more than ``MOST_BROADCAST`` rows, which spares the other side its shuffle; a
    longer one is joined by a shuffle."""
    kept = cut(ids)
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def release(spark) -> None:
    """Let go of the shuffle, broadcast and checkpoint files of finished steps, and of the
    driver's free memory.  Spark's cleaner drops the files once the driver has collected the
    garbage that refers to them, which a driver with little to do seldom does by itself."""
    trim()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give this process's free memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if give is not None:
        give(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over Arrow batches that leaves no free memory with its worker at the end of a
    task: workers are kept, and the next step would come on top of it."""
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return whole


def ranges_for(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(keys: DataFrame, key: str, ranges: int, rows: int) -> list[int]:
    """Up to ``ranges - 1`` ascending bounds that cut a long key into ranges of
    about equal size.  They come from a hashed sample of the rows, about
    ``SAMPLES_PER_RANGE`` for each range, so that what reaches the driver grows with
    the number of ranges only.  Wherever the bounds fall, results stay right."""
    step = max(1, rows // max(1, ranges * SAMPLES_PER_RANGE))
    picked = keys.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(step)) == 0) if step > 1 else keys
    values = sorted(r[0] for r in picked.where(F.col(key).isNotNull()).select(key).collect())
    if not values:
        return []
    return sorted({values[len(values) * i // ranges] for i in range(1, ranges)})


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key (null: none), by binary search."""
    if not bounds:
        return F.lit(0)
    ordered = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        ahead = at + step
        passed = (ahead <= len(bounds)) & (F.get(ordered, ahead - 1) <= key)
        return F.when(passed, ahead).otherwise(at)

    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """The sums before each of the whole numbers of an array, and the sum of all.

    Runs of about the root of the length are summed one by one, as appending to an
    array copies it: n values cost n times root n."""
    def of(chunk: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(chunk, zero, lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)))

    def summed(v: Column, step: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), step), lambda i: of(F.slice(v, i, step)))
        return let(chunks, lambda c: let(of(F.transform(c, lambda x: F.element_at(x, -1))), lambda before: F.concat(
            F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + F.get(before, i)))),
            F.array(F.element_at(before, -1)),
        )))

    return let(values, lambda v: summed(v, F.ceil(F.sqrt(F.size(v) + 1)).cast("int")))
