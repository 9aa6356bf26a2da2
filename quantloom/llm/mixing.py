"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks. Block j of a
source with weight w (weights as exact fractions that sum to 1, never rounded to parts of
a period) is released at floor(j / w) and due at ceil((j + 1) / w); at every slot the
released block with the earliest deadline runs. On one processor this order meets every
deadline, so after any slot a source has had less than one block more or less than its
weight times the slots. When a source has run out, the others start anew with their
weights brought to the sum 1: no slot stays empty, no document is dropped or repeated, and
between two such points the deviation is less than one block.

The schedule is made once, on the driver. Its length is bounded: a block has
``block_rows`` rows, and more where the table has over ``max_slots`` such blocks, so the
driver holds ``max_slots`` slots and one more per source at most, whatever the data. A
table with more than ``max_sources`` sources is refused by an error. A document's slot
follows from its rank within its source; ranks come from counts per hash bucket and a
window inside a bucket, so no task orders a whole source.

Defined cases: a null source is a source of its own (weights name it None); sources whose
weight is zero, negative, not finite or missing get no slot while a weighted source has
blocks left, and are then mixed in proportion to their sizes; documents with one id (or
none) are told apart by their other columns, and rows equal in all columns take a rank
each, which is which making no difference; an empty table gives an empty result. Extra
columns pass through whatever their names, but mix_block, mix_slot and mix_row are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh

#: A longer schedule is joined by a shuffle instead of a broadcast.
BROADCAST_SLOTS = 50_000


def exact_weights(weights: Iterable[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights; 0 for what is no positive number."""
    parts = [Fraction(w) if w is not None and math.isfinite(w) and w > 0 else Fraction(0) for w in weights]
    scale = math.lcm(*(p.denominator for p in parts)) if parts else 1
    return [int(p * scale) for p in parts]


def pfair_slots(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """Source and number of the block of each slot, until a weighted source has run out.

    Integers only: with A the sum of the weights a, block j is released at floor(j A / a)
    and due at ceil((j + 1) A / a).
    """
    total = sum(weights)
    waiting = [(0, k, 0) for k, a in enumerate(weights) if a and blocks[k]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[k]), k, j))
        due, k, j = heapq.heappop(ready)
        assert due > slot
        yield k, j
        if j + 1 == blocks[k]:
            return
        heapq.heappush(waiting, ((j + 1) * total // weights[k], k, j + 1))
        slot += 1


def schedule(weights: list[float], blocks: list[int]) -> list[tuple[int, int]]:
    """Source and number of the block of every slot until all blocks have run.

    In rounds: each ends when a source has run out, and the next is made for the others.
    """
    exact, left, done = exact_weights(weights), list(blocks), [0] * len(blocks)
    out: list[tuple[int, int]] = []
    while any(left):
        now = [a if n else 0 for a, n in zip(exact, left, strict=True)]
        if not any(now):
            now = left  # what has no weight: in proportion to what is left
        start = list(done)
        for k, j in pfair_slots(list(now), left):
            out.append((k, start[k] + j))
            done[k] += 1
        left = [n - (d - s) for n, d, s in zip(left, done, start, strict=True)]
    return out


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    source: str = "source",
    doc_id: str = "doc_id",
    block_rows: int = 16,
    max_slots: int = 200_000,
    max_sources: int = 10_000,
    temperature: float = 0.5,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """``docs`` with mix_block (number of the block in its source), mix_slot and mix_row (place in the block).

    Ordered by mix_slot and mix_row the documents are mixed. Without weights a source's
    target is its number of documents to the power ``temperature``.
    """
    docs = docs.select([f"`{c}`" for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_row")])
    h, b, r, s, of, off, at = fresh(docs, "h", "b", "r", "s", "of", "off", "at")
    counts = [(x[0], x[1]) for x in docs.groupBy(source).count().limit(max_sources + 1).collect()]  # one row per source
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources: mix groups of them")
    counts.sort(key=lambda x: (x[0] is None, str(x[0])))
    rows = sum(n for _, n in counts)
    block_rows = max(block_rows, -(-rows // max_slots))
    targets = [(weights or {}).get(x, 0.0) if weights else n**temperature for x, n in counts]
    plan = schedule(targets, [-(-n // block_rows) for _, n in counts])
    spark = docs.sparkSession
    kind = docs.schema[source].dataType
    numbered = spark.createDataFrame(
        [(x, k) for k, (x, _) in enumerate(counts)], T.StructType([T.StructField(s, kind), T.StructField("_k", T.IntegerType())])
    )
    frame = pd.DataFrame(plan, columns=["_k", "_j"]).astype({"_k": "int32", "_j": "int64"})
    slots = spark.createDataFrame(frame.assign(_slot=range(len(plan))), "_k int, _j long, _slot long")
    hint = lambda d: F.broadcast(d) if len(plan) <= BROADCAST_SLOTS else d
    by_source = hint(slots.join(F.broadcast(numbered), "_k").select(s, F.col("_j").alias(at), F.col("_slot").alias("mix_slot")))
    # all columns that hash: rows of one id, or of none, go to different buckets if they differ
    mixed = [F.col(f"`{f.name}`") for f in docs.schema if f.name != doc_id and not isinstance(f.dataType, T.MapType | T.VariantType)]
    buckets = max(64, -(-rows // bucket_rows))
    keyed = docs.withColumn(h, F.xxhash64(F.col(doc_id), *mixed)).withColumn(b, F.pmod(h, F.lit(buckets)))
    per = keyed.groupBy(F.col(source).alias(s), F.col(b).alias(of)).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(s).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(per.select(s, of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(off)))
    inside = Window.partitionBy(source, b).orderBy(h, doc_id)
    ranked = keyed.withColumn(r, F.row_number().over(inside))
    same = F.col(source).eqNullSafe(F.col(s))
    rank = F.col(off) + F.col(r) - 1
    blocked = (
        ranked.join(offsets, same & (F.col(b) == F.col(of)))
        .drop(s)
        .withColumn("mix_block", F.floor(rank / block_rows).cast("long"))
        .withColumn("mix_row", (rank % block_rows).cast("int"))
    )
    out = blocked.join(by_source, same & (F.col("mix_block") == F.col(at)))
    return out.select(*[f"`{c}`" for c in docs.columns], "mix_block", "mix_slot", "mix_row")
