"""Embedding near-dedup by the epsilon grid order join.

Vectors of unit length have cosine >= t where their distance is at most
eps = sqrt(2 - 2 t). They are rotated to their principal axes (exact second moments over
all vectors), put into cells of side eps on the leading ``axes`` dimensions, sorted by
cell (the epsilon grid order) and cut into blocks, intervals of the sequence. Intervals
are joined recursively, from whole ranges down: a pair of intervals whose bounding boxes
on the leading dimensions are further apart than eps is skipped with all that it holds.
The upper levels are joins of small interval tables, the lower ones run inside a task on
two blocks, whose size is fixed. Products are taken in single precision first; those near
the threshold are taken again in double, and a link needs cosine >= t in double precision.

Equal vectors form a class first and cost one row. A task returns, per vector, the number
of its links and a spanning forest of them, never the pairs.

In many dimensions without cluster structure boxes overlap and few pairs can be proven
distant; the work is then that of all block pairs, each with a fixed need of memory.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths are not compared; a null id links with
nothing and has no component; rows with equal ids count one by one; ties go to the
smallest id; an empty table gives an empty result; labels and extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut

FANOUT = 8
#: A block's vectors take so much at most; a task holds two blocks and their products.
BLOCK_BYTES = 32 << 20


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for d, part in pdf.groupby("d"):
            x = np.stack(part["v"].to_numpy())
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"d": d, "i": i, "j": j, "s": m[i, j]})


def _placed(axes: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = [np.asarray(v) @ axes[d] for d, v in zip(pdf["d"], pdf["v"], strict=True)]
            yield pd.DataFrame(
                {
                    "id": pdf["id"], "n": pdf["n"], "d": pdf["d"],
                    "cell": [np.floor(a / eps).astype(np.int32) for a in y],
                    "v": [np.asarray(v, np.float64).tobytes() for v in pdf["v"]],
                }
            )

    return run


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, at = TaskContext.get().partitionId(), 0
    for pdf in batches:
        yield pdf.assign(part=part, at=np.arange(at, at + len(pdf), dtype=np.int64))
        at += len(pdf)


def _far(lo1, hi1, lo2, hi2, eps2: float) -> bool:
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float(gap @ gap) > eps2


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the links a-b among positions 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    leaf = np.flatnonzero(label != np.arange(n))
    return leaf, label[leaf]


def join_blocks(x, wx, yx, z, wz, yz, t: float, same: bool, leaf: int = 512):
    """Links between two blocks in grid order: weighted counts of both, and star edges over
    positions (those of the second block follow the first's). Recursive on halves."""
    eps2 = 2 - 2 * t + 1e-9
    nx, nz = len(x), len(z)
    cx, cz = np.zeros(nx, np.int64), np.zeros(nz, np.int64)
    xs, zs = x.astype(np.float32), z.astype(np.float32)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, nx, 0, nz)]
    while stack:
        i, j, k, m = stack.pop()
        if same and k >= j and not (i < m):
            continue
        if same and i > k:
            continue  # the mirrored interval pair is on the stack as well
        if _far(yx[i:j].min(0), yx[i:j].max(0), yz[k:m].min(0), yz[k:m].max(0), eps2):
            continue
        if j - i > leaf or m - k > leaf:
            h, g = (i + j) // 2 if j - i > leaf else j, (k + m) // 2 if m - k > leaf else m
            parts = [(i, h, k, g), (h, j, k, g), (i, h, g, m), (h, j, g, m)]
            stack.extend(p for p in parts if p[0] < p[1] and p[2] < p[3])
            continue
        prod = xs[i:j] @ zs[k:m].T
        a, b = np.nonzero(prod >= t - 1e-4)
        if same and i == k:
            up = a < b
            a, b = a[up], b[up]
        if not len(a):
            continue
        near = np.flatnonzero(prod[a, b] < t + 1e-4)
        keep = np.ones(len(a), bool)
        keep[near] = np.einsum("ij,ij->i", x[i + a[near]], z[k + b[near]]) >= t
        a, b = a[keep] + i, b[keep] + k
        np.add.at(cx, a, wz[b])
        np.add.at(cz, b, wx[a])
        ends.append(_stars(a, b + (0 if same else nx), nx if same else nx + nz))
    if not ends:
        return cx, cz, np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    return cx, cz, *_stars(a, b, nx if same else nx + nz)


def _joined(t: float, basis: np.ndarray):
    def unpack(row, s):
        ids = np.array(row["id" + s])
        v = np.frombuffer(row["v" + s], np.float64).reshape(len(ids), -1)
        return ids, np.array(row["n" + s], np.int64), v, v @ basis

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                same = row["ba"] == row["bb"]
                ia, wa, va, ya = unpack(row, "a")
                ib, wb, vb, yb = (ia, wa, va, ya) if same else unpack(row, "b")
                ca, cb, e, f = join_blocks(va, wa, ya, vb, wb, yb, t, same)
                ids = ia if same else np.concatenate([ia, ib])
                counts = ca + cb if same else np.concatenate([ca, cb])
                root = np.arange(len(ids))
                root[e] = f
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"id": ids[at], "n": counts[at], "root": ids[root[at]]})

    return run


def _packed(kind: str, bases: dict[int, np.ndarray]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", kind="stable")
        d = int(pdf["d"].iloc[0])
        v = b"".join(pdf["v"])
        y = np.frombuffer(v, np.float64).reshape(len(pdf), d) @ bases[d]
        return pd.DataFrame(
            {"block": [pdf["block"].iloc[0]], "id": [pdf["id"].tolist()], "n": [pdf["n"].tolist()], "v": [v], "lo": [y.min(0).tolist()], "hi": [y.max(0).tolist()]}
        )

    return run, f"block long, id array<{kind}>, n array<long>, v binary, lo array<double>, hi array<double>"


def rows_of_block(vectors: int, length: int, tasks: int) -> int:
    """Rows to a block: few blocks, since each travels to all it is joined with, but pairs of
    blocks enough for the tasks there are, and no block larger than ``BLOCK_BYTES``."""
    blocks = math.ceil(math.sqrt(8 * max(tasks, 1)))
    return max(64, min(-(-vectors // blocks), BLOCK_BYTES // (8 * length)))


def _interval_pairs(boxes: DataFrame, eps2: float) -> DataFrame:
    """Pairs of blocks (ba <= bb) whose boxes may hold a link, by recursion from the whole sequence down."""
    levels = [boxes]
    top = boxes.agg(F.max("block")).first()[0] or 0
    size = top + 1
    while size > 1:
        low = levels[-1]
        dims = len(low.schema) - 1
        ups = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(dims // 2)] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(dims // 2)]
        levels.append(cut(low.groupBy(F.floor(F.col("block") / FANOUT).cast("long").alias("block")).agg(*ups)))
        size = -(-size // FANOUT)
    pairs = levels[-1].select(F.col("block").alias("ba"), F.col("block").alias("bb"))
    for low in levels[-2::-1] if len(levels) > 1 else []:
        axes = (len(low.schema) - 1) // 2
        side = lambda s, low=low: low.select(*[F.col(c).alias(c + s) for c in low.columns], F.floor(F.col("block") / FANOUT).cast("long").alias("up" + s))
        gaps = [F.greatest(F.lit(0.0), F.col(f"lo{k}_a") - F.col(f"hi{k}_b"), F.col(f"lo{k}_b") - F.col(f"hi{k}_a")) for k in range(axes)]
        apart = sum((g * g for g in gaps), F.lit(0.0))
        pairs = (
            pairs.join(side("_a"), F.col("ba") == F.col("up_a")).join(side("_b"), F.col("bb") == F.col("up_b"))
            .where((F.col("block_a") <= F.col("block_b")) & (apart <= eps2))
            .select(F.col("block_a").alias("ba"), F.col("block_b").alias("bb"))
        )
    return pairs


def similar_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = 0.9,
    axes: int = 8,
    block_rows: int | None = None,
) -> DataFrame:
    """One row per vector: the id, n_links, component_id and kept.

    Blocks have ``block_rows`` rows, by default as many as ``rows_of_block`` says."""
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    eps = float(np.sqrt(max(2 - 2 * threshold, 0.0)))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = F.col("e")
    scale = F.aggregate(e, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    raw = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    sound = F.coalesce(F.col("id").isNotNull() & (F.size(e) > 0) & F.forall(e, finite) & (scale > 0), F.lit(False))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    raw = raw.withColumn("e", F.when(sound, F.transform(e, lambda x: x + F.lit(0.0))))
    raw = cut(raw.withColumn("h", F.when(F.col("e").isNotNull(), F.xxhash64("e"))))
    classes = cut(raw.where("e is not null").groupBy("h", "e").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    unit = classes.withColumn("s", scale).withColumn("v", F.transform("e", lambda x: x / F.col("s"))).withColumn(
        "l", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    ).select("id", "n", F.size("v").alias("d"), F.transform("v", lambda x: x / F.col("l")).alias("v"))
    bases: dict[int, np.ndarray] = {}
    moments = unit.select("d", "v").mapInPandas(_moments, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    for d, m in moments.groupby("d"):
        full = np.zeros((d, d))
        full[m["i"], m["j"]] = full[m["j"], m["i"]] = m["s"]
        basis = np.linalg.eigh(full)[1][:, ::-1][:, :axes]
        bases[int(d)] = np.pad(basis, ((0, 0), (0, axes - basis.shape[1])))
    placed = unit.mapInPandas(_placed(bases, eps), f"id {kind}, n long, d int, cell array<int>, v binary")
    ordered = placed.repartitionByRange("d", "cell", "id").sortWithinPartitions("d", "cell", "id")
    columns = f"id {kind}, n long, d int, cell array<int>, v binary"
    numbered = cut(ordered.mapInPandas(_numbered, f"{columns}, part int, at long").drop("cell"))
    # one row per partition, vectors of one length to a block
    sizes = numbered.groupBy("part", "d").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("from"))
    sizes = cut(sizes)
    before = sizes.withColumn("off", F.sum("m").over(Window.partitionBy("d").orderBy("part")) - F.col("m") - F.col("from"))
    g = (F.col("off") + F.col("at")).alias("g")
    of_length = {r["d"]: r["m"] for r in sizes.groupBy("d").agg(F.sum("m").alias("m")).collect()}  # one row per length, as above
    tasks = spark.sparkContext.defaultParallelism
    lengths = {d: k for k, d in enumerate(sorted(bases))}
    base, height = F.lit(0), F.lit(1)
    for d, k in lengths.items():
        base = F.when(F.col("d") == d, F.lit(k)).otherwise(base)
        height = F.when(F.col("d") == d, F.lit(block_rows or rows_of_block(of_length[d], d, tasks))).otherwise(height)
    stride = 1 << 40
    blocked = numbered.join(before.select("part", "d", "off"), ["part", "d"]).select(
        "id", "n", "d", "v", g, (base.cast("long") * stride + F.floor((F.col("off") + F.col("at")) / height)).cast("long").alias("block")
    )
    pack, schema = _packed(kind, bases)
    packed = cut(blocked.groupBy("block").applyInPandas(pack, schema))
    lo_hi = [F.get("lo", F.lit(k)).alias(f"lo{k}") for k in range(axes)] + [F.get("hi", F.lit(k)).alias(f"hi{k}") for k in range(axes)]
    found = None
    eps2 = eps * eps + 1e-9
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(batch)
    for d, k in lengths.items():
        own = packed.where(F.floor(F.col("block") / stride) == k)
        boxes = cut(own.select((F.col("block") % stride).alias("block"), *lo_hi))
        pairs = cut(_interval_pairs(boxes, eps2))
        side = lambda s, own=own: own.select((F.col("block") % stride).alias("b" + s), *[F.col(c).alias(c + s) for c in ("id", "n", "v")])
        work = pairs.join(side("a"), "ba").join(side("b"), "bb")
        spark.conf.set(batch, "1")  # a row holds two blocks
        try:
            part = cut(work.mapInPandas(_joined(threshold, bases[d]), f"id {kind}, n long, root {kind}"))
        finally:
            spark.conf.set(batch, rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"id {kind}, n long, root {kind}")
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    comps = components(found.select("id", "root"), "id", "root")
    of_class = cut(
        classes.join(links, "id", "left").join(comps, "id", "left").select(
            "h", F.col("e").alias("ce"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
    )
    out = raw.join(of_class, (raw["h"] == of_class["h"]) & (raw["e"] == of_class["ce"]), "left")
    return out.select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
