"""MinHash near-dedup by min-max hashing.

A document's set is that of its distinct shingles of ``n`` words. Under each permutation
both the minimum and the maximum are kept, so half as many permutations are evaluated for
a signature of the same length, and each value agrees between two sets with probability
equal to their Jaccard similarity. Signatures are cut into bands; documents that share a
band are candidates, and a link needs similarity >= ``percent`` % on the full sets.

Equal word sequences form a class first, so copies cost one row each and no pair. Within
a band's bucket not all pairs are emitted: members are compared with two centres, links
are joined to components, and only pairs of members that are still in different
components are compared then, found by inverted lists of their rare shingles or, where
these can't decide, by bucket and an exact bound. A pair left out is in one component
already or below the limit, so the components are those of all candidate pairs. With 32 bands of 5 values a pair at
similarity 0.8 is missed with probability 3e-6, at 0.9 with 1e-12.

Sets are compared as sorted arrays of 64-bit shingle hashes. Texts are read in two scans,
without shuffle for the signatures, shuffled once by id for the sets of candidates.

Defined cases: null or empty text has an empty set and links with nothing; fewer words
than a shingle make one shingle of the whole sequence; a null id belongs to no component
(null) and is kept; rows with one id are one document, whose text is that of the smallest
hash if there are several, and share its fate; ties go to the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, slim, small_batches

BANDS, ROWS, SEED = 32, 5, 20_011
#: Documents with a shingle that still counts as rare among open documents.
RARE = 24
#: Links between components to broadcast at most, two ids each; more are joined by a shuffle.
BRIDGES = 100_000
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_TO_SPACE = bytes(32 if b in _SPACE else b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_hashes(text: str | None) -> tuple[np.ndarray, bytes]:
    """Hashes of the lower-cased words, and the canonical word sequence."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, found), np.uint64, len(found)), b" ".join(found)


def shingle_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all shingles, with repeats; the whole sequence as one if it is shorter."""
    if not len(w):
        return w
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * _P + w[i : len(w) - k + 1 + i]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, count, np.uint64), rng.integers(0, 2**64, count, np.uint64) | np.uint64(1)


def min_max_signature(shingles: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side."""
    low = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(masks), np.uint64)
    for at in range(0, len(shingles), 4096):  # a slice stays in the cache
        part = shingles[at : at + 4096]
        for k, (m, f) in enumerate(zip(masks, factors, strict=True)):
            x = (part ^ m) * f
            low[k] = min(low[k], x.min())
            high[k] = max(high[k], x.max())
    return np.stack([low, high], 1).ravel()


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks, factors = _permutations(-(-bands * rows // 2))
        for pdf in batches:
            out = []
            for i, text in zip(pdf["_id"], pdf["_text"], strict=True):
                w, canon = word_hashes(text)
                s = shingle_hashes(w, n)
                if not len(s):
                    out.append((i, None, 0, None))
                    continue
                sig = min_max_signature(s, masks, factors)[: bands * rows]
                keys = [xxhash.xxh3_64_intdigest(b.tobytes(), seed=k) - 2**63 for k, b in enumerate(sig.reshape(bands, rows))]
                out.append((i, xxhash.xxh3_128_digest(canon), len(np.unique(s)), keys))
            yield pd.DataFrame(out, columns=["_id", "key", "n_shingles", "bands"])

    return run


def _sets(n: int):
    """Sets of shingle hashes; of a document with several texts, that of the text whose key is its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for i, text, own in zip(pdf["_id"], pdf["_text"], pdf["own"], strict=True):
                w, canon = word_hashes(text)
                if own is None or xxhash.xxh3_128_digest(canon) == own:
                    made.append((i, np.unique(shingle_hashes(w, n)).tobytes()))
            yield pd.DataFrame(made, columns=["_id", "s"])

    return run


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        h = [np.frombuffer(x, np.int64) for x in pdf["s"]]
        if h:
            yield pd.DataFrame({"_id": np.repeat(pdf["_id"].to_numpy(), [len(x) for x in h]), "h": np.concatenate(h)})


def _overlaps(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shared, good = [], []
            last, kept = None, None
            for a, x, y in zip(pdf["a"], pdf["sa"], pdf["sb"], strict=True):
                if last != a:
                    last, kept = a, np.frombuffer(x, np.uint64)
                other = np.frombuffer(y, np.uint64)
                at = np.searchsorted(kept, other)
                at[at == len(kept)] = 0
                both = int((kept[at] == other).sum())
                shared.append(both)
                good.append(100 * both >= percent * (len(kept) + len(other) - both))
            yield pdf[["a", "b"]].assign(both=np.array(shared, np.int64), linked=np.array(good, bool))

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b with what their sets share. ``a`` may be in many pairs (a bucket's centre): its
    set is attached last, where its pairs lie together, and is not shuffled once per pair."""
    joined = pairs.join(sets.select(F.col("_id").alias("b"), F.col("s").alias("sb")), "b").join(
        sets.select(F.col("_id").alias("a"), F.col("s").alias("sa")), "a"
    )
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "sa", "sb").mapInPandas(_overlaps(percent), f"a {kind}, b {kind}, both long, linked boolean")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id``, n_shingles, component_id and kept."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    body = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    signed = cut(body.mapInPandas(_signatures(n, bands, rows), f"_id {kind}, key binary, n_shingles long, bands array<long>"))
    whole = signed.where("_id is not null and key is not null")
    # of several texts with one id that of the smallest key is the document's own; the others follow it
    ways = signed.where("_id is not null").groupBy("_id").agg(F.min("key").alias("own"), F.max("key").alias("last"), (F.count(F.lit(1)) - F.count("key")).alias("bare"))
    torn = cut(ways.where("own <> last or bare > 0 and own is not null").select("_id", "own"))
    whole_ids = torn.isEmpty()
    own = whole if whole_ids else whole.join(torn, "_id", "left").where("own is null or key = own")
    classes = cut(own.groupBy("key").agg(F.min(F.struct("_id", "n_shingles", "bands")).alias("r")).select("key", "r.*"))
    members = classes.select(F.col("_id").alias("id"), "n_shingles", F.posexplode("bands").alias("k", "v")).select(
        "id", "n_shingles", "k", F.xxhash64("k", "v").alias("bucket")
    )
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(members.join(shared, "bucket"))
    many = members.count()  # no table of members, documents or buckets below has more rows
    few = lambda df: slim(df, many)
    members = few(members)
    # two centres of a bucket: the smallest id, and the one that shares most buckets with
    # others, which among edited copies of a text is the text or close to it
    spread = few(members.groupBy("id").agg(F.sum("size").alias("spread")))
    facts = F.struct("id", F.col("n_shingles").alias("m"))
    centres = few(members.join(spread, "id")).groupBy("bucket").agg(
        F.min(facts).alias("c0"), F.max_by(facts, F.struct("spread", F.xxhash64("id"), "id")).alias("c1")
    )
    centres = few(cut(few(centres)))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    spokes = few(members.join(centres, "bucket")).select("id", "n_shingles", F.explode(F.array("c0", "c1")).alias("c")).where(
        (F.col("id") != F.col("c.id")) & fits(F.col("n_shingles"), F.col("c.m"))
    )
    spokes = spokes.groupBy(*ordered(F.col("id"), F.col("c.id"))).agg(F.min("c.id").alias("c"))
    spokes = few(cut(few(spokes)))
    stars = spokes.select("a", "b")
    by_centre = spokes.select(F.col("c").alias("a"), F.when(F.col("a") == F.col("c"), F.col("b")).otherwise(F.col("a")).alias("b"))
    ids = few(members.select(F.col("id").alias("_id")).distinct())
    texts = body.join(ids, "_id", "left_semi")
    if whole_ids:
        texts = texts.dropDuplicates(["_id"]).withColumn("own", F.lit(None).cast("binary"))
        sets = texts.mapInPandas(_sets(n), f"_id {kind}, s binary")
    else:
        sets = texts.join(torn, "_id", "left").mapInPandas(_sets(n), f"_id {kind}, s binary").dropDuplicates(["_id"])
    sets = few(cut(few(sets)))
    compared = few(cut(few(_compared(by_centre, sets, percent))))
    edges = compared.where("linked").select("a", "b")
    comps = few(cut(few(components(edges))))
    placed = few(members.select("id", "n_shingles", "k", "bucket").join(comps, "id", "left")).select(
        "id", "n_shingles", "k", "bucket", F.coalesce("component_id", "id").alias("comp")
    )
    placed = few(cut(placed))
    # what is left: members of one bucket in different components
    parted = few(placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket"))
    open_ = few(cut(few(placed.join(parted, "bucket"))))
    # Ordered by frequency among open documents, the first p = n - ceil(t n) + 1 shingles of
    # two similar sets have one in common. If it is rare, the inverted lists of rare shingles
    # find the pair; lists have RARE entries at most. Else all rare shingles of both stand
    # before it and, with c shingles left of n, a pair without a common rare one has at most
    # similarity min(c, c') / (n + m - min(c, c')). A second bound on what they share comes
    # from the bucket's second centre b: of b's shingles min(o, o') at most, o being the
    # overlap with b; of others, all frequent, min(f, f') at most, f being c less the
    # frequent part of o, which is o less b's rare shingles at least.
    facts = few(open_.select(F.col("id").alias("_id"), "n_shingles", "comp").distinct())
    flat = sets.join(facts.select("_id"), "_id").mapInPandas(_exploded, f"_id {kind}, h long")
    by_h = flat.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("_id").alias("lo")).where(F.col("df") <= RARE)
    private = by_h.where("df = 1").groupBy(F.col("lo").alias("_id")).agg(F.count(F.lit(1)).alias("alone"))
    facts = few(facts.join(few(private), "_id", "left")).withColumn("alone", F.coalesce("alone", F.lit(0)))
    # private shingles come first in the order and meet nothing: they are only counted
    rare = cut(flat.join(by_h.where("df > 1").select("h", "df"), "h"))
    shared_rare = few(rare.groupBy("_id").agg(F.count(F.lit(1)).alias("u")))
    facts = few(cut(few(facts.join(shared_rare, "_id", "left").withColumn("u", F.coalesce("u", F.lit(0)) + F.col("alone")))))
    open_ = few(open_.join(facts.select(F.col("_id").alias("id"), "u"), "id")).withColumn("c", F.col("n_shingles") - F.col("u")).drop("u")
    base = centres.select("bucket", F.col("c1.id").alias("b0"), F.col("c1.m").alias("m0"))
    base = few(base.join(facts.select(F.col("_id").alias("b0"), F.col("u").alias("u0")), "b0"))
    overlap = compared.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "both")
    open_ = (
        few(open_.join(base, "bucket", "left"))
        .join(overlap, (F.least("id", "b0") == F.col("x")) & (F.greatest("id", "b0") == F.col("y")), "left")
        .withColumn("o", F.when(F.col("id") == F.col("b0"), F.col("n_shingles")).otherwise(F.col("both")))
        .withColumn("f", F.coalesce(F.col("c") - F.greatest(F.col("o") - F.col("u0"), F.lit(0)), "c"))
        .withColumn("o", F.coalesce("o", F.least("n_shingles", "m0"), "n_shingles"))
        .drop("b0", "m0", "u0", "x", "y", "both")
    )
    place = F.row_number().over(Window.partitionBy("_id").orderBy("df", "h")) + F.col("alone")
    first = rare.join(facts, "_id").withColumn("at", place).where(
        F.col("at") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100.0) + 1
    )
    listed = first.select("h", F.col("_id").alias("id"), "comp", "n_shingles")
    met = (
        listed.join(listed.select("h", F.col("id").alias("id2"), F.col("comp").alias("comp2"), F.col("n_shingles").alias("m2")), "h")
        .where((F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2")) & fits(F.col("n_shingles"), F.col("m2")))
        .select(*ordered(F.col("id"), F.col("id2")))
    )
    reach = lambda c, n, m: 100 * c >= percent * (n + m - c)
    open_ = few(open_)
    least = few(open_.groupBy("bucket").agg(F.min("n_shingles").alias("least")))
    open_ = few(cut(open_.join(least, "bucket").where(reach(F.col("c"), F.col("n_shingles"), F.greatest("least", "c"))).drop("least")))
    # a pair counts in the first of its common bands alone
    open_ = few(cut(few(open_.join(classes.select(F.col("_id").alias("id"), "bands"), "id"))))
    most = lambda c, o, f: F.least(F.least("c", c), F.least("o", o) + F.least("f", f))
    others = few(open_.groupBy("bucket", F.col("comp").alias("other")).agg(
        F.max("c").alias("c_"), F.max("o").alias("o_"), F.max("f").alias("f_"), F.min("n_shingles").alias("n_")
    ))
    mine = (
        open_.join(others, "bucket")
        .where((F.col("comp") < F.col("other")) & reach(most("c_", "o_", "f_"), F.col("n_shingles"), F.col("n_")))
        .drop("c_", "o_", "f_", "n_")
    )
    renamed = {"comp": "other", "id": "id2", "n_shingles": "m2", "c": "c2", "o": "o2", "f": "f2", "bands": "bands2"}
    theirs = open_.select("bucket", *[F.col(c).alias(d) for c, d in renamed.items()])
    first_common = F.array_position(F.zip_with("bands", "bands2", lambda x, y: x == y), True) == F.col("k") + 1
    cross = (
        mine.join(theirs, ["bucket", "other"])
        .where(reach(most("c2", "o2", "f2"), F.col("n_shingles"), F.col("m2")) & first_common)
        .select(*ordered(F.col("id"), F.col("id2")))
        .unionByName(met)
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    more = few(cut(few(_compared(cross, sets, percent).where("linked").select("a", "b"))))
    if not more.isEmpty():
        # links between components: few, whatever the documents
        name = lambda c: comps.select(F.col("id").alias(c), F.col("component_id").alias(f"of_{c}"))
        ends = few(few(more.join(name("a"), "a", "left")).join(name("b"), "b", "left"))
        ends = few(cut(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct()))
        bridged = few(cut(few(components(ends).select(F.col("id").alias("was"), F.col("component_id").alias("now")))))
        hint = F.broadcast(bridged) if bridged.count() <= BRIDGES else bridged
        merged = few(comps.join(hint, F.col("component_id") == F.col("was"), "left")).select("id", F.coalesce("now", "component_id").alias("component_id"))
        # a bridge's end that was in no component before
        alone = bridged.join(comps, F.col("was") == F.col("id"), "left_anti").select(F.col("was").alias("id"), F.col("now").alias("component_id"))
        comps = few(cut(few(merged.unionByName(alone))))
    groups = classes.select("key", F.col("_id").alias("id")).join(comps, "id", "left").select(
        "key", F.coalesce("component_id", "id").alias("component_id")
    )
    rows_of = signed.select("_id", "key", "n_shingles")
    if not whole_ids:
        rows_of = rows_of.join(torn, "_id", "left").select("_id", F.coalesce("own", "key").alias("key"), "n_shingles")
    return (
        rows_of.join(cut(groups), "key", "left")
        .select(
            F.col("_id").alias(doc_id),
            "n_shingles",
            F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))
    )
