"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams (``orders``) of the lower-cased text, by a
64-bit hash folded to ``2 ** bits`` buckets. Candidates are the buckets that at least
``min_share`` of the toxic training rows hold; each is scaled by its log-count ratio
r = ln((p + a) / (P + 2a)) - ln((n + a) / (N + 2a)) of documents with it, and the
``features`` of the largest absolute z-score of the two shares enter a logistic
regression with an L2 penalty. Whole texts are scored.

Training uses at most ``max_rows`` labelled rows, those of the smallest hash of the id
(documented bound; labels of all others are not needed). Texts stay on the executors:
the driver sees counts per bucket and the selected features of training rows.

Defined cases: null text scores as empty text; rows without an id get a score, too;
labels that are null are left out, of several labels for one id the largest counts; with
no toxic (or no other) training row the score is the share of toxic rows, 0.5 with no
row at all; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

ORDERS, BITS = (3, 4, 5, 6), 22
_P, _K = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Buckets of all character n-grams of a text, with repeats."""
    raw = (" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, np.uint32).astype(np.uint64)
    h, out = c, []
    for n in range(2, max(orders) + 1):
        if len(c) < n:
            break
        h = h[:-1] * _P + c[n - 1 :]
        if n in orders:
            x = (h ^ np.uint64(n)) * _K
            out.append(((x ^ (x >> np.uint64(32))) * _K) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Classifier:
    """Selected buckets (ascending), their weights (with the ratios multiplied in) and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.int32)
        out[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return out

    def score(self, text: str | None, table: np.ndarray) -> float:
        hit = table[grams(text)]
        z = self.bias + self.weights[np.unique(hit[hit > 0]) - 1].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _bucket_counts(wanted: np.ndarray | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BITS, np.int32)
        for pdf in batches:
            for text in pdf["text"]:
                total[np.unique(grams(text))] += 1
        at = np.flatnonzero(total) if wanted is None else wanted[total[wanted] > 0]
        yield pd.DataFrame({"bucket": at, "n": total[at].astype(np.int64)})

    return run


def _rows(table: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [table[grams(t)] for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "at": [(np.unique(x[x > 0]) - 1).astype(np.int32).tobytes() for x in found]})

    return run


def _logistic(at: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio, by accelerated gradient steps."""
    k, n = len(ratios), len(y)
    blocks = []  # rows in blocks: what is computed per entry lives for one block only
    for low in range(0, n, 512):
        part = at[low : low + 512]
        blocks.append((slice(low, low + len(part)), np.concatenate(part), np.array([len(a) for a in part])))

    def ahead(v: np.ndarray) -> np.ndarray:
        xv = ratios * v
        return np.concatenate([np.bincount(np.repeat(np.arange(len(m)), m), xv[flat], len(m)) for _, flat, m in blocks])

    def back(e: np.ndarray) -> np.ndarray:
        out = np.zeros(k)
        for rows, flat, m in blocks:
            out += np.bincount(flat, np.repeat(e[rows], m), k)
        return out * ratios

    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    # Lipschitz constant of the gradient by power iteration
    v = np.ones(k) / np.sqrt(k)
    for _ in range(12):
        u = back(ahead(v))
        size = np.linalg.norm(u) or 1.0
        v = u / size
    step = 1 / (0.25 * 1.1 * (size + n) / n + penalty)
    wy, by, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(by + ahead(wy))))
        e = (p - y) / n
        w2, b2 = wy - step * (back(e) + penalty * wy), by - step * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = 20_000,
    min_share: float = 0.003,
    features: int = 20_000,
    alpha: float = 1.0,
    penalty: float = 1e-4,
    rounds: int = 400,
) -> Classifier:
    """Fit on labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    sample = cut(
        docs.join(F.broadcast(known), docs[doc_id] == F.col("_id")).select(F.coalesce(F.col(text), F.lit("")).alias("text"), "y")
    )
    totals = {r["y"] > 0: r["count"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).count().collect()}
    pos, neg = totals.get(True, 0), totals.get(False, 0)
    if not pos or not neg:
        share = 0.5 if not pos + neg else min(max(pos / (pos + neg), 1e-6), 1 - 1e-6)
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    count = lambda rows, wanted: rows.select("text").mapInPandas(_bucket_counts(wanted), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    least = max(3, int(np.ceil(min_share * pos)))
    of_pos = count(sample.where("y > 0"), None).where(F.col("n") >= least).toPandas().sort_values("bucket")
    wanted = of_pos["bucket"].to_numpy()
    of_neg = count(sample.where("y = 0"), wanted).toPandas()
    p = of_pos["n"].to_numpy().astype(float)
    n = np.zeros(len(wanted))
    n[np.searchsorted(wanted, of_neg["bucket"])] = of_neg["n"]
    both = (p + n) / (pos + neg)
    z = np.abs(p / pos - n / neg) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / pos + 1 / neg))
    best = np.sort(np.argsort(-z, kind="stable")[:features])
    buckets, p, n = wanted[best], p[best], n[best]
    ratios = np.log((p + alpha) / (pos + 2 * alpha)) - np.log((n + alpha) / (neg + 2 * alpha))
    empty = Classifier(buckets, ratios, 0.0)
    rows = sample.mapInPandas(_rows(empty.table()), "y int, at binary").toPandas()
    at = [np.frombuffer(x, np.int32) for x in rows["at"]]
    w, bias = _logistic(at, (rows["y"].to_numpy() > 0).astype(float), ratios, penalty, rounds)
    return Classifier(buckets, w * ratios, bias)


def score(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, held_out, score and predicted."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = model.table()
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "score": [model.score(t, table) for t in pdf["t"]]})

    scored = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(run, f"i {kind}, score double")
    return scored.select(
        F.col("i").alias(doc_id), held_out(F.col("i")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
