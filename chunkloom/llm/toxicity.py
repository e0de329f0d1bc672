"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and one-word skip-grams of the whole text. Learning visits one document
after another with a rate of its own for every coordinate; the L1 term keeps most weights at exactly zero, so what is sent
to the executors is the short list of the others.

The training rows are a bounded sample of the labelled ones (of either class the first by the hash of their ids); of their
features only those that enough training rows have are sent to the driver. Every text is then scored whole, in one pass
without a shuffle.

Defined cases: null and empty texts have no features and get the score of the intercept alone; labelled rows with a null
label are not learned from; of rows with the same id each is scored and learned from; labels of one id that differ are both
learned; without any label, or with one class only, features count for nothing but that (score 0.5 without labels); texts of
any length are learned and scored whole; other columns, whatever their names, are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Scratch, binaries, map_rows, narrow

BITS = 20


def features(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, one text after another, and each text's first (one more at the end)."""
    _, _, h, first = tv.words(raw, off, word_byte=tv.ALNUM)
    row = tv.row_of(first)
    shift = np.uint64(64 - bits)
    rows, keys = [row], [h >> shift]
    for n, step in ((2, 1), (2, 2)):
        grams = tv.chain(h, n, step)
        same = row[: len(grams)] == row[step:] if len(grams) else np.zeros(0, bool)
        rows.append(row[: len(grams)][same])
        keys.append(tv.mix(grams[same] + np.uint64(step)) >> shift)
    both = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(bits)) | np.concatenate(keys))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int32), np.searchsorted(both, np.arange(len(off), dtype=np.uint64) << np.uint64(bits))


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: the coordinates' learning rates; l1, l2: penalties (l1 in full from 5000 training rows on, below that in proportion); train_rows: most rows of toxic ones, twice as many of others; least_rows: training rows that a feature has to be in."""

    alpha: float = 0.4
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 6
    train_rows: int = 4000
    least_rows: int = 6

    def least(self, rows: int) -> int:
        """Of so many training rows, those that must have a feature."""
        return min(self.least_rows, max(1, rows // 50))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Intercept, and the coordinates with a weight other than zero with their weights."""
        size, l1 = 1 << BITS, self.l1 * min(1.0, len(rows) / 5000)
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        order = np.random.default_rng(11)
        often = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=size) >= self.least(len(rows))
        rows = [x[often[x]] for x in rows]
        for _ in range(self.epochs):
            for i in order.permutation(len(rows)):
                x = rows[i]
                zi, ni = z[x], n[x]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((self.beta + root) / self.alpha + self.l2))
                b = -z[size] / ((self.beta + np.sqrt(n[size])) / self.alpha)
                g = _sigmoid(b + w.sum()) - labels[i]
                z[x] += g - (np.sqrt(ni + g * g) - root) / self.alpha * w
                n[x] += g * g
                z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / self.alpha * b
                n[size] += g * g
        keep = np.flatnonzero(np.abs(z[:size]) > l1)
        w = (np.sign(z[keep]) * l1 - z[keep]) / ((self.beta + np.sqrt(n[keep])) / self.alpha + self.l2)
        return float(-z[size] / ((self.beta + np.sqrt(n[size])) / self.alpha)), keep.astype(np.int32), w.astype(np.float32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", ftrl: Ftrl = Ftrl()) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on the texts of at most train_rows toxic rows and twice as many others, the first by the hash of their ids.

    Only the chosen ids, whose number is bounded, are sent to all executors; the features are made there.
    """
    rows = narrow(labels, id=id_col, y=label_col)
    first = [rows.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(ftrl.train_rows * (2 - c)) for c in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]).distinct())

    def make():
        def f(b: pa.RecordBatch):
            out = [features(raw, off) for _, _, raw, off in tv.chunks(b.column(0))]
            return {"x": pa.array([r for v, first in out for r in binaries(v, first).to_pylist()], pa.binary()), "y": b.column(1)}

        return f

    scratch = Scratch()
    spark = docs.sparkSession
    rows = scratch(map_rows(narrow(docs, id=id_col, text=text_col).join(chosen, "id").select("text", F.col("y").cast("int").alias("y")), make, "x binary, y int"), "features")
    least = ftrl.least(rows.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            total += np.bincount(tv.text_buffer(b.column(0))[0].view(np.int32), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feature", "n"])

    often = rows.select("x").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("feature").toArrow()["feature"].to_numpy()
    use = np.zeros(1 << BITS, dtype=bool)
    use[often] = True
    shared = spark.sparkContext.broadcast(np.packbits(use))

    def some():
        use = np.unpackbits(shared.value).astype(bool)
        rank = np.cumsum(use, dtype=np.int64) - 1

        def f(b: pa.RecordBatch):
            raw, off = tv.text_buffer(b.column(0))
            x = raw.view(np.int32)
            has = use[x]
            x, first = rank[x[has]], np.concatenate([[0], np.cumsum(has)])[off // 4]
            # ascending numbers as differences: most are small, so few bytes are sent
            return {"x": pa.array([zlib.compress(np.diff(x[i:j], prepend=0).astype("<u4").tobytes(), 1) for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()), "y": b.column(1)}

        return f

    got = map_rows(rows, some, "x binary, y int").toArrow()
    shared.destroy()
    scratch.close()
    if not got.num_rows:
        return 0.0, np.zeros(0, np.int32), np.zeros(0, np.float32)
    often = np.flatnonzero(use).astype(np.int32)
    return ftrl.fit([often[np.cumsum(np.frombuffer(zlib.decompress(x), "<u4"), dtype=np.int64)] for x in got["x"].to_pylist()], got["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted, n_features and n_hits (features with a weight) of every row."""
    bias, at, weight = model

    def make():
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[at] = weight

        def f(b: pa.RecordBatch):
            scores, n, hits = [], [], []
            for _, _, raw, off in tv.chunks(b.column(1)):
                x, first = features(raw, off)
                w = dense[x]
                scores.append(_sigmoid(bias + tv.sums(w.astype(np.float64), first)))
                n.append(np.diff(first))
                hits.append(tv.sums((w != 0).astype(np.int64), first))
            s = np.concatenate(scores)
            return {"doc_id": b.column(0), "score": s, "predicted": (s >= 0.5).astype(np.int32), "n_features": np.concatenate(n), "n_hits": np.concatenate(hits)}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(narrow(docs, doc_id=id_col, text=text_col), make, f"doc_id {kind}, score double, predicted int, n_features long, n_hits long")
