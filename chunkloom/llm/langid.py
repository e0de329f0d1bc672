"""Language identification by nearest centroids.

A text is the normalised TF-IDF vector of its hashed letter bigrams and trigrams (bytes of the lower-cased UTF-8 text,
runs of other characters count as one blank). Each language has several centroids, found by spherical k-means, so that
varieties of it (short texts, mixed ones, capitals) have one of their own. The nearest centroid by cosine names the
language; a text whose best cosine is below what nearly all training texts of that language have is marked as rejected.

Centroids come from a bounded sample: the most_langs languages with the most rows, of each at most train_rows, and in all at
most train_total, the first by the hash of their ids; every text is then compared whole in one pass without a shuffle.

Defined cases: null texts and texts without a letter get und with score 0; rows with a null language aren't learned from;
without any training row everything is und; ties go to the language first in the alphabet; texts of any length are counted
whole; repeated rows are judged one by one; other columns, whatever their names, are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import map_rows, narrow

BITS = 12
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LETTER[_LETTER == 0] = 32


def counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed bigrams and trigrams: a row for each text, 2**BITS columns."""
    out = []
    for i, j, raw, off in tv.chunks(pc.utf8_lower(column.cast(pa.string())), 1 << 18):
        n = j - i
        b = _LETTER[raw]
        blank = b == 32
        keep = np.ones(len(b), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
        begins = off[:-1][np.diff(off) > 0]
        keep[begins] = True
        b, row = b[keep].astype(np.uint32), row[keep]
        out.append(np.zeros((n, 1 << BITS), np.float32))
        for size in (2, 3):
            if len(b) < size:
                continue
            key = np.zeros(len(b) - size + 1, np.uint32)
            for k in range(size):
                key = key * np.uint32(0x01000193) + b[k : len(b) - size + 1 + k] + np.uint32(size)
            key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            inside = row[: len(key)] == row[size - 1 :]
            out[-1] += np.bincount((row[: len(key)][inside] << BITS) | key[inside], minlength=n << BITS).reshape(n, -1)
    return np.concatenate(out) if out else np.zeros((0, 1 << BITS), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass(frozen=True)
class Centroids:
    langs: tuple[str, ...]
    owner: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    #: Least cosine of each language, below which a text is rejected.
    least: np.ndarray

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best cosine for every language, a row for each text, and the best language's number."""
        sims = _unit(np.sqrt(tf) * self.idf) @ self.vectors.T
        best = np.stack([sims[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1)
        return best, best.argmax(axis=1)


def fit(tf: np.ndarray, langs: list[str], clusters: int = 4, reject_share: float = 0.002, rounds: int = 12) -> Centroids:
    names = tuple(sorted(set(langs)))
    y = np.array([names.index(x) for x in langs])
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 0.05
    x = _unit(np.sqrt(tf) * idf)
    rng = np.random.default_rng(5)
    owner, vectors = [], []
    for k in range(len(names)):
        own = x[y == k]
        c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
        for _ in range(rounds):
            near = (own @ c.T).argmax(axis=1)
            c = _unit(np.stack([own[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
        owner += [k] * len(c)
        vectors.append(c)
    model = Centroids(names, np.array(owner), np.concatenate(vectors).astype(np.float32), idf, np.zeros(len(names)))
    best, _ = model.nearest(tf)
    model.least[:] = [np.quantile(best[y == k, k], reject_share) for k in range(len(names))]
    return model


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = 600, clusters: int = 4, most_langs: int = 200, train_total: int = 12_000) -> Centroids | None:
    """Fit on at most train_rows rows of each language, train_total in all. The n-grams are counted on the executors."""
    rows = narrow(labelled.where(labelled[lang_col].isNotNull() & labelled[text_col].isNotNull()), id=id_col, lang=lang_col)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not sizes:
        return None
    rows = rows.where(F.col("lang").isin([r["lang"] for r in sizes]))
    train_rows = min(train_rows, max(1, train_total // len(sizes)))
    # Ids are ranked in two steps (within a piece of a language, then among the pieces' first) so that no task gets a whole language; texts follow by a join.
    piece = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(64))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("id"), "id"))
    first = rows.withColumn("piece", piece).withColumn("r", rank("lang", "piece")).where(f"r <= {train_rows}")
    chosen = first.withColumn("r", rank("lang")).where(f"r <= {train_rows}").select("id", "lang")
    texts = narrow(labelled.where(labelled[text_col].isNotNull()), id=id_col, lang=lang_col, text=text_col).join(F.broadcast(chosen.distinct()), ["id", "lang"], "left_semi").select("lang", "text")

    def make():
        def f(b: pa.RecordBatch):
            tf = counts(b.column(1))
            return {"lang": b.column(0), "tf": pa.array([r.tobytes() for r in tf], pa.binary())}

        return f

    got = map_rows(texts, make, "lang string, tf binary").toArrow()
    if not got.num_rows:
        return None
    tf = np.array([np.frombuffer(x, np.float32) for x in got["tf"].to_pylist()], dtype=np.float32).reshape(got.num_rows, -1)
    return fit(tf, got["lang"].to_pylist(), clusters)


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the cosine), margin over the next language, rejected, of every row."""

    def make():
        def f(b: pa.RecordBatch):
            parts = []
            for k in range(0, b.num_rows, 256):
                column = b.column(1).slice(k, 256)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if model is None:
                    parts.append((np.full(len(column), "und", object), np.zeros(len(column)), np.zeros(len(column)), letters))
                    continue
                best, who = model.nearest(counts(column))
                top = best[np.arange(len(who)), who]
                second = np.sort(best, axis=1)[:, -2] if best.shape[1] > 1 else np.zeros(len(who))
                lang = np.where(letters, np.array(model.langs, object)[who], "und")
                parts.append((lang, np.where(letters, np.clip(top, 0, 1), 0.0), np.where(letters, top - second, 0.0), ~letters | (top < model.least[who])))
            lang, top, margin, out = (np.concatenate(x) for x in zip(*parts, strict=True))
            return {"doc_id": b.column(0), "lang_pred": pa.array(lang, pa.string()), "score": top.astype(float), "margin": margin.astype(float), "rejected": out.astype(bool)}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(narrow(docs, doc_id=id_col, text=text_col), make, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")
