"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of BLOCK words; windows of two sizes are made of neighbouring passages, so that short and long
items both fill a good part of one. Passages and benchmark items are TF-IDF vectors over the benchmark's words (other words can't contribute to a
similarity), with document frequencies counted over all texts. A singular value decomposition by subspace iteration, with the
Gram matrix of all passages summed and multiplied on the executors, gives a latent space in which every window of every text is compared
with every item by cosine. Above a low threshold a candidate is checked word by word: the longest common subsequence of the
item with stretches hardly longer than it, and for paraphrases, of which less is left, the item's answer too.

Beside the cosine an exact bound gives candidates: a leak misses few of an item's words, so of any more of them, here the
rarest, it has some within a stretch's length (Bound). Every leak by the rule above meets it, whatever the sizes of corpus
and benchmark; the cosine's threshold loses none.

The space is fitted on every passage of the corpus and all items. The pass that counts the words keeps the numbers of the
benchmark's words in each passage; from these the Gram matrix is summed in whole numbers, so that the order doesn't matter, and
the iteration, from random directions on, goes on until the space holds no more of it. All passages together weigh as many rows as
Retrieval.sample at most, lest the items have no part in the space of a large corpus: a weight, no choice of passages. The mean
weight of the words beyond the benchmark's is that of all their occurrences. Every window is then searched. Items have spaces in blocks of bounded size. A pass over the texts counts the words of up to
MANY_BLOCKS blocks, and one searches as many blocks as fit into Retrieval.memory, so that what is sent to the executors and
held by the driver is bounded whatever the size of the benchmark, and small benchmarks take two passes.

A benchmark without a column of answers counts the last fifth of an item's words, three at least, as its answer.

Defined cases: null and empty texts match nothing; items that are null or have no word are passed over; an item of fewer
than 5 words must occur as it stands; texts of any length are searched whole; a row that occurs twice, or another of the same
id, is reported once for each item; remove_contaminated judges every row by its own text, with null or repeated ids too; ids of
documents and items keep their types; empty tables give no rows; columns not named, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Scratch, batch_function, give_back, map_rows, narrow

BLOCK = 16
#: Windows are so many neighbouring passages, powers of two.
WINDOWS = (2, 4)
#: Words beyond the benchmark's that a task counts before it passes the counts on, for their mean weight, and rows of a batch of them.
OUTSIDE, OUTSIDE_ROWS = 1 << 19, 1 << 16
#: Blocks of items whose words are counted in one pass.
MANY_BLOCKS = 64
#: The Gram matrix is summed in multiples of this.
UNIT = 2.0**-24
#: Pairs of so many of the most common words are summed in a square, others as sorted lists of so many pairs.
COMMON, PAIRS = 2048, 1 << 22
#: The iteration ends when the space holds no more than this share more of the matrix than before.
SETTLED = 1e-3


@dataclass(frozen=True)
class Retrieval:
    """rank: latent dimensions at least, a block of more items has one for each; cosine: least cosine of a candidate, for an item
    of which the space holds less than the share held, less in proportion; copied: share of an item's words in order that is a copy;
    paraphrased: share that is one if the answer is there too; answer_share: share of the answer's words that must be; sample: rows as which all
    passages together count at most beside the items; none is left out."""

    rank: int = 160
    cosine: float = 0.18
    held: float = 0.74
    copied: float = 0.8
    paraphrased: float = 0.55
    answer_share: float = 0.6
    sample: int = 4096
    block_words: int = 30_000
    block_items: int = 1000
    #: Bytes of the tables with which one pass searches.
    memory: int = 128 << 20
    #: Words count by their idf to this power; items count in the decomposition with this weight.
    power: float = 1.5
    item_weight: float = 3.0

    def dimensions(self, items: int, words: int) -> int:
        return min(max(self.rank, items), words)

    def weights(self, df: np.ndarray, texts: int) -> np.ndarray:
        """Zero for a word in at least half of all texts."""
        return (np.maximum(0.0, np.log((texts - df + 0.5) / (df + 0.5))) ** self.power).astype(np.float32)


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tv.words(raw, np.array([0, len(raw)]), word_byte=tv.ALNUM)[2]


def lcs(pattern: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence, with a bit for each word of the pattern. pattern: word to its places."""
    full = (1 << size) - 1
    v = full
    for w in text:
        m = pattern.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Item:
    number: int
    words: np.ndarray
    answer: np.ndarray

    def __post_init__(self):
        self.where = places(self.words.tolist())
        self.answer_where = places(self.answer.tolist())
        self.set, self.counts = np.unique(self.words, return_counts=True)

    def sizes(self, how: Retrieval) -> tuple[int, int]:
        """Least length of a leak's subsequence, and words in a stretch."""
        n = len(self.words)
        return (n, n) if n < 5 else (math.ceil(how.paraphrased * n), int(1.3 * n) + 4)

    def check(self, region: np.ndarray, how: Retrieval) -> tuple[float, float, bool]:
        """Best share of the item's words in order within a stretch of the region, the answer's share there, and the verdict."""
        n = len(self.words)
        need, long = self.sizes(how)
        k = np.minimum(np.searchsorted(self.set, region), len(self.set) - 1)
        inside = self.set[k] == region
        # no subsequence is longer than what the two have in common in any order
        common = lambda a, b: int(np.minimum(np.bincount(k[a:b][inside[a:b]], minlength=len(self.set)), self.counts).sum())
        if common(0, len(region)) < need:
            return 0.0, 0.0, False
        total = np.concatenate([[0], np.cumsum(inside)])
        starts = np.arange(0, max(1, len(region) - long + 1))
        ends = np.minimum(starts + long, len(region))
        many = total[ends] - total[starts]
        best, answered, bad = 0, 0.0, False
        for i in np.argsort(-many, kind="stable"):
            # until a stretch passes, any with enough words may; then only better ones count
            least = max(need, best + (answered >= 1)) if bad else need
            if many[i] < least:
                break
            if common(starts[i], ends[i]) < least:
                continue
            text = region[starts[i] : ends[i]].tolist()
            got = lcs(self.where, n, text)
            if got < least:
                continue
            there = lcs(self.answer_where, len(self.answer), text) / len(self.answer)
            passes = got / n >= how.copied or there >= how.answer_share
            if (passes, got, there) > (bad, best, answered):
                best, answered, bad = got, there, passes
        return best / n, answered, bad


class Bound:
    """Stretches of texts that can hold a leak of an item, and all of those that do.

    A leak has at least need of an item's n words in a stretch of long words, so it misses n - need at most. Of the
    n - need + t rarest it has at least t: for every item the places of these words are sorted, and t of them in a row
    that are less than long words apart are a candidate.
    """

    def __init__(self, items: list[Item], vocab: np.ndarray, df: np.ndarray, how: Retrieval):
        words, self.few, self.long = [], np.empty(len(items), np.int64), np.empty(len(items), np.int64)
        for i, x in enumerate(items):
            n = len(x.words)
            need, self.long[i] = x.sizes(how)
            self.few[i] = t = n if need == n else max(1, n // 6)
            ids = np.searchsorted(vocab, x.words)
            words.append(np.unique(ids[np.argsort(df[ids], kind="stable")][: n - need + t]))
        self.word, self.item = np.concatenate(words), np.repeat(np.arange(len(items)), [len(x) for x in words])
        self.size = len(vocab)

    def regions(self, ids: np.ndarray, place: np.ndarray, first: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of the stretches, joined where they overlap. ids, place: vocabulary words of the texts and where they are; first: each text's first word."""
        order = np.argsort(ids, kind="stable")
        count = np.bincount(ids, minlength=self.size)
        begin = np.cumsum(count) - count
        many = count[self.word]
        # so many pairs of a place and an item at once, whole items
        part = np.cumsum(np.bincount(self.item, weights=many, minlength=len(self.few)))[self.item] // limit
        for p in np.unique(part[many > 0]):
            use = (part == p) & (many > 0)
            n, at = many[use], begin[self.word[use]]
            k = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = np.sort(np.repeat(self.item[use], n) * (int(first[-1]) + 1) + place[order[k]])
            item, pos = np.divmod(key, int(first[-1]) + 1)
            last = np.arange(len(key)) + self.few[item] - 1
            j = np.flatnonzero(last < len(key))
            j = j[item[last[j]] == item[j]]
            j = j[pos[last[j]] - pos[j] < self.long[item[j]]]
            text = np.searchsorted(first, pos[j], side="right") - 1
            ok = pos[last[j]] < first[text + 1]
            j, text = j[ok], text[ok]
            if not len(j):
                continue
            a = np.maximum(pos[last[j]] - self.long[item[j]] + 1, first[text])
            b = np.minimum(pos[j] + self.long[item[j]], first[text + 1])
            new = np.flatnonzero(np.concatenate([[True], (item[j][1:] != item[j][:-1]) | (text[1:] != text[:-1]) | (a[1:] > b[:-1])]))
            yield from zip(text[new].tolist(), item[j][new].tolist(), a[new].tolist(), b[np.append(new[1:], len(j)) - 1].tolist(), strict=True)


def _rows(matrix: np.ndarray, ids: np.ndarray, weight: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """Sums of the matrix' rows, weighted or not, for each group of ids; zeros for an empty group."""
    out = np.zeros((len(first) - 1, matrix.shape[1]), np.float32)
    has = np.diff(first) > 0
    if has.any():
        rows = matrix[ids]
        if weight is not None:
            rows *= weight[:, None]
        out[has] = np.add.reduceat(rows, first[:-1][has], axis=0)
    return out


def _unit_weights(ids: np.ndarray, first: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights with which each group of ids is a unit vector; a term that occurs twice has two entries of idf each."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key, back, c = np.unique(row.astype(np.int64) * len(idf) + ids, return_inverse=True, return_counts=True)
    square = np.bincount(key // len(idf), weights=(c * idf[key % len(idf)]) ** 2, minlength=len(first) - 1)
    return (idf[ids] / np.sqrt(np.maximum(square, 1e-12))[row]).astype(np.float32)


def _product(q: np.ndarray, ids: np.ndarray, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over all rows x of x (x q)."""
    y = _rows(q, ids, weight, first)
    out = np.zeros_like(q)
    order = np.argsort(ids, kind="stable")
    terms, begin = np.unique(ids[order], return_index=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[order]
    if len(terms):
        out[terms] = np.add.reduceat(y[row] * weight[order][:, None], begin, axis=0)
    return out


def _pairs(ids: np.ndarray, first: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller id, greater id, products of the weights in UNITs) of all pairs within a group; with the pairs in the other order a group's outer product."""
    row = tv.row_of(first)
    for d in range(BLOCK):
        a = np.flatnonzero(row[d:] == row[: len(row) - d])
        if not len(a):
            return
        i, j, w = ids[a], ids[a + d], weight[a].astype(np.float64) * weight[a + d]
        if d:
            w[i == j] *= 2
        yield np.minimum(i, j), np.maximum(i, j), np.rint(w / UNIT).astype(np.int64)


def _added(key: list[np.ndarray], value: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the sums of their values."""
    k, v = np.concatenate(key), np.concatenate(value)
    order = np.argsort(k, kind="stable")
    k, begin = np.unique(k[order], return_index=True)
    return k, np.add.reduceat(v[order], begin) if len(k) else v


def gram(passages: DataFrame, idf: np.ndarray, local: np.ndarray, scratch: Scratch) -> tuple[DataFrame, np.ndarray, int]:
    """Sum of the outer products of all passages' unit TF-IDF vectors: its upper half in bands of rows (band, keys within it, values in
    UNITs), the order of the words in it, the most common first, and the rows of a band.

    Every task sums its passages, in memory of bounded size, and the sums are added band by band.
    """
    size = len(idf)
    order = np.argsort(idf, kind="stable")
    rank = np.empty(size, np.int32)
    rank[order] = np.arange(size)
    rank[idf <= 0] = -1
    numbers = np.where(local >= 0, rank[local], -1).astype(np.int32)
    height, square = max(1, (1 << 18) // size), min(size, COMMON)
    spark = passages.sparkSession
    shared = spark.sparkContext.broadcast((numbers, idf[order]))
    kind = _number_type(len(local))

    def bands(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        band = key // (height * size)
        cut = np.flatnonzero(np.diff(band, prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(band[a])], pa.int32()), pa.array([(key[a:b] - band[a] * height * size).astype(np.int32).tobytes()], pa.binary()), pa.array([value[a:b].tobytes()], pa.binary())], names=["band", "keys", "sums"])

    def summed(batches):
        numbers, idf = shared.value
        table, keys, values, held = np.zeros(square * square, np.int64), [], [], 0
        for b in batches:
            for ids, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64)])
                _, ids, first = _inside(np.frombuffer(ids, kind), first, numbers)
                for i, j, v in _pairs(ids.astype(np.int64), first, _unit_weights(ids, first, idf)):
                    common = j < square
                    np.add.at(table, i[common] * square + j[common], v[common])
                    keys.append(i[~common] * size + j[~common])
                    values.append(v[~common])
                    held += len(keys[-1])
                if held > PAIRS:
                    k, v = _added(keys, values)
                    keys, values, held = [k], [v], len(k)
                    if held > PAIRS // 2:
                        yield from bands(k, v)
                        keys, values, held = [], [], 0
        at = np.flatnonzero(table)
        yield from bands(*_added([*keys, at // square * size + at % square], [*values, table[at]]))
        del table
        give_back()

    def joined(batches):
        now, key, value = None, [], []
        for b in batches:
            for band, k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if band != now and key:
                    yield from bands(*_added(key, value))
                    key, value = [], []
                now = band
                key.append(np.frombuffer(k, np.int32) + np.int64(band) * height * size)
                value.append(np.frombuffer(v, np.int64))
                if len(key) > 64:
                    key, value = ([x] for x in _added(key, value))
        if key:
            yield from bands(*_added(key, value))

    schema = "band int, keys binary, sums binary"
    parts = passages.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(summed, schema)
    parts = parts.repartition(max(8, size // 1024), "band").sortWithinPartitions("band")
    out = scratch(parts.mapInArrow(joined, schema), "gram")
    shared.destroy()
    return out, order, height


def _passages(raw: np.ndarray, off: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, ...]:
    """All words, each text's first; vocabulary numbers of those that have one and their places, each passage's first of these, each text's first passage, and each passage's number of words."""
    _, _, h, first = tv.words(raw, off, word_byte=tv.ALNUM)
    k = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    at = np.flatnonzero(vocab[k] == h)
    blocks = np.concatenate([[0], np.cumsum(-(-np.diff(first) // BLOCK))])
    row = tv.row_of(first)
    block = blocks[:-1][row] + (np.arange(len(h)) - first[:-1][row]) // BLOCK
    return h, first, k[at].astype(np.int32), at, np.searchsorted(block[at], np.arange(blocks[-1] + 1)), blocks, np.bincount(block, minlength=blocks[-1])


def _inside(ids: np.ndarray, first: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which ids a block has, their numbers there, and each group's first of these."""
    own = local[ids]
    has = own >= 0
    return has, own[has], np.concatenate([[0], np.cumsum(has)])[first]


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the sums of their two counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    uniq, back = np.unique(w, return_inverse=True)
    return uniq, np.bincount(back, weights=a, minlength=len(uniq)).astype(np.int64), np.bincount(back, weights=b, minlength=len(uniq)).astype(np.int64)


def _number_type(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.int32


def _statistics(texts: DataFrame, vocab: np.ndarray, how: Retrieval, scratch: Scratch) -> tuple[np.ndarray, int, float, DataFrame, DataFrame]:
    """Document frequency of every vocabulary word over all texts, the number of texts, the mean squared weight of an occurrence
    of any other word, some passages (first_passages), and all passages: the numbers of their words, and how many each has, a row
    for many passages. The mean is that of all occurrences of all other words."""
    kind = _number_type(len(vocab))
    schema = "term int, n long, word long, times long, passages binary, sizes binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(term: np.ndarray, **columns: np.ndarray | list) -> pa.RecordBatch:
        got = {"term": pa.array(term, pa.int32())} | {k: pa.array(v, pa.int64() if k in ("n", "word", "times") else pa.binary()) for k, v in columns.items()}
        return pa.RecordBatch.from_arrays([got.get(k, pa.nulls(len(term), pa.int64() if k in ("n", "word", "times") else pa.binary())) for k in names], names=names)

    def beyond(counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(counts[0]), OUTSIDE_ROWS):
            w, docs, times = (x[a : a + OUTSIDE_ROWS] for x in counts)
            yield rows(np.full(len(w), -3), n=docs, word=w.view(np.int64), times=times)

    def run(batches):
        df, n, others, held = np.zeros(len(vocab), np.int64), 0, [], 0
        for b in batches:
            every, sizes = [], []
            for _, _, raw, off in tv.chunks(b.column(0)):
                h, wfirst, ids, place, first, blocks, _ = _passages(raw, off, vocab)
                n += len(off) - 1
                long = np.diff(first)
                every.append(ids.astype(kind).tobytes())
                sizes.append(long[long > 0].astype(np.uint8).tobytes())
                text_first = first[blocks]
                key = np.unique(np.repeat(np.arange(len(off) - 1), np.diff(text_first)) * len(vocab) + ids)
                df += np.bincount(key % len(vocab), minlength=len(vocab))
                outside = np.ones(len(h), dtype=bool)
                outside[place] = False
                w, word, times = np.unique(h[outside], return_inverse=True, return_counts=True)
                if len(w):
                    in_text = np.unique(tv.row_of(wfirst)[outside] * len(w) + word)
                    others.append((w, np.bincount(in_text % len(w), minlength=len(w)), times))
                    held += len(w)
                if held > OUTSIDE:
                    others = [_summed(others)]
                    held = len(others[0][0])
                    if held > OUTSIDE // 2:
                        yield from beyond(others[0])
                        others, held = [], 0
            yield rows(np.full(len(every), -4), passages=every, sizes=sizes)
        at = np.flatnonzero(df)
        yield rows(np.append(at, -2), n=np.append(df[at], n))
        yield from beyond(_summed(others))
        del others
        give_back()

    got = scratch(texts.select("text").mapInArrow(run, schema), "statistics")
    df, n = np.zeros(len(vocab), np.int64), 0
    for r in got.where("term not in (-3, -4)").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    words = got.where("term = -3").groupBy("word").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    weight = F.pow(F.greatest(F.lit(0.0), F.log((F.lit(n + 0.5) - F.col("n")) / (F.col("n") + 0.5))), F.lit(2 * how.power))
    outside = words.agg(F.sum(F.col("times") * weight) / F.sum("times")).first()[0]
    passages = got.where("term = -4").select("passages", "sizes")
    return df, n, float(how.weights(np.zeros(1), n)[0]) ** 2 if outside is None else outside, first_passages(passages, kind, how.sample), passages


def first_passages(passages: DataFrame, kind: type, most: int) -> DataFrame:
    """The first passages of 4 words or more by the hash of their words, to look at: no model or threshold comes from them, and nothing is read until they are."""

    def run(batches):
        for b in batches:
            kept: list[tuple[int, bytes]] = []
            for ids, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, long = np.frombuffer(ids, kind), np.frombuffer(sizes, np.uint8).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(long)])
                mark = tv.mix(tv.sums(tv.mix(ids.astype(np.uint64)).view(np.int64) >> 16, first).view(np.uint64))
                some = np.flatnonzero(long >= 4)
                some = some[np.argsort(mark[some])[:most]]
                kept += [(int(mark[i] >> np.uint64(1)), ids[first[i] : first[i + 1]].astype(np.int32).tobytes()) for i in some]
            kept = sorted(set(kept))[:most]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.binary())], names=["n", "ids"])

    return passages.mapInArrow(run, "n long, ids binary").distinct().orderBy("n", "ids").limit(most)


def latent_space(passages: DataFrame, items: list[np.ndarray], idf: np.ndarray, rank: int, item_weight: float, local: np.ndarray, most: int, scratch: Scratch) -> np.ndarray:
    """Right singular vectors (words by rank) of the matrix whose rows are the unit TF-IDF vectors of all passages and items.

    local: numbers of the passages' words here, -1 for words that don't count; most: rows as which all passages count at most.

    By subspace iteration: products of the Gram matrix with a thin matrix, a band of rows at a time on the executors. It starts
    with random directions, so that none of the matrix is missing from the first step, and every step takes all passages and items.
    """
    spark, size = passages.sparkSession, len(idf)
    wide = min(rank + 12, size)
    flat, first = np.concatenate(items), np.concatenate([[0], np.cumsum([len(x) for x in items])])
    item_weights = _unit_weights(flat, first, idf) * np.float32(item_weight)
    table, order, height = gram(passages, idf, local, scratch)

    def product(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q[order])

        def run(batches):
            q, total, trace = shared.value, None, 0.0
            for b in batches:
                for band, keys, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if total is None:
                        total = np.zeros(q.shape, np.float64)
                    low, high = band * height, min(size, (band + 1) * height)
                    part = np.zeros((high - low, size), np.float32)
                    part.reshape(-1)[np.frombuffer(keys, np.int32)] = np.frombuffer(sums, np.int64) * UNIT
                    total[low:high] += part @ q
                    diagonal = np.arange(high - low), np.arange(low, high)
                    trace += float(part[diagonal].sum(dtype=np.float64))
                    part[diagonal] = 0
                    total += part.T @ q[low:high]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([trace])], names=["part", "trace"])

        got, passages = np.zeros(q.shape), 0.0
        parts = table.mapInArrow(run, "part binary, trace double").toArrow()
        for x, t in zip(parts["part"].to_pylist(), parts["trace"].to_pylist(), strict=True):
            got[order] += np.frombuffer(x, np.float32).reshape(q.shape)
            passages += t  # each has length 1
        return got * min(1.0, most / max(passages, 1.0)) + _product(q, flat, first, item_weights)

    q, held = np.linalg.qr(np.random.default_rng(41).standard_normal((size, wide)))[0].astype(np.float32), 0.0
    while True:
        got = product(q)
        inner = q.T @ got
        now = float(np.trace(inner))
        if now <= held * (1 + SETTLED):
            break
        held = now
        q = np.linalg.qr(got)[0].astype(np.float32)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return (q @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _segments(blocks: np.ndarray, limit: int = 1024) -> Iterator[tuple[int, int, slice]]:
    """Texts and their passages, some texts at a time; a text of many passages in parts that overlap by a window."""
    for t0, t1 in tv.spans_of_rows(blocks, limit):
        begin, end = int(blocks[t0]), int(blocks[t1])
        step = max(end - begin, 1) if t1 - t0 > 1 else 4 * limit
        for a in range(begin, end, step):
            yield t0, t1, slice(a, min(end, a + step + max(WINDOWS) - 1))


def projected(flat: np.ndarray, first: np.ndarray, idf: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an occurrence of each word adds to the product with each item's direction in the space, and the share of every item's length that the space holds."""
    weighted = space * idf[:, None]
    latent = _rows(weighted, flat, None, first)
    long = np.linalg.norm(latent, axis=1)
    row = tv.row_of(first)
    key, count = np.unique(row * len(idf) + flat, return_counts=True)
    whole = np.sqrt(np.bincount(key // len(idf), weights=(count * idf[key % len(idf)].astype(np.float64)) ** 2, minlength=len(long)))
    return (weighted @ (latent / np.maximum(long, 1e-9)[:, None]).T).astype(np.float32), long / np.maximum(whole, 1e-9)


@dataclass
class Block:
    """Items with what their search needs: numbers of the vocabulary's words here, what a word adds to an item's product, least cosines, the bound."""

    items: list[Item]
    local: np.ndarray
    table: np.ndarray
    cosine: np.ndarray
    bound: Bound

    def bytes(self) -> int:
        return self.table.nbytes + self.local.nbytes + 200 * sum(len(x.words) for x in self.items)


@dataclass
class Search:
    """Some blocks, the vocabulary of all, the square of every word's weight and the mean one of words beyond the vocabulary."""

    blocks: list[Block]
    vocab: np.ndarray
    square: np.ndarray
    outside: float
    how: Retrieval

    def found(self, column: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item): share, cosine and answer's share of the items in some texts."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        for i0, _, raw, off in tv.chunks(column, 1 << 19):
            h, wfirst, ids, place, pfirst, blocks, size = _passages(raw, off, self.vocab)
            if len(ids):
                # squared lengths of the whole vectors, with words that no item has at their mean weight
                square = tv.sums(self.square[ids], pfirst) + (size - np.diff(pfirst)) * self.outside
                for block in self.blocks:
                    has, own, first = _inside(ids, pfirst, block.local)
                    if len(own):
                        self._within(block, out, i0, h, wfirst, own, place[has], first, blocks, square, self.square[ids[has]] > 0)
        return out

    def _within(self, block: Block, found: dict, i0: int, h: np.ndarray, wfirst: np.ndarray, ids: np.ndarray, place: np.ndarray, pfirst: np.ndarray, blocks: np.ndarray, square: np.ndarray, heavy: np.ndarray) -> None:
        items, table, how = block.items, block.table, self.how
        sure: dict[tuple[int, int], tuple[float, float]] = {}
        ranges: list[tuple[int, int, int, int]] = []
        for t, it, a, b in block.bound.regions(ids, place, wfirst):
            share, answer, bad = items[it].check(h[a:b], how)
            if bad:
                sure[t, it] = max((share, answer), sure.get((t, it), (0.0, 0.0)))
                ranges.append((int(blocks[t]) + max(0, (a - int(wfirst[t])) // BLOCK - max(WINDOWS) + 1), int(blocks[t]) + (b - 1 - int(wfirst[t])) // BLOCK + 1, t, it))
        cosine = dict.fromkeys(sure, 0.0)
        kept = np.concatenate([[0], np.cumsum(heavy)])[pfirst]
        heavy = ids[heavy]
        text_of = np.repeat(np.arange(len(blocks) - 1), np.diff(blocks))
        hits: list[tuple[int, int, float]] = []
        for t0, t1, here in _segments(blocks):
            # passages of some texts with empty ones between texts, so that no window reaches into another text
            at = np.arange(here.stop - here.start) + (max(WINDOWS) - 1) * (text_of[here] - t0)
            dot = np.zeros((len(at) + (max(WINDOWS) - 1) * (t1 - t0), len(items)), np.float32)
            long = np.zeros(len(dot))
            first = kept[here.start : here.stop + 1]
            dot[at], long[at] = _rows(table, heavy[first[0] : first[-1]], None, first - first[0]), square[here]
            back = np.full(len(dot), -1)
            back[at] = np.arange(here.start, here.stop)
            done = 1
            for width in WINDOWS:  # each twice the one before: a window's product is the sum of its halves'
                while done < width:
                    dot[:-done] += dot[done:]
                    long[:-done] += long[done:]
                    done *= 2
                for p0, p1, t, it in ranges:
                    p0, p1 = max(p0, here.start), min(p1, here.stop)
                    if p0 < p1:
                        w = at[p0 - here.start : p1 - here.start]
                        cosine[t, it] = max(cosine[t, it], float((dot[w, it] / np.sqrt(np.maximum(long[w], 1e-9))).max()))
                w, it = np.nonzero(dot >= np.sqrt(np.maximum(long, 1e-9)).astype(np.float32)[:, None] * block.cosine)
                ok = back[w] >= 0
                w, it = w[ok], it[ok]
                hits += zip(back[w].tolist(), it.tolist(), (dot[w, it] / np.sqrt(np.maximum(long[w], 1e-9))).tolist(), strict=True)
        best = {(i0 + t, items[it].number): (share, cosine[t, it], answer) for (t, it), (share, answer) in sure.items()}
        close: dict[tuple[int, int], float] = {}
        for w, it, c in hits:
            close[w, it] = max(c, close.get((w, it), 0.0))
        for (w, it), c in close.items():
            t = int(text_of[w])
            at = int(wfirst[t]) + (w - int(blocks[t])) * BLOCK
            n = len(items[it].words)
            region = h[max(int(wfirst[t]), at - n) : min(int(wfirst[t + 1]), at + max(WINDOWS) * BLOCK + n)]
            share, answer, bad = items[it].check(region, how)
            old = best.get((i0 + t, items[it].number))
            if bad and (old is None or (share, c) > old[:2]):
                best[i0 + t, items[it].number] = (share, c, answer)
        found |= best


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None, how: Retrieval) -> tuple[DataFrame, int]:
    """The items with the number of their block, and how many blocks there are."""
    rows = benchmark.select(benchmark[id_col].alias("item_id"), benchmark[text_col].alias("text"), (benchmark[answer_col] if answer_col else F.lit(None)).cast("string").alias("answer")).where("text is not null and item_id is not null")
    words, items = rows.agg(F.coalesce(F.sum(F.length("text") / 5), F.lit(0)), F.count(F.lit(1))).first()
    n = int(max(words // how.block_words, items // how.block_items)) + 1
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), n


def searches(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, answer_col: str | None, how: Retrieval) -> Iterator[tuple[Search, pa.Array]]:
    """What each pass over the texts searches with, and the ids of the items by their numbers."""
    texts = narrow(docs, text=text_col)
    rows, n = item_blocks(benchmark, item_col, item_text_col, answer_col, how)
    for low in range(0, n, MANY_BLOCKS):
        got = rows.where(F.col("block").between(low, low + MANY_BLOCKS - 1)).distinct().toArrow()
        names, by = got["item_id"].combine_chunks(), {}
        for r in sorted(zip(got["block"].to_pylist(), map(str, got["item_id"].to_pylist()), got["text"].to_pylist(), map(str, got["answer"].to_pylist()), range(got.num_rows), got["answer"].to_pylist(), strict=True), key=lambda r: r[:5]):
            words = word_hashes(r[2])
            if len(words):
                answer = word_hashes(r[5]) if r[5] else words[-max(3, len(words) // 5) :]
                by.setdefault(r[0], []).append(Item(r[4], words, answer if len(answer) else words))
        if not by:
            continue
        scratch = Scratch()
        vocab = np.unique(np.concatenate([x.words for items in by.values() for x in items]))
        df, total, outside, _, passages = _statistics(texts, vocab, how, scratch)
        weights = how.weights(df, total)
        search = Search([], vocab, weights.astype(np.float64) ** 2, outside, how)
        for items in by.values():
            own = np.unique(np.concatenate([x.words for x in items]))
            at = np.searchsorted(vocab, own)
            local = np.full(len(vocab), -1, np.int32)
            local[at] = np.arange(len(own))
            ids, idf = [np.searchsorted(own, x.words).astype(np.int32) for x in items], weights[at]
            space = latent_space(passages, ids, idf, how.dimensions(len(items), len(own)), how.item_weight, local, how.sample, scratch)
            table, held = projected(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]), idf, space)
            block = Block(items, local, table, (how.cosine * np.minimum(1.0, held / how.held)).astype(np.float32), Bound(items, own, df[at], how))
            if search.blocks and sum(x.bytes() for x in search.blocks) + block.bytes() > how.memory:
                yield search, names
                search = Search([], vocab, search.square, outside, how)
            search.blocks.append(block)
        scratch.close()
        yield search, names


HIT_COLUMNS = ("lcs_share", "cosine", "answer_share")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, how: Retrieval = Retrieval()) -> DataFrame:
    """doc_id, item_id, lcs_share, cosine and answer_share of every text that holds an item, for each such item."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, lcs_share double, cosine double, answer_share double"
    out = spark.createDataFrame([], schema)
    for search, names in searches(docs, benchmark, text_col, item_col, item_text_col, answer_col, how):
        shared = spark.sparkContext.broadcast((search, names))

        def make(shared=shared):
            search, names = shared.value

            def f(b: pa.RecordBatch):
                found = search.found(b.column(1))
                keys = sorted(found)
                return {
                    "doc_id": b.column(0).take(pa.array([k for k, _ in keys], pa.int64())), "item_id": names.take(pa.array([i for _, i in keys], pa.int64())),
                    **{c: np.array([found[k][n] for k in keys], dtype=np.float64) for n, c in enumerate(HIT_COLUMNS)},
                }

            return f

        out = out.unionByName(map_rows(narrow(docs, doc_id=id_col, text=text_col), make, schema))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in HIT_COLUMNS])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, how: Retrieval = Retrieval()) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Every row is judged by its own text, without a join."""
    out = docs
    for search, _ in searches(docs, benchmark, text_col, item_col, item_text_col, answer_col, how):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def make(shared=shared):
            def f(texts: pa.Array) -> pa.Array:
                free = np.ones(len(texts), dtype=bool)
                free[[k for k, _ in shared.value.found(texts)]] = False
                return pa.array(free)

            return f

        out = out.where(batch_function(make, "boolean")(F.col(f"`{text_col}`")))
    return out
