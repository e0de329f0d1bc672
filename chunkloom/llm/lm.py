"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts a token's class from those of the two tokens before: the WORDS most frequent words that occur LEAST_COUNT
times are a class each, all others fall into a few classes by their shape (length, last character, characters beyond ASCII),
and a token of such a class has the add-one share of its class that its corpus count gives it. So every text, with unknown
words too, has a probability. The vocabulary grows with the corpus up to WORDS; the nearer context distinguishes NEAR of its
words, the farther one FAR, others by their shape.

Representations, context matrices and biases are learned in numpy by telling true classes from noise. All training tokens are
learned from: after a start on the driver with a bounded sample, every task goes through its own texts from there, and the
tasks' models are averaged, each row by how often a task updated it, in ROUNDS rounds with a part of the texts each. Texts are
read where they are; only models, of a size that doesn't grow with the corpus, are shuffled.

Afterwards the exact normaliser of every pair of contexts comes from batched matrix products over all classes: the sum over
words of exp(x + y) is the product of the matrices of exp(x) and exp(y). A token's normalised log probability is then a
product of two short vectors and a table lookup.

Corpus counts cover all texts and are shuffled by word. Words above the share 1 / HEAD of all tokens, learned from or not, of
which there can't be more than HEAD, are sent to all executors with their counts; the other occurrences are joined with the
counts by word, so no hot word reaches the join.

Defined cases: a null text is empty; an empty text is its end alone; texts of any length are learned and scored whole; repeated
rows are counted and scored one by one; words of equal count are ranked by their hash; without training texts all counts are 0
and the model is near its start; an empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Scratch, lists, map_rows, written

BEGIN, END, SHAPES = 0, 1, 32
FIRST_WORD = 2 + SHAPES
#: Words with a class of their own; those that the nearer and the farther context distinguish; words whose counts are sent to all executors, at most.
WORDS, NEAR, FAR, HEAD = 1 << 15, 1 << 12, 1 << 10, 1 << 22
#: Occurrences of a word with a class of its own, at least.
LEAST_COUNT = 8
#: Rounds of averaging over the executors; in each a part of the training texts is learned from, all in all of them.
ROUNDS = 2
DIM = 24
END_HASH = np.uint64(0x0E0D)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shape classes of all tokens, each text's end included, and each text's first (one more at the end)."""
    starts, ends, h, first = tv.words(raw, off)
    n = len(off) - 1
    begin = first + np.arange(n + 1)
    hashes, cls = np.full(int(begin[-1]), END_HASH), np.full(int(begin[-1]), END, dtype=np.int16)
    if len(starts):
        size, last = ends - starts, raw[ends - 1]
        wide = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(raw >= 128, out=wide[1:])
        shape = np.minimum((size - 1) // 4, 3) * 4 + np.where(last == 46, 1, np.where(last == 44, 2, np.where(tv.ALNUM[last], 0, 3)))
        shape = shape * 2 + (wide[ends] > wide[starts])
        inner = np.ones(len(hashes), dtype=bool)
        inner[begin[1:] - 1] = False
        hashes[inner], cls[inner] = h, 2 + shape
    return hashes, cls, begin


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted values in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return k, keys[k] == wanted


def before(cls: np.ndarray, begin: np.ndarray, by: int) -> np.ndarray:
    """Classes of the tokens so many places before, BEGIN beyond the text's start."""
    out = np.full(len(cls), BEGIN, dtype=cls.dtype)
    out[by:] = cls[:-by] if by < len(cls) else cls[:0]
    for k in range(by):
        at = begin[:-1] + k
        out[at[at < begin[1:]]] = BEGIN
    return out


def token_counts(texts: DataFrame) -> DataFrame:
    """h, shape, c and m of every distinct token: its occurrences in texts to learn from and in all. Summed within a task, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> tuple[np.ndarray, ...]:
            h, s, c, m = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
            return uniq, s[at], np.bincount(back, weights=c).astype(np.int64), np.bincount(back, weights=m).astype(np.int64)

        def batch(x) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2]), pa.array(x[3])], names=["h", "shape", "c", "m"])

        for b in batches:
            learn = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, raw, off in tv.chunks(b.column(0)):
                h, s, begin = tokens(raw, off)
                uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
                held.append((uniq, s[at], np.bincount(back, weights=np.repeat(learn[i:j], np.diff(begin)), minlength=len(uniq)).astype(np.int64), np.bincount(back, minlength=len(uniq))))
                if sum(len(x[0]) for x in held) > 400_000:
                    merged = flush()
                    if len(merged[0]) > 200_000:
                        yield batch(merged)
                    else:
                        held.append(merged)
        if held:
            yield batch(flush())

    return texts.select("text", "learn").mapInArrow(run, "h long, shape int, c long, m long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"), F.sum("m").alias("m"))


class LogBilinear:
    """Representations of classes as contexts (ctx, the nearer's) and as targets (out), a matrix for each context, biases.

    Classes are numbered by frequency after the shapes, so that a context keeps the first near or far classes and takes the
    shape of others. The natural logarithm of a class' probability is (ctx[a] c1 + ctx[b] c2) out[w] + bias[w] - norm[a, b].
    """

    def __init__(self, unigram: np.ndarray, near: int = NEAR, far: int = FAR, dim: int = DIM):
        k = len(unigram)
        self.near, self.far = min(k, FIRST_WORD + near), min(k, FIRST_WORD + far)
        p = unigram + 0.5
        p[BEGIN] = 0
        self.p = p / p.sum()
        rng = np.random.default_rng(17)
        self.ctx = (rng.standard_normal((self.near, dim)) * 0.1).astype(np.float32)
        self.out = (rng.standard_normal((k, dim)) * 0.1).astype(np.float32)
        self.c1, self.c2 = (np.eye(dim, dtype=np.float32) * x for x in (1.0, 0.5))
        self.bias = np.log(np.maximum(self.p, 1e-12)).astype(np.float32)
        self.memory = [np.full_like(x, 0.05) for x in self.tables()]
        self.norm: np.ndarray | None = None

    def tables(self) -> list[np.ndarray]:
        return [self.ctx, self.out, self.bias, self.c1, self.c2]

    def contexts(self, w: np.ndarray, shape: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the nearer and of the farther context of every token."""
        return before(np.where(w < self.near, w, shape), begin, 1), before(np.where(w < self.far, w, shape), begin, 2)

    def learn(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, rng: np.random.Generator, noise: int = 128, batch: int = 1024, rate: float = 0.08) -> list[np.ndarray]:
        """One pass over some events in random order, by Adagrad; noise is drawn from the unigram distribution and shared
        within a batch. How often each row of ctx and out was updated is returned."""
        times = [np.zeros(len(self.ctx), np.int64), np.zeros(len(self.out), np.int64)]
        logp = np.log(np.maximum(self.p, 1e-12)).astype(np.float32) + np.float32(np.log(noise))
        cumulative = np.cumsum(self.p)

        def step(i: int, table: np.ndarray, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
            self.memory[i][at] += grad * grad
            table[at] -= rate * grad / np.sqrt(self.memory[i][at])

        def gather(at: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.argsort(at, kind="stable")
            s = at[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            return s[first], np.add.reduceat(grad[order], first, axis=0), np.diff(np.append(first, len(s)))

        order = rng.permutation(len(w))
        for i in range(0, len(order), batch):
            use = order[i : i + batch]
            x_at, y_at, good_at = a[use], b[use], w[use]
            bad_at = np.minimum(np.searchsorted(cumulative, rng.random(noise)), len(self.p) - 1)
            x, y, good, bad = self.ctx[x_at], self.ctx[y_at], self.out[good_at], self.out[bad_at]
            q = x @ self.c1 + y @ self.c2
            g = -1 / (1 + np.exp(np.clip((q * good).sum(axis=1) + self.bias[good_at] - logp[good_at], -30, 30)))
            m = q @ -bad.T
            m += logp[bad_at] - self.bias[bad_at]
            np.exp(np.minimum(m, 30, out=m), out=m)
            m += 1
            np.reciprocal(m, out=m)
            dq = g[:, None] * good + m @ bad
            # the last column is the bias'
            grad = np.concatenate([np.column_stack([g[:, None] * q, g]), np.column_stack([m.T @ q, m.sum(axis=0)])])
            at, grad, n = gather(np.concatenate([good_at, bad_at]), grad)
            times[1][at] += n
            step(1, self.out, grad[:, :-1], at)
            step(2, self.bias, grad[:, -1], at)
            at, grad, n = gather(np.concatenate([x_at, y_at]), np.concatenate([dq @ self.c1.T, dq @ self.c2.T]))
            times[0][at] += n
            step(0, self.ctx, grad, at)
            step(3, self.c1, x.T @ dq / len(use) * 8)
            step(4, self.c2, y.T @ dq / len(use) * 8)
        return times

    def ready(self) -> None:
        """Context products for scoring; training is over."""
        self.bias[BEGIN] = -60
        self.one, self.two = self.ctx @ self.c1, self.ctx[: self.far] @ self.c2
        self.memory = []

    def norms(self, a0: int, a1: int, block: int = 4096) -> np.ndarray:
        """Logarithms of the sums over all classes, for nearer contexts from a0 to a1 and all farther ones."""
        one, two = self.one[a0:a1], self.two
        cut = range(0, len(self.out), block)
        top1 = np.max([(one @ self.out[k : k + block].T).max(axis=1) for k in cut], axis=0)
        top2 = np.max([(two @ self.out[k : k + block].T + self.bias[k : k + block]).max(axis=1) for k in cut], axis=0)
        total = np.zeros((len(one), len(two)))
        for k in cut:
            w, bias = self.out[k : k + block].T, self.bias[k : k + block]
            total += np.exp(one @ w - top1[:, None]) @ np.exp(two @ w + bias - top2[:, None]).T
        low = np.argwhere(total < 1e-25)  # hardly ever: the two maxima are far apart
        out = np.log(np.maximum(total, 1e-300)) + top1[:, None] + top2
        for i, j in low:
            s = (self.out @ (one[i] + two[j])).astype(np.float64) + self.bias
            out[i, j] = s.max() + np.log(np.exp(s - s.max()).sum())
        return out.astype(np.float32)

    def log10(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        dot = np.empty(len(w), np.float32)
        for k in range(0, len(w), 1 << 16):
            at = slice(k, k + (1 << 16))
            dot[at] = np.einsum("ij,ij->i", self.one[a[at]] + self.two[b[at]], self.out[w[at]])
        return (dot.astype(np.float64) + self.bias[w] - self.norm[a, b]) / np.log(10)


def text_mark(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number for each text from its words, the same wherever the text is."""
    return tv.mix(tv.sums(h.view(np.int64) >> 8, begin).view(np.uint64))


@dataclass
class Vocabulary:
    """Hashes of the words with a class of their own, sorted, and their classes."""

    keys: np.ndarray
    cls: np.ndarray

    def classes(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        k, there = find(self.keys, h)
        out = shape.astype(np.int32)
        out[there] = self.cls[k[there]]
        return out


SLICE = 2048


def share_of(text: str, n: int) -> Column:
    """Which of n parts a text belongs to, by its hash; rows of one text are together. Decided before texts leave the JVM."""
    return F.pmod(F.xxhash64(text, F.lit(61)), F.lit(n))


def averaged(train: DataFrame, model: LogBilinear, vocabulary: Vocabulary, part: int, scratch: Scratch) -> LogBilinear:
    """The model after all tasks have learned from their texts of a part, averaged by rows."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((model, vocabulary))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = copy.deepcopy(shared.value)  # a worker process keeps what it was sent for its next task
        times, n, mark = None, 0, 0
        for b in batches:
            for _, _, raw, off in tv.chunks(b.column(0)):
                h, shape, begin = tokens(raw, off)
                w = vocabulary.classes(h, shape)
                seed = int(text_mark(h, begin).sum())
                mark ^= seed
                got = model.learn(*model.contexts(w, shape, begin), w, np.random.default_rng(seed))
                times = got if times is None else [s + t for s, t in zip(times, got, strict=True)]
                n += len(w)
        if times is None:
            return
        weights = [*times, times[1], np.full(len(model.c1), n), np.full(len(model.c2), n)]
        for k, (table, weight) in enumerate(zip(model.tables(), weights, strict=True)):
            table = table.reshape(len(table), -1) * weight[:, None].astype(np.float64)
            for i in range(0, len(table), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i // SLICE], pa.int32()), pa.array([mark - (1 << 63)], pa.int64()), pa.array([weight[i : i + SLICE].astype(np.int64).tobytes()], pa.binary()), pa.array([table[i : i + SLICE].astype(np.float32).tobytes()], pa.binary())], names=["k", "slice", "mark", "n", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in batches:
            for k, s, n, x in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                n, x = np.frombuffer(n, np.int64), np.frombuffer(x, np.float32).astype(np.float64)
                if (k, s) in total:
                    total[k, s][0] += n
                    total[k, s][1] += x
                else:
                    total[k, s] = [n.copy(), x]
        for (k, s), (n, x) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["k", "slice", "n", "x"])

    models = train.where(share_of("text", ROUNDS) == part).select("text").mapInArrow(learn, "k int, slice int, mark long, n binary, x binary")
    got = models.repartition("k", "slice").sortWithinPartitions("k", "slice", "mark").mapInArrow(add, "k int, slice int, n binary, x binary").toArrow()
    for k, s, n, x in sorted(zip(*(got[c].to_pylist() for c in ("k", "slice", "n", "x")), strict=True), key=lambda r: r[:2]):
        table = model.tables()[k]
        rows = slice(s * SLICE, s * SLICE + SLICE)
        n = np.frombuffer(n, np.int64)
        x = np.frombuffer(x, np.float64).reshape(len(n), -1)
        has = n > 0
        table[rows].reshape(len(n), -1)[has] = (x[has] / n[has, None]).astype(np.float32)
    shared.destroy()
    return model


def train_model(train: DataFrame, n: int, unigram: np.ndarray, vocabulary: Vocabulary, start_events: int, scratch: Scratch) -> LogBilinear:
    """Fit on all texts of train, of n tokens, after a start on about start_events of them."""
    spark = train.sparkSession
    rate = min(1.0, start_events / max(1, n))
    some = max(1, int(1 / (20 * rate)))  # one of so many texts is sent, so that a text of any length is a small part of the sample
    rate *= some
    model = LogBilinear(unigram)
    contexts = (model.near, model.far)

    def draw():
        def f(b: pa.RecordBatch):
            out = [np.zeros((0, 3), np.int32)]
            for _, _, raw, off in tv.chunks(b.column(0)):
                h, shape, begin = tokens(raw, off)
                w = vocabulary.classes(h, shape)
                x, y = (before(np.where(w < k, w, shape), begin, i + 1) for i, k in enumerate(contexts))
                seed = tv.mix(np.repeat(text_mark(h, begin), np.diff(begin)) + (np.arange(len(h)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.uint64))
                at = np.flatnonzero(seed < np.uint64(min(rate, 1 - 1e-12) * 2.0**64))
                out.append(np.stack([x[at], y[at], w[at]], axis=1))
            return {"events": pa.array([np.concatenate(out).astype("<i4").tobytes()], pa.binary())}

        return f

    got = map_rows(train.where(share_of("text", some) == 0).select("text"), draw, "events binary").toArrow()["events"].to_pylist()
    events = np.frombuffer(b"".join(sorted(got)), "<i4").reshape(-1, 3)
    rng = np.random.default_rng(19)
    for _ in range(2 if len(events) else 0):
        model.learn(*events.T, rng)
    for part in range(ROUNDS if len(events) else 0):
        model = averaged(train, model, vocabulary, part, scratch)
    model.ready()
    shared = spark.sparkContext.broadcast(model)
    step = 128

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([shared.value.norms(i, i + step).tobytes()], pa.binary())], names=["id", "x"])

    got = spark.range(0, model.near, step, -(-model.near // step)).mapInArrow(norms, "id long, x binary").toArrow()
    model.norm = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, model.far) for _, x in sorted(zip(got["id"].to_pylist(), got["x"].to_pylist(), strict=True))])
    shared.destroy()
    return model


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", start_events: int = 200_000) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every row; learn tells the rows to learn from.

    start_events: expected number of tokens, drawn at one rate from all training texts, with which training starts on the driver
    before all training tokens are gone through on the executors.
    """
    spark = docs.sparkSession
    scratch = Scratch()
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    train = texts.where("learn")
    counts = scratch(token_counts(texts), "counts")
    n, v, m = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("m"), F.lit(0))).first()
    least = max(1, -(-m // HEAD))  # no more than HEAD words can have so many occurrences
    head = counts.where(F.col("m") >= least).select("h", "c", "shape").toArrow()
    order = np.argsort(head["h"].to_numpy().view(np.uint64))
    keys, number, shape_of = head["h"].to_numpy().view(np.uint64)[order], head["c"].to_numpy()[order], head["shape"].to_numpy()[order]
    often = np.flatnonzero((number >= LEAST_COUNT) & (keys != END_HASH))
    own = often[np.lexsort((keys[often], -number[often]))][:WORDS]
    cls = np.full(len(keys), -1, dtype=np.int32)
    cls[own] = FIRST_WORD + np.arange(len(own))
    # tokens and distinct words of each shape that have no class of their own
    unigram = np.zeros(FIRST_WORD + len(own))
    kinds = np.zeros(FIRST_WORD)
    for r in counts.where("c > 0").groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        unigram[r["shape"]], kinds[r["shape"]] = r["c"], r["v"]
    np.subtract.at(unigram, shape_of[own], number[own])
    np.subtract.at(kinds, shape_of[own], 1)
    unigram[cls[own]] = number[own]
    share = np.log10(unigram[:FIRST_WORD] + kinds + 1)
    share[END] = 0.0
    top = np.sort(own)
    model = train_model(train, n, unigram, Vocabulary(keys[top], cls[top]), start_events, scratch)
    shared = spark.sparkContext.broadcast((keys, np.where(number > 0, np.log10(number + 1.0), -1.0), cls, model, share))

    def judge():
        keys, logs, cls, model, share = shared.value

        def f(b: pa.RecordBatch):
            parts, tails, sizes = [], [], []
            for _, _, raw, off in tv.chunks(b.column(1)):
                h, shape, begin = tokens(raw, off)
                k, there = find(keys, h)
                w = shape.astype(np.int32)
                named = np.zeros(len(h), dtype=bool)
                named[there] = cls[k[there]] >= 0
                w[named] = cls[k[named]]
                plain = ~named & (shape != END)
                log_c = np.zeros(len(h))
                log_c[there] = logs[k[there]]
                known = there & (log_c > 0)
                log_c[~known] = 0
                lp = model.log10(*model.contexts(w, shape, begin), w)
                lp[plain] += log_c[plain] - share[shape[plain]]
                parts.append((np.diff(begin), tv.sums(known.astype(np.int64), begin), tv.sums(log_c, begin), tv.sums(lp, begin)))
                tails.append(h[~there].view(np.int64))
                sizes.append(tv.sums((~there).astype(np.int64), begin))
            size, known, base, lp = (np.concatenate(x) for x in zip(*parts, strict=True))
            return {"doc_id": b.column(0), "learn": b.column(2), "n_tokens": size, "known": known, "base": base, "lp": lp, "tail": lists(np.concatenate(tails), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int64())}

        return f

    rows = map_rows(texts, judge, f"doc_id {kind}, learn boolean, n_tokens long, known long, base double, lp double, tail array<bigint>")
    rows = scratch(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    shared.destroy()
    rare = counts.where((F.col("m") < least) & (F.col("c") > 0)).select("h", "c")
    found = rows.select("row", F.explode("tail").alias("h")).join(rare, "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("found"))
    more, total = F.coalesce("more", F.lit(0.0)), float(np.log10(n + v + 1.0))
    out = rows.join(found, "row", "left").select(
        "doc_id", "learn", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("lp") + more).alias("score"),
    )
    out = written(out, "scores")
    scratch.close()
    return out
