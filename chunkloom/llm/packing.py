"""Best-fit packing with exact-complement hashing.

Documents become token ids, those longer than a sequence are cut, and the pieces are packed on the histogram of their
lengths, which has at most max_tokens entries whatever the size of the corpus: the plan is made on the driver from that
histogram alone. Lengths are taken from the longest down; for the gap that is left an index of single lengths, pair sums and
triple sums gives a combination that fills it exactly and of which pieces are left; where there is none the longest piece
that fits goes in and the search goes on with the smaller gap. A combination is used as often as its pieces last.

A piece's place follows from its rank among the pieces of its length. Ranks are counted within (length, salt) and shifted by
the counts of the salts before, so that a length that a third of all pieces has is spread over many tasks, and so are the copies
of one row. Texts are read once: the pieces, without their ids, are written to the shared folder.

Token ids come from a word cache: the tokenizer splits at white space in any case, so that each distinct word is encoded
once per task and the rest is array work.

Defined cases: a null text counts as empty and is the end id alone; a row that occurs twice is packed twice; pieces of equal
length are interchangeable and take their places in no fixed order; an empty table gives no rows; a word or text of any length
is encoded whole; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import dropped, map_rows, narrow, written

#: Letters of a word that Merges encodes, at most.
LONG = 64
_NONBLANK = np.ones(256, dtype=bool)
_NONBLANK[[9, 10, 13, 32]] = False


class Merges:
    """The tokenizer's merges for many words at once, for words of small letters (a to z and those of Latin-1)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letter[b] + end] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[x] << 20) | vocab[y] for x, y in pairs], dtype=np.int64)
        _, first = np.unique(keys, return_index=True)
        self.keys, self.rank = keys[first], first.astype(np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], dtype=np.int64)[first]

    _NONE = np.iinfo(np.int64).max

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = (left << 20) | right
        k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[k] == want, self.rank[k], self._NONE), self.made[k]

    def encode(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes one after another, and the number of each word's ids."""
        first = np.cumsum(size) - size
        counts = np.zeros(len(size), dtype=np.int64)
        parts, owners = [], []
        for n in np.unique(size):
            who = np.flatnonzero(size == n)
            sym = self.inner[flat[first[who][:, None] + np.arange(n)]]
            sym[:, -1] = self.final[flat[first[who] + n - 1]]
            rank = np.full((len(who), max(int(n), 1)), self._NONE)
            if n > 1:
                rank[:, :-1] = self._ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel())[0].reshape(len(who), -1)
            left = int(n)
            while len(who):
                best = rank.argmin(axis=1)
                rows = np.arange(len(who))
                more = rank[rows, best] != self._NONE
                done = ~more
                if done.any():
                    parts.append(sym[done, :left].ravel())
                    owners.append(np.repeat(who[done], left))
                    counts[who[done]] = left
                    who, sym, rank, best = who[more], sym[more], rank[more], best[more]
                if not len(who):
                    break
                rows = np.arange(len(who))
                made = self._ranks(sym[rows, best], sym[rows, best + 1])[1]
                take = np.arange(left - 1) + (np.arange(left - 1) > best[:, None])
                sym = np.take_along_axis(sym, take, axis=1)
                rank = np.take_along_axis(rank, take, axis=1)
                sym[rows, best] = made
                left -= 1
                for at in (best - 1, best):
                    ok = np.flatnonzero((at >= 0) & (at + 1 < left))
                    rank[ok, at[ok]] = self._ranks(sym[ok, at[ok]], sym[ok, at[ok] + 1])[0]
                rank[:, left - 1] = self._NONE
        if not parts:
            return np.zeros(0, np.uint32), counts
        owner = np.concatenate(owners)
        return np.concatenate(parts)[np.argsort(owner, kind="stable")].astype(np.uint32), counts


_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[65:91] = _PLAIN[97:123] = True
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False  # multiplication and division signs
_POINT = np.zeros(256, dtype=bool)
_POINT[33:48] = _POINT[58:65] = _POINT[91:97] = _POINT[123:127] = True
_POINT[39] = False  # an apostrophe may begin a contraction


def letters(raw: np.ndarray) -> np.ndarray:
    """True for bytes of a letter of ASCII or of Latin-1."""
    out = _PLAIN[raw]
    pair = (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
    out[:-1] |= pair
    out[1:] |= pair
    return out


def small(raw: np.ndarray) -> np.ndarray:
    """The bytes with capital letters of ASCII and of Latin-1 made small."""
    out = tv.LOWER[raw]
    up = (raw[1:] >= 0x80) & (raw[1:] < 0x9F) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
    out[1:][up] += 32
    return out


class WordIds:
    """Ids of words, each distinct one encoded once; forgotten when there are too many.

    A word of letters with points after it is two tokens of the tokenizer's first step, so it is looked up as two. New words
    of letters go through Merges, all others through the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.most = Tokenizer.from_file(path), Merges(path), most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.zeros(len(starts), dtype=np.int64)
        size = (ends - starts)[simple]
        flat, n[simple] = self.merges.encode(small(raw)[np.repeat(starts[simple] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size)
        data = raw.tobytes()
        got = [e.ids for e in self.tokenizer.encode_batch_fast([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[~simple], ends[~simple], strict=True)], add_special_tokens=False)]
        n[~simple] = [len(x) for x in got]
        out = np.zeros(int(n.sum()), np.uint32)
        own = np.repeat(simple, n)
        out[own], out[~own] = flat, np.array([x for ids in got for x in ids], np.uint32)
        return out, n

    def places(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids are in the pool, and how many."""
        uniq, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        k = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = k < len(self.keys)
        known[inside] = self.keys[k[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        if len(new):
            i = first[new]
            flat, n = self._encoded(raw, starts[i], ends[i], simple[i])
            if len(flat) and flat.max() >= 1 << 16 and self.pool.dtype == np.uint16:
                self.pool = self.pool.astype(np.uint32)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.pool.dtype)])
            self.pool[self.used : self.used + len(flat)] = flat
            at = self.used + np.cumsum(n) - n
            self.used += len(flat)
            into = k[new]
            self.keys, self.at, self.n = np.insert(self.keys, into, uniq[new]), np.insert(self.at, into, at), np.insert(self.n, into, n.astype(np.int32))
            k = np.searchsorted(self.keys, uniq)
        return self.at[k][back], self.n[k][back].astype(np.int64)

    def _split(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, ends, hashes, simple or not, of what is looked up, and each text's first."""
        starts, ends, hashes, first = tv.words(raw, off, word_byte=_NONBLANK, lower=False)
        if not len(starts) or len(raw) > 4 * tv.CHUNK_BYTES:
            return starts, ends, hashes, np.zeros(len(starts), bool), first
        letter = letters(raw)
        points = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(_POINT[raw], out=points[1:])
        other = np.append(np.flatnonzero(~letter), len(raw))
        stem = np.minimum(other[np.searchsorted(other, starts)], ends)
        # a very long word takes as many steps as it has letters in Merges; the tokenizer itself does with fewer
        simple = (stem > starts) & (stem - starts <= LONG) & (points[ends] - points[stem] == ends - stem)
        two = simple & (stem < ends)
        word = np.repeat(np.arange(len(starts)), 1 + two)
        tail = np.zeros(len(word), dtype=bool)
        tail[1:] = word[1:] == word[:-1]
        a, b = np.where(tail, stem[word], starts[word]), np.where(two[word] & ~tail, stem[word], ends[word])
        plain = simple[word] & ~tail
        h = tv.span_hashes(small(raw), a, b)
        # words as they stand and words made small are kept apart, and so are capitals in what isn't simple
        h[~plain] = tv.mix(tv.span_hashes(raw, a[~plain], b[~plain]) + np.uint64(1))
        moved = np.concatenate([[0], np.cumsum(1 + two)])
        return a, b, h, plain, moved[first]

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id after it, and each text's first (one more at the end)."""
        starts, ends, hashes, simple, first = self._split(raw, off)
        at, n = self.places(raw, starts, ends, hashes, simple)
        sizes = tv.sums(n, first) + 1
        begin = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(int(begin[-1]), dtype="<u4")
        total = int(n.sum())
        shift = np.cumsum(n) - n
        where = np.repeat(at - shift, n)
        where += np.arange(total)
        inner = np.ones(len(ids), dtype=bool)
        inner[begin[1:] - 1] = False
        ids[inner] = self.pool[where]
        ids[begin[1:] - 1] = end_id
        return ids, begin


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One for each file and worker process: what it has seen in one task helps in the next."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row."""

    def make():
        enc = encoder(tokenizer)

        def f(b: pa.RecordBatch):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, _, raw, off in tv.chunks(b.column(1)):
                ids, begin = enc.encode(raw, off, end_id)
                view = memoryview(ids.view(np.uint8))
                for k in range(len(off) - 1):
                    n = int(begin[k + 1] - begin[k])
                    for p in range(0, n, max_tokens):
                        a = int(begin[k]) + p
                        m = min(max_tokens, n - p)
                        rows.append(i + k)
                        piece.append(p // max_tokens)
                        start.append(p)
                        length.append(m)
                        crc.append(zlib.crc32(view[4 * a : 4 * (a + m)]))
            return {"doc_id": b.column(0).take(pa.array(rows, pa.int64())), "piece": np.array(piece, np.int32), "start": np.array(start, np.int64), "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(narrow(docs, doc_id=id_col, text=text_col), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Sequences for a histogram of lengths: patterns (lengths in order) with the number of sequences of each."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.left = np.zeros(size + 1, dtype=np.int64)
        for k, n in counts.items():
            self.left[k] += n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._pairs, self._age = None, 0
        for top in range(size, 0, -1):
            while self.left[top]:
                self._emit(top)

    def _has(self, *parts: int) -> bool:
        return all(self.left[p] >= parts.count(p) for p in set(parts))

    def _pair(self, gap: int, first: int = 0) -> tuple[int, int] | None:
        """Two lengths of which pieces are left, beside one of the first length, that make the gap, the longer one as long as can be."""
        a = np.arange(1, gap // 2 + 1)
        b = gap - a
        both = (a == b).astype(np.int64)
        ok = np.flatnonzero((self.left[a] > both + (a == first)) & (self.left[b] > both + (b == first)))
        return (int(b[ok[0]]), int(a[ok[0]])) if len(ok) else None

    def _sums(self) -> np.ndarray:
        """Sums of two lengths that were left not long ago; some may be gone."""
        if self._pairs is None or self._age > 256:
            have = (self.left > 0).astype(float)
            n = 1 << (2 * len(have)).bit_length()
            self._pairs = np.fft.irfft(np.fft.rfft(have, n) ** 2, n)[: self.size + 1] > 0.5
            self._age = 0
        self._age += 1
        return self._pairs

    def _triple(self, gap: int, firsts: np.ndarray) -> tuple[int, ...] | None:
        for x in firsts.tolist():
            pair = self._pair(gap - x, x)
            if pair:
                return (x, *pair)
        return None

    def _exact(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap]:
            return (gap,)
        pair = self._pair(gap)
        if pair:
            return pair
        if gap > 2:
            a = np.arange(gap - 2, 0, -1)
            hits = a[(self.left[a] > 0) & self._sums()[gap - a]]
            for k, x in enumerate(hits):
                if k == 24 and self._age > 1:  # sums that are gone: look only at those that there are now
                    self._age = 257
                    hits = hits[self._sums()[gap - hits]]
                    return self._triple(gap, hits[hits < x + 1])
                pair = self._pair(gap - int(x), int(x))
                if pair:
                    return (int(x), *pair)
        return None

    def _emit(self, top: int) -> None:
        parts, gap = [top], self.size - top
        self.left[top] -= 1
        while gap:
            more = self._exact(gap)
            if more is None:
                fits = np.flatnonzero(self.left[1 : gap + 1])
                if not len(fits):
                    break
                more = (int(fits[-1]) + 1,)
            for p in more:
                self.left[p] -= 1
                gap -= p
                parts.append(p)
        for p in parts:
            self.left[p] += 1
        times = min(int(self.left[p]) // parts.count(p) for p in set(parts))
        for p in parts:
            self.left[p] -= times
        self.patterns.append((tuple(parts), times))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every run of ranks of a length: its key (length << 40 | first rank), first sequence and offset, by key."""
        rank: dict[int, int] = defaultdict(int)
        out, base = [], 0
        for parts, times in self.patterns:
            at = 0
            for p in parts:
                out.append(((p << 40) | rank[p], base, at))
                rank[p] += times
                at += p
            base += times
        out.sort()
        key, seq, off = (np.array([x[i] for x in out], dtype=np.int64) for i in range(3))
        return key, seq, off


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, id_col, text_col, max_tokens, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by row too: neither a hot id nor copies of one row are in a single group
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # max_tokens rows at most
    key, seq, off = Plan({r["length"]: r["n"] for r in total}, max_tokens).runs()
    shared = spark.sparkContext.broadcast((key, seq, off))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")) - 1).join(shift, ["length", "salt"]).withColumn("r", F.col("r") + F.col("shift"))

    def make():
        key, seq, off = shared.value

        def f(b: pa.RecordBatch):
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            want = (cols["length"].to_numpy() << 40) | cols["r"].to_numpy()
            k = np.searchsorted(key, want, side="right") - 1
            return {n: cols[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": seq[k] + want - key[k], "offset": off[k]}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_rows(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "r"), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    out = written(out, "packed")
    dropped(cut)
    shared.destroy()
    return out
