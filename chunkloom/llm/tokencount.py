"""Token counts by trie-shared dynamic programming.

Words (split at white space, with the word mark before each) are segmented into the likeliest pieces of a public vocabulary
under a unigram model. The distinct words of a batch are put in a trie, level by level in arrays; the forward score of a
prefix (best log probability of its segmentations) and its number of pieces are computed once per node, whichever words
share it, and each word takes those of its terminal node. Words met before in the task are looked up.

The vocabulary is read, never trained: a piece's log probability is that of its rank in the public file under Zipf's law.
A byte that no piece covers costs one token of probability exp(UNSEEN).

One pass, no shuffle. Defined cases: null and empty texts have 0 tokens; words of any length are handled (those longer than
LONG bytes one by one); repeated rows are counted one by one; of segmentations with equal scores the one with the shorter
last piece counts; an empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import map_rows, narrow

MARK = "▁".encode()
UNSEEN = -25.0
LONG = 96
_T = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece model file with log probabilities by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    scale = math.log(sum(1 / (r + 3) for r in range(len(pieces))))
    return {p.encode(): -math.log(r + 3) - scale for r, p in enumerate(pieces)}


class Trie:
    """The vocabulary, by piece length: hashes and scores."""

    def __init__(self, vocab: dict[bytes, float]):
        self.vocab = vocab
        self.longest = max(map(len, vocab), default=0)
        self.power = np.cumprod(np.full(max(self.longest, 1), 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            own = [p for p in vocab if len(p) == n]
            if own:
                b = np.frombuffer(b"".join(own), np.uint8).reshape(-1, n)
                h = (_T[b[:, ::-1]] * self.power[:n]).sum(axis=1, dtype=np.uint64)
                o = np.argsort(h)
                self.by[n] = h[o], np.array([vocab[p] for p in own])[o]

    def one(self, word: bytes, block: int = 1 << 16) -> tuple[int, float]:
        """Tokens and score of a single word, of any length: the pieces at all places are looked up in arrays, block by block."""
        m = np.concatenate([np.zeros(self.longest, np.uint8), np.frombuffer(word, np.uint8)])
        score, n = [0.0], [0]
        for low in range(0, len(word), block):
            ends = np.arange(low, min(low + block, len(word))) + 1
            h = np.zeros(len(ends), dtype=np.uint64)
            hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for k in range(1, min(len(word), self.longest) + 1):
                h += _T[m[self.longest + ends - k]] * self.power[k - 1]
                if k in self.by:
                    keys, vals = self.by[k]
                    j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    at = np.flatnonzero((keys[j] == h) & (ends >= k))
                    hits.append((at, np.full(len(at), k), vals[j[at]]))
            at, size, value = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((size, at))
            first = np.searchsorted(at[order], np.arange(len(ends) + 1)).tolist()
            size, value = size[order].tolist(), value[order].tolist()
            for i in range(len(ends)):
                d = low + i + 1
                best, count = score[d - 1] + UNSEEN, n[d - 1] + 1
                for x in range(first[i], first[i + 1]):
                    s = score[d - size[x]] + value[x]
                    if s > best:
                        best, count = s, n[d - size[x]] + 1
                score.append(best)
                n.append(count)
        return n[-1], score[-1]

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of distinct words."""
        tokens, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                tokens[i], scores[i] = self.one(w)
        if not short:
            return tokens, scores
        order = sorted(short, key=words.__getitem__)
        size = np.array([len(words[i]) for i in order])
        deep = int(size.max())
        m = np.zeros((deep, len(order)), dtype=np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        col = np.repeat(np.arange(len(order)), size)
        m[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), col] = flat
        at = np.array(order)
        fresh = np.zeros(len(order), dtype=bool)  # differs from the word before within this depth
        fresh[0] = True
        node = [np.zeros(len(order), dtype=np.int32)]
        fwd, num = [np.zeros(1)], [np.zeros(1, np.int64)]
        for d in range(1, deep + 1):
            fresh[1:] |= m[d - 1, 1:] != m[d - 1, :-1]
            alive = size >= d
            rep = np.flatnonzero(fresh & alive)
            # a word of exactly the shared prefix sorts first, so that a node's first word is always alive where the node is
            node.append((np.cumsum(fresh & alive) - 1).astype(np.int32))
            best = fwd[d - 1][node[d - 1][rep]] + UNSEEN
            n = num[d - 1][node[d - 1][rep]] + 1
            h = np.zeros(len(rep), dtype=np.uint64)
            for k in range(1, min(d, self.longest) + 1):
                h += _T[m[d - k, rep]] * self.power[k - 1]
                if k in self.by:
                    keys, vals = self.by[k]
                    j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = np.flatnonzero(keys[j] == h)
                    if len(hit):
                        prev = node[d - k][rep[hit]]
                        s = fwd[d - k][prev] + vals[j[hit]]
                        win = s > best[hit]
                        best[hit[win]] = s[win]
                        n[hit[win]] = num[d - k][prev[win]] + 1
            fwd.append(best)
            num.append(n)
            done = np.flatnonzero(size == d)
            tokens[at[done]], scores[at[done]] = n[node[d][done]], best[node[d][done]]
        return tokens, scores


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 400_000) -> DataFrame:
    """n_tokens, n_words, n_bytes and the log probability of every row's best segmentation."""

    def make():
        trie = Trie(vocabulary(model_path))
        known = {"k": np.zeros(0, np.uint64), "t": np.zeros(0, np.int64), "s": np.zeros(0)}

        def f(b: pa.RecordBatch):
            tokens, words, logs, sizes = [], [], [], []
            for _, _, raw, off in tv.chunks(b.column(1), 4 << 20):
                starts, ends, h, first = tv.words(raw, off, lower=False)
                uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
                if len(known["k"]) > remembered:
                    known.update(k=np.zeros(0, np.uint64), t=np.zeros(0, np.int64), s=np.zeros(0))
                k = np.searchsorted(known["k"], uniq)
                old = np.zeros(len(uniq), dtype=bool)
                inside = k < len(known["k"])
                old[inside] = known["k"][k[inside]] == uniq[inside]
                new = np.flatnonzero(~old)
                if len(new):
                    data = raw.tobytes()
                    t, s = trie.many([MARK + data[starts[i] : ends[i]] for i in at[new]])
                    into = k[new]
                    known.update(k=np.insert(known["k"], into, uniq[new]), t=np.insert(known["t"], into, t), s=np.insert(known["s"], into, s))
                    k = np.searchsorted(known["k"], uniq)
                tokens.append(tv.sums(known["t"][k][back], first))
                logs.append(tv.sums(known["s"][k][back], first))
                words.append(np.diff(first))
                sizes.append(np.diff(off))
            return {"doc_id": b.column(0), "n_tokens": np.concatenate(tokens), "n_words": np.concatenate(words), "n_bytes": np.concatenate(sizes), "log_prob": np.round(np.concatenate(logs), 6)}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(narrow(docs, doc_id=id_col, text=text_col), make, f"doc_id {kind}, n_tokens long, n_words long, n_bytes long, log_prob double")
