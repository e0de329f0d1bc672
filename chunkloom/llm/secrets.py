"""Secret scans by grammar inference.

Base rules find assignments (password = ...), access keys and hexadecimal runs. The values that they find, with the rule as
label, and examples of a few public token formats are the labelled credentials: from those of each kind a prefix tree is
built, and its states are merged while their statistics are compatible (Hoeffding bounds, red and blue states), which gives
a probabilistic automaton of the format. Every other long token of the text with more than one class of characters is a
candidate; it is a secret of the kind whose automaton gives it the greatest likelihood, if that is no less than what the
automaton gives all but one in 200 of its own examples, and well above a bigram model of all candidates. Where the whole token is none,
its parts between signs (= / . - + _) are tried, from every sign to every later one, the longest first.

Every candidate is scored, whatever its length: beyond the lengths of an automaton's examples its likelihood of a symbol falls
by LENGTH_BITS for each factor of 1.5. Parts of a token are tried at lengths from 0.75 of the shortest to 1.5 of the longest
example, of which one in 200 at either end don't count.

Learning takes every distinct value of any length that a scan of all texts finds. Their prefixes are counted on the executors;
states are merged on the driver in the tree of the prefixes that the most values have (all prefixes while there are at most
tree of them; a rarer one is merged unseen with the start, as states too rare to be told apart are). Then all values pass through the automaton on the
executors: from them come its probabilities, its least likelihood and its lengths, and from all candidates the background. The
more values there are, the surer a difference of states must be, so that many comparisons don't make up differences. Then every
text is scanned whole, in one pass without a shuffle.

Defined cases: a null text counts as empty; an empty text has no spans; spans are in code points with the end exclusive, sorted
by start, then kind (assign, access, hex, inferred ones by name); of automata that accept a string the likeliest counts, of
equally likely ones the first by name; texts and tokens of any length are scanned whole; repeated rows are scanned one by one;
without any example the public formats alone are learned; other columns, whatever their names, are left alone; an empty table
gives none.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Scratch, batch_function, give_back, map_rows, narrow

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_CRED = np.zeros(256, dtype=bool)
_CRED[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_CLASS = np.zeros((3, 256), dtype=bool)
_CLASS[0, 48:58] = _CLASS[1, 65:91] = _CLASS[2, 97:123] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[58, 61]] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False
LEAST = 12
#: What a length beyond those seen costs, in bits a symbol for a factor of 1.5.
LENGTH_BITS = 0.35
#: Prefixes of a kind's values in the driver's tree, at most.
TREE = 100_000
#: Beyond so many examples the chance that equal states differ falls as their number grows.
FEW = 400
#: Where a credential can begin or end inside a token.
_CUT = re.compile(rb"[+/_.=-]")

#: Public token formats, as (fixed start, alphabet, length of the rest).
FORMATS = {
    "github": ("ghp_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 36),
    "google": ("AIza", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", 35),
    "slack": ("xoxb-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-", 48),
    "stripe": ("sk_live_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 24),
}


def format_examples(n: int = 150) -> dict[str, list[str]]:
    rng = random.Random(3)
    return {k: [a + "".join(rng.choice(b) for _ in range(c)) for _ in range(n)] for k, (a, b, c) in FORMATS.items()}


def _runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs within a text, of at least so many bytes."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]).astype(np.int8))
    begin, stop = edge[:-1] > 0, edge[1:] < 0
    inner = off[(off > 0) & (off < len(mask))]
    begin[inner] |= mask[inner]
    stop[inner - 1] |= mask[inner - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= least
    return a[long], b[long]


def base_spans(raw: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int, int, int]]]:
    """Of every text its (start, kind, end, value start, value end), sorted, in bytes of raw."""
    found: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(len(off) - 1)]
    data = raw.tobytes()
    for k in np.unique(np.searchsorted(off, np.flatnonzero(_SIGN[raw]), side="right") - 1):
        for m in _ASSIGN.finditer(data, off[k], off[k + 1]):
            if m.end(2) - m.start(2) >= LEAST:
                found[k].append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    at = data.find(b"AKIA")
    while at >= 0:
        k = int(np.searchsorted(off, at, side="right")) - 1
        for m in _ACCESS.finditer(data, off[k], off[k + 1]):
            if m.end() - m.start() >= 18:
                found[k].append((m.start(), 1, m.end(), m.start(), m.end()))
        at = data.find(b"AKIA", off[k + 1])
    a, b = _runs(_HEX[raw], off, 16)
    for k, s, e in zip(np.searchsorted(off, a, side="right") - 1, a.tolist(), b.tolist(), strict=True):
        found[k].append((s, 2, e, s, e))
    for x in found:
        x.sort()
    return found


def _mixed_runs(raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of long tokens with two classes of characters (a capital at the start doesn't count)."""
    a, b = _runs(_CRED[raw], off, LEAST)
    many = np.zeros(len(a), dtype=np.int64)
    for k, cls in enumerate(_CLASS):
        total = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(cls[raw], out=total[1:])
        many += total[b] - total[a + (k == 1)] > 0
    a, b = a[many >= 2], b[many >= 2]
    return list(zip((np.searchsorted(off, a, side="right") - 1).tolist(), a.tolist(), b.tolist(), strict=True))


def candidates(raw: np.ndarray, off: np.ndarray, base: list[list[tuple[int, int, int, int, int]]]) -> list[tuple[int, int, int]]:
    """(text, start, end) of the tokens that could be credentials: long, with two classes of characters (a capital at the
    start doesn't count) and no part in a base span."""
    out = []
    for k, s, e in _mixed_runs(raw, off):
        if not any(x[0] < e and s < x[2] for x in base[k]):
            out.append((k, s, e))
    return out


def parts(raw: np.ndarray, off: np.ndarray, base: list[list[tuple[int, int, int, int, int]]]) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of credential characters without the base spans in them, of at least LEAST bytes."""
    out = []
    for k, s, e in _mixed_runs(raw, off):
        for x in base[k]:
            if x[0] < e and s < x[2]:
                if x[0] - s >= LEAST:
                    out.append((k, s, x[0]))
                s = max(s, x[2])
        if e - s >= LEAST:
            out.append((k, s, e))
    return out


def mixed(s: bytes) -> bool:
    """Whether there are two classes of characters, without a capital at the start."""
    x = np.frombuffer(s, np.uint8)
    return sum(bool(x.any()) for x in (_CLASS[0, x], _CLASS[1, x[1:]], _CLASS[2, x])) >= 2


@dataclass
class Automaton:
    """A probabilistic deterministic automaton: next[state][symbol] and log2 probabilities; -1 is the end."""

    next: list[dict[int, int]]
    logp: list[dict[int, float]]
    shortest: int
    longest: int
    #: Least mean log2 likelihood of a symbol for an accepted string.
    least: float = -99.0
    #: What an unseen symbol costs.
    unseen: float = -12.0

    def score(self, s: bytes) -> float:
        """Mean log2 probability of a symbol, the end included."""
        state, total = 0, 0.0
        for c in s:
            p = self.logp[state].get(c)
            if p is None:  # a symbol that the examples don't have here: the state stays
                total += self.unseen
            else:
                total += p
                state = self.next[state][c]
        total += self.logp[state].get(-1, self.unseen)
        return total / (len(s) + 1)

    def surprise(self, n: int) -> float:
        """What a length costs, in bits a symbol."""
        return LENGTH_BITS * max(0.0, math.log(self.shortest / max(n, 1)), math.log(n / self.longest) if n else 0.0) / math.log(1.5)

    def ends(self, s: bytes, start: int, stops: list[int]) -> list[tuple[int, float]]:
        """Of the stops, in order, those at which the string from start is accepted, with its score."""
        state, total, out, at = 0, 0.0, [], start
        worst = self.least * (1.5 * self.longest + 1)
        for stop in stops:
            n = stop - start
            if n > 1.5 * self.longest:
                break
            while at < stop:
                p = self.logp[state].get(s[at])
                if p is None:
                    total += self.unseen
                else:
                    total += p
                    state = self.next[state][s[at]]
                at += 1
                if total < worst:  # no later symbol makes up for it
                    return out
            if n >= 0.75 * self.shortest:
                got = (total + self.logp[state].get(-1, self.unseen)) / (n + 1) - self.surprise(n)
                if got >= self.least:
                    out.append((stop, got))
        return out


@dataclass
class Tree:
    """Of every prefix the next ones by symbol, how many examples go on with each, end there, and those of which this is known."""

    child: list[dict[int, int]] = field(default_factory=lambda: [{}])
    passed: list[dict[int, int]] = field(default_factory=lambda: [defaultdict(int)])
    ended: list[int] = field(default_factory=lambda: [0])
    count: list[int] = field(default_factory=lambda: [0])

    def add(self, q: int, c: int) -> int:
        self.child[q][c] = len(self.child)
        self.child.append({})
        self.passed.append(defaultdict(int))
        self.ended.append(0)
        self.count.append(0)
        return self.child[q][c]

    @staticmethod
    def of(examples: list[bytes]) -> Tree:
        t = Tree()
        for s in examples:
            q = 0
            t.count[0] += 1
            for c in s:
                t.passed[q][c] += 1
                q = t.child[q][c] if c in t.child[q] else t.add(q, c)
                t.count[q] += 1
            t.ended[q] += 1
        return t

    @staticmethod
    def from_rows(rows: dict[int, list[tuple[int, int, int]]]) -> Tree:
        """rows: by a prefix' hash the (symbol, how many, hash of the longer prefix), -1 for the end."""
        t, todo = Tree(), [(0, 0)]
        while todo:
            q, h = todo.pop()
            for c, n, longer in sorted(rows.get(h, ())):
                t.count[q] += n
                if c < 0:
                    t.ended[q] += n
                else:
                    t.passed[q][c] += n
                    todo.append((t.add(q, c), longer))
        return t


def states(tree: Tree, alpha: float = 0.01) -> list[dict[int, int]]:
    """Merge compatible states of a prefix tree (ALERGIA): of each state the next one by symbol. The tree is used up."""
    child, passed, ended, count = tree.child, tree.passed, tree.ended, tree.count
    alpha *= min(1.0, FEW / max(count[0], 1))
    wide = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > wide * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            n1, n2 = count[x], count[y]
            if min(n1, n2) < 4 and ((x, y) != (a, b) or not min(n1, n2)):
                continue
            if differ(ended[x], n1, ended[y], n2):
                return False
            for c in passed[x].keys() | passed[y].keys():
                if differ(passed[x].get(c, 0), n1, passed[y].get(c, 0), n2):
                    return False
                if c in child[x] and c in child[y]:
                    stack.append((child[x][c], child[y][c]))
        return True

    def merge(into: int, b: int) -> None:
        stack = [(into, b)]
        while stack:
            x, y = stack.pop()
            if x == y:
                continue
            count[x] += count[y]
            ended[x] += ended[y]
            for c, n in passed[y].items():
                passed[x][c] += n
            for c, t in child[y].items():
                if c in child[x]:
                    stack.append((child[x][c], t))
                else:
                    child[x][c] = t

    red, blue = [0], [(0, c) for c in sorted(child[0])]
    while blue:
        blue.sort(key=lambda e: -count[child[e[0]][e[1]]])
        q, c = blue.pop(0)
        b = child[q][c]
        if b in red:
            continue
        home = next((r for r in red if compatible(r, b)), None)
        if home is None:
            red.append(b)
        else:
            child[q][c] = home
            merge(home, b)
        known = set(red)
        blue = [(r, x) for r in red for x in child[r] if child[r][x] not in known]
    number = {r: i for i, r in enumerate(red)}
    return [{c: number[t] for c, t in child[r].items()} for r in red]


def walked(nexts: list[dict[int, int]], values: list[bytes]) -> np.ndarray:
    """How often the values leave each state by each symbol, or end there (the last column). Without a way on they go to the start."""
    out = [[0] * 257 for _ in nexts]
    for s in values:
        q = 0
        for c in s:
            out[q][c] += 1
            q = nexts[q].get(c, 0)
        out[q][256] += 1
    return np.array(out, np.int64)


def fitted(nexts: list[dict[int, int]], walks: np.ndarray) -> Automaton:
    """The automaton with the probabilities of the walks; bounds are still to come."""
    logs = []
    for q, n in zip(nexts, walks, strict=True):
        total = float(n.sum()) + 0.5
        ways = np.flatnonzero(n[:256]).tolist()
        for c in ways:
            q.setdefault(c, 0)
        for c in q.keys() - set(ways):
            del q[c]
        logs.append({c: math.log2(n[c] / total) for c in q} | ({-1: math.log2(n[256] / total)} if n[256] else {}))
    return Automaton(nexts, logs, 1, 1)


def spared(n: int) -> int:
    """How many of n examples a bound leaves out."""
    return n // 200


def infer(examples: list[bytes], alpha: float = 0.01) -> Automaton:
    """The automaton of some examples."""
    nexts = states(Tree.of(examples), alpha)
    out, k = fitted(nexts, walked(nexts, examples)), spared(len(examples))
    sizes = sorted(len(s) for s in examples)
    out.shortest, out.longest = sizes[k], sizes[-1 - k]
    out.least = sorted(out.score(s) for s in examples)[k] - 0.35
    return out


@dataclass
class Model:
    automata: dict[str, Automaton]
    #: log2 probabilities of a character after another in candidates at large.
    background: np.ndarray = field(default_factory=lambda: np.full((256, 256), -8.0))
    #: Bits by which a symbol must be likelier than in the background.
    gain: float = 0.5

    def kind(self, s: bytes) -> tuple[str, float] | None:
        b = np.frombuffer(b"\0" + s, np.uint8)
        plain = float(self.background[b[:-1], b[1:]].sum()) / (len(s) + 1)
        best = None
        for name, a in self.automata.items():
            got = a.score(s) - a.surprise(len(s))
            if got >= a.least and got - plain >= self.gain and (best is None or got > best[1]):
                best = (name, got)
        return best

    def within(self, s: bytes) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, likelihood) of the secrets in a token: itself, or parts of it that don't overlap, longest first."""
        whole = self.kind(s) if mixed(s) else None
        if whole:
            return [(0, len(s), *whole)]
        cuts = [m.start() for m in _CUT.finditer(s)]
        if not cuts or not mixed(s):
            return []
        x = np.frombuffer(s, np.uint8)
        pairs = np.concatenate([[0.0, 0.0], np.cumsum(self.background[x[:-1], x[1:]])])
        found = []
        stops = [*cuts, len(s)]
        for start in [0, *(c + 1 for c in cuts)]:
            later = stops[bisect.bisect_left(stops, start + LEAST) :]
            if not later:
                break
            for name, a in self.automata.items():
                for stop, got in a.ends(s, start, later):
                    plain = (self.background[0, x[start]] + pairs[stop] - pairs[start + 1]) / (stop - start + 1)
                    if got - plain >= self.gain and mixed(s[start:stop]):
                        found.append((start, stop, name, got))
        out: list[tuple[int, int, str, float]] = []
        for f in sorted(found, key=lambda f: (f[0] - f[1], -f[3])):
            if all(f[1] <= o[0] or o[1] <= f[0] for o in out):
                out.append(f)
        return out


def _values(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct values of the base rules' finds by kind, and candidates."""

    def make():
        def f(b: pa.RecordBatch):
            kinds, values = [], []
            for _, _, raw, off in tv.chunks(b.column(0)):
                base = base_spans(raw, off)
                for x in base:
                    for _, k, _, s, e in x:
                        kinds.append(KINDS[k])
                        values.append(raw[s:e].tobytes().decode())
                for _, s, e in candidates(raw, off, base):
                    kinds.append("candidate")
                    values.append(raw[s:e].tobytes().decode())
            return {"kind": pa.array(kinds, pa.string()), "value": pa.array(values, pa.string())}

        return f

    return map_rows(narrow(docs, text=text_col), make, "kind string, value string").distinct()


def _background(values: DataFrame) -> np.ndarray:
    """How often a character follows another, or begins, in all candidates."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for _, _, raw, off in tv.chunks(b.column(0)):
                before = np.concatenate([[0], raw[:-1]]).astype(np.int64)
                before[off[:-1][np.diff(off) > 0]] = 0
                total += np.bincount(before << 8 | raw, minlength=1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    got = values.where("kind = 'candidate'").select("value").mapInArrow(run, "part binary").toArrow()["part"].to_pylist()
    return sum((np.frombuffer(x, np.int64) for x in got), np.zeros(1 << 16, np.int64)).reshape(256, 256)


def _prefixes(values: DataFrame) -> DataFrame:
    """kind, prefix and longer (hashes), symbol that makes it longer, -1 at the end, n values, and total of the prefix."""
    from pyspark.sql import Window

    def run(batches):
        for b in batches:
            for i, _, raw, off in tv.chunks(b.column(1), 1 << 18):
                row = np.repeat(np.arange(len(off) - 1), np.diff(off) + 1)
                at = np.arange(len(row)) - row
                h = tv.span_hashes(raw, off[row], at).view(np.int64)
                symbol = np.append(raw, 0).astype(np.int16)[at]
                symbol[at == off[row + 1]] = -1
                for a in range(0, len(row), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    longer = h[a + 1 : a + 1 + (1 << 16)]
                    longer = np.where(symbol[part] < 0, 0, np.append(longer, np.zeros(len(row[part]) - len(longer), np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[part] + i)), pa.array(h[part]), pa.array(symbol[part]), pa.array(longer)], names=["kind", "prefix", "symbol", "longer"])

    rows = values.mapInArrow(run, "kind string, prefix long, symbol short, longer long").groupBy("kind", "prefix", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("longer").alias("longer"))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy("kind", "prefix")))


def _trees(prefixes: DataFrame, most: int) -> dict[str, Tree]:
    """Of each kind the tree of its most frequent prefixes, at most so many rows."""
    sizes = defaultdict(list)
    for r in prefixes.groupBy("kind", "total").count().toArrow().to_pylist():
        sizes[r["kind"]].append((r["total"], r["count"]))
    out = {}
    for k, totals in sorted(sizes.items()):
        totals.sort(reverse=True)
        held, least = 0, totals[0][0]
        for total, rows in totals:
            held += rows
            if held > most:
                break
            least = total
        rows = defaultdict(list)
        got = prefixes.where((F.col("kind") == k) & (F.col("total") >= least)).select("prefix", "symbol", "n", "longer").toArrow()
        for h, c, n, longer in zip(*(got[c].to_pylist() for c in got.column_names), strict=True):
            rows[h].append((c, n, longer))
        out[k] = Tree.from_rows(rows)
    return out


def _walks(values: DataFrame, nexts: dict[str, list[dict[int, int]]]) -> dict[str, np.ndarray]:
    """The walks of all values through the states of their kinds."""

    def run(batches):
        total = {k: np.zeros((len(x), 257), np.int64) for k, x in nexts.items()}
        for b in batches:
            by = defaultdict(list)
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[k].append(v.encode())
            for k, v in by.items():
                total[k] += walked(nexts[k], v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["kind", "part"])
        give_back()

    out = {k: np.zeros((len(x), 257), np.int64) for k, x in nexts.items()}
    got = values.mapInArrow(run, "kind string, part binary").toArrow()
    for k, x in zip(got["kind"].to_pylist(), got["part"].to_pylist(), strict=True):
        out[k] += np.frombuffer(x, np.int64).reshape(out[k].shape)
    return out


def learn(docs: DataFrame, text_col: str = "text", tree: int = TREE) -> Model:
    """Automata of all values that the base rules find, and of the public formats. tree: prefixes of a kind that the driver holds, at most."""
    scratch = Scratch()
    values = scratch(_values(docs, text_col), "values")
    plain = _background(values) + 0.05
    model = Model({}, np.log2(plain / plain.sum(axis=1, keepdims=True)))
    found = values.where("kind <> 'candidate'")
    nexts = {k: states(t) for k, t in _trees(scratch(_prefixes(found), "prefixes"), tree).items() if t.count[0] >= 8}
    if nexts:
        found = found.where(F.col("kind").isin(*nexts))
        automata = {k: fitted(nexts[k], w) for k, w in _walks(found, nexts).items()}

        def make():
            return lambda b: {"kind": b.column(0), "size": pa.array([len(v) for v in b.column(1).to_pylist()], pa.int64()), "score": pa.array([automata[k].score(v.encode()) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.float64())}

        scores = scratch(map_rows(found, make, "kind string, size long, score double"), "scores")
        sizes = defaultdict(list)
        for r in scores.groupBy("kind", "size").count().toArrow().to_pylist():
            sizes[r["kind"]].append((r["size"], r["count"]))
        for k, a in sorted(automata.items()):
            size, times = np.array(sorted(sizes[k])).T
            upto = np.cumsum(times)
            skip = spared(int(upto[-1]))
            low = scores.where(F.col("kind") == k).orderBy("score").limit(skip + 1).agg(F.max("score")).first()[0]
            a.least = low - 0.35
            a.shortest, a.longest = (int(size[np.searchsorted(upto, x, side="right")]) for x in (skip, upto[-1] - 1 - skip))
            model.automata[k] = a
    scratch.close()
    for k, v in format_examples().items():
        model.automata[k] = infer([x.encode() for x in v])
    return model


def find(column: pa.Array, model: Model) -> list[list[tuple[int, int, str, int, float | None]]]:
    """Of every text its spans (start, order of kind, kind, end, likelihood; None for base rules), sorted, in code points."""
    out: list[list[tuple[int, int, str, int, float | None]]] = []
    for _, _, raw, off in tv.chunks(column):
        base = base_spans(raw, off)
        points = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(_LEAD[raw], out=points[1:])
        own = [[(s, k, KINDS[k], e, None) for s, k, e, _, _ in x] for x in base]
        for k, s, e in parts(raw, off, base):
            for i, j, kind, got in model.within(raw[s:e].tobytes()):
                own[k].append((s + i, 9, kind, s + j, got))
        out += [[(int(points[s] - points[off[i]]), o, k, int(points[e] - points[off[i]]), g) for s, o, k, e, g in sorted(x, key=lambda y: y[:3])] for i, x in enumerate(own)]
    return out


def joined(spans: list[tuple[int, int, str, int, float | None]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in spans)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, span digests and the spans themselves for every row."""

    def make():
        def f(b: pa.RecordBatch):
            found = find(b.column(1), model)
            base = [[x for x in s if x[4] is None] for s in found]
            cols = {f"n_{k}": np.array([sum(x[1] == i for x in s) for s in base], dtype=np.int64) for i, k in enumerate(KINDS)}
            return {
                "doc_id": b.column(0), **cols, "base_sha256": pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()), "spans": pa.array([joined(s) for s in found], pa.string()),
                "n_inferred": np.array([len(s) - len(t) for s, t in zip(found, base, strict=True)], dtype=np.int64),
            }

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(narrow(docs, doc_id=id_col, text=text_col), make, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long")


def blanked(text: str, spans: list[tuple[int, int, str, int, float | None]], mark: str) -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, _, _, e, _ in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with secrets replaced by the mark, and the column of text lengths, if there is one, brought up to date.

    Texts alone go to Python, and only those that change come back.
    """
    names = [c for c in docs.columns]

    def make():
        def f(texts: pa.Array) -> pa.Array:
            found = find(texts, model)
            return pa.array([blanked(texts[i].as_py(), s, mark) if s else None for i, s in enumerate(found)], pa.string())

        return f

    changed = f"_changed{len(names)}"
    while changed in names:
        changed += "_"
    rows = docs.withColumn(changed, batch_function(make, "string")(docs[text_col]))
    new = {text_col: F.coalesce(F.col(changed), F.col(f"`{text_col}`"))}
    if chars_col in names:
        new[chars_col] = F.when(F.col(changed).isNotNull(), F.length(changed).cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"`{chars_col}`"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])
