"""Near-duplicate detection by MinHash with tensored banding; candidates are confirmed on full sets.

A document's set is its distinct two-word shingles. Two collections of HALVES half keys (each of WIDTH minhashes) are
computed once; the table keys are all pairs of a half key of the first and one of the second, so HALVES**2 tables cost
2 * HALVES * WIDTH minhashes and no more. At similarity s a pair meets in some table unless all half keys of a collection
differ: it is missed with probability 2 * (1 - s**WIDTH)**HALVES, which is about 1e-5 at s = 0.8 and falls fast above.
A table key can't be shared unless both of its halves are, so half keys of one class alone are dropped before pairs of them
are made; that loses nothing, and few table keys remain.

Documents with equal sets are one class from the start, whatever their ids. Classes that share a table key are compared with
one of the key's members (a star, never all pairs); what that links is joined to components. Where a key still holds more than
one component, their members are joined by an exact prefix filter: with the shingles of every set in one order, rare ones
first (by a sketch of fixed size), two sets as similar as required share one among the first few of each. Only pairs that do
are compared, so no link is left out, and a family of texts that share a template but are not similar enough has next to none.
Before sets are fetched, the 2 * HALVES * WIDTH minhashes, a byte of each, are compared: pairs that agree in fewer than
AGREE of them are no candidates (at s = 0.8 a pair is lost so with probability 3e-6).
Sets of candidates meet in groups of bounded size, two blocks of a family of candidates each.

Defined cases: null texts, and texts without words, have an empty set and are linked with nothing, not even with other texts
of their id; a text of one word has that word as its only shingle; a row with a null id is linked with nothing and kept; rows
with the same id belong together, whether their texts are equal or not, and so do all rows that any of them is linked with;
the order of rows doesn't matter; an empty table gives no rows; texts of any length are compared whole; columns beside id and
text, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Scratch, binaries, dropped, give_back, lists, map_rows, narrow, written

HALVES, WIDTH = 12, 2
#: Rows and bytes of ids up to which a side is sent to all executors or to the driver; above, the same is done by shuffles.
FEW_ROWS, FEW_BYTES = 400_000, 16 << 20
#: Shingles of the sets that meet in a group come from two blocks of about so many each.
BLOCK = 1 << 20
#: Bits of the sketch that orders shingles by the number of sets that hold them.
RARITY_BITS = 20
#: Of 48 minhashes, those in which the pair must agree. At another threshold than 80 percent: the same deviations below the mean.
AGREE = 25


def least_agreement(threshold: int) -> int:
    n, p = 2 * HALVES * WIDTH, threshold / 100
    return max(0, min(AGREE if threshold == 80 else n, int(n * p - 4.85 * (n * p * (1 - p)) ** 0.5)))

_rng = np.random.default_rng(8128)
_A = _rng.integers(1, 1 << 63, 2 * HALVES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_X = _rng.integers(1, 1 << 63, 2 * HALVES * WIDTH, dtype=np.uint64)


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, one text after another, and each text's first (one more at the end)."""
    _, _, h, first = tv.words(raw, off)
    row = tv.row_of(first)
    pair = tv.chain(h, 2)
    ok = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    alone = np.flatnonzero(np.diff(first) == 1)
    sh = np.concatenate([pair[ok], tv.mix(h[first[alone]] + np.uint64(12345))])
    rows = np.concatenate([row[:-1][ok], alone])
    order = np.argsort(sh)
    order = order[np.argsort(rows[order].astype(np.uint16 if len(off) < 60000 else np.int64), kind="stable")]
    sh, rows = sh[order], rows[order]
    fresh = np.ones(len(sh), dtype=bool)
    fresh[1:] = (sh[1:] != sh[:-1]) | (rows[1:] != rows[:-1])
    sh, rows = sh[fresh], rows[fresh]
    return sh, np.searchsorted(rows, np.arange(len(off)))


def digests(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set; 0 for an empty one."""
    has = np.diff(first) > 0
    out = np.zeros((2, len(has)), np.uint64)
    if has.any():
        out[0, has] = np.add.reduceat(tv.mix(sh + np.uint64(1)), first[:-1][has])
        out[1, has] = np.add.reduceat(tv.mix(sh ^ np.uint64(0xA5A5A5A55A5A5A5A)), first[:-1][has])
    return out[0], out[1]


def sketch(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each whole set; of each non-empty set its half keys (rows of 2 * HALVES) and a byte of each minhash."""
    has = np.diff(first) > 0
    at = first[:-1][has]
    s1, s2 = digests(sh, first)
    keys = np.zeros((int(has.sum()), 2 * HALVES), np.uint64)
    small = np.zeros((int(has.sum()), 2 * HALVES * WIDTH), np.uint8)
    if len(at):
        for k in range(2 * HALVES):
            h = np.full(len(at), k, dtype=np.uint64)
            for t in range(k * WIDTH, (k + 1) * WIDTH):
                low = np.minimum.reduceat((sh ^ _X[t]) * _A[t], at)
                small[:, t] = tv.mix(low) & np.uint64(255)
                h = tv.mix(h + low)
            keys[:, k] = h
    return s1, s2, keys, small


def _sketches(docs: DataFrame, kind: str) -> DataFrame:
    def make():
        def f(b: pa.RecordBatch):
            n, s1, s2, keys, small = [], [], [], [], []
            for _, _, raw, off in tv.chunks(b.column(1)):
                sh, first = shingles(raw, off)
                x, y, k, bits = sketch(sh, first)
                small.append(bits.ravel())
                n.append(np.diff(first))
                s1.append(x.view(np.int64))
                s2.append(y.view(np.int64))
                keys.append(k.view(np.int64).ravel())
            n = np.concatenate(n)
            where = np.concatenate([[0], np.cumsum((n > 0) * (2 * HALVES))])
            return {"id": b.column(0), "n": n.astype(np.int64), "s1": np.concatenate(s1), "s2": np.concatenate(s2), "halves": lists(np.concatenate(keys), where, pa.int64()), "bytes": binaries(np.concatenate(small), where * WIDTH)}

        return f

    return map_rows(docs, make, f"id {kind}, n long, s1 long, s2 long, halves array<bigint>, bytes binary")


def _few(rows: DataFrame, *ids: str) -> bool:
    """Whether the rows, with ids of any type, are few enough to be sent to all executors."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(sum((F.sum(F.octet_length(F.col(c).cast("string"))) for c in ids), F.lit(0)), F.lit(0))).first()
    return n <= FEW_ROWS and size <= FEW_BYTES


def _alike(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose minhashes agree often enough."""
    least = least_agreement(threshold)
    one, two = (classes.select(F.col("u").alias(i), F.col("n").alias(f"n_{i}"), F.col("bytes").alias(x)) for i, x in ("ax", "by"))
    both = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (tv.text_buffer(b.column(k))[0].reshape(b.num_rows, -1) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.mapInArrow(run, "a long, b long")


def _sets(nodes: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """u and sh, the whole set in ascending order, of the classes in nodes (column u). A class can come more than once."""
    want = scratch(classes.join(nodes, "u", "left_semi").select("u", "id", "s1"), "wanted")
    rows = texts.join(F.broadcast(want) if _few(want, "id") else want, "id").select("u", "s1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            own, s1 = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for i, j, raw, off in tv.chunks(b.column(2)):
                sh, first = shingles(raw, off)
                # another text of the same id has another digest
                use = [k for k in np.flatnonzero(digests(sh, first)[0].view(np.int64) == s1[i:j]).tolist() if own[i + k] not in seen]
                seen.update(own[i + k] for k in use)
                yield pa.RecordBatch.from_arrays([pa.array([own[i + k] for k in use], pa.int64()), binaries(sh, first).take(pa.array(use, pa.int64()))], names=["u", "sh"])
        give_back()

    return scratch(rows.mapInArrow(run, "u long, sh binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, classes: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose similarity is at least threshold percent.

    Classes that candidate pairs connect are a family. Its members are in blocks of bounded size, and the sets of two blocks meet
    where pairs lie between them: so a set is sent as often as its family has blocks, and not once for every pair.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    family = nodes.join(components(pairs, scratch), "u", "left").select("u", F.coalesce("comp", "u").alias("family")).join(classes.select("u", "n"), "u")
    family = scratch(family, "families")
    blocks = family.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    placed = scratch(family.join(blocks, "family").select("u", "family", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("block")), "placed")
    one, two = placed.select(F.col("u").alias("a"), "family", F.col("block").alias("p")), placed.select(F.col("u").alias("b"), F.col("block").alias("q"))
    lies = scratch(pairs.join(one, "a").join(two, "b").select("family", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "a", "b"), "lies")
    want = scratch(lies.select("family", "i", "j", F.explode(F.array("a", "b")).alias("u")).distinct(), "meeting")
    here = sets.join(F.broadcast(want) if _few(want) else want, "u").select("family", "i", "j", F.lit(0).alias("role"), F.col("u").alias("a"), F.lit(None).cast("long").alias("b"), "sh")
    rows = here.unionByName(lies.select("family", "i", "j", F.lit(1).alias("role"), "a", "b", F.lit(None).cast("binary").alias("sh")))
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "role", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, {}
        for batch in batches:
            where = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            role, a, b = (batch.column(k).to_pylist() for k in range(3, 6))
            raw, off = tv.text_buffer(batch.column(6))
            left, right = [], []
            for k in range(batch.num_rows):
                if group != where[k]:
                    group, own = where[k], {}
                if role[k] == 0:
                    own[a[k]] = raw[off[k] : off[k + 1]].view(np.uint64).copy()
                    continue
                x, y = own.get(a[k]), own.get(b[k])
                if x is None or y is None:
                    raise RuntimeError("a set of a candidate pair is missing")
                n, m = len(x), len(y)
                if n < m:
                    x, y = y, x
                both = int((x[np.minimum(np.searchsorted(x, y), max(n, m) - 1)] == y).sum())
                if 100 * both >= threshold * (n + m - both):
                    left.append(a[k])
                    right.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        give_back()

    return scratch(rows.mapInArrow(run, "a long, b long").distinct(), "links")


def rarity(sets: DataFrame) -> np.ndarray:
    """For every value of the first RARITY_BITS bits of a shingle, how many sets' shingles have it (a set counts once for each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            raw, off = tv.text_buffer(b.column(0))
            for i, j in tv.spans_of_rows(off):
                total += np.bincount((raw[off[i] : off[j]].view(np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "c"])

    got = sets.select("sh").mapInArrow(run, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << RARITY_BITS, np.int64)
    out[got["slot"].to_numpy()] = got["c"].to_numpy()
    return out


def prefix_lengths(n: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles of a set of n are looked at for a partner that is not larger, and for one that is not smaller."""
    return n - -(-threshold * n // 100) + 1, n - -(-2 * threshold * n // (100 + threshold)) + 1


def _prefix_pairs(members: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members (u, comp) of different components that can be similar enough: all that are, and few others.

    Of two sets with a similarity of t the larger has one of its first n - t n + 1 shingles in common with the first
    m - 2 t m / (1 + t) + 1 of the smaller, whatever the order, if it is one order for all.
    """
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast(rarity(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            raw, off = tv.text_buffer(b.column(2))
            u, comp = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in tv.spans_of_rows(off):
                sh, n = raw[off[i] : off[j]].view(np.uint64), np.diff(off[i : j + 1]) // 8
                first = np.concatenate([[0], np.cumsum(n)])
                row = tv.row_of(first)
                times = often[(sh >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                order = np.lexsort((sh, times, row))
                place = np.arange(len(sh)) - first[row]
                far, near = (x[row] for x in prefix_lengths(n, threshold))
                use = (place < far) & (times[order] > 1)  # what one set alone has is shared by none
                at, r = order[use], row[use]
                yield pa.RecordBatch.from_arrays([pa.array(sh[at].view(np.int64)), pa.array(u[i:j][r]), pa.array(comp[i:j][r]), pa.array(n[r]), pa.array(place[use] < near[use])], names=["g", "u", "comp", "n", "near"])
        give_back()

    rows = members.join(sets, "u").select("u", "comp", "sh").mapInArrow(run, "g long, u long, comp long, n long, near boolean")
    rows = scratch(rows.distinct(), "prefixes")
    mixed = rows.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("near").alias("z")).where("x != y and z").select("g")
    rows = rows.join(mixed, "g", "left_semi")
    one, two = rows.select("g", *[F.col(c).alias(f"{c}_a") for c in ("u", "comp", "n")]), rows.where("near").select("g", *[F.col(c).alias(f"{c}_b") for c in ("u", "comp", "n")])
    both = one.join(two, "g").where(f"comp_a != comp_b and (n_b < n_a or n_b = n_a and u_b < u_a) and 100 * n_b >= {threshold} * n_a")
    pairs = scratch(both.select(F.least("u_a", "u_b").alias("a"), F.greatest("u_a", "u_b").alias("b")).distinct(), "near")
    shared.destroy()
    return pairs


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """u and comp, the smallest number that it reaches, of every number in an edge (a, b) whose comp is another.

    Few edges are joined on the driver; more by alternating large and small stars, which shuffles edges only.
    """
    spark = edges.sparkSession
    if edges.count() <= FEW_ROWS:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        got = edges.toArrow()
        for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        found = [(x, root(x)) for x in list(up)]
        return spark.createDataFrame(pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "comp": pa.array([y for _, y in found], pa.int64())}))
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").where("u != m").unionByName(low.select("u", "m")).select("u", F.col("m").alias("v")).distinct()
        new = written(small, "edges")
        same = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        done = same(new) == same(now)
        dropped(now)
        if done:
            scratch.made.append(new)
            return new.select("u", F.col("v").alias("comp"))
        now = new


def _table_keys(classes: DataFrame) -> DataFrame:
    """u and key of every class' table keys whose two halves other classes have too."""
    halves = classes.select("u", F.posexplode("halves").alias("k", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    kept = halves.join(shared, "half", "left_semi").groupBy("u").agg(F.collect_list(F.struct("k", "half")).alias("h"))  # 2 * HALVES at most
    side = lambda k: F.transform(F.filter("h", lambda x: (x.k >= HALVES) == F.lit(bool(k))), lambda x: x.half)
    return kept.select("u", F.explode(F.flatten(F.transform(side(0), lambda x: F.transform(side(1), lambda y: F.xxhash64(x, y))))).alias("key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; threshold is the least similarity in percent."""
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch()
    texts = narrow(docs, id=id_col, text=text_col)
    rows = scratch(_sketches(texts, kind), "sketches")
    usable = rows.where("n > 0 and id is not null")
    classes = usable.groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "halves", "bytes")).alias("m")).select(F.monotonically_increasing_id().alias("u"), "n", "s1", "s2", "m.*")
    classes = scratch(classes, "classes")  # u numbers the classes once for all
    keys = scratch(_table_keys(classes), "keys")
    shared = keys.groupBy("key").agg(F.min("u").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "a")
    buckets = scratch(keys.join(shared, "key").select("key", "a", "u"), "buckets")
    pairs = scratch(buckets.where("u != a").select("a", F.col("u").alias("b")).distinct(), "pairs")
    alike = scratch(_alike(pairs, classes, threshold), "alike")
    sets = _sets(alike.select(F.explode(F.array("a", "b")).alias("u")).distinct(), classes, texts, scratch)
    edges = _confirmed(alike, sets, classes, threshold, scratch)
    # Rows of one id belong together: its classes are linked as they are.
    several = usable.groupBy("id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x != y").select("id")
    several = scratch(several, "several")
    if not several.isEmpty():
        own = usable.join(several, "id").select("id", "n", "s1", "s2").distinct().join(classes.select("u", "n", "s1", "s2"), ["n", "s1", "s2"]).select("id", "u")
        own = scratch(own, "own")
        edges = edges.unionByName(own.join(own.groupBy("id").agg(F.min("u").alias("a")), "id").where("u != a").select("a", F.col("u").alias("b")))
    label = scratch(components(edges, scratch), "label")
    # Keys that still hold several components.
    marked = buckets.join(label, "u", "left").select("key", "u", F.coalesce("comp", "u").alias("comp"))
    open_keys = marked.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    members = scratch(marked.join(open_keys, "key", "left_semi").select("u", "comp").distinct(), "open")
    if not members.isEmpty():
        open_sets = _sets(members.select("u"), classes, texts, scratch)
        near = _prefix_pairs(members, open_sets, threshold, scratch)
        more = scratch(_alike(near.join(pairs, ["a", "b"], "left_anti"), classes, threshold), "more")
        if not more.isEmpty():
            label = scratch(components(edges.unionByName(_confirmed(more, open_sets, classes, threshold, scratch)), scratch), "label")
    named = classes.select("u", "id", "n", "s1", "s2").join(label, "u", "left").select("id", "n", "s1", "s2", F.coalesce("comp", "u").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("least"))
    members = rows.select("id", "n", "s1", "s2").join(named.join(least, "comp").select("n", "s1", "s2", "least"), ["n", "s1", "s2"], "left")
    comp = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("least")).otherwise(F.col("id"))
    out = written(members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept")), "neardup")
    scratch.close()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: one of the group's smallest id.

    Of several rows with that id the smallest by their columns' hashes stays. Rows with a null id are all kept, and so are those
    without words.
    """
    found = near_duplicates(docs, id_col, text_col, threshold)
    ids = written(found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept").select(F.col("doc_id").alias("_id"), "n", "kept"), "settled")
    dropped(found)

    def rows_of(chosen: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(chosen) if _few(chosen, "_id") else chosen
        return docs.join(side, (docs[id_col] == side["_id"]) & docs[text_col].rlike(r"[^\x20\x09-\x0D]"), how)

    rest = rows_of(ids.select("_id"), "left_anti")
    again = written(ids.where("kept").select("_id"), "again")
    if again.isEmpty():
        return rest
    cols = [F.col(f"`{c}`") for c in docs.columns]
    one = rows_of(again, "left_semi").groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("_row"))
    return rest.unionByName(one.select("_row.*"))
