"""Near-duplicate detection: repeated ids, large groups, families of one template, the ways for many rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from chunkloom.llm import neardup
from chunkloom.llm import textvec as tv


def edited(words, rng, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"e{rng.integers(1 << 40)}"
    return out


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w)} if len(w) == 1 else set(itertools.pairwise(w))


def by_hand(rows):
    """Component of each row (id, text): rows with words and an id are joined by id and by similarity."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for i, j in itertools.combinations(live, 2):
        if rows[i][0] == rows[j][0] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i in live:
        least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return sorted((str(d), least[root(i)] if i in live else d) for i, (d, _) in enumerate(rows))


def result(spark, rows, kind="long"):
    got = neardup.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3))
    return sorted(((str(r.doc_id), r.component_id) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(21)
    a, b = ([f"{c}{x}" for x in rng.integers(0, 1 << 30, 120)] for c in "ab")
    return {"A": " ".join(a), "B": " ".join(b), "a": " ".join(edited(a, rng, 5)), "b": " ".join(edited(b, rng, 5))}


@pytest.mark.parametrize("turned", [False, True])
def test_texts_of_one_id(spark, pair, turned):
    rows = [(1, pair["A"]), (1, pair["B"]), (2, pair["a"]), (3, pair["b"]), (1, ""), (2, pair["a"]), (None, pair["A"]), (4, None)]
    got = result(spark, rows[::-1] if turned else rows)
    assert got == sorted(by_hand(rows), key=str)
    assert {c for d, c in got if d in "123"} == {1}


def test_ids_of_another_type(spark, pair):
    rows = [("x", pair["A"]), ("m", pair["a"]), ("k", pair["B"]), ("z", pair["b"]), ("q", "")]
    assert result(spark, rows, "string") == sorted(by_hand(rows), key=str)


@pytest.mark.parametrize("few", [0, 400_000])
def test_large_groups(spark, monkeypatch, few):
    # a star of many partners in blocks of a few, chains of edits, a hot exact copy, and both ways of joining
    monkeypatch.setattr(neardup, "FEW_ROWS", few)
    monkeypatch.setattr(neardup, "BLOCK", 700)
    rng = np.random.default_rng(22)
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, 150)]
    rows = [(i, " ".join(edited(base, rng, 3))) for i in range(10, 70)]
    chain = [f"c{x}" for x in rng.integers(0, 1 << 30, 150)]
    for i in range(100, 112):
        rows.append((i, " ".join(chain)))
        chain = edited(chain, rng, 8)
    rows += [(i, rows[3][1]) for i in range(200, 240)] + [(300 + i, f"alone {i} x{i} y{i}") for i in range(20)]
    assert result(spark, rows) == sorted(by_hand(rows), key=str)


def test_keep_one(spark, pair):
    rows = [(1, pair["A"], "p"), (1, pair["A"], "q"), (1, pair["B"], "r"), (2, pair["a"], "s"), (3, pair["b"], "t"), (None, pair["A"], "u"), (None, pair["A"], "u"), (7, "other words", "v"), (8, None, "w"), (8, "", "x"), (9, pair["A"], "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = neardup.keep_one(d)
    kept = sorted(map(tuple, got.collect()), key=str)
    assert got.columns == d.columns
    assert [r for r in kept if r[0] != 1] == sorted([r for r in rows if r[0] in (None, 7, 8)], key=str)
    assert len([r for r in kept if r[0] == 1]) == 1 and [r for r in kept if r[0] == 1][0] in rows
    assert neardup.keep_one(d.where("false")).count() == 0


def test_a_family_of_one_template_has_few_pairs(spark, monkeypatch):
    # texts that share half of their shingles and no more: candidates must not grow with the square of the family
    seen = {}
    real = neardup._prefix_pairs

    def counted(members, *rest):
        out = real(members, *rest)
        seen[members.count()] = out.count()
        return out

    monkeypatch.setattr(neardup, "_prefix_pairs", counted)
    rng = np.random.default_rng(23)
    template = [f"t{x}" for x in range(200)]
    for n in (100, 300, 900):
        rows = [(i, " ".join(template + [f"o{x}" for x in rng.integers(0, 1 << 40, 90)])) for i in range(n)]
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got.where("not kept").count() == 0
    assert all(pairs <= 2 * members for members, pairs in seen.items()), seen


def test_prefixes_lose_nothing():
    # any two sets as similar as required share one of their first shingles, whatever the order
    rng = np.random.default_rng(24)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        both = rng.permutation(1000)[: n + 20]
        x, y = set(both[:n].tolist()), set(both[int(rng.integers(0, 8)) : n + int(rng.integers(0, 8))].tolist())
        if not y or 100 * len(x & y) < 80 * len(x | y):
            continue
        large, small = sorted((x, y), key=len, reverse=True)
        far, near = neardup.prefix_lengths(np.array([len(large)]), 80)[0][0], neardup.prefix_lengths(np.array([len(small)]), 80)[1][0]
        assert set(sorted(large)[:far]) & set(sorted(small)[:near])


def test_long_texts(spark):
    rng = np.random.default_rng(25)
    words = [f"w{x}" for x in rng.integers(0, 1 << 40, 500_000)]
    assert len(" ".join(words)) > 5 << 20
    rows = [(1, " ".join(words)), (2, " ".join(edited(words, rng, 1000))), (3, " ".join(words[: len(words) // 2]))]
    assert [c for _, c in result(spark, rows)] == [1, 1, 3]
    sh, first = neardup.shingles(*tv.text_buffer(pa.array([rows[0][1]])))
    assert first.tolist() == [0, len(shingle_set(rows[0][1]))] and (np.diff(sh.astype(object)) > 0).all()
