"""Chunkers against a plain loop, and the properties that all of them have."""

import random

import pytest

from chunkloom.model import BLOCK, Block
from chunkloom.operators import chunking


def tokens(text):
    return -(-len(text.encode()) // 5)


def pack_loop(blocks, most, overlap):
    out, cur, prefix = [], [], None
    for b in blocks:
        if cur and sum(tokens(x.text) for x in cur) + tokens(b.text) > most:
            out.append((cur, prefix))
            tail, n = [], 0
            for x in reversed(cur):
                if n >= overlap:
                    break
                tail.insert(0, x.text)
                n += tokens(x.text)
            prefix, cur = "\n".join(tail), []
        cur = [*cur, b]
    return [*out, (cur, prefix)] if cur else out


def split(blocks, new):
    out = []
    for i, b in enumerate(blocks):
        if i == 0 or new(blocks[i - 1], b):
            out.append([])
        out[-1].append(b)
    return out


def loop(blocks, strategy, most, overlap):
    """(text, prefix, number of blocks) of each chunk."""
    if strategy == "by-structure":
        parts = pack_loop(blocks, most, overlap)
    else:
        new = (lambda a, b: b.element_type in ("title", "header")) if strategy == "by-title" else (lambda a, b: a.page != b.page)
        parts = []
        for s in split(blocks, new):
            parts += [(s, None)] if tokens("\n".join(x.text for x in s)) <= most else pack_loop(s, most, overlap)
    join = lambda p: "\n".join(x.text for x in p)
    return [(f"{pre}\n{join(p)}" if pre else join(p), pre, len(p)) for p, pre in parts]


def make(spark, docs):
    return spark.createDataFrame([(i, [b.row() | {"metadata": b.metadata} for b in d]) for i, d in docs.items()], f"doc_id long, blocks array<{BLOCK}>")


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé😀 ") for _ in range(rng.choice([0, 3, 30, 200])))
    return {i: [Block(rng.choice(["title", "narrative_text", "table", "header", "narrative_text"]), word(), page=rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(0, 30))] for i in range(40)}


@pytest.mark.parametrize("strategy", ["by-structure", "by-title", "by-page"])
@pytest.mark.parametrize("most,overlap", [(40, 0), (40, 15), (8, 4), (1000, 50)])
def test_like_a_loop(spark, docs, strategy, most, overlap):
    got = chunking.chunk(make(spark, docs), strategy, most, overlap).selectExpr("doc_id", "chunk_idx", "text", "overlap_prefix", "size(source_blocks) n").orderBy("doc_id", "chunk_idx").collect()
    want = [(i, k, *c) for i, d in docs.items() for k, c in enumerate(loop(d, strategy, most, overlap))]
    assert [tuple(r) for r in got] == want


def test_fixed_windows(spark):
    d = make(spark, {1: [Block("narrative_text", "é" * 100)], 2: [Block("narrative_text", "")], 3: []})
    got = chunking.chunk(d, "fixed", 10, 2).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.doc_id, r.chunk_idx, len(r.text), r.overlap_prefix) for r in got] == [(1, 0, 40, None), (1, 1, 48, "é" * 8), (1, 2, 44, "é" * 8), (1, 3, 12, "é" * 8)]


def test_no_overlap_loses_nothing(spark, docs):
    got = chunking.chunk(make(spark, docs), "by-structure", 30, 0).orderBy("doc_id", "chunk_idx").collect()
    for i, d in docs.items():
        assert [b.text for r in got if r.doc_id == i for b in r.source_blocks] == [b.text for b in d]


def test_title_hierarchy_and_confidence(spark):
    d = make(spark, {1: [Block("title", "T", hierarchy=["h1"]), Block("narrative_text", "x", confidence=0.7, page=3)]})
    r = chunking.chunk(d, "by-title", 100, 0).first()
    assert r.source_blocks[0].hierarchy == ["T"] and round(r.confidence, 4) == 0.7 and (r.page_start, r.page_end) == (1, 3)


def test_each_document_its_own_way(spark, docs):
    d = make(spark, docs).selectExpr("*", "case doc_id % 4 when 0 then 'by-structure' when 1 then 'by-title' when 2 then 'by-page' else 'fixed' end s", "20 m", "int(doc_id % 3) o")
    got = {(r.doc_id, r.chunk_idx): r.text for r in chunking.chunk_each(d, "s", "m", "o").collect()}
    for i, x in docs.items():
        if i % 4 < 3:
            want = loop(x, ("by-structure", "by-title", "by-page")[i % 4], 20, i % 3)
            assert [got[i, k] for k in range(len(want))] == [c[0] for c in want]


@pytest.mark.parametrize("most,overlap", [(8, 0), (8, 3), (8, 5), (8, 7), (8, 8), (8, 30), (1, 0)])
def test_windows_by_slices(spark, most, overlap):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = ["", "short", "é" * 7, "".join(rng.choice("ab\n\r\u2028😀é ") for _ in range(700)), "x" * (most * 4), "y" * (most * 4 + 1), "z" * 5 * most]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(w.text, w.prefix) for w in r.w] for r in df.select("i", chunking.windows(F.col("t"), F.lit(most), F.lit(overlap)).alias("w")).collect()}
    width, ov = most * 4, overlap * 4
    for i, t in enumerate(texts):
        if not t or tokens(t) <= most:
            assert got[i] == [(t, None)] * bool(t)
            continue
        starts = range(0, len(t), width - ov if width > ov else width)
        assert got[i] == [(t[s : s + width], t[max(0, s - ov) : s] if s and ov else None) for s in starts]


def test_windows_of_a_long_text_take_seconds(spark):
    import time

    from pyspark.sql import functions as F

    df = spark.range(1).select(F.repeat(F.lit("0123456789 abcdefghé "), 1_000_000).alias("t"))
    began = time.time()
    n, size = df.select(F.explode(chunking.windows(F.col("t"), F.lit(512), F.lit(50))).alias("w")).agg(F.count("w"), F.sum(F.length("w.text"))).first()
    assert n == -(-21_000_000 // 1848) and size > 21_000_000 and time.time() - began < 30
