"""The pipeline against its stages by hand, and the operators' queries against their SQL."""

import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chunkloom.llm import decontam, queries, secrets
from test_brute_force import verdict_by_hand
from test_operators import WORD, quality_by_hand

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def by_hand(spark, docs, items):
    """(doc_id, piece, start, length, crc32) of what run() returns, from a list of (doc_id, text), one stage after another."""
    # quality rules
    docs = [(d, t) for d, t in docs for n, _, _, _, r in [quality_by_hand(t)] if n >= 10 and 100 * r <= 20 * n and verdict_by_hand(t) == "ok"]
    stages = [len(docs)]
    # near duplicates
    sets = {d: set(itertools.pairwise(WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t)))) for d, t in docs}
    comp = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = comp[a], comp[b]
            comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    docs = [(d, t) for d, t in docs if comp[d] == d]
    stages.append(len(docs))
    # benchmark: every item against every whole text
    how = decontam.Retrieval()
    found = []
    for text in items:
        w = decontam.word_hashes(text)
        found.append(decontam.Item(0, w, w[-max(3, len(w) // 5) :]))
    docs = [(d, t) for d, t in docs if not any(x.check(decontam.word_hashes(t), how)[2] for x in found)]
    stages.append(len(docs))
    # secrets
    model = secrets.learn(spark.createDataFrame(docs, "doc_id long, text string"))
    clean = []
    for d, t in docs:
        spans = secrets.find(pa.array([t]), model)[0]
        hidden = [False] * len(t)
        for s, _, _, e, _ in spans:
            hidden[s:e] = [True] * (e - s)
        # spans that touch without overlapping have a mark each
        cuts = {s for s, _, _, e, _ in spans if not any(x < s < y for x, _, _, y, _ in spans)}
        out = []
        for i, c in enumerate(t):
            if hidden[i] and (i in cuts or not i or not hidden[i - 1]):
                out.append("[SECRET]")
            elif not hidden[i]:
                out.append(c)
        clean.append((d, "".join(out)))
    # packing
    encode = Tokenizer.from_file(queries.vocabulary_file("word_bpe_49k.json")).encode
    rows = []
    for d, t in clean:
        ids = [*encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            rows.append((d, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    return rows, stages, dict(clean)


def test_run_by_hand(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if decontam.word_hashes(r.text or "").size]
    want, stages, clean = by_hand(spark, docs, items)
    assert len(docs) > stages[0] > stages[1] > stages[2] and any("[SECRET]" in t for t in clean.values())
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    for _, own in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in got), key=lambda x: x[0]):
        end = 0
        for _, offset, length in own:
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 4096) + 2


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
        ids = now
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns


def test_stages_with_odd_rows(spark):
    rng = np.random.default_rng(61)
    text, other = (" ".join("".join(rng.choice(list("etaoinshrdlu"), 6)) for _ in range(60)) for _ in range(2))
    rows = [(1, text, "en", None, None), (1, text, "en", None, None), (2, text + " more", None, "s", 3), (None, other, None, None, None), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _changed string")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.where("false"), SF)
        assert none.count() == 0, name
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == none.columns and docs.columns[-1] == "_changed"
            assert sorted(str(r.doc_id) for r in docs.collect()) == (["1", "1", "2", "None"] if k == 0 else ["1", "None"]), name
    assert {(r.doc_id, r.piece) for r in docs.collect()} == {(1, 0), (None, 0)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_decontamination_fits_its_space_on_all_passages(spark, tmp_path, monkeypatch):
    rng, seen = np.random.default_rng(8), []
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 320)) for _ in range(300)]
    item = " ".join(f"w{x}" for x in range(500))
    docs = spark.createDataFrame(list(enumerate([*texts, f"so {item} on"])), "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    real = decontam.latent_space
    monkeypatch.setattr(decontam, "latent_space", lambda passages, *a: seen.append(passages.collect()) or real(passages, *a))
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()} == set(range(300))
    assert sum(len(r.sizes) for r in seen[0]) == 300 * 20 + 32


def test_decontamination_takes_nothing_from_a_sample(spark, tmp_path, monkeypatch):
    # the mean weight of other words is that of all of them, and the space is the same whichever passages are looked at first
    rng, means, spaces = np.random.default_rng(9), [], []
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 160)) + " " + " ".join(f"o{int(x)}" for x in rng.zipf(1.3, 80) % 3000) for _ in range(200)]
    items = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    statistics, space, keep = decontam._statistics, decontam.latent_space, 1
    monkeypatch.setattr(decontam, "_statistics", lambda *a: (got := statistics(*a), means.append(got[2]))[0][:3] + (got[3].limit(4096 * keep), got[4]))
    monkeypatch.setattr(decontam, "latent_space", lambda *a: spaces.append(space(*a)) or spaces[-1])
    for keep in (1, 0):
        assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 200
    own = {w for i in items for w in i.split()}
    others = [[w for w in t.split() if w not in own] for t in texts]
    words, df = np.unique([w for t in others for w in set(t)], return_counts=True)
    squares = dict(zip(words.tolist(), (np.maximum(0, np.log((200 - df + 0.5) / (df + 0.5))) ** 3).tolist(), strict=True))
    assert means == pytest.approx([np.mean([squares[w] for t in others for w in t])] * 2, rel=1e-9)
    assert np.array_equal(*spaces)
