"""Decontamination: items of all lengths, several blocks and passes, ids of other types, rows without an id, long texts."""

import numpy as np
import pytest

from chunkloom.llm import decontam


def words(rng, n, kind="w"):
    return [f"{kind}{x}" for x in rng.integers(0, 1 << 20, n)]


@pytest.mark.parametrize("how", [decontam.Retrieval(), decontam.Retrieval(block_items=4, block_words=400, memory=1)])
def test_items_of_all_lengths(spark, how, monkeypatch):
    rng = np.random.default_rng(31)
    items = {f"i{k}": words(rng, n, "q") for k, n in enumerate((5, 8, 12, 20, 40, 90, 250, 700, 1500, 3000, 5000))}
    rows, want = [], set()
    for d, (name, item) in enumerate(items.items()):
        leak = list(item)
        body = words(rng, 300)
        rows.append((f"d{d}", " ".join(body[:150] + leak + body[150:])))
        want.add((f"d{d}", name))
        if len(item) >= 20:  # a fifth of the words replaced
            for j in rng.choice(len(item) * 4 // 5, len(item) // 5, replace=False):
                leak[j] = f"z{j}"
            rows.append((f"p{d}", " ".join(body[:60] + leak + body[60:])))
            want.add((f"p{d}", name))
        rows.append((f"n{d}", " ".join(body + item[: len(item) // 3])))
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id string, text string")
    passes = []
    real = decontam.searches
    monkeypatch.setattr(decontam, "searches", lambda *a: (passes.append(s) or (s, n) for s, n in real(*a)))
    got = decontam.contaminated(docs, bench, how=how)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert (len(passes) == 1) == (how.memory > 1)
    assert {r.doc_id for r in decontam.remove_contaminated(docs, bench, how=how).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_rows_without_an_id_and_repeated_ones(spark):
    rng = np.random.default_rng(32)
    item = words(rng, 30, "q")
    leak, clean = " ".join(words(rng, 50) + item + words(rng, 50)), " ".join(words(rng, 120))
    rows = [(None, leak, 1), (None, clean, 2), (1, leak, 3), (1, clean, 4), (1, leak, 5), (2, None, 6), (2, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (None, clean)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs.where("doc_id is not null"), bench).collect()) == [(1, 1)]
    assert {r.item for r in decontam.remove_contaminated(docs, bench).collect()} == {2, 4, 6, 7}


def test_paraphrases(spark):
    # recall by the share of words replaced, the answer (a fifth, at the end) left
    rng = np.random.default_rng(33)
    items = {k: words(rng, int(rng.integers(15, 60)), "q") for k in range(40)}
    rows = []
    for share in (0.1, 0.2, 0.3, 0.4):
        for k, item in items.items():
            leak, head = list(item), len(item) - max(3, len(item) // 5)
            for j in rng.choice(head, int(share * head), replace=False):
                leak[j] = f"z{j}"
            body = words(rng, 200)
            rows.append((f"{share}-{k}", " ".join(body[:90] + leak + body[90:])))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id int, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, int(d.split("-")[1])) for d, _ in rows}
    assert decontam.contaminated(docs, bench).schema["item_id"].dataType.simpleString() == "int"


def test_long_text(spark):
    rng = np.random.default_rng(34)
    item = words(rng, 25, "q")
    body = words(rng, 700_000)
    docs = spark.createDataFrame([(1, " ".join(body[:690_000] + item + body[690_000:])), (2, " ".join(body))], "doc_id long, text string")
    assert len(" ".join(body)) > 5 << 20
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(docs, bench).collect()] == [1]


def test_the_sample_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(35)
    vocab = np.unique(decontam.word_hashes(" ".join(f"w{x}" for x in range(300))))
    docs = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 300, 400)),) for _ in range(60)], "text string")
    how = decontam.Retrieval(sample=200)
    got = [decontam._statistics(docs.repartition(n), vocab, how, decontam.Scratch())[3].collect() for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 200


def test_the_space_is_that_of_all_passages(spark, monkeypatch):
    # many more passages than the iteration starts with, on many themes: the space is the exact one of all passages and items
    rng, seen = np.random.default_rng(36), []
    texts = [" ".join(f"w{t % 50 * 30 + x}" for x in rng.integers(0, 30, 120)) for t in range(400)]
    items = [" ".join(f"w{x}" for x in rng.integers(0, 1500, 400)) for _ in range(8)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    how = decontam.Retrieval(sample=64, rank=40)
    real = decontam.latent_space
    monkeypatch.setattr(decontam, "latent_space", lambda *a: seen.append(real(*a)) or seen[-1])
    list(decontam.searches(docs, bench, "text", "item_id", "text", None, how))
    vocab = np.unique(np.concatenate([decontam.word_hashes(x) for x in items]))
    number = {int(h): k for k, h in enumerate(vocab)}
    numbers = [[number[h] for h in decontam.word_hashes(t).tolist() if h in number] for t in texts]
    df = np.bincount(np.concatenate([list(set(x)) for x in numbers]), minlength=len(vocab))
    weights = how.weights(df, len(texts))
    rows = []
    for t in texts:
        h = decontam.word_hashes(t).tolist()
        rows += [np.bincount([number[x] for x in h[a : a + 16] if x in number], minlength=len(vocab)) * weights for a in range(0, len(h), 16)]
    corpus, own = np.array(rows), np.array([np.bincount([number[x] for x in decontam.word_hashes(i).tolist()], minlength=len(vocab)) * weights for i in items])
    corpus, own = (x[np.linalg.norm(x, axis=1) > 0] for x in (corpus, own))
    corpus, own = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (corpus, own))
    whole = corpus.T @ corpus * (how.sample / len(corpus)) + 9 * own.T @ own
    best = np.sort(np.linalg.eigvalsh(whole))[-40:].sum()
    (space,) = seen
    assert len(corpus) > 40 * how.sample and np.trace(space.T @ whole @ space) > 0.995 * best
