"""Operators do the whole job: nothing is lost as corpora and benchmarks grow."""

import numpy as np
import pyarrow as pa

from chunkloom.llm import decontam, packing, secrets


def test_leaks_among_rare_words(spark):
    # words of the items are in many texts, all others in one: by the cosine with the whole window nothing is near
    rng = np.random.default_rng(3)
    items = {i: [f"c{x}" for x in rng.permutation(60)[:14]] for i in range(4)}
    rows, want = [], set()
    for d in range(600):
        own = [f"u{d}x{j}" for j in range(90)]
        if d % 20 == 0:
            i = d // 20 % 4
            w = list(items[i])
            if d % 40 == 0:
                w[1] = w[4] = f"z{d}"
            own[40:40] = w
            want.add((d, i))
        else:
            for j in sorted(rng.integers(0, 90, 25)):
                own[j] = f"c{rng.integers(60)}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(d, i) for d, t in rows for i, w in items.items() if decontam.Item(i, decontam.word_hashes(" ".join(w)), decontam.word_hashes(" ".join(w[-3:]))).check(decontam.word_hashes(t), decontam.Retrieval())[2]}
    assert got >= want


def test_answers_at_the_end_of_a_text():
    # a fifth of the words, the answer, at the end; 40 % of the others replaced
    rng, lost = np.random.default_rng(5), []
    for k in range(300):
        n = int(rng.integers(40, 160))
        w = np.arange(1, n + 1).astype(np.uint64)
        item = decontam.Item(0, w, w[-max(3, n // 5) :])
        leak, head = w.copy(), n - len(item.answer)
        leak[rng.choice(head, int(0.4 * head), replace=False)] = 1000 + k
        text = np.concatenate([5000 + np.arange(200 + k), leak]).astype(np.uint64)
        if not item.check(text, decontam.Retrieval())[2]:
            lost.append(k)
    assert not lost


def test_any_stretch_may_hold_the_answer():
    w = np.arange(1, 21).astype(np.uint64)
    item = decontam.Item(0, w, w[-4:])
    filler = 500 + np.arange(60)
    # fourteen words without the answer, and elsewhere twelve with it
    text = np.concatenate([w[:14], filler, w[:8], w[-4:], filler]).astype(np.uint64)
    share, answered, bad = item.check(text, decontam.Retrieval())
    assert bad and share == 0.6 and answered == 1


def test_the_space_follows_the_items(spark, monkeypatch):
    rng, seen = np.random.default_rng(6), []
    items = [" ".join(f"w{x}" for x in rng.integers(0, 2500, 24)) for _ in range(500)]
    docs = spark.createDataFrame([(d, " ".join(f"w{x}" for x in rng.integers(0, 2500, 120)) + (" " + items[d] if d < 20 else "")) for d in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    real = decontam.latent_space

    def space(passages, ids, idf, *rest):
        out = real(passages, ids, idf, *rest)
        for x in ids:
            v = np.bincount(x, minlength=len(idf)) * idf
            seen.append(np.linalg.norm(v @ out) / np.linalg.norm(v))
        return out

    monkeypatch.setattr(decontam, "latent_space", space)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(d, d) for d in range(20)}
    assert len(seen) == 500 and np.median(seen) > 0.74


def test_secrets_joined_to_other_text():
    model = secrets.Model({k: secrets.infer([x.encode() for x in v]) for k, v in secrets.format_examples().items()})
    for name, fresh in secrets.format_examples(400).items():
        lost, alone = 0, sum(model.kind(x.encode()) is None for x in fresh[200:])
        for x in fresh[200:]:
            for before, after in (("GH=", ""), ("https://h.org/?key=", ""), ("//host/", "/v1/x"), ("deadbeefdeadbeef0123/", ""), ("a.b-", ".json")):
                text = f"see {before}{x}{after} end"
                got = secrets.find(pa.array([text]), model)[0]
                lost += not any(k in secrets.FORMATS and s <= text.index(x) and e >= text.index(x) + len(x) for s, _, k, e, _ in got)
        assert lost <= 5 * alone + 50, (name, lost, alone)
    plain = ["https://www.example.org/docs/2024/10/index.html?page=12", "src/main/java/org/apache/Some_Class.java", "state-of-the-art/one.two.three=4"]
    assert secrets.find(pa.array(plain), model) == [[], [], []]


def test_every_exact_triple_is_found():
    # brute force over small sets of lengths, with sums that are still those of all lengths
    rng = np.random.default_rng(7)
    for _ in range(40):
        plan = packing.Plan({}, 400)
        plan.left[rng.integers(1, 400, 60)] = 1
        plan._sums()
        plan.left[rng.permutation(400)[:330] + 1] = 0
        have = np.flatnonzero(plan.left).tolist()
        for gap in range(3, 400, 7):
            any_left = gap in have or any(gap - x in have and gap - x != x for x in have) or any(gap - x - y in have and len({x, y, gap - x - y}) == 3 for x in have for y in have)
            got = plan._exact(gap)
            assert (got is not None) == any_left
            assert got is None or (sum(got) == gap and plan._has(*got))


def test_triples_beyond_the_first_24():
    plan = packing.Plan({}, 1000)
    # sums of the first 30 lengths are gone; 100 + 150 + 250 is left
    plan.left[[*range(450, 480), *range(10, 26)]] = 1
    plan.left[[100, 150, 250]] = 1
    plan._sums()
    plan.left[10:26] = 0
    got = plan._exact(500)
    assert got is not None and sorted(got) == [100, 150, 250]
