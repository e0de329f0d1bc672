"""Exact token counts against a loop over the published merge rule."""

import base64

import pytest
import regex

from chunkloom.operators.tokens import bpe_tokens

P = pytest.importorskip("public_tokenizers")


def count(text, ranks):
    """Tokens of a text: in each piece of the pattern the pair of lowest rank is merged, the leftmost first, until there is none."""
    total = 0
    for piece in regex.findall(P.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert b"".join(parts) == piece.encode() and all(p in ranks for p in parts)
        total += len(parts)
    return total


def test_counts_equal_the_merge_loop(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    texts = ["", " ", "hello world", "Don't stop  me\n\n now", "naïve café 漢字 😀👩‍👩‍👧", "x" * 300, "1234567890 3.14", "tabs\tand\r\nlines\n", "<|endoftext|>", "ſtraße ΑΒΓ иван"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() if r.text]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", bpe_tokens("text").alias("n")).collect()}
    assert {i: got[i] for i in range(len(texts))} == {i: count(t, ranks) for i, t in enumerate(texts)} and got[999] in (0, None)
