"""Quality rules by compression bands.

A text's zstandard ratio (compressed bytes over bytes) is compared with limits that depend on its length: below the band
it repeats itself, above it it is close to random. The same is done for fixed chunks of the text, so that a bad part of a
long document isn't hidden by the rest: a document is rejected if a given share of its chunks is out of band.

One pass, no shuffle: nothing about a document depends on another.

Defined cases: a null text counts as empty; an empty text has ratio 0 and no words and is rejected by the base rule;
texts of any length are compressed whole; repeated rows and ids are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import batch_function, map_rows, narrow


@dataclass(frozen=True)
class Bands:
    """limits: (bytes from which they hold, least ratio, greatest ratio), ascending.

    The lower limits are about six tenths of what prose of that length has, the upper ones lie between prose and base64 of
    random bytes (about 0.76 for long texts). Below the first entry the frame's own bytes decide the ratio: no band.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (64, 0.40, 1.20), (128, 0.36, 1.05), (256, 0.34, 0.92), (512, 0.32, 0.85), (1024, 0.29, 0.78),
        (2048, 0.27, 0.74), (4096, 0.25, 0.72), (8192, 0.24, 0.72), (16384, 0.22, 0.72), (65536, 0.20, 0.72),
    )
    level: int = 3
    chunk_bytes: int = 4096
    #: A last chunk shorter than this is judged with the one before it.
    least_chunk: int = 1024
    #: Rejected from this share of chunks out of band.
    bad_share: float = 0.25

    def check(self, size: int, ratio: float) -> int:
        """-1 below the band, 1 above it, else 0."""
        low, high = 0.0, 9.9
        for at, a, b in self.limits:
            if size >= at:
                low, high = a, b
        return -1 if ratio < low else int(ratio > high)


RULE_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long, verdict string"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, and which of the sorted ones equal the one before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(keys), dtype=bool)
    if len(keys):
        same[1:] = s[1:] == s[:-1]
    return order, same


def base_counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Word, symbol and repetition counts of some texts (see the query's contract)."""
    n = len(off) - 1
    starts, _, h, first = tv.words(raw, off, lower=False)
    row = tv.row_of(first)
    solid = tv.NONSPACE[raw]
    out = {
        "n_words": np.diff(first),
        "word_chars": tv.sums((solid & _LEAD[raw]).astype(np.int64), off),
        "n_symbols": tv.sums(_SYMBOL[raw].astype(np.int64), off),
    }
    ls, le, lh, lfirst = tv.words(raw, off, word_byte=_LINE, lower=False)
    seen = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(solid, out=seen[1:])
    real = seen[le] > seen[ls]
    lrow = tv.row_of(lfirst)[real]
    order, same = _repeats(lh[real] ^ tv.mix(lrow.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(lrow[order][same], minlength=n)
    repeated = np.zeros(len(h) + 1, dtype=np.int64)
    grams = tv.chain(h, 5)
    if len(grams):
        at = np.flatnonzero(row[: len(grams)] == row[4:])
        order, same = _repeats(grams[at] ^ tv.mix(row[at].astype(np.uint64)))
        many = same.copy()
        many[:-1] |= same[1:]
        hit = at[order[many]]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + 5, -1)
    out["n_repeat_words"] = tv.sums((np.cumsum(repeated)[:-1] > 0).astype(np.int64), first) if len(h) else np.zeros(n, np.int64)
    return out


def judge(text: memoryview | bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float, int, int, str]:
    """Ratio of the whole text, its chunks, those out of band, and the verdict."""
    size = len(text)
    if not size:
        return 0.0, 0, 0, "ok"
    ratio = len(z.compress(text)) / size
    whole = bands.check(size, ratio)
    n = max(1, size // bands.chunk_bytes + (size % bands.chunk_bytes >= bands.least_chunk))
    low = high = 0
    if n > 1:
        for k in range(n):
            part = text[k * bands.chunk_bytes : size if k == n - 1 else (k + 1) * bands.chunk_bytes]
            c = bands.check(len(part), len(z.compress(part)) / len(part))
            low, high = low + (c < 0), high + (c > 0)
    else:
        low, high = int(whole < 0), int(whole > 0)
    bad = low + high
    if whole < 0 or whole == 0 and bad >= bands.bad_share * n and low >= high and bad:
        return ratio, n, bad, "repetitive"
    if whole > 0 or bad >= bands.bad_share * n and bad:
        return ratio, n, bad, "incompressible"
    return ratio, n, bad, "ok"


def _judged(column: pa.Array, bands: Bands, z: zstandard.ZstdCompressor) -> dict[str, np.ndarray | pa.Array]:
    parts: list[dict[str, np.ndarray]] = []
    verdicts: list[str] = []
    for i, j, raw, off in tv.chunks(column):
        out = base_counts(raw, off)
        n = j - i
        ratio, chunks, bad = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        view = memoryview(np.ascontiguousarray(raw))
        for k in range(n):
            ratio[k], chunks[k], bad[k], v = judge(view[off[k] : off[k + 1]], bands, z)
            verdicts.append(v)
        parts.append(out | {"n_bytes": np.diff(off), "ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad})
    cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    cols["base_failed"] = (cols["n_words"] < 10) | (100 * cols["n_repeat_words"] > 20 * cols["n_words"])
    cols["kept"] = ~cols["base_failed"] & np.array([v == "ok" for v in verdicts])
    cols["verdict"] = pa.array(verdicts, pa.string())
    return cols


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: its counts, compression figures and whether it is kept."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        z = zstandard.ZstdCompressor(level=bands.level)
        return lambda b: {"doc_id": b.column(0)} | _judged(b.column(1), bands, z)

    return map_rows(narrow(docs, doc_id=id_col, text=text_col), make, f"doc_id {kind}, {RULE_COLUMNS}")


def keep_good(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns. Texts alone go to Python and one boolean for each comes back."""

    def make():
        z = zstandard.ZstdCompressor(level=bands.level)
        return lambda texts: pa.array(_judged(texts, bands, z)["kept"] if len(texts) else [], pa.bool_())

    return docs.where(batch_function(make, "boolean")(docs[text_col]))
