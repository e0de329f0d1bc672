"""Chunkers: a document's blocks to chunks, by structure, title, page or fixed size.

A document is one row with its blocks in an array, so packing, sectioning and overlap are array expressions: no shuffle, no
Python, and block order can't be lost. The packing fold keeps only the places where chunks begin, so its state is as long as
the number of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fast_tokens, let

STRATEGIES = ("by-structure", "by-title", "by-page", "fixed")


def joined(blocks: Column) -> Column:
    """Text of the blocks, one line each."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def _cut(blocks: Column, begins: Column) -> Column:
    """Parts of the array that start at the given places (from 0, ascending)."""
    return let(begins, lambda at: F.transform(at, lambda b, i: F.slice(blocks, b + 1, F.coalesce(F.get(at, i + 1), F.size(blocks)) - b)))


def packed(blocks: Column, max_tokens: Column) -> Column:
    """Greedy packing: a part ends where the next block would take it over max_tokens. No block is split."""
    start = F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, b: Column) -> Column:
        k = fast_tokens(b["text"])
        new = (acc["i"] == 0) | (acc["t"] + k > max_tokens)
        return F.struct(F.when(new, k).otherwise(acc["t"] + k).alias("t"), (acc["i"] + 1).alias("i"), F.when(new, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"))

    return _cut(blocks, F.aggregate(blocks, start, step, lambda acc: acc["at"]))


def tail_text(blocks: Column, overlap: Column) -> Column:
    """Text of the last blocks, whole ones, until they have overlap tokens; empty for an overlap of 0."""
    start = F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0).alias("k"))
    take = F.aggregate(F.reverse(blocks), start, lambda a, b: F.when(a["t"] < overlap, F.struct((a["t"] + fast_tokens(b["text"])).alias("t"), (a["k"] + 1).alias("k"))).otherwise(a), lambda a: a["k"])
    return F.when(overlap <= 0, F.lit("")).otherwise(joined(F.slice(blocks, F.size(blocks) - take + 1, take)))


def _run(blocks: Column, max_tokens: Column, overlap: Column) -> Column:
    """Parts of a run of blocks with the overlap of the part before; null for the first."""
    one = lambda parts: F.transform(parts, lambda p, i: F.struct(p.alias("blocks"), F.when(i > 0, let(F.get(parts, i - 1), lambda b: tail_text(b, overlap))).alias("prefix")))
    return let(packed(blocks, max_tokens), one)


def _titled(blocks: Column) -> Column:
    """A section that fits gets its titles as the hierarchy of its first title."""
    is_title = lambda b: b["element_type"].isin("title", "header")
    titles = F.transform(F.filter(blocks, is_title), lambda b: b["text"])
    return F.transform(blocks, lambda b, i: F.when((i == 0) & is_title(b), b.withField("hierarchy", titles)).otherwise(b))


def _sections(blocks: Column, begins: Column, max_tokens: Column, overlap: Column, titled: bool) -> Column:
    def one(s: Column) -> Column:
        whole = F.array(F.struct((_titled(s) if titled else s).alias("blocks"), F.lit(None).cast("string").alias("prefix")))
        return F.when(fast_tokens(joined(s)) <= max_tokens, whole).otherwise(_run(s, max_tokens, overlap))

    return F.flatten(F.transform(_cut(blocks, begins), one))


def parts_of(blocks: Column, strategy: str, max_tokens: Column, overlap: Column) -> Column:
    """array<struct<blocks, prefix>> of all strategies but fixed."""
    places = F.when(F.size(blocks) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(blocks) - 1))
    if strategy == "by-structure":
        return _run(blocks, max_tokens, overlap)
    if strategy == "by-title":
        return _sections(blocks, F.filter(places, lambda i: (i == 0) | F.get(blocks, i)["element_type"].isin("title", "header")), max_tokens, overlap, True)
    if strategy == "by-page":
        return _sections(blocks, F.filter(places, lambda i: (i == 0) | (F.get(blocks, i)["page"] != F.get(blocks, F.greatest(i - 1, F.lit(0)))["page"])), max_tokens, overlap, False)
    raise ValueError(f"unknown strategy {strategy}")


def _pages(blocks: Column) -> tuple[Column, Column, Column]:
    pages, conf = F.transform(blocks, lambda b: b["page"]), F.transform(blocks, lambda b: b["confidence"])
    low = F.least(F.coalesce(F.array_min(conf), F.lit(1.0).cast("float")), F.lit(1.0).cast("float"))
    return F.coalesce(F.array_min(pages), F.lit(0)), F.coalesce(F.array_max(pages), F.lit(0)), low


def windows(text: Column, max_tokens: Column, overlap: Column) -> Column:
    """array<struct<text, prefix>>: windows of 4 * max_tokens code points with 4 * overlap from before each; a text that fits is one.

    The text is cut once, into the strides from one window's start to the next; a window is its stride and the beginning of those
    after it, its prefix the end of those before. So the work grows with the text and not with the text times its windows.
    """
    width, ov = max_tokens * 4, overlap * 4
    step = F.when(width > ov, width - ov).otherwise(width)
    near = F.ceil(ov / step).cast("int")
    cut = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), F.lit(0))

    def one(parts: Column) -> Column:
        some = lambda i, n: F.array_join(F.slice(parts, i, n), "")
        before = lambda i: some(F.greatest(i - near, F.lit(0)) + 1, F.least(i, near))
        prefix = lambda i: F.when((i > 0) & (ov > 0), let(before(i), lambda t: F.substring(t, F.greatest(F.length(t) - ov, F.lit(0)) + 1, ov)))
        return F.transform(parts, lambda p, i: F.struct(F.substring(some(i + 1, near + 1), F.lit(1), width).alias("text"), prefix(i).alias("prefix")))

    whole = F.array(F.struct(text.alias("text"), F.lit(None).cast("string").alias("prefix")))
    return F.when(text == "", F.slice(whole, 1, 0)).when(fast_tokens(text) <= max_tokens, whole).otherwise(let(cut, one))


def _fixed(docs: DataFrame, keep: list[str], blocks: Column, max_tokens: Column, overlap: Column) -> DataFrame:
    """Windows of code points. All blocks belong to every window; they are copied to it only if source_blocks is read."""
    low, high, conf = _pages(blocks)
    rows = docs.withColumns({"_low": low, "_high": high, "_conf": conf}).select(*keep, "_low", "_high", "_conf", blocks.alias("_blocks"), F.posexplode(let(joined(blocks), lambda t: windows(t, max_tokens, overlap))).alias("chunk_idx", "_w"))
    prefix = F.col("_w.prefix")
    return rows.select(
        *keep, "chunk_idx", F.concat(F.lit("chunk-"), "chunk_idx").alias("id"), F.concat(F.coalesce(prefix, F.lit("")), F.col("_w.text")).alias("text"), F.col("_blocks").alias("source_blocks"),
        F.col("_low").alias("page_start"), F.col("_high").alias("page_end"), prefix.alias("overlap_prefix"), F.col("_conf").alias("confidence"),
    )


def chunk(docs: DataFrame, strategy: str = "by-structure", max_tokens: int | str = 512, overlap: int | str = 50, blocks_col: str = "blocks", keep: list[str] | None = None) -> DataFrame:
    """One row per chunk, chunk_idx from 0 in each document (no filter on the blocks: it would compute them twice). max_tokens and overlap are numbers or names of columns.

    A document without blocks, or with null ones, has no chunks.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != blocks_col]
    number = lambda x: F.col(x).cast("int") if isinstance(x, str) else F.lit(int(x))
    m, o, blocks = number(max_tokens), number(overlap), F.col(blocks_col)
    if strategy == "fixed":
        return _fixed(docs, keep, blocks, m, o)
    return _chunks(docs, keep, parts_of(blocks, strategy, m, o))


def _chunks(docs: DataFrame, keep: list[str], parts: Column) -> DataFrame:
    rows = docs.select(*keep, F.posexplode(parts).alias("chunk_idx", "_part"))
    b, prefix = F.col("_part.blocks"), F.col("_part.prefix")
    low, high, conf = _pages(b)
    text = F.when(prefix.isNotNull() & (prefix != ""), F.concat(prefix, F.lit("\n"), joined(b))).otherwise(joined(b))
    return rows.select(*keep, "chunk_idx", F.concat(F.lit("chunk-"), "chunk_idx").alias("id"), text.alias("text"), b.alias("source_blocks"), low.alias("page_start"), high.alias("page_end"), prefix.alias("overlap_prefix"), conf.alias("confidence"))


def chunk_each(docs: DataFrame, strategy_col: str, max_col: str, overlap_col: str, blocks_col: str = "blocks") -> DataFrame:
    """Each document by its own settings: one branch for windows, one for all else; no shuffle."""
    keep, m, o = [c for c in docs.columns if c != blocks_col], F.col(max_col).cast("int"), F.col(overlap_col).cast("int")
    own = F.when(F.col(strategy_col) == STRATEGIES[0], parts_of(F.col(blocks_col), STRATEGIES[0], m, o))
    for s in STRATEGIES[1:3]:
        own = own.when(F.col(strategy_col) == s, parts_of(F.col(blocks_col), s, m, o))
    some = docs.where(F.col(strategy_col) != "fixed")
    return _chunks(some, keep, own).unionByName(chunk(docs.where(F.col(strategy_col) == "fixed"), "fixed", max_col, overlap_col, blocks_col))


def collected(rows: DataFrame, doc: str = "doc_id", order: str = "block_idx") -> DataFrame:
    """Documents from exploded blocks: one shuffle by document, blocks in their order whatever the shuffle did."""
    names = [c for c in rows.columns if c not in (doc, order)]
    by = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)  # noqa: E731  (blocks hold maps, which have no order)
    sorted_ = F.array_sort(F.collect_list(F.struct(order, *names)), by)
    return rows.groupBy(doc).agg(F.transform(sorted_, lambda b: F.struct(*[b[c].alias(c) for c in names])).alias("blocks"))
