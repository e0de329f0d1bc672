"""Output projections: columnar rows, element-compatibility rows, Markdown, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import element_name, let


def type_runs(blocks: Column) -> Column:
    """Names of the blocks' types, repeats in a row once, joined with commas."""
    names = F.transform(blocks, lambda b: element_name(b["element_type"]))
    runs = lambda all_: F.transform(all_, lambda n, i: F.when((i == 0) | (F.get(all_, F.greatest(i - 1, F.lit(0))) != n), n))
    return F.array_join(F.filter(let(names, runs), lambda n: n.isNotNull()), ",")


def columnar(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of the Parquet sink."""
    return chunks.select(*keep, "id", "text", "token_count", "page_start", "page_end", type_runs(F.col("source_blocks")).alias("element_types"), F.exists("source_blocks", lambda b: b["element_type"] == "table").alias("has_table"))


def compat_elements(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """A row per block with text: type, text, page_number; a chunk without blocks is one narrative element."""
    bare = F.array(F.struct(F.lit("NarrativeText").alias("type"), F.col("text").alias("text"), F.col("page_start").alias("page_number")))
    own = F.transform(F.filter("source_blocks", lambda b: b["text"] != ""), lambda b: F.struct(element_name(b["element_type"], compat=True).alias("type"), b["text"].alias("text"), b["page"].alias("page_number")))
    rows = chunks.select(*keep, "chunk_idx", F.posexplode(F.when(F.size("source_blocks") == 0, bare).otherwise(own)).alias("element_idx", "_e"))
    return rows.select(*keep, "chunk_idx", "element_idx", "_e.type", "_e.text", "_e.page_number")


def gfm_table(table: Column, text: Column) -> Column:
    """A table as Markdown, a line per row; the text where there are no cells. Null cells are empty."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |\n"))
    heads = table["headers"]
    rule = F.concat(F.lit("|"), F.array_join(F.transform(heads, lambda _: F.lit(" --- ")), "|"), F.lit("|\n"))
    head = F.when(heads.isNotNull(), F.concat(row(heads), rule)).otherwise("")
    return F.when(table.isNotNull(), F.concat(head, F.array_join(F.transform(table["rows"], row), ""))).otherwise(F.concat(text, F.lit("\n")))


def markdown_block(b: Column) -> Column:
    t, kind = b["text"], b["element_type"]
    hashes = lambda plain: F.repeat(F.lit("#"), F.when(F.coalesce(F.size(b["hierarchy"]), F.lit(0)) <= 0, plain).otherwise(F.least(F.size(b["hierarchy"]), F.lit(6))))
    around = lambda a, z: F.concat(F.lit(a), t, F.lit(z))
    return (
        F.when(kind == "title", F.concat(hashes(2), F.lit(" "), t, F.lit("\n\n"))).when(kind == "header", F.concat(hashes(3), F.lit(" "), t, F.lit("\n\n"))).when(kind == "table", F.concat(gfm_table(b["table_data"], t), F.lit("\n")))
        .when(kind == "code_block", around("```\n", "\n```\n\n")).when(kind == "list_item", around("- ", "\n")).when(kind == "formula", around("$$", "$$\n\n")).when(kind == "caption", around("*", "*\n\n"))
        .when(kind == "image", around("![image](", ")\n\n")).otherwise(around("", "\n\n"))
    )


def markdown(chunks: DataFrame, doc: str, name: Column) -> DataFrame:
    """One Markdown text per document, its chunks in order."""
    body = F.when(F.size("source_blocks") == 0, F.concat("text", F.lit("\n\n"))).otherwise(F.array_join(F.transform("source_blocks", markdown_block), ""))
    overlap = F.when(F.coalesce(F.col("overlap_prefix"), F.lit("")) != "", F.concat(F.lit("> *Overlap:* "), "overlap_prefix", F.lit("\n\n"))).otherwise("")
    info = F.concat(F.lit("** | tokens: "), "token_count", F.lit(" | pages: "), "page_start", F.lit("-"), "page_end", F.lit("\n\n"))
    parts = chunks.select(doc, name.alias("_name"), F.struct("chunk_idx", info.alias("info"), F.concat(overlap, body).alias("body")).alias("_c"))
    whole = parts.groupBy(doc).agg(F.first("_name").alias("_name"), F.array_sort(F.collect_list("_c")).alias("_c"))
    text = F.array_join(F.transform("_c", lambda c, i: F.concat(F.lit("---\n\n**Chunk "), i + 1, F.lit(" / "), F.size("_c"), c["info"], c["body"])), "")
    return whole.select(doc, F.concat(F.lit("# Chunked Output: "), "_name", F.lit("\n\n"), text).alias("markdown"))


def chunk_json(pretty: bool = False) -> Column:
    """A chunk as JSON with all its fields, nulls too."""
    names = ("id", "text", "token_count", "source_blocks", "page_start", "page_end", "overlap_prefix", "confidence")
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
