"""From files to chunks to sinks.

One row per document all the way to the chunks: detection, parsing and chunking need no shuffle. Settings files are a small
table joined by path; it is sent to all executors only if its size is below a bound, else joined by a shuffle.
"""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import needs_vision
from ..model import E_CONFIG
from ..operators import chunking, render
from ..operators.tokens import bpe_tokens
from ..sources import reader

log = logging.getLogger("chunkloom")
#: Rows of settings that are sent to all executors, at most.
FEW_SETTINGS = 100_000


def with_settings(docs: DataFrame, sidecars: DataFrame | None, settings: Settings) -> DataFrame:
    """strategy, max_tokens and overlap of each document: its own, else the common ones. Senseless ones are its error."""
    common = (F.lit(settings.chunk_strategy), F.lit(settings.max_tokens), F.lit(settings.overlap))
    names = ("strategy", "max_tokens", "overlap")
    if sidecars is None:
        return docs.withColumns(dict(zip(names, common, strict=True)))
    few = sidecars.limit(FEW_SETTINGS + 1).count() <= FEW_SETTINGS
    joined = docs.join(F.broadcast(sidecars) if few else sidecars, "path", "left")
    joined = joined.withColumns({n: F.coalesce(s, c) for n, s, c in zip(names, ("s_strategy", "s_max", "s_overlap"), common, strict=True)})
    return joined.withColumn("error_code", F.coalesce("error_code", F.when(F.col("s_error").isNotNull(), E_CONFIG))).withColumn("error_message", F.coalesce("error_message", "s_error")).drop("s_strategy", "s_max", "s_overlap", "s_error")


def models_folder(path: str, settings: Settings) -> str | None:
    """The folder that was named, else models beside the documents, else here; on a cluster one that all executors see."""
    if settings.models:
        return settings.models
    place = path.removeprefix("file://")
    own = os.path.join(place if os.path.isdir(place) else os.path.dirname(place), "models")
    return next((os.path.abspath(x) for x in (own, "models") if os.path.isdir(x)), None)


def parsed_documents(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """path, ext, format_key, length, blocks, error columns and settings of every document below a path."""
    # images and pages with next to no text go to OCR; without models the parser's blocks stay
    docs = reader.parse_documents(reader.detect(reader.read_files(spark, path)), models=models_folder(path, settings))
    docs = docs.withColumn("needs_vision", F.col("format_key").isin("image", "pdf") & F.coalesce(needs_vision("blocks"), F.lit(False)))
    try:
        sidecars = reader.read_sidecars(spark, path)
    except Exception as e:  # a single file as input: there is nothing beside it to list
        if "PATH_NOT_FOUND" not in str(e):
            raise
        sidecars = None
    return with_settings(docs, sidecars, settings)


def to_chunks(docs: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of the documents without an error."""
    rows = docs.where("error_code is null").select("path", "blocks", "strategy", "max_tokens", "overlap")
    out = chunking.chunk_each(rows, "strategy", "max_tokens", "overlap").drop("strategy", "max_tokens", "overlap")
    return out.withColumn("token_count", bpe_tokens("text", settings.tokenizer))


def summary(docs: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """One row: documents, successes, failures, chunks and the common settings."""
    failed = F.col("error_code").isNotNull()
    counts = docs.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))
    return counts.withColumns({"total_chunks": F.lit(chunks.count()), "chunk_strategy": F.lit(settings.chunk_strategy), "max_tokens": F.lit(settings.max_tokens), "overlap": F.lit(settings.overlap)})


def file_name(path: Column) -> Column:
    """Name of an output: the path with what can't be in a name replaced, so that equal stems don't collide."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/*", ""), r"[^A-Za-z0-9._-]+", "_")


def write(chunks: DataFrame, output: str, fmt: str, compat: str | None = None) -> None:
    """The chunks as a dataset in the order of paths: JSON lines or Parquet; or a text per document: JSON (an array), Markdown or,
    if compat is given, a JSON array of elements."""
    log.debug("writing %s to %s", compat or fmt, output)
    if compat is not None:
        e = render.compat_elements(chunks, ["path"])
        one = F.to_json(F.struct("type", "text", F.struct("page_number", file_name(F.col("path")).alias("filename")).alias("metadata")))
        rows = e.select("path", F.struct("chunk_idx", "element_idx", one.alias("j")).alias("c")).groupBy("path").agg(F.array_sort(F.collect_list("c")).alias("c"))
        _documents(rows.select("path", F.concat(F.lit("["), F.array_join(F.transform("c", lambda c: c["j"]), ","), F.lit("]")).alias("body")), output, ".json")
    elif fmt == "parquet":
        render.columnar(chunks, ["path", "chunk_idx"]).orderBy("path", "chunk_idx").drop("chunk_idx").write.mode("overwrite").option("compression", "snappy").parquet(output)
    elif fmt == "jsonl":
        chunks.select("path", "chunk_idx", render.chunk_json().alias("value")).orderBy("path", "chunk_idx").select("value").write.mode("overwrite").text(output)
    elif fmt == "json":
        rows = chunks.select("path", F.struct("chunk_idx", render.chunk_json(pretty=True).alias("j")).alias("c")).groupBy("path").agg(F.array_sort(F.collect_list("c")).alias("c"))
        text = F.concat(F.lit("[\n"), F.array_join(F.transform("c", lambda c: c["j"]), ",\n"), F.lit("\n]"))
        _documents(rows.select("path", text.alias("body")), output, ".json")
    elif fmt == "markdown":
        _documents(render.markdown(chunks, "path", file_name(F.col("path"))).select("path", F.col("markdown").alias("body")), output, ".md")
    else:
        raise ValueError(f"unknown output format {fmt}")


def on_this_machine(spark: SparkSession, output: str) -> bool:
    """Whether tasks that write to the path write to this machine's disk: a local master and a file system of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(output)
    return spark.sparkContext.master.startswith("local") and path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def _documents(rows: DataFrame, output: str, suffix: str) -> None:
    """A text for each document.

    On one machine a file each, written through a temporary name, so that a task that runs again does no harm. On a cluster, or
    to any other file system, a folder document=NAME each, by Spark's own writer and commit protocol: a task's machine has no
    part in where the output is.
    """
    spark = rows.sparkSession
    named = rows.select(F.concat(file_name(F.col("path")), F.lit(suffix)).alias("document"), "body")
    if not on_this_machine(spark, output):
        named.select("document", F.col("body").alias("value")).repartition("document").write.mode("overwrite").partitionBy("document").text(output)
        return
    folder = output.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        n = 0
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{folder}/.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as out:
                    out.write(body)
                os.replace(part, f"{folder}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["written"])

    named.mapInArrow(run, "written long").agg(F.sum("written")).collect()


def dump(docs: DataFrame, chunks: DataFrame, folder: str) -> None:
    """What every step made of every document, a dataset each: how it was read, its blocks, its chunks."""
    counts = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"))
    steps = docs.select("path", "format_key", "needs_vision", F.coalesce(F.size("blocks"), F.lit(0)).alias("block_count"), "error_code", "error_message").join(counts, "path", "left")
    steps = steps.select(F.col("path").alias("input_file"), "format_key", F.col("format_key").alias("parser_routed_to"), "needs_vision", "block_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "error_code", "error_message")
    steps.orderBy("input_file").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/format")
    docs.where("blocks is not null").select("path", "blocks").orderBy("path").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/blocks")
    chunks.orderBy("path", "chunk_idx").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/chunks")


def run(spark: SparkSession, settings: Settings) -> dict:
    """Read, parse, chunk and write; the summary as a dictionary."""
    began = time.time()
    log.info("reading %s", settings.input)
    docs = parsed_documents(spark, settings.input, settings).persist()
    chunks = to_chunks(docs, settings).persist()
    if settings.debug_output:
        dump(docs, chunks, settings.debug_output)
    write(chunks, settings.output, settings.format, settings.output_compat)
    out = summary(docs, chunks, settings).first().asDict()
    out["elapsed_secs"] = time.time() - began
    out["files_per_sec"] = out["succeeded"] / max(out["elapsed_secs"], 1e-9)
    out["errors"] = [(r["path"], r["error_code"], r["error_message"]) for r in docs.where("error_code is not null").select("path", "error_code", "error_message").orderBy("path").limit(20).collect()]
    for path, code, message in out["errors"]:
        log.warning("%s %s: %s", code, path, message)
    log.info("%d of %d documents, %d chunks", out["succeeded"], out["total_files"], out["total_chunks"])
    docs.unpersist()
    chunks.unpersist()
    if settings.debug_output:
        spark.createDataFrame([(json.dumps(out, ensure_ascii=False),)], "summary string").coalesce(1).write.mode("overwrite").text(f"{settings.debug_output}/summary")
    return out
