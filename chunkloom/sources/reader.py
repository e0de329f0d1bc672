"""Documents from files: listing, format detection, parsing to blocks.

Files are read by Spark's binary source, one row each. Everything that built-in expressions can tell (extension, first
bytes) is decided before Python sees a row; parsers then run in one Arrow stage, and a failure is a row's error, never the
job's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SIDECAR, parse_sidecar
from ..functions import text as T
from ..model import BLOCK, E_IO, E_PARSE, DocError
from ..operators import ocr
from . import html, office, pdf, plain

_UNSUPPORTED = ("epub",)


def parse(content: bytes, format_key: str, ext: str, document_order: bool = False) -> list:
    """Blocks of one document; DocError if it can't be parsed."""
    f = {
        "csv_tsv": plain.parse_delimited, "html": lambda c: html.parse_html(c, document_order), "pdf": pdf.parse_pdf, "docx": office.parse_docx, "xlsx": office.parse_sheets, "pptx": office.parse_pptx,
        "email": plain.parse_email, "msg": office.parse_msg, "rtf": plain.parse_rtf, "image": lambda c: office.parse_image(c, ext), **{k: lambda c: plain.parse_text_format(c, ext, format_key) for k in ("text", "json", "yaml", "xml")},
    }.get(format_key)
    if f is None:
        raise DocError(E_IO, f"no parser for {format_key}")
    try:
        return f(content)
    except DocError:
        raise
    except Exception as e:  # a damaged file may break a parser anywhere; its row says so
        raise DocError(E_PARSE, f"{type(e).__name__}: {e}") from e


def spread(df: DataFrame, part_bytes: int = 1 << 20) -> DataFrame:
    """The same rows in as many partitions as there are cores, if a table of a few large row groups has fewer.

    Tables with enough splits, as all large ones have, are left as they are: nothing is shuffled then.
    """
    plan = df._jdf.queryExecution()
    have, cores = plan.toRdd().getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    want = min(cores, int(str(plan.optimizedPlan().stats().sizeInBytes())) // part_bytes)
    return df.repartition(want) if have < want else df


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of a file or of all files below a folder, but for the settings files beside documents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").endswith(SIDECAR)).select("path", "length", "content")


def zip_kind(content: Column) -> Column:
    """Kind of office archive; null stays null, so that only archives need be sent."""

    @F.arrow_udf("string")
    def kind(batch: pa.Array) -> pa.Array:
        return pa.array((None if c is None else office.zip_format(c) for c in (x.as_py() for x in batch)), pa.string())

    return kind(content)


def detect(files: DataFrame) -> DataFrame:
    """The files whose format is known by extension or first bytes, with format_key and ext. Files are read once; bytes go to Python here for archives alone."""
    known = files.withColumn("ext", T.extension("path")).withColumn("format_key", F.coalesce(T.format_by_extension("path"), T.format_by_magic("content"))).where("format_key is not null")
    return known.withColumn("format_key", F.coalesce(zip_kind(F.when(F.col("format_key") == "zip", F.col("content"))), "format_key"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """path of the document, and what its settings file says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    got = parse_sidecar(c.decode("utf-8", "replace"))
                    if got is not None:
                        rows.append({"path": p.removesuffix(SIDECAR), "s_strategy": got.get("chunk_strategy"), "s_max": got.get("max_tokens"), "s_overlap": got.get("overlap"), "s_error": None})
                except DocError as e:
                    rows.append({"path": p.removesuffix(SIDECAR), "s_strategy": None, "s_max": None, "s_overlap": None, "s_error": f"{e.code}: {e.message}"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("s_strategy", pa.string()), ("s_max", pa.int32()), ("s_overlap", pa.int32()), ("s_error", pa.string())]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{SIDECAR}").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, s_strategy string, s_max int, s_overlap int, s_error string")


def needs_ocr(blocks: list, format_key: str) -> bool:
    """Images and documents of pages of which the parser made next to nothing (functions.text.needs_vision is the same of a column)."""
    return format_key in ("image", "pdf") and (all(b.confidence < 0.3 for b in blocks) or sum(len(b.text.encode()) for b in blocks) < 50)


def recognized(content: bytes, format_key: str, blocks: list, models) -> list:
    """Blocks by OCR; the parser's where that fails or finds nothing. models: None, or what ocr.load_models gives."""
    if models is None or not needs_ocr(blocks, format_key):
        return blocks
    try:
        if format_key == "pdf":
            content = pdf.rasterize(content, 1)
        return ocr.process_page(content, 1, models) or blocks
    except DocError:
        return blocks


def block_array(docs: list[list | None]) -> pa.Array:
    """Blocks of documents as a list column. Fields are gathered one by one: no dictionary is made for a block."""
    blocks = [b for d in docs if d for b in d]
    starts = lambda sizes: np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64, len(sizes)))]).astype(np.int32)
    lists = lambda rows, flat: pa.ListArray.from_arrays(pa.array(starts([len(r) for r in rows])), flat)
    strings = lambda rows: lists(rows, pa.array([x for r in rows for x in r], pa.string()))
    boxes = [b.bbox or (0.0,) * 4 for b in blocks]
    no_box = pa.array([b.bbox is None for b in blocks], pa.bool_())
    box = pa.StructArray.from_arrays([pa.array([x[k] for x in boxes], pa.float32()) for k in range(4)], names=["x", "y", "width", "height"], mask=no_box)
    pairs = [list(b.metadata.items()) for b in blocks]
    meta = pa.MapArray.from_arrays(pa.array(starts([len(x) for x in pairs])), pa.array([k for x in pairs for k, _ in x], pa.string()), pa.array([v for x in pairs for _, v in x], pa.string()))
    rows = [b.rows or [] for b in blocks]
    cells = lists(rows, strings([r for x in rows for r in x]))
    heads = pa.array([b.headers if b.rows is not None else None for b in blocks], pa.list_(pa.string()))
    table = pa.StructArray.from_arrays([cells, heads], names=["rows", "headers"], mask=pa.array([b.rows is None for b in blocks], pa.bool_()))
    flat = pa.StructArray.from_arrays(
        [
            pa.array([b.element_type for b in blocks], pa.string()), pa.array([b.text for b in blocks], pa.string()), box, pa.array([b.page for b in blocks], pa.int32()), pa.array([b.confidence for b in blocks], pa.float32()),
            strings([b.hierarchy for b in blocks]), meta, table,
        ], names=["element_type", "text", "bbox", "page", "confidence", "hierarchy", "metadata", "table_data"],
    )
    offsets = starts([len(d or ()) for d in docs])
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.array([*(d is None for d in docs), False])), flat)


def parse_documents(docs: DataFrame, document_order: bool = False, models: str | Callable[[], object] | None = None) -> DataFrame:
    """content is replaced by blocks, error_code and error_message; other columns stay.

    models: a folder with OCR models, or a function that returns them, called once in each task; without, there is no OCR.
    """
    keep = [c for c in docs.columns if c != "content"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "content"), f"blocks array<{BLOCK}>, error_code string, error_message string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            loaded = models() if callable(models) else ocr.load_models(models) if models else None
        except DocError:  # as if there were none
            loaded = None
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for k in range(0, b.num_rows, 64):
                blocks, codes, messages = [], [], []
                for content, key, ext in zip(*(col[n].slice(k, 64).to_pylist() for n in ("content", "format_key", "ext")), strict=True):
                    try:
                        blocks.append(recognized(content, key, parse(content or b"", key, ext, document_order), loaded))
                        codes.append(None)
                        messages.append(None)
                    except DocError as e:
                        blocks.append(None)
                        codes.append(e.code)
                        messages.append(e.message)
                yield pa.RecordBatch.from_arrays([*(col[n].slice(k, 64) for n in keep), block_array(blocks), pa.array(codes, pa.string()), pa.array(messages, pa.string())], names=[*keep, "blocks", "error_code", "error_message"])
            del b, col

    return docs.mapInArrow(run, schema)
