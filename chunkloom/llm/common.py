"""Helpers shared by the corpus operators: tables in the shared folder, held-out folds, Arrow output."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


#: Rows in an Arrow batch. Spark's default, 10,000, is as much text as a whole split, held by the JVM and by Python at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, for queries over whole texts, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, is it a temporary folder of this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="chunkloom-"))
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chunkloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    path = getattr(df, "_chunkloom_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in the shared folder that are deleted together once nothing reads them any more."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(written(df, name))
        return self.made[-1]

    def close(self) -> None:
        for df in self.made:
            dropped(df)
        self.made.clear()


def fold(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; 0 for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(0))


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under fixed names: other columns, whatever their names, can't get in the way."""
    return df.select(*[df[c].alias(k) for k, c in cols.items()])


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker process stays for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, np.ndarray | pa.Array] | None]], schema: str) -> DataFrame:
    """mapInArrow with a function of a batch that is set up once per task and returns columns."""
    names = [x.strip().split()[0] for x in _split_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                out = f(b)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)
                del out
        give_back()

    return df.mapInArrow(run, schema)


def batch_function(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str):
    """A column function of one column, by Arrow batches, set up once per task: only that column leaves the JVM, only the result comes back."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for b in batches:
            yield f(b)
        give_back()

    return run


def _split_schema(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def binaries(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of flat[first[i]:first[i+1]]."""
    flat = np.ascontiguousarray(flat)
    off = (np.asarray(first, dtype=np.int64) * flat.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(off), pa.py_buffer(flat)]).cast(pa.binary())


def lists(flat: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i holds flat[first[i]:first[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(first), type=pa.int32()), pa.array(flat, type=kind))


def first_by_hash(df: DataFrame, group: str, key: str, n: int, pieces: int = 64) -> DataFrame:
    """Of every group the n rows with the smallest hashes of key. Ranked in pieces first, so no task gets a whole group."""
    from pyspark.sql import Window

    h = F.xxhash64(key)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(h, key))
    some = df.withColumn("_piece", F.pmod(F.xxhash64(key, F.lit(7)), F.lit(pieces))).withColumn("_rank", rank(group, "_piece")).where(f"_rank <= {n}")
    return some.withColumn("_rank", rank(group)).where(f"_rank <= {n}").drop("_piece", "_rank")
