"""Sharding by extendible hashing.

A directory is indexed by the first bits of a row's hash. A bucket that holds more bytes than a shard may have is split on
its next bit, and only such a bucket, until every one fits. Bytes are summed by a prefix a few bits longer than shards are
expected to need (map side first); all shorter prefixes follow from that small table, and a row's shard is its shortest
prefix whose bytes fit. Buckets that are too large even there, which hot hashes make, are split on further bits alone.
Texts aren't moved to find the shards; write_shards() moves them once.

Rows whose hashes are equal in all DEPTH bits can't be told apart by bits. Where such rows together exceed the limit they are
put in overflow shards of their own by the running sum of their bytes, in the order of the table; a row of more than half the
limit is alone in one. The running sum is that of the parts of the table before plus that within the part, so that a hot
hash, as all rows with a null id have, is in no one task.

Defined cases: a null text has 0 bytes; a null id is hashed as an empty string; repeated rows are sharded one by one; texts of
any length count whole; other columns, whatever their names, are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

DEPTH = 32


def hash_number(ident: Column) -> Column:
    """The first DEPTH bits of the MD5 of the id as text (which other engines have too), as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), 1, DEPTH // 4), 16, 10).cast("long")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """The rows (n_bytes, h and row, whose upper bits are the part of the table) with part: the overflow shard among those of equal h."""
    half = max(1, limit // 2)  # rows of at most half the limit fill a shard to its half at least and never beyond the limit
    small = F.col("n_bytes") <= half
    rows = rows.withColumn("task", F.shiftright("row", 33)).withColumn("small", F.when(small, F.col("n_bytes")).otherwise(0)).withColumn("large", F.when(small, 0).otherwise(1))
    tasks = rows.groupBy("h", "task").agg(F.sum("small").alias("s"), F.sum("large").alias("l"))
    earlier = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("h", "task", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"), F.coalesce(F.sum("l").over(earlier), F.lit(0)).alias("l0"))
    within = Window.partitionBy("h", "task").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sum", F.sum("small").over(within)).withColumn("nth", F.sum("large").over(within)).join(tasks, ["h", "task"])
    part = F.when(F.col("large") == 0, 1 + F.floor((F.greatest(F.col("s0") + F.col("sum"), F.lit(1)) - 1) / half).cast("long")).otherwise(-(F.col("l0") + F.col("nth")).cast("long"))
    return rows.withColumn("part", part)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 64 << 20, least_shards: int = 1) -> DataFrame:
    """doc_id, n_bytes, depth, prefix (the first depth bits), part (0, but in overflow shards) and shard_bytes of every row.

    A shard has at most limit bytes, and so few that there are at least least_shards of them.
    """
    scratch = Scratch()
    rows = scratch(docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"), hash_number(docs[id_col]).alias("h"), F.monotonically_increasing_id().alias("row")), "sizes")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    limit = max(1, min(limit, -(-total // least_shards)))
    # Directory: a table of at most 2**fine entries, a few times as many as there are shards, summed by prefix and not by row.
    fine = min(DEPTH, max(0, (total // limit).bit_length() + 4))
    buckets = scratch(rows.groupBy(F.shiftright("h", DEPTH - fine).alias("p")).agg(F.sum("n_bytes").alias("size")), "buckets")
    sums = buckets.select(F.explode(F.sequence(F.lit(0), F.lit(fine))).alias("depth"), "p", "size").withColumn("prefix", F.expr(f"shiftright(p, {fine} - depth)")).groupBy("depth", "prefix").agg(F.sum("size").alias("shard_bytes"))
    fits = sums.where(F.col("shard_bytes") <= limit)
    leaf = buckets.select("p", F.explode(F.sequence(F.lit(0), F.lit(fine))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(p, {fine} - depth)")).join(fits, ["depth", "prefix"]).groupBy("p").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
    found = rows.withColumn("p", F.shiftright("h", DEPTH - fine)).join(leaf, "p", "left")
    settled = found.where("leaf is not null").select("doc_id", "n_bytes", "leaf.depth", "leaf.prefix", F.lit(0).alias("part"), "leaf.shard_bytes")
    # What is over the limit at the directory's depth is split on further bits, row by row.
    deep = found.where("leaf is null").select("doc_id", "n_bytes", "h", "row")
    steps = deep.select(F.explode(F.sequence(F.lit(fine + 1), F.lit(DEPTH))).alias("depth"), "h", "n_bytes") if fine < DEPTH else deep.select(F.lit(DEPTH).alias("depth"), "h", "n_bytes").where("false")
    deep_sums = steps.withColumn("prefix", F.expr(f"shiftright(h, {DEPTH} - depth)")).groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    hashes = deep.select("h").distinct()
    deep_leaf = hashes.select("h", F.explode(F.sequence(F.lit(min(fine + 1, DEPTH)), F.lit(DEPTH))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(h, {DEPTH} - depth)")).join(deep_sums, ["depth", "prefix"]).groupBy("h").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
    deep = deep.join(deep_leaf, "h", "left")
    deep_settled = deep.where("leaf is not null").select("doc_id", "n_bytes", "leaf.depth", "leaf.prefix", F.lit(0).alias("part"), "leaf.shard_bytes")
    over = scratch(_overflow(scratch(deep.where("leaf is null").select("doc_id", "n_bytes", "h", "row"), "overflow"), limit).select("doc_id", "n_bytes", "h", "part"), "parts")
    over = over.join(over.groupBy("h", "part").agg(F.sum("n_bytes").alias("shard_bytes")), ["h", "part"]).select("doc_id", "n_bytes", F.lit(DEPTH).alias("depth"), F.col("h").alias("prefix"), "part", "shard_bytes")
    out = settled.unionByName(deep_settled).unionByName(over)
    out = written(out.select("doc_id", "n_bytes", F.col("depth").cast("int"), F.col("prefix").cast("long"), F.col("part").cast("long"), F.col("shard_bytes").cast("long")), "shards")
    scratch.close()
    return out


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 64 << 20, least_shards: int = 1) -> None:
    """Write the rows as Parquet, a folder for each shard. One shuffle of the texts, by shard; texts of overflow shards are written twice."""
    found = shards(docs, id_col, text_col, limit, least_shards)
    scratch = Scratch()
    scratch.made.append(found)
    total = found.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    name = F.concat_ws("-", "depth", "prefix", "part")
    # Rows of one id have one hash: they are all in the same shard, or all in overflow shards.
    where = found.where("part = 0").select(F.col("doc_id").alias("_id"), name.alias("shard")).distinct()
    placed = docs.join(where, docs[id_col].eqNullSafe(where["_id"])).drop(where["_id"])
    apart = scratch(found.where("part <> 0").select(F.col("doc_id").alias("_id")).distinct(), "apart")
    if not apart.isEmpty():
        cols = [F.col(f"`{c}`") for c in docs.columns]
        rows = docs.join(apart, docs[id_col].eqNullSafe(apart["_id"]), "left_semi").select(F.struct(*cols).alias("doc"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"), hash_number(docs[id_col]).alias("h"), F.monotonically_increasing_id().alias("row"))
        rows = _overflow(scratch(rows, "overflow"), max(1, min(limit, -(-total // least_shards))))
        placed = placed.unionByName(rows.select("doc.*", F.concat_ws("-", F.lit(DEPTH), "h", "part").alias("shard")))
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
    scratch.close()
