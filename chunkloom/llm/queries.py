"""The corpus operators as queries over the test tables, with production parameters, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reader import spread
from . import decontam, langid, lm, neardup, packing, quality, secrets, sharding, tokencount, toxicity
from .common import fold, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def vocabulary_file(name: str) -> str:
    """Place of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_features", "n_hits")


@query
def op3_lm_score(spark, sf_dir):
    held_out = fold("doc_id", 7) == 2
    out = lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return out.withColumn("held_out", ~F.col("learn")).drop("learn")


@query
def op4_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


#: Bytes of text in a shard, at most, and shards, at least: a small table is still shared among readers.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 32


@query
def op6_extendible_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES, least_shards=LEAST_SHARDS)


def sharding_sql(limit: int = SHARD_BYTES, least: int = LEAST_SHARDS) -> str:
    """Every prefix of every hash, and for each row the shortest whose bytes fit. Where none does, the row is alone in an overflow
    shard if it is over half the limit (ids are taken to be distinct there)."""
    return f"""
WITH h AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
most AS (SELECT greatest(1, least({limit}, (coalesce(sum(n_bytes), 0) + {least - 1}) // {least}))::BIGINT AS most FROM h),
sums AS (SELECT d AS depth, h >> (32 - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes
         FROM h, range(0, 33) r(d) GROUP BY 1, 2),
leaf AS (SELECT h.doc_id, min(s.depth) AS depth
         FROM h, range(0, 33) r(d) JOIN sums s ON s.depth = d AND s.prefix = h.h >> (32 - d), most
         WHERE s.shard_bytes <= most GROUP BY 1)
SELECT h.doc_id, h.n_bytes, coalesce(l.depth, 32)::INTEGER AS depth, (h.h >> (32 - coalesce(l.depth, 32)))::BIGINT AS prefix,
       CASE WHEN l.depth IS NOT NULL THEN 0 ELSE -row_number() OVER (PARTITION BY h.h ORDER BY h.doc_id) END::BIGINT AS part,
       CASE WHEN l.depth IS NOT NULL THEN s.shard_bytes ELSE h.n_bytes END AS shard_bytes
FROM h LEFT JOIN leaf l USING (doc_id) LEFT JOIN sums s ON s.depth = l.depth AND s.prefix = h.h >> (32 - l.depth)
"""


ORACLES["op6_extendible_sharding"] = sharding_sql()


@query
def op7_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


@query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 4) != 2))
    out = langid.identify(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query
def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


@query
def op10_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op10_minhash_neardup"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
    FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) = 1 THEN [t[1]]
                        ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS t
    FROM w),
n AS (SELECT doc_id, len(t) AS n FROM s),
classes AS (SELECT min(doc_id) AS rep, any_value(t) AS t, len(any_value(t)) AS n FROM (SELECT doc_id, list_sort(t) AS t FROM s) GROUP BY hash(t), t HAVING len(any_value(t)) > 0),
member AS (SELECT s.doc_id, c.rep FROM (SELECT doc_id, list_sort(t) AS t FROM s) s JOIN classes c ON s.t = c.t),
x AS (SELECT rep, n, unnest(t) AS g FROM classes),
common AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
           FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS id, rep AS r FROM classes UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(comp.c, n.doc_id) AS component_id, coalesce(comp.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN member USING (doc_id) LEFT JOIN comp ON comp.id = member.rep
"""
