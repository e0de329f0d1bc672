"""The operators as queries over the test tables, each with the SQL that gives the same rows where SQL can.

The tables stand in for documents: lines of documents are blocks (ten to a page), conversations are documents whose turns are
blocks (user turns as titles, two turns to a page), pages are HTML.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import BLOCK
from ..operators import chunking, render, vision
from ..operators.tokens import bpe_tokens
from ..sources.reader import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def block(kind: Column, text: Column, page: Column, confidence: Column, rows: Column | None = None, headers: Column | None = None) -> Column:
    data = F.struct(rows.alias("rows"), headers.alias("headers")) if rows is not None else F.lit(None)
    return F.struct(
        kind.alias("element_type"), text.alias("text"), F.lit(None).alias("bbox"), page.cast("int").alias("page"), confidence.cast("float").alias("confidence"), F.array().cast("array<string>").alias("hierarchy"),
        F.create_map().cast("map<string,string>").alias("metadata"), data.alias("table_data"),
    ).cast(BLOCK)


def line_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and blocks of documents: their lines that aren't empty."""
    texts = F.filter(F.transform(T.lines("text"), T.trim), lambda x: x != "")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.transform(texts, lambda x, i: block(F.lit("narrative_text"), x, F.floor(i / 10) + 1, F.lit(1.0) - (i % 5) / 10)).alias("blocks"))


_LINES = """
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS b FROM documents),
blk AS (SELECT doc_id, (i - 1)::INTEGER AS idx, b[i] AS text, ((i - 1) // 10 + 1)::INTEGER AS page, (1 - ((i - 1) % 5) / 10)::FLOAT AS conf, 'narrative_text' AS kind
        FROM l, unnest(range(1, len(b) + 1)) r(i))"""


def turn_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and blocks of conversations."""
    kind = F.when(F.col("role") == "user", "title").when(F.col("role") == "system", "header").otherwise("narrative_text")
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), block(kind, F.col("text"), F.floor(F.col("turn") / 2) + 1, F.lit(0.9)).alias("b"))
    return chunking.collected(rows).select("doc_id", F.transform("blocks", lambda x: x["b"]).alias("blocks"))


_TURNS = """
blk AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS idx, text, (turn // 2 + 1)::INTEGER AS page, 0.9::FLOAT AS conf,
               CASE role WHEN 'user' THEN 'title' WHEN 'system' THEN 'header' ELSE 'narrative_text' END AS kind
        FROM conversations)"""

_SECTION = {"by-structure": "0", "by-title": "sum((kind IN ('title', 'header'))::INTEGER) OVER w", "by-page": "sum(new_page) OVER w"}


def chunk_sql(blocks: str, strategy: str, most: int, overlap: int) -> str:
    """Common table expressions up to ch (doc_id, cid, idx, text, page, conf, kind, fits) and pre (doc_id, cid, prefix)."""
    fits = "false" if strategy == "by-structure" else f"ceil((sum(strlen(text)) OVER s + count(*) OVER s - 1) / 5.0) <= {most}"
    return f"""WITH RECURSIVE {blocks},
p AS (SELECT *, ceil(strlen(text) / 5.0)::BIGINT AS k, (coalesce(page <> lag(page) OVER (PARTITION BY doc_id ORDER BY idx), false))::INTEGER AS new_page FROM blk),
q AS (SELECT *, {_SECTION[strategy]} AS sec FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
b AS (SELECT *, {fits} AS fits FROM q WINDOW s AS (PARTITION BY doc_id, sec)),
r AS (SELECT doc_id, idx, sec, k AS tok, 0 AS cid FROM b WHERE idx = 0
      UNION ALL
      SELECT b.doc_id, b.idx, b.sec, CASE WHEN b.sec <> r.sec OR (NOT b.fits AND r.tok + b.k > {most}) THEN b.k ELSE r.tok + b.k END,
             CASE WHEN b.sec <> r.sec OR (NOT b.fits AND r.tok + b.k > {most}) THEN r.cid + 1 ELSE r.cid END
      FROM r JOIN b ON b.doc_id = r.doc_id AND b.idx = r.idx + 1),
ch AS (SELECT b.*, r.cid FROM b JOIN r USING (doc_id, idx)),
suffix AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc_id, cid ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM ch),
tails AS (SELECT doc_id, cid + 1 AS cid, any_value(sec) AS sec, coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (after < {overlap}), '') AS prefix FROM suffix GROUP BY doc_id, cid),
heads AS (SELECT doc_id, cid, any_value(sec) AS sec, string_agg(text, chr(10) ORDER BY idx) AS body, count(*)::INTEGER AS n_blocks, min(page)::INTEGER AS page_start, max(page)::INTEGER AS page_end,
                 round(least(min(conf), 1)::DOUBLE, 4) AS confidence, any_value(fits) AS fits FROM ch GROUP BY doc_id, cid),
out AS (SELECT h.*, t.prefix FROM heads h LEFT JOIN tails t ON t.doc_id = h.doc_id AND t.cid = h.cid AND t.sec = h.sec AND NOT h.fits)
"""


_CHUNK_OUT = "SELECT doc_id, cid::INTEGER AS chunk_idx, 'chunk-' || cid AS id, CASE WHEN coalesce(prefix, '') <> '' THEN prefix || chr(10) || body ELSE body END AS text, n_blocks, page_start, page_end, prefix AS overlap_prefix, confidence FROM out"


def _plain(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_idx", "id", "text", F.size("source_blocks").alias("n_blocks"), "page_start", "page_end", "overlap_prefix", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


def _chunk_query(name: str, docs, strategy: str, most: int, overlap: int, blocks_sql: str) -> None:
    QUERIES[name] = lambda spark, sf: _plain(chunking.chunk(docs(spark, sf), strategy, most, overlap))
    ORACLES[name] = chunk_sql(blocks_sql, strategy, most, overlap) + _CHUNK_OUT


for _name, _args in {
    "chunk_structure_o0": (line_docs, "by-structure", 512, 0, _LINES), "chunk_structure_o50": (line_docs, "by-structure", 512, 50, _LINES), "chunk_page_o0": (line_docs, "by-page", 256, 0, _LINES),
    "chunk_page_o50": (line_docs, "by-page", 256, 50, _LINES), "chunk_title_o0": (turn_docs, "by-title", 64, 0, _TURNS), "chunk_title_o20": (turn_docs, "by-title", 64, 20, _TURNS), "chunk_turns_structure": (turn_docs, "by-structure", 128, 16, _TURNS),
}.items():
    _chunk_query(_name, *_args)


def _fixed_query(name: str, most: int, overlap: int) -> None:
    width, ov = 4 * most, 4 * overlap
    step = width - ov if width > ov else width
    QUERIES[name] = lambda spark, sf: chunking.chunk(line_docs(spark, sf), "fixed", most, overlap).select("doc_id", "chunk_idx", "text", "overlap_prefix", "page_start", "page_end")
    ORACLES[name] = f"""WITH {_LINES},
d AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS t, min(page)::INTEGER AS page_start, max(page)::INTEGER AS page_end FROM blk GROUP BY doc_id),
w AS (SELECT *, unnest(CASE WHEN ceil(strlen(t) / 5.0) <= {most} THEN [0] ELSE range(0, length(t), {step}) END) AS st, ceil(strlen(t) / 5.0) <= {most} AS fits FROM d WHERE t <> ''),
x AS (SELECT *, CASE WHEN NOT fits AND st > 0 AND {ov} > 0 THEN substr(t, greatest(st - {ov}, 0) + 1, least(st, {ov})) END AS pre, CASE WHEN fits THEN t ELSE substr(t, st + 1, {width}) END AS core FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1)::INTEGER AS chunk_idx, coalesce(pre, '') || core AS text, pre AS overlap_prefix, page_start, page_end FROM x"""


_fixed_query("chunk_fixed_o0", 512, 0)
_fixed_query("chunk_fixed_o50", 512, 50)


@query
def text_paragraphs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("doc"))
    return turns.select("conv_id", F.posexplode(T.paragraphs("doc")).alias("idx", "text"))


ORACLES["text_paragraphs"] = r"""
WITH d AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
n AS (SELECT conv_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10)) AS t FROM d),
p AS (SELECT conv_id, list_transform(list_filter(list_transform(regexp_split_to_array(t, '\n\n+'), lambda x: trim(x, chr(10))), lambda x: x <> ''), lambda x: replace(x, chr(10), ' ')) AS p FROM n)
SELECT conv_id, (i - 1)::INTEGER AS idx, p[i] AS text FROM (SELECT conv_id, CASE WHEN len(p) = 0 THEN [''] ELSE p END AS p FROM p), unnest(range(1, len(p) + 1)) r(i)"""


@query
def fast_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fast_tokens("text").alias("tokens"))


ORACLES["fast_tokens"] = "SELECT doc_id, ceil(strlen(text) / 5.0)::BIGINT AS tokens FROM documents"


@query
def bpe_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", bpe_tokens("text").alias("token_count"), F.lit("byte_bpe_50k").alias("tokenizer"))


@query
def chunk_confidence_pages(spark, sf_dir):
    chunks = chunking.chunk(line_docs(spark, sf_dir), "by-structure", 512, 0)
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.round(F.min("confidence").cast("double"), 4).alias("confidence"))


ORACLES["chunk_confidence_pages"] = chunk_sql(_LINES, "by-structure", 512, 0) + "SELECT doc_id, count(*) AS chunks, min(page_start) AS first_page, max(page_end) AS last_page, min(confidence) AS confidence FROM out GROUP BY doc_id"


def _turn_chunks(spark, sf_dir, most=64):
    return chunking.chunk(turn_docs(spark, sf_dir), "by-structure", most, 0).withColumn("token_count", T.fast_tokens("text"))


@query
def parquet_projection(spark, sf_dir):
    return render.columnar(_turn_chunks(spark, sf_dir), ["doc_id"])


_PASCAL = "CASE kind WHEN 'title' THEN 'Title' WHEN 'header' THEN 'Header' ELSE 'NarrativeText' END"
ORACLES["parquet_projection"] = (
    chunk_sql(_TURNS, "by-structure", 64, 0)
    + f"""SELECT o.doc_id, 'chunk-' || o.cid AS id, o.body AS text, ceil(strlen(o.body) / 5.0)::BIGINT AS token_count, page_start, page_end, e.element_types, false AS has_table
FROM out o JOIN (SELECT doc_id, cid, string_agg({_PASCAL}, ',' ORDER BY idx) AS element_types
                 FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id, cid ORDER BY idx) AS before FROM ch) WHERE kind IS DISTINCT FROM before GROUP BY doc_id, cid) e USING (doc_id, cid)"""
)


@query
def compat_elements(spark, sf_dir):
    return render.compat_elements(_turn_chunks(spark, sf_dir), ["doc_id"])


ORACLES["compat_elements"] = (
    chunk_sql(_TURNS, "by-structure", 64, 0)
    + f"SELECT doc_id, cid::INTEGER AS chunk_idx, (row_number() OVER (PARTITION BY doc_id, cid ORDER BY idx) - 1)::INTEGER AS element_idx, {_PASCAL} AS type, text, page AS page_number FROM ch WHERE text <> ''"
)


@query
def markdown_render(spark, sf_dir):
    return render.markdown(_turn_chunks(spark, sf_dir), "doc_id", F.concat(F.lit("conv-"), F.col("doc_id")))


ORACLES["markdown_render"] = (
    chunk_sql(_TURNS, "by-structure", 64, 0)
    + """, body AS (SELECT doc_id, cid, string_agg(CASE kind WHEN 'title' THEN '## ' WHEN 'header' THEN '### ' ELSE '' END || text || chr(10) || chr(10), '' ORDER BY idx) AS md FROM ch GROUP BY doc_id, cid),
n AS (SELECT doc_id, count(*) AS n FROM out GROUP BY doc_id)
SELECT o.doc_id, '# Chunked Output: conv-' || o.doc_id || chr(10) || chr(10) || string_agg('---' || chr(10) || chr(10) || '**Chunk ' || (o.cid + 1) || ' / ' || n || '** | tokens: ' || ceil(strlen(o.body) / 5.0)::BIGINT
  || ' | pages: ' || page_start || '-' || page_end || chr(10) || chr(10) || md, '' ORDER BY o.cid) AS markdown
FROM out o JOIN body USING (doc_id, cid) JOIN n USING (doc_id) GROUP BY o.doc_id"""
)


def _nation_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grid = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return rows.groupBy("r_name").agg(grid.alias("rows")).withColumn("headers", F.array(F.lit("key"), F.lit("name")))


@query
def gfm_table(spark, sf_dir):
    return _nation_tables(spark, sf_dir).select("r_name", render.gfm_table(F.struct("rows", "headers"), F.lit("")).alias("markdown"))


ORACLES["gfm_table"] = """SELECT r_name, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey) AS markdown
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""


@query
def table_descriptor(spark, sf_dir):
    n = F.size("headers")
    return _nation_tables(spark, sf_dir).select("r_name", F.concat(F.lit("Table with "), n, F.lit(" columns ("), F.array_join("headers", ", "), F.lit(") and "), F.size("rows"), F.lit(" rows")).alias("descriptor"))


ORACLES["table_descriptor"] = "SELECT r_name, 'Table with 2 columns (key, name) and ' || count(*) || ' rows' AS descriptor FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


@query
def delimiter_detect(spark, sf_dir):
    one = table(spark, sf_dir, "documents").where("text is not null").select(F.lit("d").alias("src"), F.col("doc_id").alias("id"), T.delimiter("text").alias("delimiter"))
    return one.unionByName(table(spark, sf_dir, "events").where("props is not null").select(F.lit("e").alias("src"), F.col("event_id").alias("id"), T.delimiter("props").alias("delimiter")))


ORACLES["delimiter_detect"] = """
WITH t AS (SELECT 'd' AS src, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'e', event_id, props FROM events),
h AS (SELECT src, id, array_to_string(string_split(t, chr(10))[1:5], chr(10)) AS t FROM t WHERE t IS NOT NULL),
c AS (SELECT *, length(t) - length(replace(t, chr(9), '')) AS a, length(t) - length(replace(t, ';', '')) AS b, length(t) - length(replace(t, '|', '')) AS c, length(t) - length(replace(t, ',', '')) AS d FROM h)
SELECT src, id, CASE WHEN greatest(a, b, c, d) = 0 THEN ',' WHEN a = greatest(a, b, c, d) THEN chr(9) WHEN b = greatest(a, b, c, d) THEN ';' WHEN c = greatest(a, b, c, d) THEN '|' ELSE ',' END AS delimiter FROM c"""


_NAMES = ["report.TXT", "a/b/readme.md", ".txt", "x.tar.gz", "data.csv", "t.tab", "p.xhtml", "f.PDF", "w.doc", "s.xlsb", "deck.ppt", "m.eml", "m.msg", "r.rtf", "feed.rss", "l.ndjson", "c.yml", "b.epub", "i.heic", "noext", "dir.pdf/file"]


@query
def detect_extension(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", names.alias("name"), T.format_by_extension(names).alias("format_key"), T.format_by_extension("url").alias("url_format"))


def _extension_sql(path: str) -> str:
    cases = " ".join(f"WHEN e IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in T.EXTENSIONS.items())
    return f"(SELECT CASE {cases} END FROM (SELECT lower(regexp_extract({path}, '[^/]\\.([^./]+)$', 1)) AS e))"


ORACLES["detect_extension"] = f"SELECT page_id, name, {_extension_sql('name')} AS format_key, {_extension_sql('url')} AS url_format FROM (SELECT page_id, url, ([{', '.join(map(repr, _NAMES))}])[(page_id % {len(_NAMES)} + 1)::INTEGER] AS name FROM pages)"


@query
def detect_magic(spark, sf_dir):
    heads = ["%PDF-1.7 ", "{\\rtf1 ", "GIF89a", "<?xml version='1.0'?>", "  [1, ", "plain ", "<!DOCTYPE HTML><p>", "PK\x03\x04", "{"]
    content = F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % len(heads) + 1).cast("int")), F.lit(" x "), F.coalesce("text", F.lit(""))).cast("binary")
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("src"), F.col("doc_id").alias("id"), T.format_by_magic(content).alias("format_key"))
    return docs.unionByName(table(spark, sf_dir, "pages").where("html is not null").select(F.lit("p").alias("src"), F.col("page_id").alias("id"), T.format_by_magic(F.col("html").cast("binary")).alias("format_key")))


ORACLES["detect_magic"] = """
SELECT 'd' AS src, doc_id AS id, CASE WHEN k IN ('pdf', 'rtf', 'image', 'zip') THEN k WHEN substr(hex(encode(h || ' x ' || coalesce(text, ''))), 16385, 1) IN ('8', '9', 'A', 'B') THEN NULL WHEN k = '' THEN NULL ELSE k END AS format_key
FROM (SELECT *, (['pdf', 'rtf', 'image', 'xml', 'json', '', 'html', 'zip', 'json'])[(doc_id % 9 + 1)::INTEGER] AS k,
             (['%PDF-1.7 ', '{\\rtf1 ', 'GIF89a', '<?xml version=\'\'1.0\'\'?>', '  [1, ', 'plain ', '<!DOCTYPE HTML><p>', 'PK' || chr(3) || chr(4), '{'])[(doc_id % 9 + 1)::INTEGER] AS h FROM documents)
UNION ALL
SELECT 'p', page_id, CASE WHEN substr(hex(encode(html)), 16385, 1) IN ('8', '9', 'A', 'B') THEN NULL WHEN contains(lower(html), '<!doctype html') OR contains(lower(html), '<html') THEN 'html' WHEN starts_with(html, '<?xml') THEN 'xml' WHEN regexp_matches(html, '^\\s*[{\\[]') THEN 'json' END FROM pages WHERE html IS NOT NULL"""


@query
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html("html").alias("text"))


ORACLES["strip_html"] = r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*(>|$)|>', ' ', 'g'), '[\s\x{0B}\x{85}\x{A0}]+', ' ', 'g')) AS text FROM pages"


def _all_lines(spark, sf_dir):
    return line_docs(spark, sf_dir).select("doc_id", F.posexplode("blocks.text").alias("idx", "line"))


_ALL_LINES = f"WITH {_LINES} SELECT doc_id, idx, "
_FOOT = "(regexp_full_match(text, '\\+?[0-9]+') AND try_cast(ltrim(text, '+') AS HUGEINT) <= 4294967295 OR starts_with(lower(text), 'page '))"
_ITEM = "regexp_matches(text, '^([-*•·◦‣] |[0-9]{1,3}[.)])')"
_ALPHA, _UPPER = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))", "length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))"


@query
def classify_lines(spark, sf_dir):
    return _all_lines(spark, sf_dir).select("doc_id", "idx", T.classify("line").alias("kind"), T.is_list_item("line").alias("list_item"), T.is_footer("line").alias("footer"))


ORACLES["classify_lines"] = (
    _ALL_LINES
    + f"""CASE WHEN {_FOOT} THEN 'footer' WHEN {_ITEM} THEN 'list_item' WHEN strlen(text) < 120 AND NOT ends_with(text, '.') AND {_ALPHA} > 0 AND ({_UPPER} / {_ALPHA} > 0.6 OR strlen(text) < 60) THEN 'title' ELSE 'narrative_text' END AS kind,
{_ITEM} AS list_item, coalesce({_FOOT}, false) AS footer FROM blk"""
)


@query
def classify_headings(spark, sf_dir):
    ratio, bold = 1.0 + (F.col("idx") % 4) / 10, F.col("idx") % 3 == 0
    return _all_lines(spark, sf_dir).select("doc_id", "idx", T.is_heading("line", ratio, bold).alias("heading"))


ORACLES["classify_headings"] = (
    _ALL_LINES
    + f"""strlen(text) <= 200 AND (1 + (idx % 4) / 10 >= 1.2 OR (idx % 3 = 0 AND strlen(text) < 120 AND NOT ends_with(text, '.')) OR (strlen(text) < 80 AND NOT ends_with(text, '.') AND {_ALPHA} > 0 AND {_UPPER} / {_ALPHA} > 0.7)) AS heading FROM blk"""
)


@query
def vision_triage(spark, sf_dir):
    return line_docs(spark, sf_dir).select("doc_id", T.needs_vision("blocks").alias("needs_vision"))


ORACLES["vision_triage"] = f"WITH {_LINES} SELECT l.doc_id, len(l.b) = 0 OR list_sum(list_transform(l.b, lambda x: strlen(x))) < 50 AS needs_vision FROM l WHERE l.b IS NOT NULL"


@query
def sidecar_override(spark, sf_dir):
    docs = line_docs(spark, sf_dir)
    # a checked bound: at most three settings rows
    own = spark.createDataFrame([(0, "fixed", 128, None), (1, None, 64, 8), (2, "by-page", None, 0)], "doc_id long, s_strategy string, s_max int, s_overlap int")
    joined = docs.join(F.broadcast(own), "doc_id", "left").select("doc_id", "blocks", F.coalesce("s_strategy", F.lit("by-structure")).alias("strategy"), F.coalesce("s_max", F.lit(512)).alias("max_tokens"), F.coalesce("s_overlap", F.lit(50)).alias("overlap"))
    out = chunking.chunk_each(joined, "strategy", "max_tokens", "overlap")
    return out.groupBy("doc_id", "strategy", "max_tokens", "overlap").agg(F.count(F.lit(1)).alias("chunks"))


def _count_sql(strategy: str, most: int, overlap: int, where: str) -> str:
    blocks = _LINES.replace("FROM documents)", f"FROM documents WHERE {where})")
    return f"(SELECT doc_id, '{strategy}' AS strategy, {most} AS max_tokens, {overlap} AS overlap, count(*) AS chunks FROM ({chunk_sql(blocks, strategy, most, overlap)} SELECT * FROM out) GROUP BY doc_id)"


ORACLES["sidecar_override"] = (
    f"""SELECT doc_id, 'fixed' AS strategy, 128 AS max_tokens, 50 AS overlap, count(*) AS chunks FROM ({ORACLES["chunk_fixed_o50"].replace("2048", "512").replace("1848", "312").replace("<= 512", "<= 128")}) WHERE doc_id = 0 GROUP BY doc_id
UNION ALL {_count_sql("by-structure", 64, 8, "doc_id = 1")} UNION ALL {_count_sql("by-page", 512, 0, "doc_id = 2")} UNION ALL {_count_sql("by-structure", 512, 50, "doc_id > 2")}"""
)


@query
def batch_summary(spark, sf_dir):
    docs = line_docs(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    chunks = chunking.chunk(docs, "by-structure", 512, 50).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select("doc_id").join(labels, "doc_id", "left").join(chunks, "doc_id", "left")
    failed = F.coalesce(F.col("quality") == 0, F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.sum(F.when(~failed, F.coalesce("n", F.lit(0)))).alias("total_chunks"), F.lit("by-structure").alias("strategy"), F.lit(512).alias("max_tokens"), F.lit(50).alias("overlap")
    )


ORACLES["batch_summary"] = (
    chunk_sql(_LINES, "by-structure", 512, 50)
    + """SELECT count(*) AS total, count(*) FILTER (NOT f) AS succeeded, count(*) FILTER (f) AS failed, (sum(n) FILTER (NOT f))::BIGINT AS total_chunks, 'by-structure' AS strategy, 512 AS max_tokens, 50 AS overlap
FROM (SELECT d.doc_id, coalesce(q.quality = 0, false) AS f, coalesce(c.n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM out GROUP BY doc_id) c USING (doc_id))"""
)


def _pages_html(spark, sf_dir):
    from ..sources.reader import parse_documents

    docs = table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.col("html").cast("binary").alias("content"), F.lit("html").alias("format_key"), F.lit("html").alias("ext"))
    return parse_documents(docs)


@query
def html_blocks(spark, sf_dir):
    return _pages_html(spark, sf_dir).select("page_id", F.posexplode("blocks").alias("idx", "b")).select("page_id", "idx", "b.element_type", "b.text", F.round(F.col("b.confidence").cast("double"), 4).alias("confidence"))


def _html_query(name: str, kind: str, level: str | None, tag: str) -> None:
    def run(spark, sf_dir):
        rows = _pages_html(spark, sf_dir).select("page_id", F.explode("blocks").alias("b")).where(F.col("b.element_type") == kind)
        rows = rows.where(F.get("b.hierarchy", F.lit(0)) == level) if level else rows.where(F.size("b.hierarchy") == 0)
        return rows.select("page_id", F.col("b.text").alias("text"))

    QUERIES[name] = run
    entity = "replace(replace(replace(replace(replace(x, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(13), '')"
    ORACLES[name] = f"""
WITH s AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', '', 'g') AS h FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)) AS x FROM s),
u AS (SELECT page_id, regexp_replace(x, '<[^>]*>', '', 'g') AS x FROM t)
SELECT page_id, text FROM (SELECT page_id, trim({entity}, ' ' || chr(10) || chr(9)) AS text FROM u) WHERE text <> ''"""


_html_query("html_titles", "title", None, "title")
_html_query("html_headings", "title", "h1", "h1")
_html_query("html_list_items", "list_item", None, "li")


# All blocks of a page. An open paragraph ends where a tag of a block begins or ends.
_ENDS = "'(?i)(</?(?:p|div|h1|ul|ol|li|article|footer|header|nav|main|section|table|body|html)\\b)', chr(1) || '\\1', 'g'"
_KIND_SQL = [(1, "title", "<title(?:\\s[^>]*)?>(.*?)</title>"), (2, "title", "<h1(?:\\s[^>]*)?>(.*?)</h1>"), (3, "narrative_text", "<p(?:\\s[^>]*)?>([^\\x01]*)"), (4, "list_item", "<li(?:\\s[^>]*)?>(.*?)</li>")]
_PAGE_BLOCKS = f"""s AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages WHERE html IS NOT NULL),
k AS ({" UNION ALL ".join(f"SELECT page_id, {n} AS k, '{kind}' AS element_type, regexp_extract_all({f'regexp_replace(h, {_ENDS})' if n == 3 else 'h'}, '(?is){tag}', 1) AS l FROM s" for n, kind, tag in _KIND_SQL)}),
x AS (SELECT page_id, k, element_type, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM k),
y AS (SELECT page_id, k, pos, element_type, regexp_replace(x, '<[^>]*>|' || chr(1), '', 'g') AS x FROM x),
z AS (SELECT page_id, k, pos, element_type, trim(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(13), ''), ' ' || chr(10) || chr(9)) AS text FROM y)"""
ORACLES["html_blocks"] = f"WITH {_PAGE_BLOCKS} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k, pos) - 1)::INTEGER AS idx, element_type, text, 0.95::DOUBLE AS confidence FROM z WHERE text <> ''"


@query
def html_paragraphs(spark, sf_dir):
    return _pages_html(spark, sf_dir).select("page_id", F.explode("blocks").alias("b")).where(F.col("b.element_type") == "narrative_text").select("page_id", F.col("b.text").alias("text"))


ORACLES["html_paragraphs"] = f"WITH {_PAGE_BLOCKS} SELECT page_id, text FROM z WHERE k = 3 AND text <> ''"


# Literal fixtures: the expected rows are the SQL.


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


def _fixture(name: str, format_key: str, ext: str, content: bytes, expected: list[tuple]) -> None:
    def run(spark, sf_dir):
        from ..sources.reader import parse_documents

        docs = spark.createDataFrame([(bytearray(content), format_key, ext)], "content binary, format_key string, ext string")
        return parse_documents(docs).select(F.posexplode("blocks").alias("idx", "b")).select("idx", "b.element_type", "b.text", F.array_join("b.hierarchy", "/").alias("hierarchy"))

    QUERIES[name] = run
    ORACLES[name] = _values([(i, *r) for i, r in enumerate(expected)], "idx, element_type, text, hierarchy")


_fixture(
    "markdown_parse", "text", "md", b"# Top\nintro line\nmore\n\n- one\n2) two\n```py\n\nx = 1\n```\n##No space\n####### deep\ntail",
    [("title", "Top", "h1"), ("narrative_text", "intro line more", ""), ("list_item", "one", ""), ("list_item", "two", ""), ("code_block", "x = 1", ""), ("title", "No space", "h2"), ("title", "deep", "h7"), ("narrative_text", "tail", "")],
)
_fixture("rtf_extract", "rtf", "rtf", b"{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}Caf\\'e9 \\{x\\}\\par next\\par\\par last}", [("narrative_text", "Café {x} next", ""), ("narrative_text", "last", "")])
_fixture("xml_walk", "xml", "xml", b"<r><t>A</t><s><p>B <![CDATA[c]]></p>tail<e/></s></r>", [("narrative_text", "A", "r/t"), ("narrative_text", "B c", "r/s/p"), ("narrative_text", "tail", "r/s")])
_fixture("csv_parse", "csv_tsv", "csv", b'name;"a;b"\nx;1\ny;2\n', [("table", "Table with 2 columns (name, a;b) and 2 rows", "")])


@query
def otsl_html(spark, sf_dir):
    rows = [("C C NL C U", "a b c"), ("C L NL U X", "h"), ("C C NL C C NL", "1 2 3 4")]
    f = F.udf(lambda t, c: vision.otsl_html(vision.parse_otsl(t), c.split()), "string")
    return spark.createDataFrame(rows, "otsl string, cells string").select("otsl", f("otsl", "cells").alias("html"))


ORACLES["otsl_html"] = _values(
    [
        ("C C NL C U", '<table><tr><td>a</td><td rowspan="2">b</td></tr><tr><td>c</td></tr></table>'),
        ("C L NL U X", '<table><tr><td colspan="2" rowspan="2">h</td></tr><tr></tr></table>'),
        ("C C NL C C NL", "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"),
    ],
    "otsl, html",
)


@query
def ctc_decode(spark, sf_dir):
    """The embeddings as logits: 16 steps of 4 classes."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    out = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", vision.ctc_decode(steps, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("d"))
    return out.select("vec_id", "d.text", F.round("d.confidence", 6).alias("confidence"))


ORACLES["ctc_decode"] = """
WITH s AS (SELECT vec_id, t, embedding[(t * 4 + 1):(t * 4 + 4)] AS r FROM embeddings, range(0, 16) x(t)),
a AS (SELECT vec_id, t, list_max(r) AS v, list_position(r, list_max(r)) - 1 AS b FROM s),
p AS (SELECT *, lag(b) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM a),
k AS (SELECT vec_id, t, substr('abc', b::INTEGER, 1) AS ch, 1 / (1 + exp(-v::DOUBLE)) AS c FROM p WHERE b > 0 AND b IS DISTINCT FROM before)
SELECT e.vec_id, coalesce(string_agg(k.ch, '' ORDER BY k.t), '') AS text, round(coalesce(avg(k.c), 0), 6) AS confidence FROM embeddings e LEFT JOIN k USING (vec_id) GROUP BY e.vec_id"""


@query
def merge_ocr(spark, sf_dir):
    rows = [(1, [("Hello", 0.0, 10.0, 40.0, 12.0, 0.8), ("world", 45.0, 11.0, 40.0, 12.0, 0.6), ("again", 0.0, 40.0, 40.0, 12.0, 0.9)]), (2, [("far", 0.0, 0.0, 10.0, 10.0, 1.0), ("apart", 90.0, 0.0, 10.0, 10.0, 0.5)])]
    docs = spark.createDataFrame(rows, "id long, r array<struct<t:string,x:float,y:float,w:float,h:float,c:float>>")
    blocks = F.transform("r", lambda r: F.struct(r["t"].alias("text"), F.struct(r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("width"), r["h"].alias("height")).alias("bbox"), r["c"].alias("confidence")))
    out = docs.select("id", F.posexplode(vision.merge_boxes(blocks)).alias("idx", "b"))
    return out.select("id", "idx", "b.text", F.round(F.col("b.bbox.width").cast("double"), 3).alias("width"), F.round(F.col("b.confidence").cast("double"), 3).alias("confidence"))


ORACLES["merge_ocr"] = "SELECT id::BIGINT AS id, idx, text, width::DOUBLE AS width, confidence::DOUBLE AS confidence FROM (VALUES (1, 0, 'Hello world', 85.0, 0.7), (1, 1, 'again', 40.0, 0.9), (2, 0, 'far', 10.0, 1.0), (2, 1, 'apart', 10.0, 0.5)) t(id, idx, text, width, confidence)"


@query
def pdf_fallback(spark, sf_dir):
    """Turns as pages of text without layout: paragraphs with their kind and page."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.filter(F.transform(F.split("text", "\\n\\n", -1), T.trim), lambda p: p != "")).alias("idx", "text"))
    return rows.select("conv_id", F.col("turn").alias("page"), "idx", "text", T.classify("text").alias("kind"))


_MANY = "len(string_split(rtrim(text, chr(10)), chr(10)))"
ORACLES["pdf_fallback"] = f"""
WITH p AS (SELECT conv_id, turn AS page, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS p FROM conversations WHERE text IS NOT NULL),
t AS (SELECT conv_id, page, (i - 1)::INTEGER AS idx, p[i] AS text FROM p, unnest(range(1, len(p) + 1)) r(i))
SELECT conv_id, page, idx, text, CASE WHEN {_MANY} = 1 AND {_FOOT} THEN 'footer' WHEN {_ITEM} THEN 'list_item'
  WHEN {_MANY} = 1 AND strlen(text) < 120 AND NOT ends_with(text, '.') AND {_ALPHA} > 0 AND ({_UPPER} / {_ALPHA} > 0.6 OR strlen(text) < 60) THEN 'title' ELSE 'narrative_text' END AS kind FROM t"""


@query
def regions_in_reading_order(spark, sf_dir):
    """The embeddings as sixteen regions each: those with a confidence of 0, by y, then x."""
    e = F.col("embedding")
    boxes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(i.alias("n"), F.get(e, i * 4).alias("confidence"), F.struct(F.round(F.get(e, i * 4 + 1).cast("double"), 1).alias("y"), F.round(F.get(e, i * 4 + 2).cast("double"), 1).alias("x")).alias("bbox")))
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", vision.reading_order(vision.confident(boxes, 0.0)).alias("r"))
    out = rows.select("vec_id", F.posexplode("r").alias("idx", "r"))
    return out.select("vec_id", "idx", F.col("r.bbox.y").alias("y"), F.col("r.bbox.x").alias("x"))


ORACLES["regions_in_reading_order"] = """
WITH b AS (SELECT vec_id, round(embedding[i * 4 + 2]::DOUBLE, 1) AS y, round(embedding[i * 4 + 3]::DOUBLE, 1) AS x FROM embeddings, range(0, 16) r(i) WHERE embedding[i * 4 + 1] >= 0)
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY y, x) - 1)::INTEGER AS idx, y, x FROM b"""


@query
def image_sizes(spark, sf_dir):
    png, gif, bmp = bytes.fromhex("89504e470d0a1a0a0000000d49484452000001f400000064"), b"GIF89a" + bytes([44, 1, 7, 0]), b"BM" + bytes(16) + (640).to_bytes(4, "little") + (-480).to_bytes(4, "little", signed=True)
    rows = [("a.png", bytearray(png)), ("b.gif", bytearray(gif)), ("c.bmp", bytearray(bmp)), ("d.png", bytearray(b"no")), ("e.tif", bytearray(png))]
    return spark.createDataFrame(rows, "name string, content binary").select("name", T.image_size("content", T.extension("name")).alias("size"), T.format_by_magic("content").alias("magic"))


ORACLES["image_sizes"] = _values([("a.png", "500x100", "image"), ("b.gif", "300x7", "image"), ("c.bmp", "640x480", "image"), ("d.png", None, None), ("e.tif", None, "image")], "name, size, magic")


@query
def pdf_lines(spark, sf_dir):
    """Characters with places to lines, tables and paragraphs."""
    import pandas as pd

    from ..sources import pdf

    def blocks(pages):
        for page in pages:
            for n, own in page.groupby("page"):
                got = pdf.layout([pdf.Char(c.ch, c.x, c.y, c.y + c.size, 6.0, c.size, "F", bool(c.bold)) for c in own.itertuples()], int(n))
                yield pd.DataFrame([(int(n), i, b.element_type, b.text) for i, b in enumerate(got)], columns=["page", "idx", "element_type", "text"])

    word = lambda page, x, y, size, bold, text: [(page, x + 6.0 * i, y, size, bold, ch) for i, ch in enumerate(text)]
    chars = word(1, 50.0, 700.0, 20.0, False, "Report") + word(1, 50.0, 660.0, 10.0, False, "first line goes on") + word(1, 50.0, 648.0, 10.0, False, "and ends here.") + word(1, 50.0, 600.0, 10.0, False, "- item")
    for k in range(3):
        for c in range(3):
            chars += word(2, 50.0 + 100 * c, 500.0 - 12 * k, 10.0, k == 0, f"r{k}c{c}")
    chars += word(2, 300.0, 20.0, 10.0, False, "7")
    rows = spark.createDataFrame(chars, "page int, x double, y double, size double, bold boolean, ch string").repartition(1)
    return rows.mapInPandas(blocks, "page int, idx int, element_type string, text string")


ORACLES["pdf_lines"] = _values(
    [(1, 0, "title", "Report"), (1, 1, "narrative_text", "first line goes on and ends here."), (1, 2, "list_item", "- item"), (2, 0, "table", "r1c0 | r1c1 | r1c2\nr2c0 | r2c1 | r2c2"), (2, 1, "footer", "7")], "page, idx, element_type, text"
)


@query
def jsonl_render(spark, sf_dir):
    """Chunks as JSON, read back."""
    chunks = _turn_chunks(spark, sf_dir)
    line = chunks.select("doc_id", render.chunk_json().alias("j"))
    back = F.from_json("j", "id string, text string, token_count bigint, page_start int, page_end int, overlap_prefix string, source_blocks array<struct<element_type:string,text:string>>")
    return line.select("doc_id", back.alias("c")).select("doc_id", "c.id", "c.text", "c.token_count", "c.page_start", "c.page_end", "c.overlap_prefix", F.size("c.source_blocks").alias("n_blocks"))


ORACLES["jsonl_render"] = chunk_sql(_TURNS, "by-structure", 64, 0) + "SELECT doc_id, 'chunk-' || cid AS id, body AS text, ceil(strlen(body) / 5.0)::BIGINT AS token_count, page_start, page_end, prefix AS overlap_prefix, n_blocks FROM out"


@query
def conversation_round_trip(spark, sf_dir):
    """Blocks exploded, shuffled and collected again keep their order."""
    rows = turn_docs(spark, sf_dir).select("doc_id", F.posexplode("blocks").alias("block_idx", "b")).repartition("block_idx")
    return chunking.collected(rows).select("doc_id", F.array_join(F.transform("blocks", lambda x: x["b"]["text"]), "\n").alias("text"), F.size("blocks").alias("n"))


ORACLES["conversation_round_trip"] = f"WITH {_TURNS} SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS text, count(*)::INTEGER AS n FROM blk GROUP BY doc_id"


# Every document as a file of a format, made of its lines and read by that format's parser.


def file_docs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """doc_id and blocks of documents written as files of a kind; null texts have no lines."""
    from ..sources.reader import parse_documents
    from ..sources.writers import WRITERS, written

    texts = F.filter(F.transform(T.lines(F.coalesce("text", F.lit(""))), T.trim), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", texts.alias("lines")).select("doc_id", written(F.col("lines"), kind).alias("content"))
    _, format_key, ext = WRITERS[kind]
    return parse_documents(docs.withColumns({"format_key": F.lit(format_key), "ext": F.lit(ext)}))


_FILE_LINES = _LINES.replace("FROM documents)", "FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
_ONE = "(SELECT doc_id, 0::INTEGER AS idx, '' AS text, 0 AS n FROM l WHERE len(b) = 0)"


def _file_query(kind: str, rows_sql: str) -> None:
    """A row for each block: doc_id, idx, element_type, text, page, hierarchy, cells (all cells of a table, names first, one to a line)."""

    def run(spark, sf_dir):
        b = file_docs(spark, sf_dir, kind).select("doc_id", F.posexplode("blocks").alias("idx", "b"))
        t = F.col("b.table_data")
        cells = F.when(t.isNotNull(), F.array_join(F.flatten(F.concat(F.array(F.coalesce(t["headers"], F.array().cast("array<string>"))), t["rows"])), "\n"))
        return b.select("doc_id", "idx", "b.element_type", "b.text", "b.page", F.array_join("b.hierarchy", "/").alias("hierarchy"), cells.alias("cells"))

    QUERIES[f"file_{kind}"] = run
    ORACLES[f"file_{kind}"] = f"WITH {_FILE_LINES}, n AS (SELECT doc_id, len(b)::INTEGER AS n, b FROM l) {rows_sql}"


_NO_CELLS = "1::INTEGER AS page, {h} AS hierarchy, NULL::VARCHAR AS cells"
_PLAIN = _NO_CELLS.format(h="''")


def _table_sql(label: str, text: str, page: int = 1, before: int = 0) -> str:
    line = text.replace("x", "b[i]")
    return f"SELECT doc_id, {before}::INTEGER AS idx, 'table' AS element_type, {label} AS text, {page}::INTEGER AS page, '' AS hierarchy, 'line' || chr(10) || 'text' || coalesce((SELECT string_agg(chr(10) || i || chr(10) || {line}, '' ORDER BY i) FROM range(1, n.n + 1) r(i)), '') AS cells FROM n"


_SHEET = "SELECT doc_id, 0::INTEGER AS idx, 'title' AS element_type, 'Lines' AS text, 1::INTEGER AS page, '' AS hierarchy, NULL::VARCHAR AS cells FROM n UNION ALL " + _table_sql("'Sheet \"Lines\": 2 columns (line, text) and ' || n || ' data rows'", "x", before=1)
_LATIN = "regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g')"
_WINDOWS = "regexp_replace(text, '[^\\x{0}-\\x{7f}\\x{a0}-\\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g')"
_EMPTY = f"UNION ALL SELECT doc_id, idx, 'narrative_text' AS element_type, text, {_PLAIN} FROM {_ONE}"

_file_query("docx", f"SELECT doc_id, idx, CASE idx WHEN 0 THEN 'title' ELSE 'narrative_text' END AS element_type, text, {_NO_CELLS.format(h='''CASE idx WHEN 0 THEN 'h1' ELSE '' END''')} FROM blk")
_file_query("pptx", f"SELECT doc_id, idx, CASE idx % 10 WHEN 0 THEN 'title' ELSE 'narrative_text' END AS element_type, text, page, '' AS hierarchy, NULL::VARCHAR AS cells FROM blk UNION ALL SELECT doc_id, idx, 'narrative_text', 'Empty presentation', {_PLAIN} FROM {_ONE}")
_file_query("xlsx", _SHEET)
_file_query("ods", _SHEET)
_file_query(
    "eml",
    f"""SELECT doc_id, u.idx::INTEGER AS idx, u.kind AS element_type, u.x AS text, {_PLAIN} FROM n, unnest([
 {{'idx': 0, 'kind': 'title', 'x': coalesce(nullif(trim(left(regexp_replace(coalesce(b[1], ''), '[^\\x{{0}}-\\x{{7f}}]', '?', 'g'), 60)), ''), 'none')}}, {{'idx': 1, 'kind': 'email_header', 'x': 'From: Ann <ann@example.org>'}}, {{'idx': 2, 'kind': 'email_header', 'x': 'To: bob@example.org'}},
 {{'idx': 3, 'kind': 'email_body', 'x': CASE WHEN n.n > 1 THEN array_to_string(b[2:], chr(10)) END}}]) t(u) WHERE u.x IS NOT NULL""",
)
_file_query("rtf", f"SELECT doc_id, idx, 'narrative_text' AS element_type, {_LATIN} AS text, {_PLAIN} FROM blk {_EMPTY}")
_file_query("xml", f"SELECT doc_id, idx, 'narrative_text' AS element_type, text, {_NO_CELLS.format(h="'doc/line'")} FROM blk {_EMPTY}")
_file_query("csv", _table_sql("'Table with 2 columns (line, text) and ' || n || ' rows'", "translate(x, ',;|' || chr(9), '    ')"))
_file_query("md", f"SELECT doc_id, idx, CASE idx WHEN 0 THEN 'title' ELSE 'list_item' END AS element_type, text, {_NO_CELLS.format(h='''CASE idx WHEN 0 THEN 'h1' ELSE '' END''')} FROM blk {_EMPTY}")
_file_query(
    "html",
    f"""SELECT doc_id, 0::INTEGER AS idx, 'title' AS element_type, text, {_NO_CELLS.format(h="'h2'")} FROM blk WHERE idx = 0
UNION ALL SELECT doc_id, (idx + 1)::INTEGER, 'narrative_text', text, {_PLAIN} FROM blk
UNION ALL SELECT doc_id, (CASE WHEN n = 0 THEN 0 ELSE n + 1 END)::INTEGER AS idx, element_type, text, page, hierarchy, cells FROM (SELECT n.n, t.* FROM n JOIN ({_table_sql("'Table: 2 columns, ' || n || ' rows'", 'x')}) t USING (doc_id))
UNION ALL SELECT doc_id, (n + 2)::INTEGER, 'code_block', b[1], {_PLAIN} FROM n WHERE n > 0""",
)
_file_query("cp1252", f"SELECT doc_id, idx, 'narrative_text' AS element_type, {_WINDOWS} AS text, {_PLAIN} FROM blk {_EMPTY}")
_file_query("png", f"SELECT doc_id, 0::INTEGER AS idx, 'image' AS element_type, 'Image (png): ' || coalesce(list_max(list_transform(b, lambda x: length(x))), 0) || 'x' || n || ', 29 bytes — OCR not available (ONNX runtime not configured)' AS text, {_PLAIN} FROM n")


@query
def chunk_counts(spark, sf_dir):
    """Chunks of every document, those without text or lines too."""
    texts = F.filter(F.transform(T.lines("text"), T.trim), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(texts, lambda x, i: block(F.lit("narrative_text"), x, F.floor(i / 10) + 1, F.lit(1.0))).alias("blocks"))
    counts = chunking.chunk(docs, "by-structure", 512, 50).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


ORACLES["chunk_counts"] = chunk_sql(_LINES, "by-structure", 512, 50) + "SELECT d.doc_id, count(o.doc_id) AS chunks FROM documents d LEFT JOIN out o USING (doc_id) GROUP BY d.doc_id"
