"""Functions for SQL."""

from chunkloom.functions.register import register


def test_sql_functions(spark):
    register(spark)
    rows = spark.sql("SELECT b.block_idx, b.element_type, b.text FROM (SELECT cast('# A\n\nx' AS binary) c) d, LATERAL parse_blocks(d.c, 'text', 'md') b").collect()
    assert [tuple(r) for r in rows] == [(0, "title", "A"), (1, "narrative_text", "x")]
    assert spark.sql("SELECT b.error FROM (SELECT cast('x' AS binary) c) d, LATERAL parse_blocks(d.c, 'epub', 'epub') b").first()[0].startswith("E1001")
    assert tuple(spark.sql("SELECT fast_tokens('éé1'), bpe_tokens('hello world'), bpe_tokens(NULL)").first()) == (1, 2, 0)
