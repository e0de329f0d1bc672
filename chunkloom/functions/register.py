"""Functions for SQL: parsers as a table function, token counts as scalar ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from ..model import DocError


def blocks_function() -> UserDefinedTableFunction:
    from ..sources.reader import parse

    class Blocks:
        def eval(self, content: bytes, format_key: str, ext: str):
            try:
                for i, b in enumerate(parse(bytes(content or b""), format_key, ext)):
                    yield i, b.element_type, b.text, b.page, b.confidence, None
            except DocError as e:
                yield None, None, None, None, None, f"{e.code}: {e.message}"

    return F.udtf(Blocks, returnType="block_idx int, element_type string, text string, page int, confidence float, error string")


def register(spark: SparkSession) -> None:
    """parse_blocks(content, format_key, ext), bpe_tokens(text), fast_tokens(text)."""
    from ..operators.tokens import encoder

    @F.pandas_udf("bigint")
    def bpe_tokens(s: pd.Series) -> pd.Series:
        enc = encoder()
        return s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    spark.udf.register("bpe_tokens", bpe_tokens)
    spark.udtf.register("parse_blocks", blocks_function())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fast_tokens(text STRING) RETURNS BIGINT RETURN CAST(ceil(octet_length(text) / 5.0D) AS BIGINT)")
