"""op6: token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.token_counts import count_tokens
from lodestar.sources.tables import read_table

VOCABULARY = "piece_bpe_32k.model"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return count_tokens(docs, path=public_tokenizers.path(VOCABULARY), keep=["doc_id", "lang", "source"])


QUERIES = {"op6_token_counts": op6_token_counts}
