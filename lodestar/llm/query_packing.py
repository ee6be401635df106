"""op4: pack all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.packing import pack_documents
from lodestar.sources.tables import read_table

VOCABULARY = "byte_bpe_50k.json"


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, path=public_tokenizers.path(VOCABULARY), pattern=public_tokenizers.PATTERN)


QUERIES = {"op4_pack": op4_pack}
