"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns the pieces of every document with their
place in a sequence. Columns beyond those of documents are left behind by the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.lineage import ensure_checkpoint_dir, remove
from lodestar.llm.mixing import mixed_texts
from lodestar.llm.near_copies import keep_one_each
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import judge_quality
from lodestar.llm.secrets import scan_secrets
from lodestar.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_50k.json"


def _once(df: DataFrame) -> DataFrame:
    """The same rows, made once each: what is asked of a row that an array held is not asked of what the array was made from."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row_of")).select("row_of.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Statistics are made twice, for the vote counts and for the verdicts: no text is
    written but the stage's own."""
    return judge_quality(docs, keep=COLUMNS, cut=_once).filter("kept").select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 alike or more: the one with the smallest id."""
    return keep_one_each(docs, COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret; n_chars follows a text that was changed."""
    found = scan_secrets(docs, keep=COLUMNS)
    changed = F.exists("candidates", lambda c: c["secret"])
    n_chars = F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixed_texts(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack_documents(docs, path=public_tokenizers.path(VOCABULARY), pattern=public_tokenizers.PATTERN, keep=["doc_id", "source"])


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]

#: The forest's findings, the links of fingerprints and the packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again by the next.

    A stage's table is removed once the next stage's is complete; the last one stays for the result to be read.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

