"""op10: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.secrets import scan_secrets
from lodestar.sources.tables import read_table


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    secrets = F.filter("candidates", lambda c: c["secret"])
    spans = F.array_join(F.transform(secrets, lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("candidates").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), spans.alias("secrets"), F.sha2("redacted", 256).alias("redacted_sha256"))


QUERIES = {"op10_secrets": op10_secrets}
