"""op8: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.html_text import extract_text
from lodestar.sources.tables import read_table


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op8_html_text": op8_html_text}
