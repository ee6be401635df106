"""Helpers that the corpus operators share: lineage cuts, words, and prefix sums over skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrays import let, running_sums
from lodestar.lineage import ensure_checkpoint_dir
from lodestar.lineage import written as cut_lineage

__all__ = ["ASCII_SPACES", "WORD", "ascii_lower", "count_words", "cut_lineage", "ensure_checkpoint_dir", "let", "power_of_two", "running_sums", "text_column"]

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACES = " \t\n\x0b\x0c\r"


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; the quick way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def power_of_two(n: float, least: int, most: int) -> int:
    """The least power of two that is n or more, kept within [least, most]."""
    p = least
    while p < n and p < most:
        p *= 2
    return p


def text_column(docs: DataFrame, name: str = "text") -> Column:
    return F.col(name).cast("string")
