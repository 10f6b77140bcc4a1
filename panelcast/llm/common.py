"""Helpers shared by the operators: written intermediate tables and row identity."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
"""The characters that separate words: [\\x20\\x09-\\x0D]."""


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Cuts the lineage: a lost executor costs a re-read, and jobs that follow do not repeat the work.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as ``doc_id`` long) and the text (as ``text``, null replaced by empty), so that
    other columns cannot clash with names the operators make."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(id_column: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_SYSTEM = ctypes.CDLL(None)


def give_back() -> None:
    """Return memory that nothing uses to the system: a Python worker lives on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_SYSTEM, "malloc_trim"):
        _SYSTEM.malloc_trim(0)


def tally(n: int, per: int, least: int = 1) -> int:
    """Number of groups of about ``per`` rows that ``n`` rows need."""
    return max(least, -(-n // per))
