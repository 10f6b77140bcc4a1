"""Line dedup on DataFrame functions only.

Line hashes are range-partitioned and sorted by document and position, first occurrences and document
counts are streamed from each range, and the answer is one compressed keep bitmap per document; the
text itself meets its bitmap only when somebody asks for the cleaned text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import LOWER, SPACE, UPPER, rows_of, stored

BLOCKS = 512
"""Blocks of documents a single line hash is spread over, so that a line found in a third of all
documents is streamed by many tasks."""
SALTS = 64
"""Parts of these blocks, one per bit of a long: the records of one common line meet it in so many tasks."""


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_records(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: the document (``doc_id`` and the
    hash of its text), the position and a 128-bit hash of the key."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("tid"),
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "tid", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "doc_id", "tid", "pos", F.xxhash64("key").alias("h"),
        F.xxhash64(F.lit(1), F.col("key")).alias("g"),
        F.pmod(F.xxhash64("doc_id", "tid"), F.lit(BLOCKS)).cast("int").alias("block"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep bitmaps of the documents that lose lines.

    A line key found in at least ``min_docs`` documents loses its lines: all of them (``keep="none"``)
    or all but the first in order of document and position (``keep="first"``). Returns ``doc_id``,
    ``tid`` (hash of the text) and ``keep``: a map from word number to 64 bits, bit ``i`` of word ``w``
    standing for line ``64 w + i``; a word that is absent has all bits set, so the map only holds
    what changes.

    Null or empty text is one empty line and loses nothing. A null id is a document like any other;
    rows that repeat both id and text are one document and get the same bitmap.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    records = stored(line_records(rows_of(docs, id_col, text_col), min_chars))
    ranged = records.repartitionByRange("h", "block")
    stream = Window.partitionBy("h", "block").orderBy("g", "doc_id", "tid", "pos")
    before = F.lag(F.struct("g", "doc_id", "tid")).over(stream)
    streamed = ranged.select("*", (~before.eqNullSafe(F.struct("g", "doc_id", "tid"))).alias("opens"))
    by_block = streamed.where("opens").groupBy("h", "g", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tid", "pos")).alias("first"))
    salt = F.pmod(F.col("block"), F.lit(SALTS))
    common = by_block.groupBy("h", "g").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt)).alias("salts")).where(F.col("n") >= min_docs)
    # A common line goes only to the parts that hold it: one row for most, at most 64.
    dealt = common.select("h", "g", "first", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)),
        lambda i: F.call_function("getbit", F.col("salts"), i) == 1)).alias("salt"))
    hit = records.withColumn("salt", salt).join(dealt, ["h", "g", "salt"])
    if keep == "first":
        hit = hit.where(~F.struct("doc_id", "tid", "pos").eqNullSafe(F.col("first")))
    words = hit.groupBy("doc_id", "tid", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("gone"))
    return words.groupBy("doc_id", "tid").agg(F.map_from_entries(F.collect_list(
        F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def kept_lines(text: Column, keep: Column) -> Column:
    """Lines of ``text`` whose bit is set."""
    lines = F.split(text, "\n", -1)
    bit = lambda i: F.call_function("getbit", F.element_at(keep, F.floor(i / 64).cast("int")), (i % 64).cast("int"))
    return F.when(keep.isNull(), lines).otherwise(
        F.filter(lines, lambda _, i: F.coalesce(bit(i), F.lit(1)) == 1))


def _marked(rows: DataFrame, bitmaps: DataFrame, doc_id: Column, tid: Column) -> DataFrame:
    marks = bitmaps.select(F.col("doc_id").alias("_b_id"), F.col("tid").alias("_b_tid"), F.col("keep").alias("_keep"))
    return rows.join(marks, doc_id.eqNullSafe(F.col("_b_id")) & (tid == F.col("_b_tid")), "left")


def clean_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1, id_col: str = "doc_id",
                text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all its columns, the text without the dropped lines; ``length_col`` takes the new
    number of characters. A null text stays null."""
    marks = keep_bitmaps(docs, min_docs, keep, min_chars, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = _marked(docs, marks, F.col(id_col).cast("long"), F.xxhash64(text))
    new = F.when(F.col("_keep").isNull(), F.col(text_col)).otherwise(
        F.array_join(kept_lines(F.col(text_col), F.col("_keep")), "\n"))
    out = joined.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and the cleaned ``text`` of every row of ``docs``."""
    rows = rows_of(docs, id_col, text_col)
    joined = _marked(rows, bitmaps, F.col("doc_id"), F.xxhash64("text"))
    lines, kept = F.split("text", "\n", -1), kept_lines(F.col("text"), F.col("_keep"))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept")).select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its cleaned text; see ``keep_bitmaps`` for what is dropped."""
    marks = keep_bitmaps(docs, min_docs, keep, min_chars, id_col, text_col)
    return apply_bitmaps(docs, marks, id_col, text_col)
