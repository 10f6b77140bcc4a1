"""Packing token sequences by minimum bin slack.

Documents are tokenized and cut into pieces in one pass. Only the histogram of piece lengths (at most
``capacity`` numbers) reaches the driver, where a bitset subset-sum picks, window by window, the
multiset of remaining lengths with the least slack. A pattern is used as often as the counts allow, so
the plan has at most a few thousand patterns at any number of documents. Pieces then find their place
from their rank among the pieces of equal length.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import give_back, rows_of, stored

WORDS_KEPT = 600_000
"""Words whose ids a task remembers; beyond it the memory is emptied."""
TEXTS = 700
"""Texts whose new words are learned together."""
BLOCKS = 256
"""Blocks that pieces of one length are ranked in, so that no length meets in one task."""
# Lower-case letters that normalisation leaves alone: a run of them is one unit of the tokenizer, and a
# run of marks after it another.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
MARKS = ".,;:!?"


class WordTokens:
    """Token ids of a text from those of its words. The vocabulary drops white space and never joins
    across it, so the ids of a text are those of its words in a row, and each word is tokenized once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > WORDS_KEPT:
            self.words.clear()
        known = self.words
        new = words - known.keys()
        cores = {w: w.rstrip(MARKS) for w in new if w and w[-1] in MARKS}
        marks = {w[len(c):] for w, c in cores.items()}
        single = (new - cores.keys()) | (set(cores.values()) | marks) - known.keys()
        plain = [w for w in single if PLAIN(w)]
        if plain:  # one text of all of them, cut where a token ends a word
            ids = np.array(self.tokenizer.encode_batch_fast(
                [" ".join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the vocabulary splits runs of letters")
            raw, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
            known.update(zip(plain, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        rest = list(single.difference(plain)) + [w for w, c in cores.items() if not PLAIN(c)]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = np.array(e.ids, dtype="<u4").tobytes()
        known.update((w, known[c] + known[w[len(c):]]) for w, c in cores.items() if PLAIN(c))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = []
        for text in texts:
            if _latin(text):  # here the tokenizer's lower case is Python's
                text = text.lower()
            split.append(text.replace("\n", " ").split(" "))
        found: set[str] = set()
        for words in split:
            found.update(words)
        self.learn(found)
        ids = self.words.__getitem__
        return [b"".join([ids(w) for w in words]) for words in split]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids, each document closed by ``end_id``, cut into pieces of at most ``capacity``:
    ``doc_id``, ``start``, ``length``, ``doc_tokens`` and ``ids`` (little-endian unsigned 32-bit).

    A document gives full windows and one rest. Null and empty texts are the one id ``end_id``. Repeated
    rows give repeated pieces; null ids are kept.
    """
    tail, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "ids"]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out: list[list] = [[] for _ in names]
                texts = part.column(1).to_pylist()
                for doc, ids in zip(part.column(0).to_pylist(), _tokens(tokenizer_path).encode(texts)):
                    ids += tail
                    for start in range(0, len(ids), step):
                        piece = ids[start:start + step]
                        for column, value in zip(out, (doc, start // 4, len(piece) // 4, len(ids) // 4, piece)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, [pa.int64()] * 4 + [pa.binary()])], names)
        # A worker goes on to other stages; they need the memory.
        _tokens(tokenizer_path).words.clear()
        give_back()

    return rows_of(docs, id_col, text_col).mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def least_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as ``(times, {length: copies})`` that use up ``counts``.

    Each window takes the longest remaining length and fills what is left of it with the multiset of
    remaining lengths that comes closest: bit ``s`` of a running bitset tells whether the sum ``s`` is
    reachable, and the bitsets before each length give the copies back.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        first = max(left)
        room = capacity - first
        mask = (1 << (room + 1)) - 1
        reach, stages = 1, []
        for n in sorted((n for n in left if n <= room), reverse=True):
            before, many = reach, min(left[n] - (n == first), room // n)
            take = 1
            while many > 0:  # copies in powers of two reach every number of copies
                take = min(take, many)
                reach |= (reach << (n * take)) & mask
                many -= take
                take *= 2
            stages.append((n, before))
        at = reach.bit_length() - 1
        pattern = {first: 1}
        for n, before in reversed(stages):
            while not before >> at & 1:
                pattern[n] = pattern.get(n, 0) + 1
                at -= n
        times = min(left[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
        plan.append((times, pattern))
    return plan


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (a written table of pieces) with ``sequence_id`` and ``offset``, both gapless from 0.

    Ranks come from blocks of each length plus the sizes of the blocks before, so pieces that share
    one length, such as those of many copies, are ranked by many tasks.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, sequence = [], 0
    used: dict[int, int] = {}
    for times, pattern in least_slack(counts, capacity):
        offset = 0
        for n in sorted(pattern, reverse=True):
            lo = used.get(n, 0)
            rows.append((n, lo, pattern[n], offset, sequence))
            used[n] = lo + times * pattern[n]
            offset += n * pattern[n]
        sequence += times
    rows.sort()
    lengths, lows, copies, offsets, bases = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else [
        np.zeros(0, dtype=np.int64)] * 5
    firsts = np.searchsorted(lengths, np.arange(capacity + 2))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, rank = f["length"].to_numpy(), f["_rank"].to_numpy()
            at = np.zeros(len(f), dtype=np.int64)
            for one in np.unique(n):
                mine, lo, hi = n == one, firsts[one], firsts[one + 1]
                at[mine] = lo + np.searchsorted(lows[lo:hi], rank[mine], side="right") - 1
            since = rank - lows[at]
            f = f.drop(columns="_rank")
            f["sequence_id"] = bases[at] + since // copies[at]
            f["offset"] = offsets[at] + since % copies[at] * n
            yield f

    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(BLOCKS)).cast("int")
    blocks = cut.select("length", block.alias("_block")).groupBy("length", "_block").agg(
        F.count(F.lit(1)).alias("_n"))
    bases_of = blocks.select("length", "_block", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_block")) - F.col("_n")).alias("_base"))
    order = Window.partitionBy("length", "_block").orderBy("doc_id", "start", "doc_tokens")
    ranked = cut.withColumn("_block", block).withColumn("_in", F.row_number().over(order) - 1).join(
        bases_of, ["length", "_block"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    kept = ranked.select(*cut.columns, "_rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return kept.mapInPandas(find, schema)


def sequences(placed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``n_tokens`` and ``ids`` of ``placed`` pieces that still
    carry ``ids``, padded to ``capacity`` unless their length is a power of two."""
    joined = placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    full = F.call_function("bit_count", F.col("n_tokens")) == 1
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()),
                           (F.lit(capacity) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.when(full, ids).otherwise(F.concat(ids, pad)).alias("ids"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place and the crc32 of their ids; the ids stay in the tokenizing task.
    Without documents there are no pieces."""
    cut = pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col)
    slim = stored(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return place(slim, capacity)
