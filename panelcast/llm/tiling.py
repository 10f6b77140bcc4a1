"""Benchmark decontamination by greedy string tiling.

Runs of a few words that a document shares with a benchmark item seed the comparison. For each seeded
pair the longest common runs are marked first, found by running Karp-Rabin hashes of falling length over
what is still unmarked; tiles never overlap and may come in any order, so a reordered passage is caught
as well as a verbatim one. A document is contaminated when its tiles cover enough of an item.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import exchange as X

TILE = 4
"""Least words of a tile."""
COVERAGE = 0.5
"""Part of an item's words that tiles must cover."""
BLOCK_BYTES = 4_000_000
"""Bytes of benchmark text that are compared with all documents in one pass; what is sent to the tasks
is bounded by it, and a larger benchmark takes more passes."""


class Items:
    """A block of benchmark items: word hashes and the seeds that point into them."""

    def __init__(self, ids: list, texts: list[bytes], tile: int):
        words = X.Words([_lower(t) for t in texts], letters=True)
        self.ids, self.tile = ids, tile
        self.hashes, self.firsts = words.hashes, words.firsts
        self.sizes = np.diff(words.firsts)
        self.seeds = {}
        for n in range(1, tile + 1):  # an item shorter than a tile is one tile
            h, at = words.windows(n)
            pick = (self.sizes[words.doc[at]] == n) if n < tile else np.ones(len(at), dtype=bool)
            if pick.any():
                order = np.argsort(h[pick], kind="stable")
                item = words.doc[at][pick][order]
                self.seeds[n] = (h[pick][order], item, at[pick][order] - words.firsts[item])


_HIDDEN = regex.compile(r"[\u00ad\u200c\u200d\u2060\ufeff]+")
"""Characters inside words that do not show: soft hyphen, joiners, byte order mark."""
_BETWEEN = regex.compile(r"[^\p{L}\p{M}\p{N}\x00-\x7f]+")


def _lower(text: bytes) -> bytes:
    """Lower-cased text whose characters beyond ASCII are letters, marks and digits: others become a space,
    hidden ones go, and compatible forms (ligatures, wide letters, composed accents) become one."""
    if text.isascii():
        return text.lower()
    wide = unicodedata.normalize("NFKC", _HIDDEN.sub("", text.decode("utf-8", "replace")))
    return _BETWEEN.sub(" ", wide.lower()).encode("utf-8", "replace")


def tile_pair(doc: np.ndarray, item: np.ndarray, least: int, longest: int) -> list[tuple[int, int, int]]:
    """Tiles (first word in the document, first word in the item, words), longest first."""
    free_doc, free_item = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    tiles = []
    for n in range(min(longest, len(doc), len(item)), least - 1, -1):
        d, i = _open(free_doc, n), _open(free_item, n)
        if not len(d) or not len(i):
            continue
        of_doc, of_item = X.run_hashes(doc, d, d + n), X.run_hashes(item, i, i + n)
        order = np.argsort(of_item, kind="stable")
        lo = np.searchsorted(of_item[order], of_doc, side="left")
        hi = np.searchsorted(of_item[order], of_doc, side="right")
        for k in np.flatnonzero(hi > lo):
            a = int(d[k])
            for b in i[order[lo[k]:hi[k]]].tolist():
                if free_doc[a:a + n].all() and free_item[b:b + n].all():
                    free_doc[a:a + n] = free_item[b:b + n] = False
                    tiles.append((a, b, n))
                    break
    return tiles


def _open(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of ``n`` unmarked words."""
    if len(free) < n:
        return np.zeros(0, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[n:] - total[:-n] == n)


def matches(raw: list[bytes], items: Items, coverage: float) -> Iterator[tuple[int, int, list]]:
    """Text number, item number and tiles of every pair whose tiles reach the coverage."""
    words = X.Words([_lower(t) for t in raw], letters=True)
    pairs: dict[tuple[int, int], list] = {}
    for n, (seeds, item, place) in items.seeds.items():
        h, at = words.windows(n)
        lo, hi = np.searchsorted(seeds, h, side="left"), np.searchsorted(seeds, h, side="right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        count = (hi - lo)[hit]
        which = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        pos = np.repeat(at[hit], count)
        doc = words.doc[pos].astype(np.int64)
        key = doc * len(items.ids) + item[which]
        order = np.lexsort((pos, key))
        key, pos, which = key[order], pos[order], which[order]
        cuts = np.append(X.group_starts(key), len(key))
        # Item words that seeds touch bound what tiles can cover.
        for i, j in zip(cuts, cuts[1:]):
            one = int(key[i] % len(items.ids))
            size = int(items.sizes[one])
            touched = np.zeros(size + 1, dtype=np.int64)
            spots = np.unique(place[which[i:j]])
            np.add.at(touched, spots, 1)
            np.add.at(touched, np.minimum(spots + n, size), -1)
            if (np.cumsum(touched)[:size] > 0).sum() >= coverage * size:
                pairs.setdefault((int(key[i] // len(items.ids)), one), []).append((n, pos[i:j], place[which[i:j]]))
    for (doc, one), seeds in sorted(pairs.items()):
        n, pos, place = seeds[0]
        spots = np.unique(pos)
        # Words of the document inside seeds, with a gap where others are left out.
        near = np.unique((spots[:, None] + np.arange(n)).reshape(-1))
        gap = np.flatnonzero(np.diff(near) > 1) + 1
        values = np.insert(words.hashes[near], gap, np.arange(1, len(gap) + 1, dtype=np.uint64))
        back = np.insert(near - words.firsts[doc], gap, -1)
        item = items.hashes[items.firsts[one]:items.firsts[one + 1]]
        tiles = tile_pair(values, item, n, _longest(pos, place, n))
        if sum(t[2] for t in tiles) >= coverage * len(item):
            yield doc, one, [(int(back[a]), b, size) for a, b, size in tiles]


def _longest(pos: np.ndarray, place: np.ndarray, n: int) -> int:
    """Longest run of seeds that advance together."""
    diagonal = pos - place
    order = np.lexsort((pos, diagonal))
    d, p = diagonal[order], pos[order]
    fresh = np.ones(len(p), dtype=bool)
    fresh[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    return int(np.diff(np.append(np.flatnonzero(fresh), len(p))).max()) + n - 1


def _blocks(items: DataFrame, item_id: str, item_text: str, tile: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_BYTES``."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where(
        "t is not null").select("i", F.col("t").cast("binary").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    for k in range(count):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).collect()
        if got:
            yield Items([r["i"] for r in got], [bytes(r["t"]) for r in got], tile)


TILES = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))


def contaminated(docs: DataFrame, items: DataFrame, tile: int = TILE, coverage: float = COVERAGE,
                 id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id``, ``item_id``, ``n_tiles``,
    ``covered`` and ``item_words`` (words), ``coverage`` and ``tiles``.

    Words are runs of lower-cased letters, marks and digits of any script, in compatible form; spaces, dashes
    and quotes of any kind separate them, soft hyphens and joiners inside them do not count. Items shorter than ``tile`` words count when they
    occur whole; items and texts that are null or wordless match nothing. Null ids are carried along, and
    repeated rows are reported again. An empty benchmark or corpus gives no rows.
    """
    spark = docs.sparkSession
    schema = ("doc_id long, item_id long, n_tiles int, covered int, item_words int, coverage double, "
              "tiles array<struct<doc_start:long,item_start:long,length:long>>")

    def run(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for ids, raw in X.chunks(batch):
                out: list[list] = [[] for _ in range(7)]
                for doc, one, tiles in matches(raw, block, coverage):
                    covered, size = sum(t[2] for t in tiles), int(block.sizes[one])
                    row = (ids[doc], block.ids[one], len(tiles), covered, size, covered / size,
                           [{"doc_start": a, "item_start": b, "length": n} for a, b, n in tiles])
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), TILES]
                names = ["doc_id", "item_id", "n_tiles", "covered", "item_words", "coverage", "tiles"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = spark.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text, tile):
        found = found.union(rows.mapInArrow(partial(run, sent=spark.sparkContext.broadcast(block)), schema))
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, tile: int = TILE, coverage: float = COVERAGE,
                         text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged and without a shuffle."""
    def keep(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            pairs = pa.RecordBatch.from_arrays(
                [pa.array(range(batch.num_rows), pa.int64()), column.cast(pa.string()).fill_null("")], ["i", "t"])
            clean = np.ones(batch.num_rows, dtype=bool)
            for ids, raw in X.chunks(pairs):
                for doc, _, _ in matches(raw, sent.value, coverage):
                    clean[ids[doc]] = False
            yield batch.filter(pa.array(clean))

    for block in _blocks(items, item_id, item_text, tile):
        docs = docs.mapInArrow(partial(keep, sent=docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
