"""Near-duplicate documents by an n-gram Jaccard join with rare-first prefix filtering.

Hashed n-grams are counted through the packed exchange, and each document gets back the n-grams it
shares with others, rarest first. Documents meet on the n-grams of their prefixes only; length,
positional and suffix filters thin the pairs out before each is verified once. Within the list of an
n-gram everything is first compared with the list's cleanest document (the one with the fewest rarer
n-grams); documents linked in this way need no further comparison with each other, so a large group of
near copies costs its size, not its square. Pairs that are still in different components afterwards
are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import exchange as X
from panelcast.llm.common import give_back, rows_of, stored
from panelcast.llm.components import components

BITS = 48
"""Bits of an n-gram's hash that are kept."""


def text_shingles(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text (hash and text number, sorted by text), their number per text and a
    hash of the whole word sequence. A text with fewer words has the whole sequence as its one n-gram."""
    words = X.Words(raw, lower=True)
    h, at = words.windows(n)
    doc = words.doc[at]
    counts = np.diff(words.firsts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = X.run_hashes(words.hashes, words.firsts[:-1], words.firsts[1:])
    h, doc = np.concatenate([h, whole[short]]), np.concatenate([doc, short]).astype(np.int64)
    h = h >> np.uint64(64 - BITS) << np.uint64(64 - BITS)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    at = X.group_starts(doc, h)
    return h[at], doc[at], np.bincount(doc[at], minlength=len(raw)), whole


def _send(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """N-grams to the buckets of their hash, sizes of the sets to the buckets of their document."""
    gathered, size = [], 0

    def flush():
        base, hashes, owner, ids, whole = 0, [], [], [], []
        for h, doc, numbers, counts, digest in gathered:
            hashes.append(h)
            owner.append(doc + base)
            ids.append(numbers)
            whole.append(digest)
            base += len(numbers)
        docs = {"doc": np.concatenate(ids), "whole": np.concatenate(whole)}
        yield X.sent(np.concatenate(hashes), np.concatenate(owner), docs, buckets, BITS)
        sizes = X.to_documents(docs["doc"], [np.concatenate([g[3] for g in gathered]), docs["whole"]], buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes["bucket"] + buckets, pa.int32()), pa.array(sizes["payload"], pa.binary())],
            ["bucket", "payload"])

    for batch in batches:
        for ids, raw in X.chunks(batch):
            h, doc, counts, whole = text_shingles(raw, n)
            gathered.append((h, doc, np.array(ids, dtype=np.int64), counts.astype(np.int64), whole.view(np.int64)))
            size += len(h)
            if size >= X.FLUSH:
                yield from flush()
                gathered, size = [], 0
    if gathered:
        yield from flush()


def _shared(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """N-grams found in several different texts, to their documents, with the number of these texts."""
    bucket = int(frame["bucket"].iloc[0])
    if bucket >= buckets:
        return pd.DataFrame({"bucket": bucket - buckets, "payload": frame["payload"], "sizes": True})
    h, _, docs = X.received(frame["payload"], ["doc", "whole"])
    give_back()
    order = np.lexsort((docs["doc"], docs["whole"], h))
    h, doc, whole = h[order], docs["doc"][order], docs["whole"][order]
    texts = X.group_starts(h, whole)  # one entry per text: the smallest of its documents
    h, doc, whole = h[texts], doc[texts], whole[texts]
    starts = X.group_starts(h)
    n = np.diff(np.append(starts, len(h)))
    several = np.repeat(n > 1, n)
    # Rarity in the upper bits, identity in the lower: sorted keys are the global rare-first order.
    key = np.minimum(np.repeat(n, n), 32767).astype(np.uint64) << np.uint64(BITS) | h
    out = X.to_documents(doc[several], [key[several], whole[several]], buckets)
    out["sizes"] = False
    return out


def _least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (n + m) // (100 + percent))


def _sets(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Per document: set size, number of n-grams no other text has, the shared ones rarest first, and
    those of them that fall into the prefix."""
    size: dict[int, tuple[int, int]] = {}
    parts: dict[tuple[int, int], list] = {}
    for payload, sizes in zip(frame["payload"], frame["sizes"]):
        doc, value, whole = X.unpack(payload)
        if sizes:
            for d, n, w in zip(doc.tolist(), value.tolist(), whole.tolist()):
                size[d] = max(size.get(d, (0, 0)), (n, w))  # rows that share an id: the largest set stands
            continue
        cuts = np.append(X.group_starts(doc, whole) if len(doc) else [], len(doc)).astype(int)
        for i, j in zip(cuts, cuts[1:]):
            parts.setdefault((int(doc[i]), int(whole[i])), []).append(value[i:j])
    give_back()
    rows = []
    for d, (n, w) in size.items():
        keys = np.sort(np.unique(np.concatenate(parts[d, w]))) if (d, w) in parts else np.zeros(0, dtype=np.uint64)
        alone = n - len(keys)
        prefix = max(0, n - -(-percent * n // 100) + 1 - alone) if n else 0
        rows.append((d, w, n, alone, keys.tobytes(), keys[:prefix].astype(np.int64).tolist()))
    return pd.DataFrame(rows, columns=["doc", "whole", "n", "alone", "keys", "prefix"])


def suffix_allows(x: np.ndarray, y: np.ndarray, room: int, depth: int = 3) -> bool:
    """Whether two sorted arrays can differ in at most ``room`` values, judged by splitting both at the
    middle value of one, ``depth`` times."""
    if abs(len(x) - len(y)) > room:
        return False
    if not depth or not len(x) or not len(y):
        return True
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    met = at < len(x) and x[at] == y[mid]
    left = abs(at - mid)
    right = abs((len(x) - at - met) - (len(y) - mid - 1))
    if left + right + (not met) > room:
        return False
    return suffix_allows(x[:at], y[:mid], room - right - (not met), depth - 1)


def _verify(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs of ``a`` and ``b`` whose sets reach the similarity."""
    for f in frames:
        keep = []
        for n, m, p, q in zip(f["n"], f["m"], f["keys"], f["others"]):
            x, y = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            least = -(-percent * (n + m) // (100 + percent))
            room = n + m - 2 * least - (n - len(x)) - (m - len(y))
            keep.append(room >= 0 and suffix_allows(x, y, room)
                        and len(np.intersect1d(x, y, assume_unique=True)) >= least)
        yield f.loc[np.array(keep, dtype=bool), ["a", "b"]]


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("doc").alias("a"), "n", "keys")
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("keys").alias("others"))
    return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select(
        "a", "b", "n", "m", "keys", "others").mapInPandas(partial(_verify, percent=percent), "a long, b long")


def _can_link(percent: int):
    """Length and positional filter of two entries ``e`` and ``f`` of one n-gram."""
    n, m, i, j = F.col("e.n"), F.col("f.n"), F.col("e.pos"), F.col("f.pos")
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - i, m - j) >= least)


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row: documents link when 100 times the
    intersection of their n-gram sets is at least ``percent`` times the union, and a component is named
    by the smallest id that links reach.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null and wordless texts have no n-grams, link
    with nothing and are their own component, copies of each other included. Rows with a null id link
    with nothing and have a null component. Of rows that share an id the one with most n-grams stands
    for all. Equal word sequences are one set; everybody gets its component.
    """
    rows = rows_of(docs, id_col, text_col)
    named = rows.where("doc_id is not null")
    buckets = X.bucket_count(X.text_bytes(named))
    sent = named.mapInArrow(partial(_send, n=n, buckets=buckets), X.SENT)
    shared = sent.groupBy("bucket").applyInPandas(
        partial(_shared, buckets=buckets), "bucket int, payload binary, sizes boolean")
    sets = stored(shared.groupBy("bucket").applyInPandas(
        partial(_sets, percent=percent), "doc long, whole long, n long, alone long, keys binary, prefix array<long>"))
    # Equal word sequences: every document but the first stands behind it.
    first = sets.where("n > 0").groupBy("whole", "n").agg(
        F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    behind = stored(sets.join(first, ["whole", "n"]).where(F.col("doc") > F.col("rep")).select("doc", "rep"))
    entries = sets.where(F.size("prefix") > 0).join(
        behind.select("doc"), "doc", "left_anti").select(
        "doc", "n", "alone", F.posexplode("prefix").alias("at", "gram")).select(
        "gram", "doc", "n", (F.col("alone") + F.col("at")).alias("pos"))
    pivots = entries.groupBy("gram").agg(
        F.min(F.struct("pos", "doc", "n")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    entries = stored(entries.join(pivots.select("gram"), "gram", "left_semi"))
    stars = entries.alias("e").join(
        pivots.select("gram", F.col("p.pos").alias("pos"), F.col("p.doc").alias("doc"), F.col("p.n").alias("n")).alias("f"),
        "gram").where((F.col("e.doc") != F.col("f.doc")) & _can_link(percent)).select(
        F.col("e.doc").alias("a"), F.col("f.doc").alias("b"))
    links = stored(_links(stars, sets, percent))
    roots = components(links)
    # What is left: pairs of one list that may still link two components.
    placed = entries.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "root", F.coalesce("root", "doc"))
    torn = placed.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    open_ = stored(placed.join(torn.select("gram"), "gram", "left_semi"))
    pairs = open_.alias("e").join(open_.alias("f"), "gram").where(
        (F.col("e.doc") < F.col("f.doc")) & (F.col("e.root") != F.col("f.root")) & _can_link(percent)).select(
        F.col("e.doc").alias("a"), F.col("f.doc").alias("b"))
    more = stored(_links(pairs, sets, percent))
    if more.limit(1).count():
        roots = components(links.union(more))
    found = sets.select("doc", "n").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select(
        F.col("doc").alias("rep"), F.when(F.col("n") > 0, F.coalesce("root", "doc")).alias("root"))
    own = sets.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")).join(
        behind.withColumnRenamed("doc", "doc_id"), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    joined = own.join(found, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("root")), "doc_id").alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in X.chunks(batch):
                sizes = text_shingles(raw, n)[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(ids), pa.int64())],
                    ["doc_id", "n_shingles", "component_id"])

    rest = rows.where("doc_id is null").mapInArrow(count, "doc_id long, n_shingles long, component_id long")
    return joined.union(rest)
