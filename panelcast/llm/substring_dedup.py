"""Substring dedup by fixed-block anchors.

The reference side is sparse: the blocks of ``window / 2`` words at multiples of that length, of which
every window of a document holds at least one whole. The probing side is dense: the hash of every
rolling window of block length. Hits of a probe on the block of an earlier document are extended in
both directions, window by window, to maximal repeats; documents without hits are done after one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import exchange as X
from panelcast.llm.common import rows_of, stored

SECOND = 0xC2B2AE3D27D4EB4F
"""Base of the second hash of whole windows."""


def _probe(batches: Iterator[pa.RecordBatch], block: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Every rolling window of ``block`` words; those at multiples of ``block`` are flagged as anchors."""
    gathered, size, base = [], 0, 0

    def flush():
        h, owner, flags, ids, whole = (np.concatenate(x) for x in zip(*gathered))
        return X.sent(h, owner, {"doc": ids, "whole": whole}, buckets, bits, flags)

    for batch in batches:
        for ids, raw in X.chunks(batch):
            words = X.Words(raw)
            h, at = words.windows(block)
            doc = words.doc[at]
            anchor = (at - words.firsts[doc]) % block == 0
            gathered.append((h, doc.astype(np.int64) + base, anchor, np.array(ids, dtype=np.int64), X.text_digests(raw)))
            base += len(ids)
            size += len(h)
            if size >= X.FLUSH:
                yield flush()
                gathered, size, base = [], 0, 0
    if gathered:
        yield flush()


def _hits(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Anchors met by a probe of a later document, to both documents."""
    h, anchor, docs = X.received(frame["payload"], ["doc", "whole"])
    order = np.lexsort((docs["doc"], docs["whole"], h))
    h, anchor, doc, whole = h[order], anchor[order], docs["doc"][order], docs["whole"][order]
    # Equal documents are judged by the first of them.
    starts = X.group_starts(h, whole)
    first = np.repeat(doc[starts], np.diff(np.append(starts, len(h))))
    keep = doc == first
    h, anchor, doc = h[keep], anchor[keep], doc[keep]
    starts = X.group_starts(h)
    n = np.diff(np.append(starts, len(h)))
    group = np.repeat(np.arange(len(starts)), n)
    none = np.iinfo(np.int64).max
    least = np.full(len(starts), none)
    np.minimum.at(least, group[anchor], doc[anchor])
    last = np.full(len(starts), np.iinfo(np.int64).min)
    np.maximum.at(last, group, doc)
    # Probes behind the first anchor, and anchors that some later document may repeat.
    told = (doc > least[group]) | anchor & (doc < last[group])
    return X.to_documents(doc[told], [h[told]], buckets)


def _per_document(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per document with its matched hashes, sorted."""
    parts: dict[int, list] = {}
    for payload in frame["payload"]:
        doc, h = X.unpack(payload)
        cuts = np.append(X.group_starts(doc), len(doc))
        for i, j in zip(cuts, cuts[1:]):
            parts.setdefault(int(doc[i]), []).append(h[i:j])
    rows = [(d, np.unique(np.concatenate(p)).tobytes()) for d, p in parts.items()]
    return pd.DataFrame(rows, columns=["m_id", "hits"])


def matched(frame: DataFrame) -> DataFrame:
    return frame.groupBy("bucket").applyInPandas(_per_document, "m_id long, hits binary")


def _joined(words: X.Words, raw: list[bytes], i: int, gone: np.ndarray | None = None) -> bytes:
    """Words of text ``i`` that stay, joined by one space."""
    if gone is None:
        return b" ".join(raw[i].split())
    a, base = words.firsts[i], words.offsets[i]
    starts, ends = words.starts[a:a + len(gone)] - base, words.ends[a:a + len(gone)] - base
    return b" ".join(raw[i][s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist()))


def _out(kept: bytes, digest: bool) -> str:
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")


def _settle(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Documents without hits and later copies get their result; the others keep text and hits."""
    for batch in batches:
        hits, copy = batch.column("hits").to_pylist(), batch.column("copy").to_pylist()
        at = 0
        for ids, raw in X.chunks(batch):
            words = X.Words(raw)
            numbers = np.diff(words.firsts).tolist()
            removed, texts, open_, told = [], [], [], []
            for i, n in enumerate(numbers):
                whole = bool(copy[at + i]) and n >= window
                pending = not copy[at + i] and hits[at + i] is not None and n >= window
                removed.append(n if whole else 0)
                texts.append(None if pending else _out(b"" if whole else _joined(words, raw, i), digest))
                open_.append(raw[i].decode("utf-8", "replace") if pending else None)
                told.append(hits[at + i] if pending else None)
            at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.string()), pa.array(open_, pa.string()), pa.array(told, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept", "text", "hits"])


def _near_hits(words: X.Words, i: int, block: int, window: int, hits: np.ndarray, bits: int,
               h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the windows of text ``i`` that hold a hit, counted from the text's first word."""
    first, n = words.firsts[i], words.firsts[i + 1] - words.firsts[i]
    lo, hi = np.searchsorted(at, [first, first + n])
    cut = h[lo:hi] >> np.uint64(64 - bits)
    place = np.searchsorted(hits, cut)
    met = (place < len(hits)) & (hits[np.minimum(place, len(hits) - 1)] == cut) if len(hits) else np.zeros(len(cut), bool)
    marks = np.zeros(n + 1, dtype=np.int32)
    where = at[lo:hi][met] - first
    np.add.at(marks, np.maximum(where - (window - block), 0), 1)
    np.add.at(marks, where + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[:max(0, n - window + 1)] > 0)


def _extend(batches: Iterator[pa.RecordBatch], block: int, window: int, buckets: int, bits: int):
    """Whole windows around the hits, by two hashes of 64 bits."""
    gathered, size, base = [], 0, 0

    def flush():
        h, second, owner, ids = (np.concatenate(x) for x in zip(*gathered))
        order = np.argsort(h, kind="stable")
        h, second, owner = h[order], second[order], owner[order]
        cuts = np.searchsorted(X.bucket_of(h, buckets), np.arange(buckets + 1))
        pairs = [(b, i, j) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in pairs], pa.int32()),
             pa.array([X.pack(np.diff(h[i:j], prepend=np.uint64(0)), second[i:j].astype(np.uint32),
                              ids[owner[i:j]]) for _, i, j in pairs], pa.binary())], ["bucket", "payload"])

    for batch in batches:
        hits, at_row = batch.column("hits").to_pylist(), 0
        for ids, raw in X.chunks(batch):
            words = X.Words(raw)
            h, at = words.windows(block)
            wide, wide_at = words.windows(window)
            other = words.windows(window, SECOND)[0]
            for i in range(len(ids)):
                found = np.frombuffer(hits[at_row + i], dtype=np.uint64)
                starts = _near_hits(words, i, block, window, found, bits, h, at) + words.firsts[i]
                pick = np.searchsorted(wide_at, starts)
                gathered.append((wide[pick], other[pick], np.full(len(pick), base, dtype=np.int64),
                                 np.array([ids[i]], dtype=np.int64)))
                base += 1
                size += len(pick)
            at_row += len(ids)
            if size >= X.FLUSH:
                yield flush()
                gathered, size, base = [], 0, 0
    if size:
        yield flush()


def _repeated(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Windows that also start in an earlier document, to their document."""
    hs, seconds, docs = [], [], []
    for payload in frame["payload"]:
        steps, second, doc = X.unpack(payload)
        hs.append(np.cumsum(steps, dtype=np.uint64))
        seconds.append(second)
        docs.append(doc)
    h, second, doc = np.concatenate(hs), np.concatenate(seconds), np.concatenate(docs)
    order = np.lexsort((doc, second, h))
    h, second, doc = h[order], second[order], doc[order]
    starts = X.group_starts(h, second)
    first = np.repeat(doc[starts], np.diff(np.append(starts, len(h))))
    later = doc > first
    return X.to_documents(doc[later], [h[later]], buckets)


def _remove(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, at_row = batch.column("hits").to_pylist(), 0
        for ids, raw in X.chunks(batch):
            words = X.Words(raw)
            h, at = words.windows(window)
            numbers, removed, texts, spans = np.diff(words.firsts).tolist(), [], [], []
            for i, n in enumerate(numbers):
                first = words.firsts[i]
                lo, hi = np.searchsorted(at, [first, first + n])
                met = np.isin(h[lo:hi], np.frombuffer(hits[at_row + i] or b"", dtype=np.uint64))
                marks = np.zeros(n + 1, dtype=np.int32)
                marks[:-1][at[lo:hi][met] - first] += 1
                np.add.at(marks, np.minimum(at[lo:hi][met] - first + window, n), -1)
                gone = np.cumsum(marks)[:n] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                texts.append(_out(_joined(words, raw, i, gone), digest))
            at_row += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept", "spans"])


def remove_repeats(docs: DataFrame, window: int = 50, digest: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every document without the words covered by a window of ``window`` words that also starts in a
    document with a smaller id: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined
    by one space, or with ``digest`` their SHA-256) and ``spans`` (maximal removed runs in words).

    Windows are judged on the input. Null text has no words. Rows with a null id keep everything and are
    no reference for others; rows that share an id are never a reference for each other.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    block = window // 2
    fields = "doc_id long, n_words long, n_removed long, kept string"
    rows = rows_of(docs, id_col, text_col)
    size = X.text_bytes(rows)
    buckets = X.bucket_count(size)
    bits = X.kept_bits(size)
    named = rows.where("doc_id is not null")
    sent = named.mapInArrow(partial(_probe, block=block, buckets=buckets, bits=bits), X.SENT)
    hits = matched(sent.groupBy("bucket").applyInPandas(partial(_hits, buckets=buckets), X.SENT))
    # Equal texts after the first of their group: every window of theirs starts earlier.
    marks = named.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    marks = stored(marks)
    firsts = marks.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = marks.join(firsts, ["h", "g"]).where(F.col("doc_id") > F.col("first")).select(
        F.col("doc_id").alias("m_id"), F.lit(None).cast("binary").alias("hits"), "h")
    told = hits.withColumn("h", F.lit(None).cast("long")).union(copies).groupBy("m_id").agg(
        F.max("hits").alias("hits"), F.collect_set("h").alias("copies"))
    joined = rows.join(told, rows["doc_id"] == told["m_id"], "left").select(
        "doc_id", "text", "hits", F.array_contains("copies", F.xxhash64("text")).alias("copy"))
    settled = stored(joined.mapInArrow(
        partial(_settle, window=window, digest=digest), fields + ", text string, hits binary"))
    span = "array<struct<start:long,length:long>>"
    whole = F.when(F.col("n_removed") > 0, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_removed").alias("length"))))
    done = settled.where("hits is null").select(
        "doc_id", "n_words", "n_removed", "kept", F.coalesce(whole, F.array().cast(span)).alias("spans"))
    pending = settled.where("hits is not null").select("doc_id", "text", "hits")
    wide = pending.mapInArrow(partial(_extend, block=block, window=window, buckets=buckets, bits=bits), X.SENT)
    repeated = matched(wide.groupBy("bucket").applyInPandas(partial(_repeated, buckets=buckets), X.SENT))
    answered = pending.drop("hits").join(repeated, pending["doc_id"] == repeated["m_id"], "left").select(
        "doc_id", "text", "hits").mapInArrow(partial(_remove, window=window, digest=digest), f"{fields}, spans {span}")
    return done.union(answered)
