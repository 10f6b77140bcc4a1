"""Exact repeats of bytes by sharded suffix arrays.

Every string of ``width`` bytes has one designated position: the leftmost smallest hash among the short
grams in it. Equal strings agree on it, so the hash of that gram names the shard that sees all their
copies. Stretches whose gram occurs once are left out early. A shard sorts the suffixes of its stretches
by Larsson-Sadakane refinement, takes common prefixes by Kasai's rule, and finds the first copy of each
string. A shard with too much text is split; the parts send their sorted first copies to be merged by
binary search.
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

GRAM = 32
"""Bytes of the grams that designate positions."""
PART_BYTES = 3_000_000
"""Bytes of stretches a part of a shard takes."""
U64 = np.uint64
_POSITION = U64((1 << 31) - 1)


def stretches(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one designated gram: its hash, the text number, first start and last
    start (inclusive, counted from the text's first byte)."""
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(U64)
    empty = np.zeros(0, dtype=np.int64)
    span = width - GRAM + 1
    if len(data) < width:
        return np.zeros(0, dtype=U64), empty, empty, empty
    at = np.arange(len(data) - GRAM + 1)
    grams = X.run_hashes(data, at, at + GRAM)
    keys = grams >> U64(31) << U64(31) | at.astype(U64) & _POSITION
    # Sliding minimum over ``span`` keys: suffix minima of one block and prefix minima of the next.
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, dtype=U64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    owner = np.repeat(np.arange(len(raw)), sizes)[:len(data) - width + 1]
    starts = np.flatnonzero(np.arange(width, len(data) + 1) <= ends[owner])
    if not len(starts):
        return np.zeros(0, dtype=U64), empty, empty, empty
    doc = owner[starts]
    place = (np.minimum(behind[starts], ahead[starts + span - 1]) & _POSITION).astype(np.int64)
    first = X.group_starts(place, doc)
    last = np.append(first[1:], len(starts)) - 1
    offset = (ends - sizes)[doc[first]]
    # Designated grams have small hashes: mixed again they spread over all buckets.
    return X.mix(grams[place[first]]), doc[first], starts[first] - offset, starts[last] - offset


def _sevens(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols from each position on as one number, zeros behind the end."""
    n = len(symbols)
    padded = np.zeros(n + 7, dtype=np.int64)
    padded[:n] = symbols
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key <<= 9
        key |= padded[j:j + n]
    return key


def suffix_array(symbols: np.ndarray, width: int) -> np.ndarray:
    """Order of the suffixes of ``symbols`` (0 to 256) by their first ``width`` symbols at least.

    Suffixes start sorted by seven symbols; each round sorts the groups that are still equal by the rank
    of the suffix that begins where the compared part ends, which doubles what is compared.
    """
    n = len(symbols)
    key = _sevens(symbols)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, dtype=np.int64)
    sorted_key = key[order]
    starts = X.group_starts(sorted_key)
    lengths = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, lengths) + 1
    done = 7
    open_ = np.flatnonzero(np.repeat(lengths > 1, lengths))
    while done < width and len(open_):
        members = order[open_]
        own, next_ = rank[members], rank[np.minimum(members + done, n)]
        again = np.argsort(own << 32 | next_, kind="stable")
        members, own, next_ = members[again], own[again], next_[again]
        order[open_] = members
        starts = X.group_starts(own, next_)
        lengths = np.diff(np.append(starts, len(members)))
        rank[members] = np.repeat(open_[starts], lengths) + 1
        open_ = open_[np.repeat(lengths > 1, lengths)]
        done *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``order``.

    Kasai's rule: one position further the common prefix is one shorter, unless the symbols in front of
    the two suffixes differ. Only the positions where they differ are compared, all at once; the
    comparison stops at ``limit`` symbols.
    """
    n = len(order)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    fresh = (before <= 0) | (at == 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = symbols[inner - 1] != symbols[before[inner] - 1]
    # A neighbour that is not the follower of the last one's neighbour starts afresh as well.
    fresh[1:] |= before[1:] != before[:-1] + 1
    heads = np.flatnonzero(fresh)
    length = np.zeros(len(heads), dtype=np.int64)
    for values, step in ((_sevens(symbols), 7), (symbols, 1)):
        live = np.flatnonzero(before[heads] >= 0)
        while len(live):
            i, j = heads[live] + length[live], before[heads[live]] + length[live]
            ok = (np.maximum(i, j) < n) & (length[live] < limit)
            ok[ok] = values[i[ok]] == values[j[ok]]
            live = live[ok]
            length[live] += step
    length = np.minimum(length, n - np.maximum(heads, before[heads]))
    which = np.cumsum(fresh) - 1
    plcp = np.maximum(length[which] - (at - heads[which]), 0)
    return plcp[order]


def _designate(batches: Iterator[pa.RecordBatch], width: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Designated grams to the buckets of their hash."""
    gathered, size, base = [], 0, 0

    def flush():
        h, owner, ids, whole = (np.concatenate(x) for x in zip(*gathered))
        return X.sent(h, owner, {"doc": ids, "whole": whole}, buckets, bits)

    for batch in batches:
        for ids, raw in X.chunks(batch):
            h, doc, _, _ = stretches(raw, width)
            gathered.append((h, doc + base, np.array(ids, dtype=np.int64), X.text_digests(raw)))
            base += len(ids)
            size += len(h)
            if size >= X.FLUSH:
                yield flush()
                gathered, size, base = [], 0, 0
    if gathered:
        yield flush()


def _several(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Grams that occur more than once, equal texts counted as their first document, to the documents."""
    h, _, docs = X.received(frame["payload"], ["doc", "whole"])
    order = np.lexsort((docs["doc"], docs["whole"], h))
    h, doc, whole = h[order], docs["doc"][order], docs["whole"][order]
    starts = X.group_starts(h, whole)
    keep = doc == np.repeat(doc[starts], np.diff(np.append(starts, len(h))))
    h, doc = h[keep], doc[keep]
    starts = X.group_starts(h)
    n = np.diff(np.append(starts, len(h)))
    told = np.repeat(n > 1, n)
    return X.to_documents(doc[told], [h[told]], buckets)


def _matched(frame: pd.DataFrame) -> pd.DataFrame:
    parts: dict[int, list] = {}
    for payload in frame["payload"]:
        doc, h = X.unpack(payload)
        cuts = np.append(X.group_starts(doc), len(doc))
        for i, j in zip(cuts, cuts[1:]):
            parts.setdefault(int(doc[i]), []).append(h[i:j])
    return pd.DataFrame([(d, np.unique(np.concatenate(p)).tobytes()) for d, p in parts.items()],
                        columns=["m_id", "hits"])


def _result(ids, raw, spans, digest: bool) -> pa.RecordBatch:
    """Rows from removed byte spans (first, end) of each text."""
    kept, removed = [], []
    for text, gone in zip(raw, spans):
        at, parts = 0, []
        for a, b in gone:
            parts.append(text[at:a])
            at = b
        parts.append(text[at:])
        left = b"".join(parts)
        removed.append(len(text) - len(left))
        kept.append(hashlib.sha256(left).hexdigest().encode() if digest else left)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(removed, pa.int64()),
         pa.array(kept, pa.binary()),
         pa.array([[{"start": int(a), "length": int(b - a)} for a, b in gone] for gone in spans], kind)],
        ["doc_id", "n_bytes", "n_removed", "kept", "spans"])


RESULT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,length:long>>"


def _settle(batches: Iterator[pa.RecordBatch], width: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Texts without matched grams and later copies get their result; the others go on with their text."""
    for batch in batches:
        hits, copy = batch.column("hits").to_pylist(), batch.column("copy").to_pylist()
        at = 0
        for ids, raw in X.chunks(batch):
            open_ = [not copy[at + i] and hits[at + i] is not None for i in range(len(ids))]
            gone = [[(0, len(r))] if copy[at + i] and len(r) >= width else [] for i, r in enumerate(raw)]
            out = _result(ids, [b"" if o else r for o, r in zip(open_, raw)], gone, digest)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array([r.decode("utf-8", "replace") if o else None for o, r in zip(open_, raw)], pa.string()),
                 pa.array([hits[at + i] if o else None for i, o in enumerate(open_)], pa.binary())],
                [*out.schema.names, "text", "hits"])
            at += len(ids)


SHARDED = "bucket int, payload binary, flags boolean, size long"


def _cut(batches: Iterator[pa.RecordBatch], width: int, shards: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Stretches with a matched gram to their shards. Of equal stretches a task sends the first only and
    flags the others at once."""
    found: dict[bytes, tuple[int, int, int]] = {}
    later: list[tuple[int, int, int]] = []
    size = 0

    def rows():
        parts: dict[int, list] = {}
        for text, (shard, doc, start) in found.items():
            parts.setdefault(shard, []).append((text, doc, start))
        numbers, payloads, sizes = list(parts), [], []
        for items in parts.values():
            payloads.append(_packed(items))
            sizes.append(sum(len(text) for text, _, _ in items))
        flags = [False] * len(numbers)
        if later:
            doc, start, count = (np.array(c, dtype=np.int64) for c in zip(*later))
            back = X.to_documents(doc, [start, count], buckets)
            numbers += back["bucket"].tolist()
            payloads += back["payload"].tolist()
            flags += [True] * len(back)
            sizes += [0] * len(back)
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary()), pa.array(flags, pa.bool_()),
             pa.array(sizes, pa.int64())], ["bucket", "payload", "flags", "size"])

    for batch in batches:
        hits, at = batch.column("hits").to_pylist(), 0
        for ids, raw in X.chunks(batch):
            h, doc, first, last = stretches(raw, width)
            cut = h >> U64(64 - bits)
            shard = X.bucket_of(h, shards)
            bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i, text in enumerate(raw):
                lo, hi = bounds[i], bounds[i + 1]
                told = np.isin(cut[lo:hi], np.frombuffer(hits[at + i], dtype=U64))
                for s, a, b in zip(shard[lo:hi][told].tolist(), first[lo:hi][told].tolist(), last[lo:hi][told].tolist()):
                    piece = text[a:b + width]
                    have = found.get(piece)
                    if have is None:
                        found[piece] = (s, ids[i], a)
                        size += len(piece)
                    elif (ids[i], a) < have[1:]:
                        later.append((have[1], have[2], b - a + 1))
                        found[piece] = (s, ids[i], a)
                    else:
                        later.append((ids[i], a, b - a + 1))
            at += len(ids)
            if size >= 24_000_000:
                yield rows()
                found, later, size = {}, [], 0
    if found:
        yield rows()


def _packed(items: list[tuple[bytes, int, int]]) -> bytes:
    texts, docs, starts = zip(*items)
    return X.pack(np.array([len(t) for t in texts], dtype=np.uint32), np.array(docs, dtype=np.int64),
                  np.array(starts, dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8))


def _runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String starts as few runs: sorted by document and start, touching runs joined."""
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    if not len(doc):
        return doc, start, count
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] != (start + count)[:-1])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (start + count)[last] - start[at]


def _sort_shard(frame: pd.DataFrame, width: int, buckets: int) -> pd.DataFrame:
    """Later copies in one part of a shard, to their documents; if the shard has more parts, also the
    sorted first copies for the merge."""
    parts = int(frame["parts"].iloc[0])
    found: dict[bytes, tuple[int, int]] = {}
    later: list[tuple[int, int, int]] = []
    for payload in frame["payload"]:
        sizes, docs, starts, data = X.unpack(payload)
        data, at = data.tobytes(), 0
        for size, doc, start in zip(sizes.tolist(), docs.tolist(), starts.tolist()):
            piece = data[at:at + size]
            at += size
            have = found.get(piece)
            if have is not None:
                later.append((*max(have, (doc, start)), size - width + 1))
                found[piece] = min(have, (doc, start))
            else:
                found[piece] = (doc, start)
    symbols = np.frombuffer(b"".join(p + b"\0" for p in found), dtype=np.uint8).astype(np.int16) + 1
    sizes = np.array([len(p) for p in found], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    order = suffix_array(symbols, width)
    prefix = common_prefixes(symbols, order, 4 * width)
    owner = np.searchsorted(ends, order)
    inside = order - (ends - sizes)[owner]
    docs, starts = (np.array(c, dtype=np.int64) for c in zip(*found.values()))
    string = sizes[owner] - inside >= width
    doc, start = docs[owner], starts[owner] + inside
    group = np.cumsum(prefix < width)
    keep = np.flatnonzero(string)
    by = keep[np.lexsort((start[keep], doc[keep], group[keep]))]
    heads = X.group_starts(group[by])
    repeated = np.ones(len(by), dtype=bool)
    repeated[heads] = False
    more = by[repeated]
    old = np.array(later, dtype=np.int64).reshape(-1, 3)
    back = X.to_documents(*(lambda d, s, c: (d, [s, c], buckets))(*_runs(
        np.concatenate([doc[more], old[:, 0]]), np.concatenate([start[more], old[:, 1]]),
        np.concatenate([np.ones(len(more), dtype=np.int64), old[:, 2]]))))
    back = back.assign(part=-1)
    if parts > 1:
        firsts = by[heads]
        values = symbols.astype(U64)
        h = X.run_hashes(values, order[firsts], order[firsts] + width)
        g = X.run_hashes(values, order[firsts], order[firsts] + width, 0xC2B2AE3D27D4EB4F)
        sort = np.lexsort((g, h))
        firsts, h, g = firsts[sort], h[sort], g[sort]
        cuts = np.searchsorted(X.bucket_of(h, parts), np.arange(parts + 1))
        runs = pd.DataFrame({"bucket": int(frame["bucket"].iloc[0]), "payload": [
            X.pack(h[i:j], g[i:j], doc[firsts[i:j]], start[firsts[i:j]]) for i, j in zip(cuts, cuts[1:])],
            "part": np.arange(parts)})
        back = pd.concat([back, runs])
    return back[["bucket", "payload", "part"]]


def _merge(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Later copies among the sorted runs of a shard's parts. Each run finds its strings in the merged
    ones by binary search."""
    h, doc, start = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    second, out = np.zeros(0, dtype=U64), []
    for payload in frame["payload"]:
        a, b, d, s = X.unpack(payload)
        at = np.searchsorted(h, a)
        met = at < len(h)
        met[met] = (h[at[met]] == a[met]) & (second[at[met]] == b[met])
        old = at[met]
        earlier = (d[met] < doc[old]) | (d[met] == doc[old]) & (s[met] < start[old])
        out.append((np.where(earlier, doc[old], d[met]), np.where(earlier, start[old], s[met])))
        doc[old], start[old] = np.where(earlier, d[met], doc[old]), np.where(earlier, s[met], start[old])
        h, second = np.insert(h, at[~met], a[~met]), np.insert(second, at[~met], b[~met])
        doc, start = np.insert(doc, at[~met], d[~met]), np.insert(start, at[~met], s[~met])
    d, s = (np.concatenate(x) for x in zip(*out))
    d, s, c = _runs(d, s, np.ones(len(d), dtype=np.int64))
    return X.to_documents(d, [s, c], buckets)


def _spans(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """Removed bytes of each document from the starts of later copies."""
    if not len(frame):
        return pd.DataFrame({"s_id": [], "gone": []})
    doc, start, count = (np.concatenate(c) for c in zip(*(X.unpack(p) for p in frame["payload"])))
    rows, order = [], np.lexsort((start, doc))
    doc, first, end = doc[order], start[order], (start + count)[order] + width - 1
    cuts = np.append(X.group_starts(doc), len(doc))
    for i, j in zip(cuts, cuts[1:]):
        a, top = first[i:j], np.maximum.accumulate(end[i:j])
        new = np.concatenate([[True], a[1:] > top[:-1]])
        at = np.flatnonzero(new)
        rows.append((int(doc[i]), np.column_stack([a[at], top[np.append(at[1:], len(a)) - 1]]).astype(np.int64).tobytes()))
    return pd.DataFrame(rows, columns=["s_id", "gone"])


def _remove(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, at = batch.column("gone").to_pylist(), 0
        for ids, raw in X.chunks(batch):
            spans = [np.frombuffer(g, dtype=np.int64).reshape(-1, 2).tolist() if g else []
                     for g in gone[at:at + len(ids)]]
            at += len(ids)
            yield _result(ids, raw, spans, digest)


def remove_repeats(docs: DataFrame, width: int = 100, digest: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every document without the bytes covered by a string of ``width`` bytes that also starts earlier: in
    a document with a smaller id, or in the same one further left. Returns ``doc_id``, ``n_bytes``,
    ``n_removed``, ``kept`` (the bytes that stay, or with ``digest`` their SHA-256 in hex) and ``spans``
    (maximal removed runs).

    Texts are UTF-8 bytes, null is empty; strings are judged on the input and never cross documents. Rows
    with a null id keep everything and are no reference. Ids are taken to be unique; of rows that share
    an id each is judged as if the others were the same document.
    """
    if width <= GRAM:
        raise ValueError(f"width must be more than {GRAM} bytes")
    rows = rows_of(docs, id_col, text_col)
    size = X.text_bytes(rows)
    buckets = X.bucket_count(size)
    bits = X.kept_bits(size)
    named = rows.where("doc_id is not null")
    sent = named.mapInArrow(partial(_designate, width=width, buckets=buckets, bits=bits), X.SENT)
    hits = sent.groupBy("bucket").applyInPandas(partial(_several, buckets=buckets), X.SENT).groupBy(
        "bucket").applyInPandas(_matched, "m_id long, hits binary")
    marks = stored(named.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")))
    firsts = marks.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = marks.join(firsts, ["h", "g"]).where(F.col("doc_id") > F.col("first")).select(
        F.col("doc_id").alias("m_id"), F.lit(None).cast("binary").alias("hits"), "h")
    told = hits.withColumn("h", F.lit(None).cast("long")).union(copies).groupBy("m_id").agg(
        F.max("hits").alias("hits"), F.collect_set("h").alias("copies"))
    joined = rows.join(told, rows["doc_id"] == told["m_id"], "left").select(
        "doc_id", "text", "hits", F.array_contains("copies", F.xxhash64("text")).alias("copy"))
    settled = stored(joined.mapInArrow(partial(_settle, width=width, digest=digest), RESULT + ", text string, hits binary"))
    names = [f.split(" ")[0] for f in RESULT.replace("array<struct<start:long,length:long>>", "x").split(", ")]
    done = settled.where("hits is null").select(names)
    pending = settled.where("hits is not null").select("doc_id", "text", "hits")
    cut = stored(pending.mapInArrow(partial(_cut, width=width, shards=2 * buckets, buckets=buckets, bits=bits), SHARDED))
    pieces, flagged = cut.where("not flags"), cut.where("flags").select("bucket", "payload")
    loads = pieces.groupBy("bucket").agg(F.ceil(F.sum("size") / PART_BYTES).cast("int").alias("parts"))
    split = pieces.join(loads, "bucket").select(
        "bucket", "payload", "parts", F.pmod(F.xxhash64("payload"), F.col("parts")).cast("int").alias("sub"))
    sorted_ = stored(split.groupBy("bucket", "sub").applyInPandas(
        partial(_sort_shard, width=width, buckets=buckets), X.SENT + ", part int"))
    merged = sorted_.where("part >= 0").groupBy("bucket", "part").applyInPandas(
        partial(_merge, buckets=buckets), X.SENT)
    spans = flagged.union(sorted_.where("part < 0").select("bucket", "payload")).union(merged).groupBy(
        "bucket").applyInPandas(partial(_spans, width=width), "s_id long, gone binary")
    answered = pending.join(spans, pending["doc_id"] == spans["s_id"], "left").select(
        "doc_id", "text", "gone").mapInArrow(partial(_remove, digest=digest), RESULT)
    return done.union(answered)
