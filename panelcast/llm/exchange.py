"""Hashes of words and windows, and their exchange between tasks as packed arrays.

Matching every window of a corpus means moving about one hash per word. As rows that would be the
largest shuffle of all; here a task sorts its hashes, sends each bucket the differences of the sorted
values in byte planes, and names the documents once. Hashes are cut to the bits that tell values of the
whole corpus apart, so an entry takes 3 to 5 bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import give_back

U64 = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
FLUSH = 1_000_000
"""Entries a task gathers before it sends them."""
CHUNK_BYTES = 1_000_000
BUCKET_BYTES = 8_000_000
"""Bytes of text per bucket of the exchange."""

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base ** i`` (or its inverse) modulo 2^64 for i below ``n``."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        one = pow(base, -1, 1 << 64) if inverse else base
        have = np.empty(max(n, 1 << 16), dtype=U64)
        have[0] = 1
        done = 1
        while done < len(have):  # doubling: the next part is the last one times base^done
            more = min(done, len(have) - done)
            have[done:done + more] = have[:more] * U64(pow(one, done, 1 << 64))
            done += more
        if len(have) <= 1 << 23:
            _powers[(base, inverse)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole value, one to one."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, from one running sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((values + U64(1)) * powers(base, n), out=total[1:])
    back = powers(base, n + 1, inverse=True)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64) * U64(STEP))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: hash, text number, first and end byte of each.

    ``lower`` lower-cases A-Z first; ``letters`` takes runs of ASCII letters, digits and other characters
    beyond ASCII as words instead.
    """

    def __init__(self, raw: list[bytes], lower: bool = False, letters: bool = False):
        self.raw = raw
        sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        self.data = data
        if letters:
            low = data | 32
            out = ~((data >= 128) | ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57)))
        else:
            out = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], out]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        bounds = np.cumsum(sizes)
        self.offsets = bounds - sizes
        self.doc = np.searchsorted(bounds, self.starts, side="right").astype(np.int32)
        self.firsts = np.searchsorted(self.doc, np.arange(len(raw) + 1))
        self.hashes = run_hashes(data.astype(U64), self.starts, self.ends)

    def windows(self, n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every window of ``n`` words inside one text."""
        count = len(self.doc)
        if count < n:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[:count - n + 1] == self.doc[n - 1:])
        return run_hashes(self.hashes, at, at + n, base), at


def text_digests(raw: list[bytes]) -> np.ndarray:
    """64 bits that stand for each whole text."""
    return np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=8).digest() for r in raw), dtype=np.int64)


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts (UTF-8) of a batch, about ``limit`` bytes at a time."""
    ids, texts, size = [], [], 0
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    give_back()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        body = pa.compress(planes, "zstd", asbytes=True) if planes else b""
        out.append(struct.pack("<sBQQ", a.dtype.kind.encode(), a.itemsize, len(a), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    arrays, at = [], 0
    while at < len(data):
        kind, width, n, size = struct.unpack_from("<sBQQ", data, at)
        at += struct.calcsize("<sBQQ")
        body = pa.decompress(data[at:at + size], n * width, "zstd", asbytes=True) if n else b""
        at += size
        planes = np.frombuffer(body, dtype=np.uint8).reshape(width, n)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<{kind.decode()}{width}"))
    return arrays


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(size: int) -> int:
    return max(64, -(-size // BUCKET_BYTES))


def kept_bits(size: int) -> int:
    """Bits of a hash that tell candidates of ``size`` bytes of text apart: so many that, at any size, about
    one window in 60,000 meets an unrelated one. Exact comparison follows."""
    return min(64, max(32, max(1, size).bit_length() + 8))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket from the top 32 bits: sorted hashes have sorted buckets."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


SENT = "bucket int, payload binary"


def sent(hashes: np.ndarray, owner: np.ndarray, docs: dict[str, np.ndarray], buckets: int, bits: int,
         flags: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket with the entries that fall in it: sorted hashes cut to ``bits``, the number of
    their document in ``docs`` (arrays of one length) and a flag each."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order] >> U64(64 - bits), owner[order]
    flags = np.zeros(len(hashes), dtype=np.uint8) if flags is None else flags[order].astype(np.uint8)
    cuts = np.searchsorted(bucket_of(hashes << U64(64 - bits), buckets), np.arange(buckets + 1))
    numbers, payloads = [], []
    for b in range(buckets):
        part = slice(cuts[b], cuts[b + 1])
        if part.start == part.stop:
            continue
        named, local = np.unique(owner[part], return_inverse=True)
        local = local.astype(np.uint16 if len(named) <= 1 << 16 else np.uint32)
        steps = np.diff(hashes[part], prepend=U64(0))
        numbers.append(b)
        payloads.append(pack(steps, local, np.packbits(flags[part]), *[a[named] for a in docs.values()]))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())],
                                      ["bucket", "payload"])


def received(payloads: pd.Series, names: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Hashes, flags and document columns of all entries of a bucket, sorted by hash."""
    hashes, flags, columns = [], [], {n: [] for n in names}
    for payload in payloads:
        steps, local, bits, *docs = unpack(payload)
        hashes.append(np.cumsum(steps, dtype=U64))
        flags.append(np.unpackbits(bits, count=len(steps)).astype(bool))
        for name, values in zip(names, docs):
            columns[name].append(values[local])
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    return h[order], np.concatenate(flags)[order], {n: np.concatenate(v)[order] for n, v in columns.items()}


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Positions where any of the sorted keys changes."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(len(keys[0]), dtype=bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mix(ids.astype(np.int64).view(U64)), buckets)


def to_documents(ids: np.ndarray, columns: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """Entries packed by the bucket of their document: the way back."""
    where = doc_bucket(ids, buckets)
    order = np.lexsort((ids, where))
    ids, where, columns = ids[order], where[order], [c[order] for c in columns]
    at = np.append(group_starts(where), len(where))
    return pd.DataFrame({
        "bucket": where[at[:-1]].astype(np.int32),
        "payload": [pack(ids[i:j], *[c[i:j] for c in columns]) for i, j in zip(at, at[1:])]},
        columns=["bucket", "payload"])
