"""Clustering around centroids over a vector approximation file.

Each component of a vector is put into one of a few cells, so a vector of whole numbers becomes a few bytes.
For a centroid and a cell, a lookup table gives the least and the largest squared distance the component
can have, and the sums over all components bound the distance to every centroid. Only where the intervals
of several centroids overlap, or where a vector moves and its cluster's sum must follow, is the full vector
fetched; the sums of the clusters are kept up to date by what moves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import stored

SAMPLE = 4096
"""Vectors from which the range of the cells of a component is estimated; the outer cells reach to the ends."""
WIDEST = 1 << 27
"""Largest size of a scaled component whose squared distances fit 63 bits at up to 64 components."""
SCHEMA = "rid long, cells binary, cluster int, sums array<long>"


def quantized(rows: DataFrame, width: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of vectors with ``width`` components, all finite; ``v`` is null
    where a component is beyond ``WIDEST``."""
    x = F.col("v")
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = picked.where((F.size(x) == width) & F.forall(
        x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(e)))
    near = F.forall(x, lambda e: F.abs(e * scale) <= float(WIDEST - 1))
    return whole.select("vec_id", F.when(near, F.transform(x, lambda e: F.floor(e * scale))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed int32 as whole numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(-1, width).astype(np.int64)


def _bytes(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    size, data = rows.itemsize * rows.shape[1], rows.tobytes()
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


class Cells:
    """Borders of the cells: cell ``i`` of component ``j`` holds the whole numbers ``low[j, i] .. high[j, i]``."""

    def __init__(self, least: np.ndarray, most: np.ndarray, sample: np.ndarray, bits: int):
        n = 1 << bits
        inner = np.quantile(sample, [0.001, 0.999], axis=0)
        start, end = np.maximum(np.floor(inner[0]), least), np.minimum(np.ceil(inner[1]), most)
        step = np.maximum(1.0, (end - start + 1) / n)
        self.cuts = (start[:, None] + np.ceil(step[:, None] * np.arange(1, n))).astype(np.int64)  # first number of cells 1, 2, ...
        self.low = np.column_stack([np.minimum(least, self.cuts[:, 0] - 1), self.cuts])
        self.high = np.column_stack([self.cuts - 1, np.maximum(most, self.cuts[:, -1])])

    def encode(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v[:, j], side="right") for j, c in enumerate(self.cuts)]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance of each component, cell and centroid."""
        c = centroids.T[:, None, :]
        below, above = self.low[:, :, None] - c, c - self.high[:, :, None]
        return np.maximum(0, np.maximum(below, above)) ** 2, np.maximum(np.abs(below), np.abs(above)) ** 2


class Bounds:
    """Which centroids a vector can be nearest to, judged by its cells."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.centroids, (self.least, self.most) = centroids, cells.tables(centroids)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        lo = np.zeros((len(cells), len(self.centroids)), dtype=np.int64)
        hi = lo.copy()
        for j in range(cells.shape[1]):
            lo += self.least[j, cells[:, j]]
            hi += self.most[j, cells[:, j]]
        return lo <= hi.min(axis=1)[:, None]

    def nearest(self, v: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest of the marked centroids, the smaller on ties, and the squared distance."""
        best = np.full(len(v), np.iinfo(np.int64).max)
        which = np.full(len(v), -1, dtype=np.int32)
        for c, center in enumerate(self.centroids):
            at = np.flatnonzero(among[:, c])
            d = ((v[at] - center) ** 2).sum(axis=1)
            better = at[d < best[at]]
            which[better], best[better] = c, d[d < best[at]]
        return which, best


def _rows(rid, cells, cluster, sums=None) -> pa.RecordBatch:
    n = len(rid)
    return pa.RecordBatch.from_arrays(
        [pa.array(rid, pa.int64()), cells if cells is not None else pa.nulls(n, pa.binary()),
         pa.array(cluster, pa.int32()), pa.array(sums if sums is not None else [None] * n, pa.list_(pa.int64()))],
        names=["rid", "cells", "cluster", "sums"])


def _sum_rows(totals: np.ndarray) -> pa.RecordBatch:
    """What a task adds to each cluster: count and components, on rows without a ``rid``."""
    at = np.flatnonzero(totals.any(axis=1))
    return _rows([None] * len(at), None, at, [t.tolist() for t in totals[at]])


def _add(totals: np.ndarray, cluster: np.ndarray, v: np.ndarray, sign: int) -> None:
    at = cluster >= 0
    np.add.at(totals, cluster[at], sign * np.column_stack([np.ones(at.sum(), dtype=np.int64), v[at]]))


def _taken(table: DataFrame, totals: np.ndarray) -> np.ndarray:
    """``totals`` with the sums that the tasks wrote: one number per cluster and component is collected."""
    parts = table.where(F.col("rid").isNull()).groupBy("cluster")
    for r in parts.agg(*[F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(totals.shape[1])]).collect():
        totals[r["cluster"]] += np.array([int(x) for x in r[1:]], dtype=object)
    return totals


def _moved(centroids: np.ndarray, totals: np.ndarray) -> np.ndarray:
    counts = totals[:, :1]
    return np.where(counts > 0, totals[:, 1:] // np.maximum(counts, 1), centroids)


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2:", width: int = 64, scale: int = 256, bits: int = 8,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` and
    ``fetched`` (whether the last assignment needed the full vector) of every kept vector.

    Centroids start as the vectors with the ``k`` smallest SHA-256 of ``salt`` and the id, in that order; equal
    ids are ordered by their vectors and null ids come last. With fewer vectors there are fewer centroids;
    without any the result is empty. Vectors that are null, of another width, or hold a null or non-finite
    component are not kept; repeated rows count each. A vector with a scaled component beyond ``WIDEST``, whose
    distances no long could hold, takes part in no cluster and comes back with nulls.
    """
    if not 1 <= bits <= 8:
        raise ValueError("a cell has 1 to 8 bits")
    if width > 64:
        raise ValueError("distances of more than 64 components may not fit a long")
    spark = rows.sparkSession
    ints = quantized(rows, width, scale, id_col, vector_col)

    def pack(batches):
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _bytes(v.astype(np.int32))], names=["vec_id", "v"])

    near = ints.where(F.col("v").isNotNull())
    table = stored(near.mapInArrow(pack, "vec_id long, v binary").withColumn("rid", F.monotonically_increasing_id()))
    first = near.select("v", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("s")).orderBy(
        F.col("s").asc_nulls_last(), "v").limit(k)
    centroids = np.array([r["v"] for r in first.collect()], dtype=np.int64).reshape(-1, width)
    far = ints.where(F.col("v").isNull()).select("vec_id")
    blank = far.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
        ("centroid_sha256", "string"), ("fetched", "boolean"))])
    if not len(centroids):
        return blank
    k = len(centroids)

    def ends(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), width)
                yield pa.RecordBatch.from_pydict({"j": np.arange(width, dtype=np.int32), "lo": v.min(axis=0), "hi": v.max(axis=0)})

    span = table.select("v").mapInArrow(ends, "j int, lo long, hi long").groupBy("j").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("j").collect()
    drawn = table.select("v", F.xxhash64("rid", "v").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()
    cells = Cells(np.array([r["lo"] for r in span]), np.array([r["hi"] for r in span]),
                  np.frombuffer(b"".join(r["v"] for r in drawn), dtype=np.int32).reshape(-1, width), bits)

    def encode(batches):
        for b in batches:
            coded = cells.encode(_matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), b.column("v"), _bytes(coded)],
                                             names=["rid", "vec_id", "v", "cells"])

    file = stored(table.select("rid", "vec_id", "v").mapInArrow(encode, "rid long, vec_id long, v binary, cells binary"))

    def coded(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)

    def assign_all(centroids: np.ndarray):
        """First round: every vector is new to its cluster, so the whole file is read once."""
        def run(batches):
            bounds, totals = Bounds(cells, centroids), np.zeros((k, width + 1), dtype=np.int64)
            for b in batches:
                if b.num_rows:
                    v = _matrix(b.column("v"), width)
                    which, _ = bounds.nearest(v, bounds.candidates(coded(b.column("cells"))))
                    _add(totals, which, v, 1)
                    yield _rows(b.column("rid"), b.column("cells"), which)
            yield _sum_rows(totals)
        return run

    def judge(centroids: np.ndarray):
        """Cluster by the cells alone, -1 where several centroids remain, whose marks then follow."""
        def run(batches):
            bounds = Bounds(cells, centroids)
            for b in batches:
                if b.num_rows:
                    among = bounds.candidates(coded(b.column("cells")))
                    single = among.sum(axis=1) == 1
                    found = np.where(single, among.argmax(axis=1), -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("rid"), b.column("cells"), b.column("cluster"), pa.array(found), _bytes(np.packbits(among, axis=1))],
                        names=["rid", "cells", "old", "found", "among"])
        return run

    def settle(centroids: np.ndarray):
        """Fetched vectors: nearest of the marked centroids, and what moved from cluster to cluster."""
        def run(batches):
            bounds, totals = Bounds(cells, centroids), np.zeros((k, width + 1), dtype=np.int64)
            for b in batches:
                if b.num_rows:
                    v = _matrix(b.column("v"), width)
                    marks = np.frombuffer(b"".join(b.column("among").to_pylist()), dtype=np.uint8).reshape(len(v), -1)
                    which, _ = bounds.nearest(v, np.unpackbits(marks, axis=1, count=k).astype(bool))
                    old = b.column("old").to_numpy(zero_copy_only=False)
                    moved = which != old
                    _add(totals, old[moved], v[moved], -1)
                    _add(totals, which[moved], v[moved], 1)
                    yield _rows(b.column("rid"), b.column("cells"), which)
            yield _sum_rows(totals)
        return run

    totals = np.zeros((k, width + 1), dtype=object)
    if rounds:
        state = stored(file.select("rid", "v", "cells").mapInArrow(assign_all(centroids), SCHEMA))
        totals = _taken(state, totals)
        state = state.where(F.col("rid").isNotNull()).select("rid", "cells", "cluster")
        centroids = _moved(centroids, totals).astype(np.int64)
    for _ in range(1, rounds):
        judged = stored(state.mapInArrow(judge(centroids), "rid long, cells binary, old int, found int, among binary"))
        still = F.col("found") == F.col("old")
        fetched = judged.where(~still).join(file.select("rid", "v"), "rid")
        settled = stored(fetched.select("rid", "cells", "old", "among", "v").mapInArrow(settle(centroids), SCHEMA))
        totals = _taken(settled, totals)
        state = judged.where(still).select("rid", "cells", F.col("found").alias("cluster")).unionByName(
            settled.where(F.col("rid").isNotNull()).select("rid", "cells", "cluster"))
        centroids = _moved(centroids, totals).astype(np.int64)

    def finish(batches):
        bounds = Bounds(cells, centroids)
        for b in batches:
            if b.num_rows:
                among = bounds.candidates(coded(b.column("cells")))
                which, distance = bounds.nearest(_matrix(b.column("v"), width), among)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(which), pa.array(distance), pa.array(among.sum(axis=1) > 1)],
                    names=["vec_id", "cluster", "distance", "fetched"])

    final = stored(file.select("vec_id", "v", "cells").mapInArrow(
        finish, "vec_id long, cluster int, distance long, fetched boolean"))
    sums = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda x: x if x < 1 << 63 else None
    facts = [(c, held(sums.get(c, 0)), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
             for c, row in enumerate(centroids.tolist())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows
    out = final.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(held(sum(sums.values()))).cast("long").alias("inertia"),
        "centroid_sha256", "fetched")
    return out.unionByName(blank)
