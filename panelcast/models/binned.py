"""Tree ensembles over a packed matrix of bins.

Every feature is cut into up to 255 bins once per panel; a row becomes one byte per feature. The matrix is
partitioned by its bytes. Trees grow level by level from sums of gradient and curvature per node, feature
and bin. A panel of one partition is grown inside one task, so all ensembles of a benchmark (and stretches
of the trees of a forest, which do not depend on each other) are tasks of one job. A panel of several
partitions sums its histograms by feature in an exchange, one job per level; both ways use the same draws
and find the same splits.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.predictors import TreePredictor
from panelcast.session import cut_lineage

SEED = 42
BINS = 255
PART_BYTES = 64 << 20
"""Bytes of bins in a partition; what a task holds of the panel."""
WIDE = 64
"""Open nodes up to which a level is summed as histograms."""
TOGETHER = 12
"""Features of a forest whose sorted rows are summed together."""
STRETCH = 25
"""Trees of a forest that one task grows."""
CUT_EVERY = 20
"""Boosted trees after which the written predictions of a large panel replace their lineage."""
LEAST_GAIN = 1e-12
SUMMARY = 1024
"""Quantiles that a batch of rows gives of a feature."""


@dataclass(frozen=True)
class TreeSettings:
    """How an ensemble is grown.

    ``growth``: ``level`` splits every node that gains, ``leaf`` the best leaves first until there are
    ``leaves``, ``symmetric`` all nodes of a level at one cut. ``cut``: ``best`` of all bins, or one ``random``
    cut per node and feature. ``sample``: the share ``rows`` without replacement, ``bootstrap`` counts, or
    ``bayesian`` exponential weights. ``leaf`` is the least curvature on a side, ``l2`` the penalty on leaf
    values. Without ``boost`` trees are averaged. Trees use every ``2 ** coarse``-th cut of the matrix.
    """

    trees: int = 300
    rate: float = 0.03
    depth: int = 4
    leaf: float = 1.0
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    growth: str = "level"
    leaves: int = 0
    cut: str = "best"
    boost: bool = True
    sample: str = "rows"
    coarse: int = 2

    def size(self, values: list[np.ndarray]) -> int:
        """Bins that histograms have; each is ``2 ** coarse`` bins of the matrix."""
        return max(2, max(len(v) for v in values))

    def coarse_values(self, values: list[np.ndarray]) -> list[np.ndarray]:
        """The largest value of each bin of the histograms."""
        return [v[np.minimum(self.fine(np.arange((len(v) - 1 >> self.coarse) + 1)), len(v) - 1)] for v in values]

    def fine(self, cut: np.ndarray) -> np.ndarray:
        """Last bin of the matrix in a bin of the histograms."""
        return (cut << self.coarse) + (1 << self.coarse) - 1


@dataclass
class Tree:
    """Nodes of a tree; ``feature`` -1 marks a leaf, bins up to ``cut`` go left."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, gain: float, left: float, right: float) -> None:
        self.feature[node], self.cut[node], self.gain[node] = int(feature), int(cut), float(gain)
        self.left[node], self.right[node] = self.add(left), self.add(right)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, dtype=np.int32), np.array(self.cut, dtype=np.int32),
                np.array(self.left, dtype=np.int32), np.array(self.right, dtype=np.int32))

    def walk(self, bins: np.ndarray, steps: int) -> np.ndarray:
        """Node of each row after so many steps down."""
        feature, cut, left, right = self.arrays()
        node, rows = np.zeros(len(bins), dtype=np.int32), np.arange(len(bins))
        for _ in range(steps):
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            goes = bins[rows, np.maximum(f, 0)] <= cut[node]
            node = np.where(inner, np.where(goes, left[node], right[node]), node)
        return node

    def pruned(self, leaves: int) -> None:
        """Keep the splits that growing the best leaf first reaches before there are ``leaves``."""
        ready, kept, n = [(-self.gain[0], 0)] if self.feature[0] >= 0 else [], set(), 1
        while ready and n < leaves:
            _, node = heapq.heappop(ready)
            kept.add(node)
            n += 1
            for child in (self.left[node], self.right[node]):
                if self.feature[child] >= 0:
                    heapq.heappush(ready, (-self.gain[child], child))
        for node in range(len(self.feature)):
            if node not in kept:
                self.feature[node], self.gain[node] = -1, 0.0


# --- draws: they depend on the tree and the block of rows only, wherever they are made ------------


def row_weights(s: TreeSettings, tree: int, block: int, n: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, 1, tree, block])
    if s.sample == "bootstrap":
        return rng.poisson(1.0, n).astype(float)
    if s.sample == "bayesian":
        return rng.exponential(1.0, n)
    return np.ones(n) if s.rows >= 1 else (rng.random(n) < s.rows).astype(float)


def tree_columns(s: TreeSettings, tree: int, p: int) -> np.ndarray:
    if s.columns >= 1:
        return np.arange(p)
    rng = np.random.default_rng([SEED, 2, tree])
    return np.sort(rng.choice(p, max(1, round(p * s.columns)), replace=False))


def _draws(s: TreeSettings, tree: int, level: int, p: int) -> Callable[[int], np.ndarray] | None:
    """Uniform draws of a level by feature, as many as there are nodes."""
    if s.cut != "random":
        return None
    return lambda f, n: np.random.default_rng([SEED, 3, tree, level, int(f)]).random(n)


# --- splits from histograms ----------------------------------------------------------------------


def histogram(across: np.ndarray, node: np.ndarray, g: np.ndarray, w: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """Sums of ``g`` and ``w`` per node, feature and bin: ``(2, nodes, features, size)``. ``across`` has a row of
    bins per feature, so the sums of a feature stay in the processor's cache."""
    out = np.empty((2, nodes, len(across), size))
    base = node.astype(np.int64) * size
    for j, x in enumerate(across):
        code = base + x
        out[0, :, j] = np.bincount(code, g, minlength=nodes * size).reshape(nodes, size)
        out[1, :, j] = np.bincount(code, w, minlength=nodes * size).reshape(nodes, size)
    return out


def _scores(hist: np.ndarray, s: TreeSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of every cut ``(nodes, features, size - 1)`` and the curvature on its two sides."""
    left = hist[..., :-1].cumsum(axis=-1)
    total = left[..., -1:] + hist[..., -1:]
    gl, hl = left
    gr, hr = total[0] - gl, total[1] - hl
    floor = max(s.l2, 1e-9)  # a side without rows has no gradient either
    gl *= gl
    gl /= hl + floor
    gr *= gr
    gr /= np.maximum(hr, 0.0) + floor
    gl += gr
    return gl, hl, hr


def level_splits(hist: np.ndarray, s: TreeSettings, draws, columns: np.ndarray, values: list[np.ndarray]):
    """Best split of each node among these features: score, position among the features, cut and the sums of
    ``g`` and ``w`` on the left. The score of an impossible split is minus infinity."""
    score, hl, hr = _scores(hist, s)
    nodes, p, size = score.shape
    if s.growth == "symmetric":
        whole = np.where((hl.max(axis=0) > 0) & (hr.max(axis=0) > 1e-9), score.sum(axis=0), -np.inf)
        best = np.tile(whole.reshape(-1).argmax(), nodes)
        value = np.repeat(whole.max(), nodes)
    else:
        fits = (hl >= s.leaf) & (hr >= s.leaf) & (hl > 0) & (hr > 1e-9)
        if draws is not None:
            fits &= _random_cuts(hist[1], draws, columns, values)[..., None] == np.arange(size)
        flat = np.where(fits, score, -np.inf).reshape(nodes, -1)
        best = flat.argmax(axis=1)
        value = flat[np.arange(nodes), best]
    f, cut = best // size, best % size
    own = hist[:, np.arange(nodes), f, :]
    keep = np.arange(hist.shape[-1]) <= cut[:, None]
    return value, f, cut, (own * keep).sum(axis=-1)


def _random_cuts(counts: np.ndarray, draws, columns: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """One cut per node and feature, uniform between the least and the largest value there."""
    nodes, p, size = counts.shape
    there = counts > 0
    lo, hi = there.argmax(axis=-1), size - 1 - there[..., ::-1].argmax(axis=-1)
    out = np.full((nodes, p), -1)
    for j, f in enumerate(columns):
        v = values[f]
        a, b = v[np.minimum(lo[:, j], len(v) - 1)], v[np.minimum(hi[:, j], len(v) - 1)]
        cut = np.searchsorted(v, a + draws(f, nodes) * (b - a), side="right") - 1
        out[:, j] = np.where(hi[:, j] > lo[:, j], np.clip(cut, lo[:, j], hi[:, j] - 1), -1)
    return out


class Grower:
    """A tree under construction: which nodes are open and what each split leaves in them."""

    def __init__(self, s: TreeSettings, g: float, w: float):
        self.s, self.tree, self.level = s, Tree(), 0
        self.open = [self.tree.add(self.leaf(g, w))]
        self.sums = [(g, w)]

    def leaf(self, g: float, w: float) -> float:
        return g / (w + self.s.l2) if w > 0 else 0.0

    def settle(self, score, feature, cut, left) -> np.ndarray:
        """Apply the splits of a level; for each open node the place of its left child among the new open
        nodes (the right one follows), or -1."""
        places, opened, sums = np.full(len(self.open), -1), [], []
        here = np.array([g * g / (w + self.s.l2) if w > 0 else 0.0 for g, w in self.sums])
        gain = score - (here.sum() if self.s.growth == "symmetric" else here)
        for i, (node, (g, w)) in enumerate(zip(self.open, self.sums)):
            if np.isfinite(gain[i]) and gain[i] > LEAST_GAIN:
                gl, hl = float(left[0, i]), float(left[1, i])
                self.tree.split(node, feature[i], cut[i], gain[i], self.leaf(gl, hl), self.leaf(g - gl, w - hl))
                places[i] = len(opened)
                opened += [self.tree.left[node], self.tree.right[node]]
                sums += [(gl, hl), (g - gl, w - hl)]
        self.open, self.sums, self.level = opened, sums, self.level + 1
        return places

    def done(self) -> Tree:
        if self.s.growth == "leaf" and self.s.leaves:
            self.tree.pruned(self.s.leaves)
        return self.tree


def _segment_splits(x, g, w, inside, starts, lengths, sums, s: TreeSettings, columns, draws, values):
    """Best cut of each node among a few features whose rows are sorted by node and bin: score, feature, cut and
    the sums on the left."""
    m = x.shape[1]
    gl, hl = g.cumsum(axis=1), w.cumsum(axis=1)
    before = np.maximum(starts - 1, 0)
    for c in (gl, hl):
        c -= np.repeat(np.where(starts > 0, c[:, before], 0.0), lengths, axis=1)
    fits = np.zeros(x.shape, dtype=bool)
    fits[:, :-1] = (x[:, 1:] != x[:, :-1]) & (inside[1:] == inside[:-1])
    total_g, total_w = (np.repeat(t, lengths) for t in sums)
    hr = total_w - hl
    fits &= (hl >= s.leaf) & (hr >= max(s.leaf, 1e-9))
    cuts = None
    if draws is not None:
        lo, hi = x[:, starts].astype(int), x[:, starts + lengths - 1].astype(int)
        cuts = np.full(lo.shape, -1)
        for j, f in enumerate(columns):
            v = values[f]
            a, b = v[np.minimum(lo[j], len(v) - 1)], v[np.minimum(hi[j], len(v) - 1)]
            c = np.searchsorted(v, a + draws(f, len(starts)) * (b - a), side="right") - 1
            cuts[j] = np.where(hi[j] > lo[j], np.clip(c, lo[j], hi[j] - 1), -1)
        at = np.repeat(cuts, lengths, axis=1)
        fits &= (x <= at) & (np.concatenate([x[:, 1:], x[:, -1:]], axis=1) > at)
    score = gl * gl
    score /= hl + s.l2
    rest = total_g - gl
    rest *= rest
    with np.errstate(divide="ignore", invalid="ignore"):
        rest /= hr + s.l2
    score += rest
    score[~fits] = -np.inf
    best = np.maximum.reduceat(score, starts, axis=1)
    f = best.argmax(axis=0)
    value = best[f, np.arange(len(starts))]
    line, place = np.repeat(f, lengths), np.arange(m)
    at = np.minimum.reduceat(np.where(score[line, place] == np.repeat(value, lengths), place, m - 1), starts)
    cut = x[f, at].astype(np.int64) if cuts is None else cuts[f, np.arange(len(starts))]
    return value, columns[f], cut, np.stack([gl[f, at], hl[f, at]])


def grow(across: np.ndarray, order: np.ndarray | None, g: np.ndarray, w: np.ndarray, s: TreeSettings, tree: int,
         values: list[np.ndarray]) -> Tree:
    """A tree over rows at hand, ``across`` holding a row of bins per feature.

    While few nodes are open their histograms are summed; of two siblings only the one with fewer rows, the
    other one is what their parent has besides. Beyond ``WIDE`` nodes each feature keeps its rows sorted by node
    and bin, so that a level costs the number of rows; ``order`` has the rows by each feature's bin.
    """
    columns = tree_columns(s, tree, len(across))
    used = np.flatnonzero(w > 0)
    g = g * w
    up = Grower(s, float(g[used].sum()), float(w[used].sum()))
    live, node = _grow_narrow(across, used, g, w, s, tree, values, columns, up, order is not None)
    if up.open and up.level < s.depth:
        inside = np.full(across.shape[1], -1, dtype=np.int32)
        inside[live] = node
        _grow_wide(across, order[columns], inside, g, w, s, tree, values, columns, up)
    return up.done()


def _grow_narrow(across, used, g, w, s: TreeSettings, tree: int, values, columns, up: Grower, stop: bool):
    """Levels summed as histograms; the rows of the open nodes and their nodes."""
    x = across if len(columns) == len(across) else across[columns]
    if len(used) < x.shape[1]:
        x = x[:, used]
    g, w, size = g[used], w[used], s.size(values)
    live, node, hist = np.arange(len(used)), np.zeros(len(used), dtype=np.int32), None
    while up.open and up.level < s.depth and not (stop and len(up.open) > WIDE):
        if hist is None:
            hist = histogram(x, node, g, w, 1, size)
        score, f, cut, left = level_splits(hist, s, _draws(s, tree, up.level, len(columns)), columns, values)
        places = up.settle(score, columns[f], cut, left)
        goes = places[node] >= 0
        live, node = live[goes], node[goes]
        node = (places[node] + (x[f[node], live] > cut[node])).astype(np.int32)
        if not up.open or up.level == s.depth or stop and len(up.open) > WIDE:
            break
        counts = np.bincount(node, minlength=len(up.open)).reshape(-1, 2)
        small = 2 * np.arange(len(counts)) + (counts[:, 1] < counts[:, 0])
        which = np.full(len(up.open), -1)
        which[small] = np.arange(len(small))
        mine = which[node] >= 0
        rows = live[mine]
        part = histogram(x[:, rows], which[node[mine]], g[rows], w[rows], len(small), size)
        parent = hist[:, places >= 0]
        parent -= part
        hist = np.empty((2, len(up.open), *part.shape[2:]))
        hist[:, small] = part
        hist[:, small ^ 1] = parent
        if s.sample == "bayesian":
            hist[1] = np.maximum(hist[1], 0.0)
        else:  # counts are whole, so what is left of nothing is nothing
            hist[0][hist[1] == 0] = 0.0
    return used[live], node


def _grow_wide(across, order, node, g, w, s: TreeSettings, tree: int, values, columns, up: Grower) -> None:
    """Levels of many nodes, each feature's rows sorted by node and bin."""
    while True:
        key = node[order].astype(np.int16 if len(up.open) < 1 << 15 else np.int32)
        stays = key >= 0
        if not stays.all():
            order, key = order[stays].reshape(len(columns), -1), key[stays].reshape(len(columns), -1)
        order = np.take_along_axis(order, np.argsort(key, axis=1, kind="stable"), axis=1)
        inside = node[order[0]]
        starts = np.searchsorted(inside, np.arange(len(up.open)))
        lengths = np.diff(np.append(starts, order.shape[1]))
        sums = np.array(up.sums).T
        draws = _draws(s, tree, up.level, len(columns))
        top = None
        for a in range(0, len(columns), TOGETHER):
            some, rows = columns[a:a + TOGETHER], order[a:a + TOGETHER]
            found = _segment_splits(across[some[:, None], rows], g[rows], w[rows], inside, starts, lengths, sums, s, some, draws, values)
            if top is None:
                top = found
            else:
                better = found[0] > top[0]
                top = [np.where(better, new, old) for new, old in zip(found, top)]
        value, feature, cut, left = top
        places = up.settle(value, feature, cut, left)
        if not up.open or up.level == s.depth:
            return
        live = order[0]
        right = across[feature[inside], live] > cut[inside]
        node[live] = np.where(places[inside] >= 0, places[inside] + right, -1)


def sorted_rows(across: np.ndarray) -> np.ndarray:
    """Rows in order of each feature's bin, ``(features, rows)``."""
    return np.argsort(across, axis=1, kind="stable").astype(np.int32)


def grown(bins: np.ndarray, blocks: list[tuple[int, int]], y: np.ndarray, s: TreeSettings, values: list[np.ndarray],
          first: int = 0, keep: np.ndarray | None = None) -> Iterator[Tree]:
    """Trees of an ensemble over rows at hand, one after the other. ``blocks`` are (number, rows); rows that are
    not in ``keep`` have no weight."""
    keep = np.ones(len(y), dtype=bool) if keep is None else keep
    fit = np.full(len(y), y[keep].mean()) if s.boost else np.zeros(len(y))
    across = np.ascontiguousarray(bins.T >> s.coarse)
    order = None if s.boost or s.growth == "symmetric" else sorted_rows(across)
    values = s.coarse_values(values)
    for t in range(first, first + s.trees):
        w = np.concatenate([row_weights(s, t, b, n) for b, n in blocks]) * keep
        tree = grow(across, order, y - fit, w, s, t, values)
        tree.cut = s.fine(np.array(tree.cut)).tolist()
        if s.boost:
            tree.value = [v * s.rate for v in tree.value]
            fit += np.array(tree.value)[tree.walk(bins, s.depth)]
        yield tree


# --- panels --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BinnedPanel:
    """The packed matrix: ``blocks`` has ``block``, ``n``, ``bins``, ``y`` and ``mark`` (binary), ``cuts`` the
    values that bins end with."""

    blocks: DataFrame
    cuts: list[np.ndarray]
    parts: int
    mean: float

    @property
    def values(self) -> list[np.ndarray]:
        """A value for each bin, the last one beyond the last cut."""
        return [np.append(c, c[-1] + (c[-1] - c[0]) / max(len(c), 1) if len(c) else 0.0) for c in self.cuts]

    def unpersist(self) -> None:
        self.blocks.unpersist()


def quantile_cuts(frame: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Values that split each feature into up to ``bins`` parts of about equal numbers of rows. Each batch of
    rows gives at most ``SUMMARY`` of its own quantiles with the rows they stand for, which are merged by feature."""
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                x = np.sort(f[names].to_numpy(dtype=float), axis=0)
                at = np.unique(np.linspace(0, len(x) - 1, min(len(x), SUMMARY)).round().astype(int))
                w = np.diff(at + 1.0, prepend=0.0)
                yield pd.DataFrame({"j": np.arange(len(names)), "v": [x[at, j].tobytes() for j in range(len(names))],
                                    "w": [w.tobytes()] * len(names)})

    def merged(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        v, w = (np.concatenate([np.frombuffer(b) for b in f[c]]) for c in ("v", "w"))
        order = np.argsort(v, kind="stable")
        v, below = v[order], w[order].cumsum()
        at = np.searchsorted(below, below[-1] * np.arange(1, bins) / bins)
        cuts = np.unique(v[np.minimum(at, len(v) - 1)])
        return pd.DataFrame({"j": [key[0]], "cuts": [cuts[cuts < v[-1]]]})

    parts = frame.select(*names).mapInPandas(summed, "j int, v binary, w binary")
    found = {r["j"]: np.array(r["cuts"], dtype=float) for r in parts.groupBy("j").applyInPandas(merged, "j int, cuts array<double>").collect()}
    return [found.get(j, np.zeros(0)) for j in range(len(names))]


def bin_panel(frame: DataFrame, names: list[str], mark: str | None = None, bins: int = BINS, part_bytes: int = PART_BYTES) -> BinnedPanel:
    """Cut the features of a stored panel into bins of about equal numbers of rows. ``mark`` names a small
    integer column that is kept beside the label."""
    cuts = quantile_cuts(frame, names, bins)
    p = len(names)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                x = f[names].to_numpy(dtype=float)
                coded = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.uint8)
                yield pd.DataFrame({"n": [len(f)], "bins": [coded.tobytes()], "y": [f["y"].to_numpy(dtype=float).tobytes()],
                                    "mark": [f["mark"].to_numpy(dtype=np.int8).tobytes()]})

    kept = frame.select(*names, "y", (F.col(mark) if mark else F.lit(0)).cast("int").alias("mark"))
    blocks = kept.mapInPandas(pack, "n int, bins binary, y binary, mark binary").withColumn(
        "block", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    facts = frame.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).first()
    parts = max(1, -(-int(facts["n"]) * p // part_bytes))
    if parts > 1:
        whole = blocks
        blocks = cut_lineage(whole.repartition(parts))
        whole.unpersist()
    return BinnedPanel(blocks, cuts, parts, float(facts["mean"] or 0.0))


def _matrix(f: pd.DataFrame, p: int):
    f = f.sort_values("block")
    bins = np.frombuffer(b"".join(f["bins"]), dtype=np.uint8).reshape(-1, p)
    y = np.frombuffer(b"".join(f["y"]))
    mark = np.frombuffer(b"".join(f["mark"]), dtype=np.int8)
    return bins, y, mark, list(zip(f["block"].tolist(), f["n"].tolist()))


def _packed(tree: Tree) -> dict[str, bytes]:
    feature, cut, left, right = tree.arrays()
    return {"feature": feature.tobytes(), "cut": cut.tobytes(), "left": left.tobytes(), "right": right.tobytes(),
            "value": np.array(tree.value, dtype=float).tobytes(), "gain": np.array(tree.gain, dtype=float).tobytes()}


TREE_SCHEMA = "fit int, tree int, feature binary, cut binary, left binary, right binary, value binary, gain binary"


def per_fit(panel: BinnedPanel, fits: int, run: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run(number, rows)`` for every fit, each in a task of its own that gets the one partition."""
    numbers = F.explode(F.array(*[F.lit(i) for i in range(fits)]))
    each = panel.blocks.withColumn("fit", numbers).repartitionByRange(fits, "fit")

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return run(int(key[0]), f)

    return each.groupBy("fit").applyInPandas(one, schema)


def fit_ensembles(panel: BinnedPanel, settings: list[TreeSettings]) -> list[tuple[TreePredictor, np.ndarray]]:
    """The fitted ensembles and how much each feature gains in them."""
    if panel.parts > 1:
        return [_assembled(panel, s, _grown_by_jobs(panel, s)) for s in settings]
    jobs = []  # (ensemble, first tree, settings of the stretch)
    for i, s in enumerate(settings):
        size = s.trees if s.boost else STRETCH
        jobs += [(i, a, replace(s, trees=min(size, s.trees - a))) for a in range(0, s.trees, size)]
    # The longest fits start first.
    jobs.sort(key=lambda j: -j[2].trees * j[2].depth)
    p, values = len(panel.cuts), panel.values

    def run(number: int, f: pd.DataFrame) -> pd.DataFrame:
        ensemble, first, s = jobs[number]
        bins, y, _, blocks = _matrix(f, p)
        trees = grown(bins, blocks, y, s, values, first)
        return pd.DataFrame([{"fit": ensemble, "tree": first + k, **_packed(t)} for k, t in enumerate(trees)])

    found: dict[int, list] = {i: [] for i in range(len(settings))}
    for r in per_fit(panel, len(jobs), run, TREE_SCHEMA).collect():
        found[r["fit"]].append((r["tree"], r))
    return [_assembled(panel, s, [_plain(r) for _, r in sorted(found[i], key=lambda x: x[0])]) for i, s in enumerate(settings)]


def _plain(r) -> dict[str, np.ndarray]:
    kinds = {"value": float, "gain": float}
    return {k: np.frombuffer(r[k], dtype=kinds.get(k, np.int32)) for k in ("feature", "cut", "left", "right", "value", "gain")}


def _assembled(panel: BinnedPanel, s: TreeSettings, trees: list[dict[str, np.ndarray]]) -> tuple[TreePredictor, np.ndarray]:
    """Flat node arrays with the cuts as feature values; the mean that boosting starts from is a tree of one leaf."""
    p = len(panel.cuts)
    importance = np.zeros(p)
    if s.boost:
        none = np.full(1, -1, dtype=np.int32)
        trees = [{"feature": none, "cut": np.zeros(1, dtype=np.int32), "left": none, "right": none,
                  "value": np.array([panel.mean]), "gain": np.zeros(1)}, *trees]
    starts = np.concatenate([[0], np.cumsum([len(t["feature"]) for t in trees])[:-1]]).astype(np.int32)
    flat = {k: np.concatenate([t[k] for t in trees]) for k in ("feature", "cut", "value", "gain")}
    down = {k: np.concatenate([np.where(t[k] >= 0, t[k] + a, -1) for t, a in zip(trees, starts)]).astype(np.int32)
            for k in ("left", "right")}
    inner = flat["feature"] >= 0
    np.add.at(importance, flat["feature"][inner], flat["gain"][inner])
    width = max(1, max(len(c) for c in panel.cuts))
    table = np.zeros((p, width))
    for j, c in enumerate(panel.cuts):
        table[j, :len(c)] = c
    threshold = np.where(inner, table[np.maximum(flat["feature"], 0), np.minimum(flat["cut"], width - 1)], 0.0)
    weight = np.ones(len(trees)) if s.boost else np.full(len(trees), 1.0 / max(len(trees), 1))
    total = importance.sum()
    return (TreePredictor(flat["feature"], threshold, down["left"], down["right"], flat["value"], starts, weight, s.depth),
            importance / total if total > 0 else importance)


SNAPSHOT_SCHEMA = "family int, fold int, trees int, depth int, total binary, y binary"


def held_out_errors(panel: BinnedPanel, points: list[TreeSettings], folds: int) -> list[float]:
    """Mean absolute error of each point over expanding folds: fold ``i`` learns from rows marked up to ``i`` and
    is tested on those marked ``i + 1``. Points that differ in the number of trees only, or forests in depth only,
    are scored at stages of the same trees."""
    families: dict[TreeSettings, list[int]] = {}
    for i, s in enumerate(points):
        families.setdefault(replace(s, trees=0, depth=s.depth if s.boost else 0), []).append(i)
    jobs = []  # (family, fold, first tree, settings, stages to report, depths)
    for a, (key, members) in enumerate(families.items()):
        stages = sorted({points[i].trees for i in members})
        depths = sorted({points[i].depth for i in members})
        whole = replace(key, trees=stages[-1], depth=depths[-1])
        ends = stages if key.boost else sorted({*range(STRETCH, stages[-1], STRETCH), *stages})
        starts = [0] if key.boost else [0, *ends[:-1]]
        for fold in range(folds):
            jobs += [(a, fold, first, replace(whole, trees=(ends[-1] if key.boost else ends[j]) - first),
                      ends if key.boost else [ends[j]], depths) for j, first in enumerate(starts)]
    p, values = len(panel.cuts), panel.values

    def run(number: int, f: pd.DataFrame) -> pd.DataFrame:
        family, fold, first, s, report, depths = jobs[number]
        bins, y, mark, blocks = _matrix(f, p)
        keep, test = mark <= fold, mark == fold + 1
        out = []
        if keep.any() and test.any():
            x = bins[test]
            total = {d: np.full(len(x), y[keep].mean() if s.boost else 0.0) for d in depths}
            for t, tree in enumerate(grown(bins, blocks, y, s, values, first, keep), first + 1):
                value = np.array(tree.value)
                for d in depths:
                    total[d] += value[tree.walk(x, d)]
                if t in report:
                    out += [(family, fold, t, d, total[d].tobytes(), y[test].tobytes()) for d in depths]
        return pd.DataFrame(out, columns=["family", "fold", "trees", "depth", "total", "y"])

    members = list(families.values())

    def score(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        y = np.frombuffer(f["y"].iloc[0])
        for i in members[key[0]]:
            s = points[i]
            if s.boost:
                mean = np.frombuffer(f["total"][(f["trees"] == s.trees) & (f["depth"] == s.depth)].iloc[0])
            else:
                part = f[(f["trees"] <= s.trees) & (f["depth"] == s.depth)]
                mean = np.sum([np.frombuffer(t) for t in part["total"]], axis=0) / s.trees
            out.append((i, float(np.abs(y - mean).mean())))
        return pd.DataFrame(out, columns=["point", "mae"])

    scored = per_fit(panel, len(jobs), run, SNAPSHOT_SCHEMA).groupBy("family", "fold").applyInPandas(score, "point int, mae double")
    means = {r["point"]: r["mae"] for r in scored.groupBy("point").agg(F.avg("mae").alias("mae")).collect()}
    return [means.get(i, float("nan")) for i in range(len(points))]


# --- several partitions --------------------------------------------------------------------------

BEST_SCHEMA = "feature int, node int, score double, cut int, gl double, hl double"


def _grown_by_jobs(panel: BinnedPanel, s: TreeSettings) -> list[dict[str, np.ndarray]]:
    """Trees over a panel of several partitions. Tasks sum their rows, an exchange by feature adds the sums up
    and finds each feature's best cut, and the driver sees one row per open node and feature."""
    p, values = len(panel.cuts), s.coarse_values(panel.values)
    size = s.size(values)
    start = panel.mean if s.boost else 0.0

    def begin(batches):
        for f in batches:
            yield f[["block", "n", "bins", "y"]].assign(fit=[np.full(n, start).tobytes() for n in f["n"]])

    schema = "block long, n int, bins binary, y binary, fit binary"
    state = panel.blocks.mapInPandas(begin, schema).persist(StorageLevel.MEMORY_AND_DISK)
    trees = []
    for t in range(s.trees):
        tree = _tree_by_jobs(state, s, t, p, size, values)
        tree.cut = s.fine(np.array(tree.cut)).tolist()
        if s.boost:
            tree.value = [v * s.rate for v in tree.value]

            def update(batches, tree=tree):
                for f in batches:
                    fits = [np.frombuffer(a) + np.array(tree.value)[tree.walk(np.frombuffer(b, dtype=np.uint8).reshape(-1, p), s.depth)]
                            for a, b in zip(f["fit"], f["bins"])]
                    yield f.assign(fit=[x.tobytes() for x in fits])

            newer = state.mapInPandas(update, schema)
            newer = cut_lineage(newer) if t % CUT_EVERY == CUT_EVERY - 1 else newer.persist(StorageLevel.MEMORY_AND_DISK)
            newer.count()
            state.unpersist()
            state = newer
        trees.append(_plain(_packed(tree)))
    state.unpersist()
    return trees


def _tree_by_jobs(state: DataFrame, s: TreeSettings, t: int, p: int, size: int, values: list[np.ndarray]) -> Tree:
    columns = tree_columns(s, t, p)

    def rows_of(f):
        for b, n, bins, y, fit in zip(f["block"], f["n"], f["bins"], f["y"], f["fit"]):
            w = row_weights(s, t, int(b), int(n))
            yield np.frombuffer(bins, dtype=np.uint8).reshape(-1, p), (np.frombuffer(y) - np.frombuffer(fit)) * w, w

    def totals(batches):
        for f in batches:
            yield pd.DataFrame([(float(g.sum()), float(w.sum())) for _, g, w in rows_of(f)], columns=["g", "w"])

    whole = state.mapInPandas(totals, "g double, w double").agg(F.sum("g"), F.sum("w")).first()
    up = Grower(s, float(whole[0] or 0.0), float(whole[1] or 0.0))
    for level in range(s.depth):  # the functions of a level are sent to the tasks before the next one begins
        if not up.open:
            break
        place = np.full(len(up.tree.feature), -1)
        place[up.open] = np.arange(len(up.open))
        nodes, tree = len(up.open), up.tree

        def partial(batches):
            total = np.zeros((2, nodes, len(columns), size))
            for f in batches:
                for x, g, w in rows_of(f):
                    x = x >> s.coarse
                    node = place[tree.walk(x, level)]
                    use = np.flatnonzero((node >= 0) & (w > 0))
                    total += histogram(x.T[np.ix_(columns, use)], node[use], g[use], w[use], nodes, size)
            for j, c in enumerate(columns):
                yield pd.DataFrame({"feature": [int(c)], "sums": [np.ascontiguousarray(total[:, :, j]).tobytes()]})

        def best(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x).reshape(2, nodes, 1, size) for x in f["sums"]], axis=0)
            one = np.array([key[0]])
            score, _, cut, left = level_splits(total, s, _draws(s, t, level, 1), one, values)
            return pd.DataFrame({"feature": key[0], "node": np.arange(nodes), "score": score, "cut": cut, "gl": left[0], "hl": left[1]})

        parts = state.mapInPandas(partial, "feature int, sums binary")
        top = parts.groupBy("feature").applyInPandas(best, BEST_SCHEMA).toPandas()
        pick = top.sort_values(["node", "score", "feature"], ascending=[True, False, True]).groupby("node").first()
        up.settle(pick["score"].to_numpy(), pick["feature"].to_numpy(), pick["cut"].to_numpy(), pick[["gl", "hl"]].to_numpy().T)
    return up.done()
