"""Tree ensembles over bins against plain versions."""

from dataclasses import replace

import numpy as np
import pytest

from panelcast.models import binned as B

N, P = 400, 6
NAMES = [f"f{j}" for j in range(P)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, P)).round(1)
    x[:, 4] = 3.0  # constant
    y = 2 * (x[:, 0] > 0.3) - x[:, 1] ** 2 + 0.5 * x[:, 2] * (x[:, 3] > 0) + rng.normal(0, 0.1, N)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    rows = [(*map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*NAMES, "y"]) + ", block int").cache()


@pytest.fixture(scope="module")
def panel(frame):
    return B.bin_panel(frame, NAMES)


def test_cuts_hold_about_equal_numbers(frame, data):
    cuts = B.quantile_cuts(frame, NAMES, 10)
    assert len(cuts[4]) == 0  # nothing to cut in a constant feature
    for j in (0, 1, 2, 3, 5):
        counts = np.histogram(np.searchsorted(cuts[j], data[0][:, j]), np.arange(len(cuts[j]) + 2))[0]
        assert counts.max() <= 2 * N / 10 and len(cuts[j]) <= 9


def plain_tree(x, y, w, depth, leaf, l2):
    """Values at the rows of a tree grown by trying every cut."""
    out = np.full(len(x), (w * y).sum() / (w.sum() + l2))
    if depth == 0:
        return out
    score = lambda m: (w * y)[m].sum() ** 2 / (w[m].sum() + l2)
    best, here = None, score(np.ones(len(x), dtype=bool))
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if w[left].sum() >= leaf and w[~left].sum() >= leaf:
                gain = score(left) + score(~left) - here
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = gain, left
    if best is not None:
        left = best[1]
        for m in (left, ~left):
            out[m] = plain_tree(x[m], y[m], w[m], depth - 1, leaf, l2)
    return out


@pytest.mark.parametrize("wide", [0, 64])
def test_trees_equal_trying_every_cut(data, wide, monkeypatch):
    monkeypatch.setattr(B, "WIDE", wide)
    x, y = data
    bins = np.column_stack([np.unique(c, return_inverse=True)[1] for c in x.T]).astype(np.uint8)
    s = B.TreeSettings(1, 1.0, 3, 7, l2=0.5, boost=False, coarse=0)
    values = [np.unique(c) for c in x.T]
    tree, = B.grown(bins, [(0, N)], y, s, values)
    got = np.array(tree.value)[tree.walk(bins, 3)]
    assert got == pytest.approx(plain_tree(bins, y, np.ones(N), 3, 7, 0.5))


KINDS = {
    "level": B.TreeSettings(12, 0.3, 4, 5, rows=0.8, columns=0.7),
    "leaf": B.TreeSettings(12, 0.3, 5, 5, l2=0.1, growth="leaf", leaves=9),
    "symmetric": B.TreeSettings(12, 0.3, 4, 0, l2=3.0, growth="symmetric", sample="bayesian"),
    "forest": B.TreeSettings(12, depth=5, leaf=5, boost=False, sample="bootstrap"),
    "random": B.TreeSettings(12, depth=5, boost=False, cut="random"),
}


@pytest.mark.parametrize("kind", KINDS)
def test_jobs_over_partitions_grow_the_same_trees(frame, panel, data, kind):
    settings = replace(KINDS[kind], trees=3)
    split = replace(panel, parts=3, blocks=panel.blocks.repartition(3))
    (one, a), (many, b) = B.fit_ensembles(panel, [settings])[0], B.fit_ensembles(split, [settings])[0]
    np.testing.assert_allclose(one(data[0]), many(data[0]), rtol=1e-9)
    np.testing.assert_allclose(a, b, rtol=1e-6)


def test_large_panels_are_partitioned_by_their_bytes(frame):
    panel = B.bin_panel(frame, NAMES, part_bytes=1000)
    assert panel.parts == 3 and panel.blocks.rdd.getNumPartitions() == 3


def test_ensembles_fit_and_know_what_counts(panel, data):
    x, y = data
    for (predictor, importance), (name, s) in zip(B.fit_ensembles(panel, list(KINDS.values())), KINDS.items(), strict=True):
        assert np.mean((predictor(x) - y) ** 2) < 0.45 * y.var(), name
        assert importance.sum() == pytest.approx(1) and importance[4] == 0 and importance[[0, 1]].sum() > 0.5


def test_forests_wide_and_narrow_agree(panel, data, monkeypatch):
    bins = np.column_stack([np.searchsorted(c, data[0][:, j]) for j, c in enumerate(panel.cuts)]).astype(np.uint8)
    for kind in ("forest", "random"):
        found = []
        for wide in (0, 4, 10**6):
            monkeypatch.setattr(B, "WIDE", wide)
            trees = B.grown(bins, [(0, N)], data[1], replace(KINDS[kind], trees=4), panel.values)
            found.append(np.sum([np.array(t.value)[t.walk(bins, 5)] for t in trees], axis=0))
        np.testing.assert_allclose(found[0], found[2])
        np.testing.assert_allclose(found[1], found[2])


def test_ways_of_growing(panel, data):
    bins = np.column_stack([np.searchsorted(c, data[0][:, j]) for j, c in enumerate(panel.cuts)]).astype(np.uint8)
    grown = lambda s: next(B.grown(bins, [(0, N)], data[1], s, panel.values))
    tree = grown(KINDS["symmetric"])
    level = [0]
    while any(tree.feature[i] >= 0 for i in level):
        cuts = {(tree.feature[i], tree.cut[i]) for i in level if tree.feature[i] >= 0}
        assert len(cuts) == 1
        level = [c for i in level if tree.feature[i] >= 0 for c in (tree.left[i], tree.right[i])]
    free, few = grown(replace(KINDS["leaf"], leaves=0)), grown(KINDS["leaf"])
    kept = [i for i in range(len(few.feature)) if few.feature[i] >= 0]
    assert len(kept) == 8  # nine leaves
    reach = {c for i in kept for c in (free.left[i], free.right[i])} - set(kept)
    assert min(free.gain[i] for i in kept) >= max(free.gain[i] for i in reach if free.feature[i] >= 0) - 1e-9


def test_held_out_errors_equal_separate_fits(spark, frame, data):
    panel = B.bin_panel(frame, NAMES, mark="block")
    points = [B.TreeSettings(t, depth=d, leaf=leaf, boost=False, sample="bootstrap")
              for t in (10, 30) for d in (3, 6) for leaf in (1, 5)]
    points += [B.TreeSettings(t, 0.2, 3, 5, rows=0.8) for t in (5, 15)]
    got = B.held_out_errors(panel, points, 2)
    rows = panel.blocks.toPandas()
    bins, y, mark, blocks = B._matrix(rows, P)
    for s, error in zip(points, got, strict=True):
        miss = []
        for fold in range(2):
            keep, test = mark <= fold, mark == fold + 1
            trees = list(B.grown(bins, blocks, y, s, panel.values, keep=keep))
            total = np.sum([np.array(t.value)[t.walk(bins[test], s.depth)] for t in trees], axis=0)
            mean = total + y[keep].mean() if s.boost else total / s.trees
            miss.append(np.abs(y[test] - mean).mean())
        assert error == pytest.approx(np.mean(miss))


def test_a_panel_without_variation(spark):
    frame = spark.createDataFrame([(1.0, 2.0)] * 5, "f double, y double")
    for s in KINDS.values():
        (predictor, importance), = B.fit_ensembles(B.bin_panel(frame, ["f"]), [s])
        assert predictor(np.array([[1.0], [9.0]])) == pytest.approx([2.0, 2.0]) and importance.sum() == 0
