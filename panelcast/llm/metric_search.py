"""Exact nearest rows by inner product with a paged M-tree.

Inner products become distances: with ``m`` the largest norm, a vector ``x`` gets the further component
``sqrt(m^2 - |x|^2)`` and a query the component 0, so the distance falls as the inner product rises.

The tree has three levels. The root holds routing objects with covering radii; below each lie page objects
with their distance to the routing object and a covering radius of their own; a page holds the entries
nearest to its object with their distance to it. A query goes through the tree in rounds, nearest page
first: one page below its nearest route, then the few nearest pages of all, then every page that can still
hold a result. Each round but the last lowers the distance that its results must not exceed. Distances to
page objects and entries are computed only where the stored ones leave it open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import stored, tally

PAGE = 1024
"""Entries of a page, about."""
ROUTES = 256
"""Most routing objects of the root."""
BLOCK = 64
"""Queries that visit pages together."""
MEET = 64
"""Blocks of queries, about, that one task holds beside a page or a part of the directory."""
FIRST = 8
"""Pages a query visits in the second round."""
NODE = 256
"""Page objects in one part of the directory, about."""
SLACK = 1e-6
"""Relative room for rounding in every bound; scores themselves are exact integers."""
EXACT = float(1 << 52)
"""Products of norms up to which float64 adds whole numbers without rounding."""
LONGEST = float(1 << 63)
"""Scores beyond a long count as the nearest long."""


def quantized(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``id`` and ``v``: each component as floor(scale * x). Rows with a null id, a null or empty vector, or
    a component that is null, not finite or beyond 63 bits after scaling take no part. Repeated rows count
    once. Shorter vectors are filled with zeros up to the longest one."""
    x = F.col("v")
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = picked.where(F.col("id").isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda e: F.coalesce(F.abs(e * scale) < float(1 << 63), F.lit(False)) & ~F.isnan(e)))
    ints = stored(whole.select("id", F.transform(x, lambda e: F.floor(e * scale)).alias("v")))
    shape = ints.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if shape["lo"] != shape["hi"]:
        fill = F.array_repeat(F.lit(0).cast("long"), F.lit(shape["hi"]) - F.size("v"))
        ints = stored(ints.select("id", F.concat("v", fill).alias("v")))
    return ints


def _matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.array(column.tolist(), dtype=dtype)


class Routes:
    """The root: routing objects, covering radii and the number of directory parts below each."""

    def __init__(self, vectors: np.ndarray, top: float):
        self.objects, self.top = _lifted(vectors, top), top
        self.radii = np.zeros(len(vectors))
        self.parts = np.zeros(len(vectors), dtype=np.int64)


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - (vectors * vectors).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _asked(vectors: np.ndarray) -> np.ndarray:
    return np.column_stack([vectors, np.zeros(len(vectors))])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _room(away: np.ndarray, top: float) -> np.ndarray:
    """Room for rounding of distances. Near 0 their error grows with the norms, not with themselves."""
    return SLACK * (1 + away + np.sqrt(top))


def _scored(whole: np.ndarray, vectors: np.ndarray, query: np.ndarray, owner: np.ndarray, top: float, k: int):
    """Positions in ``owner`` that can be among the ``k`` best, with their exact scores."""
    about = np.clip(vectors @ query.astype(np.float64), -LONGEST, LONGEST)
    size = np.sqrt((query.astype(np.float64) ** 2).sum() * top)
    if size < EXACT:
        return np.arange(len(owner)), about.astype(np.int64)[owner]
    at = np.arange(len(owner))
    if len(at) > k:
        wrong = (len(query) + 4) * 2.0 ** -52 * size
        each = about[owner]
        at = np.flatnonzero(each >= np.partition(each, len(each) - k)[len(each) - k] - 2 * wrong)
    used, place = np.unique(owner[at], return_inverse=True)
    exact = (whole[used].astype(object) @ query.astype(object)).tolist()
    return at, np.array([min(max(e, -1 << 63), (1 << 63) - 1) for e in exact], dtype=np.int64)[place]


def _visit(queries: np.ndarray, away: np.ndarray, reach: np.ndarray, page: pd.DataFrame, k: int, top: float):
    """Results of each query in one page: arrays of score and id. ``away`` is the query's distance to the
    routing object, ``reach`` the distance its results must not exceed, ``top`` the largest squared norm."""
    page = page.sort_values("near", kind="stable")
    near, whole = page["near"].to_numpy(), _matrix(page["v"], np.int64)
    vectors = whole.astype(np.float64)
    counts = page["ids"].map(len).to_numpy()
    ids = np.concatenate([np.asarray(i, dtype=np.int64) for i in page["ids"]])
    owner = np.repeat(np.arange(len(page)), counts)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    room = _room(away, top)
    lo = np.searchsorted(near, away - reach - room, side="left")
    hi = np.searchsorted(near, away + reach + room, side="right")
    for query, a, b in zip(queries, lo, hi):
        if a >= b:
            yield np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            continue
        part = slice(firsts[a], firsts[b])
        at, score = _scored(whole[a:b], vectors[a:b], query, owner[part] - a, top, k)
        pick = _best(score, ids[part][at], k)
        yield score[pick], ids[part][at][pick]


def _meet(left: DataFrame, right: DataFrame, keys: list[str], of: list[str], run, schema: str) -> DataFrame:
    """``run`` over the rows of ``left`` and ``right`` of equal keys, about ``MEET`` rows of ``left`` in a
    group: a key with more of them has copies of its right rows. ``of`` tells the rows of ``left`` apart."""
    left = stored(left)
    many = F.ceil(F.col("_n") / MEET).cast("int")
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, many.alias("_many"))
    copies = right.join(sizes, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)))
    dealt = left.join(sizes, keys).withColumn("_salt", F.pmod(F.xxhash64(*of), F.col("_many")).cast("int"))
    return dealt.drop("_many").groupBy(*keys, "_salt").cogroup(
        copies.drop("_many").groupBy(*keys, "_salt")).applyInPandas(run, schema)


class Tree:
    """Root in the driver (at most ``ROUTES`` objects), directory of page objects and pages as tables."""

    def __init__(self, entries: DataFrame, n: int, top: float):
        """``entries`` has distinct vectors ``v`` with their ``ids``. Page objects are drawn by a hash, about
        one for ``PAGE`` entries. A page with more than two times as many (many entries near to one object)
        is divided by a hash; the parts keep the object and have radii of their own."""
        drawn = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(min(ROUTES, tally(n, PAGE)))
        routes = self.routes = Routes(np.array([r["v"] for r in drawn.collect()], dtype=np.float64), top)

        def to_route(frames):
            for f in frames:
                if len(f):
                    away = _distances(_lifted(_matrix(f["v"]), top), routes.objects)
                    f["route"], f["parent"] = away.argmin(axis=1).astype(np.int32), away.min(axis=1)
                    yield f

        routed = stored(entries.mapInPandas(to_route, "v array<long>, ids array<long>, route int, parent double"))
        # The nearest entry to the routing object and about one of PAGE entries are page objects.
        first = routed.groupBy("route").agg(F.min(F.struct("parent", "v")).alias("o")).select(
            "route", F.col("o.v").alias("v"), F.col("o.parent").alias("parent"))
        share = F.pmod(F.xxhash64(F.lit(6), "v"), F.lit(1 << 40)) < (1 << 40) // PAGE
        objects = first.union(routed.where(share).select("route", "v", "parent")).distinct().withColumn(
            "ord", F.row_number().over(Window.partitionBy("route").orderBy("v")) - 1)
        objects = stored(objects)
        packed = objects.groupBy("route", F.floor(F.col("ord") / (16 * NODE)).alias("slab")).agg(
            F.sort_array(F.collect_list(F.struct("ord", "v", "parent"))).alias("objects"))

        def to_page(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty:
                return pd.DataFrame(columns=["v", "ids", "route", "ord", "near"])
            x, parent = _lifted(_matrix(left["v"]), top), left["parent"].to_numpy()
            near, page = np.full(len(left), np.inf), np.zeros(len(left), dtype=np.int64)
            for slab in right["objects"]:
                o = _lifted(np.array([list(r["v"]) for r in slab], dtype=np.float64), top)
                above = np.array([r["parent"] for r in slab])
                for at in range(0, len(x), 1024):
                    part = slice(at, at + 1024)
                    # Objects whose distance to the route differs too much cannot be nearer.
                    open_ = (np.abs(parent[part][:, None] - above) <= near[part][:, None]).any(axis=0)
                    if open_.any():
                        away = _distances(x[part], o[open_])
                        best, ords = away.min(axis=1), np.array([r["ord"] for r in slab])[open_]
                        better = best < near[part]
                        near[part] = np.where(better, best, near[part])
                        page[part] = np.where(better, ords[away.argmin(axis=1)], page[part])
            return pd.DataFrame({"v": left["v"], "ids": left["ids"], "route": left["route"],
                                 "ord": page.astype(np.int32), "near": near})

        spread = F.pmod(F.xxhash64(F.lit(7), "v"), F.lit(tally(n, 16 * PAGE))).cast("int")
        groups = routed.select("route").distinct().withColumn(
            "s", F.explode(F.sequence(F.lit(0), F.lit(tally(n, 16 * PAGE) - 1))))
        paged = stored(routed.withColumn("s", spread).groupBy("route", "s").cogroup(
            packed.join(groups, "route").groupBy("route", "s")).applyInPandas(
            to_page, "v array<long>, ids array<long>, route int, ord int, near double"))
        parts = paged.groupBy("route", "ord").agg(F.ceil(F.count(F.lit(1)) / (2 * PAGE)).cast("int").alias("many"))
        self.pages = stored(paged.join(parts, ["route", "ord"]).withColumn(
            "sub", F.pmod(F.xxhash64(F.lit(8), "v"), F.col("many")).cast("int")).drop("many"))
        radii = self.pages.groupBy("route", "ord", "sub").agg(F.max("near").alias("radius"))
        listed = stored(radii.join(objects, ["route", "ord"]).withColumn(
            "part", F.floor(F.col("ord") / NODE).cast("long") * (1 << 31) + F.floor(F.col("sub") / 16)))
        part = listed.select("route", "part").distinct().withColumn(
            "node", (F.row_number().over(Window.partitionBy("route").orderBy("part")) - 1).cast("int"))
        self.directory = stored(listed.join(part, ["route", "part"]).select(
            "route", "node", "ord", "sub", "v", "parent", "radius"))
        for r in routed.groupBy("route").agg(F.max("parent").alias("far")).collect():
            routes.radii[r["route"]] = r["far"]
        for r in self.directory.groupBy("route").agg(F.max("node").alias("last")).collect():
            routes.parts[r["route"]] = r["last"] + 1


ASKED = "home int, block int, n int, q binary, reach binary"


def _blocks(queries: DataFrame, routes: Routes) -> DataFrame:
    """Query vectors ``v`` in blocks of about ``BLOCK`` with the same nearest route."""
    def home(frames):
        for f in frames:
            if len(f):
                away = _distances(_asked(_matrix(f["v"])), routes.objects)
                away[:, routes.parts == 0] = np.inf
                f["home"] = away.argmin(axis=1).astype(np.int32)
                yield f[["v", "home"]]

    at_home = stored(queries.mapInPandas(home, "v array<long>, home int"))
    counts = {r["home"]: tally(r["n"], BLOCK) for r in at_home.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = F.element_at(F.array(*[F.lit(counts.get(i, 1)) for i in range(len(routes.parts))]), F.col("home") + 1)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        q = _matrix(f["v"], np.int64)
        return pd.DataFrame([(f["home"].iloc[0], f["block"].iloc[0], len(q), q.tobytes(), np.full(len(q), np.inf).tobytes())],
                            columns=["home", "block", "n", "q", "reach"])

    return stored(at_home.withColumn("block", F.pmod(F.xxhash64(F.lit(4), "v"), many).cast("int")).groupBy(
        "home", "block").applyInPandas(pack, ASKED))


def _open_parts(blocks: DataFrame, routes: Routes, at_home: bool) -> DataFrame:
    """One row per block and directory part below a route in reach, with the positions of its queries."""
    def run(frames):
        for f in frames:
            for r in f.itertuples():
                q, reach = np.frombuffer(r.q, dtype=np.int64).reshape(r.n, -1), np.frombuffer(r.reach)
                away = _distances(_asked(q.astype(np.float64)), routes.objects)
                near = away - routes.radii - _room(away, routes.top) <= reach[:, None]
                rows = []
                for route in [r.home] if at_home else np.flatnonzero(near.any(axis=0)):
                    at = np.flatnonzero(near[:, route]).astype(np.int32)
                    rows += [(r.home, r.block, route, node, at.tobytes(), q[at].tobytes(), away[at, route].tobytes(),
                              reach[at].tobytes()) for node in range(routes.parts[route])]
                yield pd.DataFrame(rows, columns=["home", "block", "route", "node", "at", "q", "away", "reach"])

    return blocks.mapInPandas(
        run, "home int, block int, route int, node int, at binary, q binary, away binary, reach binary")


def _page_bounds(r, node: tuple, top: float):
    """Distances to the page objects, least distances to their entries, and whether the page is in reach.
    Objects that the distances to the route exclude are not compared."""
    objects, parent, radius = node
    q = np.frombuffer(r.q, dtype=np.int64).reshape(len(r.at) // 4, -1).astype(np.float64)
    up, reach = np.frombuffer(r.away)[:, None], np.frombuffer(r.reach)[:, None]
    room = _room(up, top)
    open_ = np.abs(up - parent) - radius - 2 * room <= reach
    columns = np.flatnonzero(open_.any(axis=0))
    away = np.full(open_.shape, np.inf)
    away[:, columns] = _distances(_asked(q), objects[columns])
    least = np.maximum(away - radius, 0)
    return away, least, open_ & (least - room <= reach)


def _node(f: pd.DataFrame, top: float) -> tuple:
    return _lifted(_matrix(f["v"]), top), f["parent"].to_numpy(), f["radius"].to_numpy()


VISIT = "home int, block int, route int, ord int, sub int, at binary, q binary, away binary, reach binary"


def _visits(tree: Tree, blocks: DataFrame, most: int | None, at_home: bool) -> DataFrame:
    """One row per block and page to visit: the ``most`` nearest pages of each query, or all in reach."""
    top, keys = tree.routes.top, ["route", "node"]
    asked = _open_parts(blocks, tree.routes, at_home)
    columns = ["home", "block", "route", "ord", "sub", "at", "q", "away", "reach"]

    def every(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, node = [], _node(right, top) if len(left) and len(right) else None
        for r in left.itertuples() if node else ():
            away, _, open_ = _page_bounds(r, node, top)
            at, reach = np.frombuffer(r.at, dtype=np.int32), np.frombuffer(r.reach)
            q = np.frombuffer(r.q, dtype=np.int64).reshape(len(at), -1)
            for c in np.flatnonzero(open_.any(axis=0)):
                m = open_[:, c]
                rows.append((r.home, r.block, r.route, right["ord"].iloc[c], right["sub"].iloc[c], at[m].tobytes(),
                             q[m].tobytes(), away[m, c].tobytes(), reach[m].tobytes()))
        return pd.DataFrame(rows, columns=columns)

    if most is None:
        return _meet(asked, tree.directory, keys, ["home", "block"], every, VISIT)

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        node = _node(right, top) if len(left) and len(right) else None
        for r in left.itertuples() if node else ():
            away, least, open_ = _page_bounds(r, node, top)
            least = np.where(open_, least, np.inf)
            pick = np.lexsort((away, least), axis=1)[:, :most]
            row, rank = np.nonzero(np.isfinite(np.take_along_axis(least, pick, axis=1)))
            c = pick[row, rank]
            out.append(pd.DataFrame({
                "home": r.home, "block": r.block, "at": np.frombuffer(r.at, dtype=np.int32)[row], "route": r.route,
                "ord": right["ord"].to_numpy()[c], "sub": right["sub"].to_numpy()[c], "least": least[row, c],
                "away": away[row, c]}))
        names = ["home", "block", "at", "route", "ord", "sub", "least", "away"]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    order = Window.partitionBy("home", "block", "at").orderBy("least", "away", "route", "ord", "sub")
    chosen = _meet(asked, tree.directory, keys, ["home", "block"], nearest,
                   "home int, block int, at int, route int, ord int, sub int, least double, away double").withColumn(
        "r", F.row_number().over(order)).where(F.col("r") <= most)

    def pack(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in right.itertuples() if len(left) else ():
            q, reach = np.frombuffer(r.q, dtype=np.int64).reshape(r.n, -1), np.frombuffer(r.reach)
            for (route, order_, sub), f in left.groupby(["route", "ord", "sub"]):
                at = f["at"].to_numpy(dtype=np.int32)
                rows.append((r.home, r.block, route, order_, sub, at.tobytes(), q[at].tobytes(),
                             f["away"].to_numpy(dtype=float).tobytes(), reach[at].tobytes()))
        return pd.DataFrame(rows, columns=columns)

    return chosen.groupBy("home", "block").cogroup(blocks.groupBy("home", "block")).applyInPandas(pack, VISIT)


FOUND = "home int, block int, part int, at binary, counts binary, score binary, ids binary"


def _compared(tree: Tree, visits: DataFrame, k: int) -> DataFrame:
    """Per block, the ``k`` best scores and ids of each query among the pages of ``visits``."""
    top = tree.routes.top

    def compare(left: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in left.itertuples() if len(page) else ():
            q = np.frombuffer(r.q, dtype=np.int64).reshape(len(r.at) // 4, -1)
            got = list(_visit(q, np.frombuffer(r.away), np.frombuffer(r.reach), page, k, top))
            rows.append((r.home, r.block, (r.route + r.ord + r.sub) % 64, r.at, *_lists(got)))
        return pd.DataFrame(rows, columns=["home", "block", "part", "at", "counts", "score", "ids"])

    def join_parts(f: pd.DataFrame) -> pd.DataFrame:
        best = _merged(f, k)
        at = np.array(list(best), dtype=np.int32).tobytes()
        return pd.DataFrame([(f["home"].iloc[0], f["block"].iloc[0], 0, at, *_lists(list(best.values())))],
                            columns=["home", "block", "part", "at", "counts", "score", "ids"])

    found = _meet(visits, tree.pages, ["route", "ord", "sub"], ["home", "block"], compare, FOUND)
    return found.groupBy("home", "block", "part").applyInPandas(join_parts, FOUND)


def _lists(best: list) -> tuple[bytes, bytes, bytes]:
    return (np.array([len(s) for s, _ in best], dtype=np.int32).tobytes(),
            np.concatenate([s for s, _ in best]).tobytes(), np.concatenate([i for _, i in best]).tobytes())


def _merged(f: pd.DataFrame, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ``k`` best scores and ids of each position over all rows of a block."""
    parts: dict[int, list] = {}
    for r in f.itertuples():
        score, ids, start = np.frombuffer(r.score, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64), 0
        for at, c in zip(np.frombuffer(r.at, dtype=np.int32).tolist(), np.frombuffer(r.counts, dtype=np.int32).tolist()):
            parts.setdefault(at, []).append((score[start:start + c], ids[start:start + c]))
            start += c
    best = {}
    for at, lists in parts.items():
        score, ids = (np.concatenate(x) for x in zip(*lists))
        pick = _best(score, ids, k)
        best[at] = score[pick], ids[pick]
    return best


def _tightened(tree: Tree, blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``blocks`` with the distance of each query's ``k``-th best so far, where there are as many."""
    top = tree.routes.top

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best, rows = _merged(right, k), []
        for r in left.itertuples():
            q, reach = np.frombuffer(r.q, dtype=np.int64).reshape(r.n, -1).astype(np.float64), np.frombuffer(r.reach).copy()
            for at, (score, _) in best.items():
                if len(score) == k:
                    square = q[at] @ q[at] + top - 2.0 * float(score[-1])
                    reach[at] = min(reach[at], np.sqrt(max(0.0, square)))
            rows.append((r.home, r.block, r.n, r.q, reach.tobytes()))
        return pd.DataFrame(rows, columns=["home", "block", "n", "q", "reach"])

    return stored(blocks.groupBy("home", "block").cogroup(found.groupBy("home", "block")).applyInPandas(run, ASKED))


def search(rows: DataFrame, queries: DataFrame | None = None, k: int = 20, every: int = 20, id_col: str = "vec_id",
           vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the ``k`` rows of highest inner product for
    each query, without the query's own id; ties go to the smaller id.

    Queries are the rows whose id is divisible by ``every``, or those of ``queries`` with the same columns.
    Equal vectors are one entry that keeps its ``k + 1`` smallest ids, which is all a result can need, so a
    vector that many rows share costs one comparison. See ``quantized`` for rows that take no part; an
    empty table has no results. Scores are exact; those beyond a long are the nearest long.
    """
    spark = rows.sparkSession
    data = quantized(rows, id_col, vector_col, scale)
    asked = data.where(F.col("id") % every == 0) if queries is None else quantized(queries, id_col, vector_col, scale)
    out = "query_id long, rank int, vec_id long, score long"
    salt = F.pmod(F.xxhash64("id"), F.lit(256))
    slim = data.distinct().withColumn("s", salt)
    first = slim.withColumn("r", F.row_number().over(Window.partitionBy("v", "s").orderBy("id"))).where(F.col("r") <= k + 1)
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = stored(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    norm = F.aggregate("v", F.lit(0.0), lambda t, e: t + e.cast("double") * e.cast("double"))
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).first()
    if not size["n"]:
        return spark.createDataFrame([], out)
    tree = Tree(entries, size["n"], size["top"])
    blocks = _blocks(asked.select("v").distinct(), tree.routes)
    for most, at_home in ((1, True), (FIRST, False)):
        blocks = _tightened(tree, blocks, _compared(tree, _visits(tree, blocks, most, at_home), k + 1), k + 1)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = _merged(right, k + 1)
        return pd.DataFrame([(q.tolist(), best[at][0].tolist(), best[at][1].tolist()) for r in left.itertuples()
                             for at, q in enumerate(np.frombuffer(r.q, dtype=np.int64).reshape(r.n, -1)) if at in best],
                            columns=["v", "scores", "found"])

    results = _compared(tree, _visits(tree, blocks, None, False), k + 1)
    per_vector = blocks.groupBy("home", "block").cogroup(results.groupBy("home", "block")).applyInPandas(
        finish, "v array<long>, scores array<long>, found array<long>")
    # The vectors' own rows: every query id of the class, without itself.
    pairs = F.filter(F.arrays_zip("found", "scores"), lambda p: p["found"] != F.col("id"))
    listed = asked.select("id", "v").distinct().join(per_vector, "v").select(
        "id", F.posexplode(F.slice(pairs, 1, k)).alias("pos", "hit"))
    return listed.select(F.col("id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"),
                         F.col("hit.found").alias("vec_id"), F.col("hit.scores").alias("score"))
