"""Sharding by sampled splitters, on DataFrame functions only.

Keys are drawn with a chance in proportion to their size, the quantiles of the draw cut the key
space into ranges of nearly equal bytes, ranges that turn out overfull are subdivided, and exact
running sums over the ranges place the shard boundaries. Groups of equal keys that are large for a shard
are placed first, each into the shard with most room, and the boundaries fill what room is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import rows_of, stored

DRAWN = 8192
"""Keys drawn on average for the splitters; a bound of the draw, whatever the number of rows."""
RANGES = 256
"""Ranges cut from the draw."""
LARGE = 4096
"""Groups of equal keys with more than this part of all bytes are placed one by one; there are fewer of them."""
OVER = 0.01
"""Part of a shard's share by which a whole group may overfill it."""
PART_ROWS = 1 << 20
"""Rows of a range that one task sorts, about."""


def splitters(sizes: DataFrame, ranges: int, drawn: int) -> list[int]:
    """``ranges - 1`` quantile boundaries of a size-weighted draw from ``key``.

    A row is drawn when its hash, read as a number from 0 to 1, is below its share of the bytes times
    ``drawn``. Repeating a lost task draws the same rows. The draw that reaches the driver has about
    ``drawn`` keys at any size of the table.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    chance = F.col("size") * F.lit(float(drawn) / total)
    dice = F.pmod(F.xxhash64(F.lit(17), "key", "doc_id", "m"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # A row of more than its share stands for several draws, so its key can carry several quantiles.
    times = F.floor(chance) + (dice < chance - F.floor(chance)).cast("int")
    keys = []
    for key, n in sizes.select("key", times.cast("int").alias("n")).where("n > 0").orderBy("key").collect():
        keys += [key] * n
    if not keys:
        return []
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of the range that holds ``key``: how many cuts lie at or below it. The comparisons form
    a balanced tree, so a row passes about log2 of them."""
    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    return part(0, len(cuts))


def room_for_groups(groups: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """Where groups of (key, bytes) go, and the room each shard has left.

    Largest first, a group goes whole into the shard with most room, unless it overfills that by more than
    ``OVER`` of a share. Such a group is cut into stretches that fill the shards with most room. A group's
    places are (bytes before the stretch, shard).
    """
    room = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    spare, places = int(OVER * total / shards), {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        most = max(range(shards), key=lambda s: (room[s], -s))
        if size <= room[most] + spare:
            places[key] = [(0, most)]
            room[most] -= size
            continue
        places[key], at = [], 0
        for s in sorted(range(shards), key=lambda s: (-room[s], s)):
            if at < size and room[s] > 0:
                places[key].append((at, s))
                taken = min(room[s], size - at)
                room[s], at = room[s] - taken, at + taken
    return places, room


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
           ranges: int = RANGES, drawn: int = DRAWN) -> DataFrame:
    """``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in the shard) of every row.

    The law is ``bytes``: shards have nearly equal sizes. Rows of equal text are a group and lie in one shard,
    at every size of the table, unless a group fits into no shard: then it is cut in order of ``doc_id``.
    Shard sizes differ by about ``OVER`` of a share, or by a document where documents are larger. Null text
    counts as empty (size 1); null and repeated ids are rows like any other. With fewer rows than shards some
    shards are empty.
    """
    rows = rows_of(docs, id_col, text_col)
    slim = stored(rows.select(
        "doc_id", F.xxhash64("text").alias("key"), (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("m")))
    cuts = splitters(slim, ranges, drawn)
    ranged = slim.withColumn("rng", range_of(F.col("key"), cuts))
    filled = ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    total, n_rows = sum(r["bytes"] for r in filled), sum(r["n"] for r in filled)
    # A range that holds more than twice its share is one hot key or a few: spread it over more parts
    # by the order of ids inside the key. The others are cut evenly when there are many rows.
    share = max(1, total // ranges)
    parts = _even_parts(cuts, -(-n_rows // (ranges * PART_ROWS)))
    for r in (r for r in filled if r["bytes"] > 2 * share):
        inner = _inner_cuts(ranged.where(F.col("rng") == r["rng"]), max(-(-r["bytes"] // share), -(-r["n"] // PART_ROWS)), r["bytes"])
        if inner:
            parts = F.when(F.col("rng") == r["rng"], _row_range(inner)).otherwise(parts)
    groups = slim.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > F.lit(total / LARGE)).collect()
    places, room = room_for_groups([(r["key"], r["bytes"]) for r in groups], total, shards)
    large = slim.sparkSession.createDataFrame(
        [(k, [a for a, _ in at], [s for _, s in at]) for k, at in places.items()], "key long, offsets array<long>, homes array<int>")
    placed = stored(ranged.withColumn("part", parts).repartitionByRange("rng", "part").join(F.broadcast(large), "key", "left"))
    # Exact bytes per part, in key order; a row per part, so the running sum is one small task.
    rest = F.when(F.col("homes").isNull(), F.col("size")).otherwise(F.lit(0).cast("long"))
    by_part = placed.groupBy("rng", "part").agg(F.sum("size").alias("bytes"), F.sum(rest).alias("rest"))
    ordered = Window.orderBy("rng", "part")
    starts = by_part.select("rng", "part", (F.sum("bytes").over(ordered) - F.col("bytes")).alias("before"),
                            (F.sum("rest").over(ordered) - F.col("rest")).alias("rest_before"))
    order = ("key", F.col("doc_id").asc_nulls_first(), "m")
    inside = Window.partitionBy("rng", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select("*", (F.sum("size").over(inside) - F.col("size")).alias("within"),
                            (F.sum(rest).over(inside) - rest).alias("rest_within"))
    running = running.withColumn("group_start", F.min("rest_within").over(Window.partitionBy("rng", "part", "key")))
    at = running.join(F.broadcast(starts), ["rng", "part"])
    # Small groups fill the room that large ones left, whole by where they begin.
    room = [max(0, r) for r in room]
    unplaced, free = total - sum(r["bytes"] for r in groups), max(1, sum(room))
    ends = [sum(room[:s + 1]) * unplaced // free for s in range(shards - 1)]
    small = range_of(F.col("rest_before") + F.col("group_start"), ends)
    begins = at.where(F.size("homes") > 1).groupBy("key").agg(F.min(F.col("before") + F.col("within")).alias("begin"))
    at = at.join(F.broadcast(begins), "key", "left")  # fewer than LARGE rows
    passed = F.filter("offsets", lambda o: o <= F.coalesce(F.col("before") + F.col("within") - F.col("begin"), F.lit(0)))
    sharded = at.withColumn("shard", F.when(F.col("homes").isNull(), small).otherwise(
        F.element_at("homes", F.size(passed))).cast("int"))
    # Slots: the rank in the part plus the rows of the shard in parts before it.
    counts = sharded.groupBy("shard", "rng", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "rng", "part", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("rng", "part")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("rng", "part", "shard").orderBy(*order))
    return sharded.withColumn("rank", rank).join(
        F.broadcast(offsets), ["shard", "rng", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))


def _even_parts(cuts: list[int], parts: int) -> Column:
    """Each range cut into ``parts`` equal stretches of key space; keys are hashes, so these hold about equal
    numbers of rows."""
    if parts <= 1:
        return F.lit(0)
    ends = [-(1 << 63), *cuts, (1 << 63) - 1]
    low = F.element_at(F.array(*[F.lit(float(a)) for a in ends[:-1]]), F.col("rng") + 1)
    width = F.element_at(F.array(*[F.lit(max(1.0, float(b) - float(a))) for a, b in zip(ends, ends[1:])]), F.col("rng") + 1)
    return F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("key").cast("double") - low) / width * parts))).cast("int")


def _inner_cuts(rows: DataFrame, parts: int, total: int) -> list[tuple[int, int, int]]:
    """Boundaries (key, id, row) that subdivide one overfull range, from a draw of its own."""
    drawn = 32 * parts
    chance = F.col("size") * F.lit(float(drawn) / max(1, total))
    dice = F.pmod(F.xxhash64(F.lit(18), "key", "doc_id", "m"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    got = rows.where(dice < chance).select("key", _known("doc_id").alias("doc_id"), "m").orderBy("key", "doc_id", "m").collect()
    return sorted({tuple(got[len(got) * i // parts]) for i in range(1, parts)}) if got else []


def _known(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))


def _row_range(cuts: list[tuple[int, int, int]]) -> Column:
    row = F.struct("key", _known("doc_id").alias("doc_id"), "m")
    bound = lambda cut: F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(("key", "doc_id", "m"), cut)])

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(row < bound(cuts[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    return part(0, len(cuts))
