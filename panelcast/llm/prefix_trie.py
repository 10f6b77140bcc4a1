"""Prefix tree of conversations, its subtree sums taken from a distributed Euler tour.

Every node gets an arc that enters it and an arc that leaves it; the arcs form one list that walks round
the tree. The list is ranked by contraction: in each round arcs that drew 1 behind an arc that drew 0 are
folded into it, until what is left fits a bound, is ranked by one task, and the folded arcs get their
places back round by round. Sums over a subtree are the difference of the prefix sums at its two arcs, so
deep or wide trees cost the same as flat ones.

Neither a conversation nor the children of a node are ever gathered: rows are range-partitioned, counted
or linked within their range, and carried over the few borders between ranges.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import stored

ALONE = 1 << 14
"""Arcs of a contracted list that one task ranks."""
IDS = 512
"""Most conversation ids in one piece of a node's list of ends."""
SUMS = ("pos", "leaves", "saved")


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in ranges of ``order``, with the number of the range as ``pid``."""
    return stored(rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``c``, ``turn``, ``role``, a digest of role and text, and the words of the text."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"),
                                text("role").alias("role"), text("text").alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.where(F.col("c").isNotNull()).select(
        "c", "turn", "role", F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("m"))


def rebuilt(conversations: DataFrame, every: int = 20, lend: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations and the conversations themselves.

    Conversation ``c`` takes the first ``h = crc32(c) % lend`` turns of conversation ``c - c % every`` (all
    it has, if fewer) and goes on with its own turns after its first ``h``. Turns: ``c``, ``pid``, ``d``
    (from 1), ``digest``, ``words``, ``ends`` (last turn). Conversations: ``c`` and their length ``size``.
    """
    rows = _ranged(turn_rows(conversations), "c", "turn", "role", "digest", "m")
    counts = rows.groupBy("pid", "c").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("c").agg(F.sum("n").alias("n"))
    base = F.col("c") - F.col("c") % every
    own = sizes.withColumns({"h": F.crc32(F.col("c").cast("string").cast("binary")) % lend, "base": base})
    lender = sizes.select(F.col("c").alias("base"), F.col("n").alias("b"))
    convs = stored(own.join(lender, "base", "left").withColumn(
        "lent", F.least("h", F.coalesce("b", F.lit(0)))).select(
        "c", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    before = Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pid", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(
        convs.drop("base"), "c")
    local = Window.partitionBy("pid", "c").orderBy("turn", "role", "digest", "m")
    placed = stored(rows.withColumn("k", F.row_number().over(local)).join(starts, ["pid", "c"]).select(
        "pid", "c", (F.col("k") + F.col("start")).alias("k"), "h", "lent", "size", "digest", "words"))
    kept = placed.where(F.col("k") > F.col("h")).select(
        "c", "pid", (F.col("k") - F.col("h") + F.col("lent")).alias("d"), "digest", "words", "size")
    first = placed.where((F.col("c") % every == 0) & (F.col("k") < lend)).select(
        F.col("c").alias("base"), "k", "digest", "words")
    given = first.join(convs, "base").where(F.col("k") <= F.col("lent")).select(
        "c", F.lit(-1).alias("pid"), F.col("k").alias("d"), "digest", "words", "size")
    turns = kept.unionByName(given).withColumn("ends", F.col("d") == F.col("size")).drop("size")
    return turns, convs.select("c", "size")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation: ``c``, ``d``, its fingerprint ``f1``, ``f2`` (128 bits), that of
    the prefix before it ``p1``, ``p2``, ``words`` of its last text and ``ends``.

    The fingerprint is the exclusive or of hashes of place and turn, so it is a running sum that can be
    taken range by range.
    """
    coded = turns.withColumns({"z1": F.xxhash64("d", "digest"), "z2": F.xxhash64(F.lit(1), "d", "digest")})
    rows = stored(coded.drop("digest"))
    sums = rows.groupBy("c", "pid").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    before = Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("c", "pid", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("s1", "s2")])
    local = Window.partitionBy("c", "pid").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({"r1": F.bit_xor("z1").over(local), "r2": F.bit_xor("z2").over(local)}).join(
        starts, ["c", "pid"])
    f1, f2 = F.col("r1").bitwiseXOR(F.col("s1")), F.col("r2").bitwiseXOR(F.col("s2"))
    out = running.select("c", F.col("d").cast("long").alias("d"), f1.alias("f1"), f2.alias("f2"),
                         f1.bitwiseXOR(F.col("z1")).alias("p1"), f2.bitwiseXOR(F.col("z2")).alias("p2"), "words", "ends")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("c", zero.alias("d"), zero.alias("f1"), zero.alias("f2"), none.alias("p1"), none.alias("p2"),
                         zero.alias("words"), (F.col("size") == 0).alias("ends"))
    return out.unionByName(roots)


def ends_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, ascending and joined by commas.

    The ids come in sorted pieces; a task streams the pieces of its nodes through the hash, so a node at
    which a third of all conversations end needs no more memory than any other.
    """
    key = ["d", "f1", "f2"]
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = rows.where("ends").groupBy(*key, F.floor(F.col("c") / IDS).alias("block")).agg(piece.alias("ids"))

    def stream(frames):
        at, state = None, None
        for f in frames:
            done = []
            for d, f1, f2, ids in zip(f["d"], f["f1"], f["f2"], f["ids"]):
                if (d, f1, f2) != at:
                    if state is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (d, f1, f2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["d", "f1", "f2", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["d", "f1", "f2", "ends_sha256"])

    return pieces.repartition(*key).sortWithinPartitions(*key, "block").drop("block").mapInPandas(
        stream, "d long, f1 long, f2 long, ends_sha256 string")


def tour_arcs(nodes: DataFrame) -> DataFrame:
    """The Euler tour as a linked list: arc (``c``, ``a``) and its successor (``nc``, ``na``).

    A node is named by its smallest member ``c`` and its depth; arc ``2 d`` enters it, ``2 d + 1`` leaves
    it. Children follow each other by ``c``. ``leaves`` and ``saved`` are what the arc adds to the sums;
    leaving arcs know ``parent``. Each node stands in the order once under its own key and once under its
    parent's, so the first child, the next sibling and the parent are all neighbours there.
    """
    own = nodes.select(F.col("d").alias("kd"), F.col("f1").alias("k1"), F.col("f2").alias("k2"), F.lit(0).alias("kind"), "c", "d",
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    under = nodes.where(F.col("d") > 0).select(
        (F.col("d") - 1).alias("kd"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("kind"), "c", "d",
        F.lit(0).cast("long").alias("saved"))
    order = ["kd", "k1", "k2", "kind", "c"]
    rows = _ranged(own.unionByName(under), *order)
    head = F.when(F.col("kind") == 0, F.struct("kd", "k1", "k2", "c"))
    borders = rows.groupBy("pid").agg(F.min(F.struct(*order)).alias("first"), F.max(head).alias("head"))
    across = Window.orderBy("pid")
    carried = borders.select(
        "pid", F.lead("first").over(across).alias("next_first"),
        F.last("head", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("last_head"))
    inside = Window.partitionBy("pid").orderBy(*order)
    linked = rows.join(F.broadcast(carried), "pid").select(  # one row per range
        "kd", "k1", "k2", "kind", "c", "d", "saved",
        F.coalesce(F.lead(F.struct(*order)).over(inside), "next_first").alias("next"),
        F.coalesce(F.last(head, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "last_head").alias("head"))
    child = F.coalesce(F.struct("next.kd", "next.k1", "next.k2") == F.struct("kd", "k1", "k2"), F.lit(False)) & (
        F.col("next.kind") == 1)
    enter, leave = F.col("d") * 2, F.col("d") * 2 + 1
    one, zero, none = (F.lit(x).cast("long") for x in (1, 0, None))

    def arc(a, nc, na, leaves, saved, parent):
        return F.struct(F.col("c").alias("c"), a.alias("a"), nc.alias("nc"), na.alias("na"), one.alias("pos"),
                        leaves.alias("leaves"), saved.alias("saved"), parent.alias("parent"))

    entering = arc(enter, F.when(child, F.col("next.c")).otherwise(F.col("c")), F.when(child, enter + 2).otherwise(leave),
                   F.when(child, zero).otherwise(one), F.col("saved"), none)
    leaving = arc(leave, F.when(child, F.col("next.c")).otherwise(F.col("head.c")), F.when(child, enter).otherwise(leave - 2),
                  zero, zero, F.col("head.c"))
    last = arc(leave, none, none, zero, zero, none)
    arcs = F.when(F.col("kind") == 1, F.array(leaving)).when(F.col("d") == 0, F.array(entering, last)).otherwise(F.array(entering))
    return stored(linked.select(F.inline(arcs)))


def _rank_small(frames):
    """Sums before each arc of a list of at most ``ALONE`` arcs, by pointer jumping."""
    rows = [f for f in frames if len(f)]
    if not rows:
        return
    f = pd.concat(rows, ignore_index=True)
    place = pd.Series(np.arange(len(f)), index=pd.MultiIndex.from_arrays([f["c"], f["a"]]))
    follows = f["na"].notna().to_numpy()
    after = place.loc[pd.MultiIndex.from_arrays([f["nc"][follows].astype("int64"), f["na"][follows].astype("int64")])].to_numpy()
    back = np.full(len(f), -1)
    back[after] = np.flatnonzero(follows)
    total = {s: np.where(back >= 0, f[s].to_numpy()[back], 0) for s in SUMS}
    while (back >= 0).any():
        more = back >= 0
        total = {s: t + np.where(more, t[back], 0) for s, t in total.items()}
        back = np.where(more, back[back], -1)
    yield pd.DataFrame({"c": f["c"], "a": f["a"], **total})


def rank_list(arcs: DataFrame, alone: int = ALONE) -> DataFrame:
    """``c``, ``a`` and the sums of ``pos``, ``leaves`` and ``saved`` over the arcs before each arc."""
    ids, names = ["c", "a"], ["c", "a", "nc", "na", *SUMS]
    live, rounds = arcs.select(*names), []
    while live.count() > alone:
        draw = lambda c, a: F.xxhash64(c, a, F.lit(len(rounds))).bitwiseAND(F.lit(1)) == 1
        mine, ahead = draw("c", "a"), F.coalesce(draw("nc", "na") & F.col("na").isNotNull(), F.lit(False))
        owners = live.where(~mine & ahead).select(*[F.col(x).alias(f"o_{x}") for x in names])
        met = live.where(mine).join(owners, (F.col("c") == F.col("o_nc")) & (F.col("a") == F.col("o_na")), "left")
        folded = F.struct(F.lit(True).alias("live"), F.col("o_c").alias("c"), F.col("o_a").alias("a"), F.col("nc").alias("nc"),
                          F.col("na").alias("na"), *[(F.col(s) + F.col(f"o_{s}")).alias(s) for s in SUMS])
        gone = F.struct(F.lit(False).alias("live"), F.col("c").alias("c"), F.col("a").alias("a"), F.col("o_c").alias("nc"),
                        F.col("o_a").alias("na"), *[F.col(f"o_{s}").alias(s) for s in SUMS])
        stays = F.struct(F.lit(True).alias("live"), *[F.col(x).alias(x) for x in names])
        either = met.select(F.inline(F.when(F.col("o_c").isNull(), F.array(stays)).otherwise(F.array(folded, gone))))
        rest = live.where(~mine & ~ahead).select(F.lit(True).alias("live"), *names)
        step = stored(either.unionByName(rest))
        rounds.append(step.where(~F.col("live")).select(*names))
        live = step.where("live").select(*names)
    ranks = stored(live.coalesce(1).mapInPandas(_rank_small, "c long, a long, pos long, leaves long, saved long"))
    for gone in reversed(rounds):
        owner = ranks.select(*[F.col(x).alias(f"r_{x}") for x in (*ids, *SUMS)])
        found = gone.join(owner, (F.col("nc") == F.col("r_c")) & (F.col("na") == F.col("r_a")))
        ranks = ranks.unionByName(stored(found.select(*ids, *[(F.col(s) + F.col(f"r_{s}")).alias(s) for s in SUMS])))
    return ranks


def trie(conversations: DataFrame, every: int = 20, lend: int = 4, alone: int = ALONE) -> DataFrame:
    """One row per node of the prefix tree of the rebuilt conversations (see ``rebuilt``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256``, and the places ``enter`` and ``leave``
    of the node's arcs in the tour.

    Null roles and texts are empty, a null turn comes first, rows of the same turn are ordered by role and
    the digest of the turn, repeated rows are turns of their own, and rows without a ``conv_id`` take no
    part. A table without conversations has no nodes, not even a root.
    """
    turns, convs = rebuilt(conversations, every, lend)
    rows = stored(prefixes(turns, convs))
    key = ["d", "f1", "f2"]
    nodes = stored(rows.groupBy(*key).agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    arcs = tour_arcs(nodes)
    ranks = rank_list(arcs, alone)
    places = ranks.groupBy("c", F.floor(F.col("a") / 2).alias("d")).agg(
        F.min("pos").alias("enter"), F.max("pos").alias("leave"), (F.max("leaves") - F.min("leaves")).alias("n_leaves"),
        (F.max("saved") - F.min("saved")).alias("saved_tokens"))
    parents = arcs.where(F.col("parent").isNotNull())
    above = parents.select("c", F.floor(F.col("a") / 2).alias("d"), F.col("parent").alias("parent_conv_id"))
    children = parents.groupBy(F.col("parent").alias("c"), (F.floor(F.col("a") / 2) - 1).alias("d")).agg(
        F.count(F.lit(1)).alias("n_children"))
    ended = nodes.join(ends_digests(rows), key, "left").select(
        "c", "d", "n_convs", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    out = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "enter", "leave")
    parts = places.unionByName(above, True).unionByName(children, True).unionByName(ended, True)
    whole = parts.groupBy("c", "d").agg(*[F.max(x).alias(x) for x in out])
    return whole.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), *out).fillna(0, ["n_children"])
