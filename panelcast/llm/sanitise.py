"""Personal data and the terms that give it away, on DataFrame functions only.

E-mail addresses, IP addresses, card and phone numbers are found by pattern. Each distinct value is a
protected entity ``e`` with information ``I(e) = log2(N / n(e))``, ``n`` counting the documents that hold
it among all ``N``. A term ``t`` beside an entity tells ``log2(N n(t, e) / (n(t) n(e)))`` about it
(pointwise mutual information), so ``share = mutual information / I(e)`` is 1 for a term found beside this
entity only and 0 for an unrelated one. Terms whose share exceeds a threshold are removed, terms above a
lower one are generalised, in the documents that hold the entity; documents without personal data stay
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import LOWER, UPPER, rows_of, stored

# Leftmost matches, written so that a search never goes back over a run of characters it has passed:
# a run that holds no match is left at its end (possessive), and no match starts inside a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
REACH = 64
"""Code points on each side of an entity in which its neighbours are looked for."""
NEAR = 5
"""Neighbouring terms on each side."""
PIECE = 256
"""Matches whose places are summed together, so that a text with many matches costs no square."""
SALTS = 32
"""Parts that the rows of one entity and term are dealt to."""
REMOVE, GENERALISE, LEAST = 0.95, 0.85, 3
# A word of three letters or more that hangs on no digit and on no part of an address.
TERM = r"(?<![\p{L}\p{M}0-9_@.%+'-])\p{L}[\p{L}\p{M}'-]{2,}+(?![0-9_@%+]|\.[\p{L}0-9])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """What a match must hold besides its pattern."""
    digits = F.regexp_replace(found, r"[^0-9]", "")
    if kind == "ip":
        return found.rlike(_IP)
    if kind == "card":
        fits = F.length(digits).between(16, 19)
        return F.when(fits, luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sum of the lengths before each element, in pieces of ``PIECE``."""
    def over(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, begin, step, lambda acc: acc["out"])

    part = lambda i: F.slice(lengths, i * PIECE + 1, PIECE)
    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PIECE).cast("int"))
    whole = F.transform(numbers, lambda i: F.aggregate(part(i), F.lit(0), lambda a, x: a + x))
    starts = over(whole, F.lit(0))
    return F.flatten(F.transform(numbers, lambda i: over(part(i), F.element_at(starts, i + 1))))


def matches(text: Column, kind: str) -> tuple[Column, Column]:
    """Matches of a kind and the stretches between them, one more."""
    pattern = PATTERNS[kind]
    maybe = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    none = F.array().cast("array<string>")
    return (F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            F.when(maybe, F.split(text, pattern, -1)).otherwise(F.array(text)))


def _found(kind: str) -> Column:
    """Valid matches with start, end, their value and the text beside them, from ``<kind>_m`` and ``<kind>_s``."""
    m, s = F.col(f"{kind}_m"), F.col(f"{kind}_s")
    before = F.transform(m, lambda x, i: F.length(F.element_at(s, i + 1)) + F.length(x))
    rows = F.transform(F.arrays_zip(m.alias("x"), _running(before).alias("at")), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), (z["at"] + F.length(F.element_at(s, i + 1))).alias("start"),
        (z["at"] + F.length(F.element_at(s, i + 1)) + F.length(z["x"])).alias("end"), z["x"].alias("value"),
        F.right(F.element_at(s, i + 1), F.lit(REACH)).alias("left"),
        F.left(F.element_at(s, i + 2), F.lit(REACH)).alias("right")))
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>")
    return F.when(F.size(m) == 0, nothing).otherwise(F.filter(rows, lambda r: valid(kind, r["value"])))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid`` (number of the row), ``doc_id`` and ``found``: all personal data by kind, then start, each with
    ``kind``, ``start``, ``end`` (code points), ``value`` and the text beside it, ``left`` and ``right``.

    Matches of a kind are leftmost and do not overlap; a match that is no valid number is dropped and its
    characters are not tried again. Null texts are empty.
    """
    rows = rows_of(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    split = rows.select("rid", "doc_id", *[c.alias(f"{kind}_{name}") for kind in KINDS
                                           for c, name in zip(matches(F.col("text"), kind), "ms")])
    return split.select("rid", "doc_id", F.concat(*[_found(kind) for kind in KINDS]).alias("found"))


def term_key(term: Column) -> Column:
    return F.translate(term, UPPER, LOWER)


def _neighbours(side: Column, left: bool, offset: Column) -> Column:
    """The ``NEAR`` terms nearest to the entity on one side, with their places in the document. A term cut by
    the reach is none."""
    terms, gaps = F.regexp_extract_all(side, F.lit(TERM), F.lit(0)), F.split(side, TERM, -1)
    placed = F.transform(terms, lambda t, i: F.struct(
        t.alias("term"), (offset + F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(
            F.slice(terms, 1, i), F.lit(0), lambda a, x: a + F.length(x))).alias("start")))
    cut = F.length(side) == REACH
    edge = offset if left else offset + F.length(side)
    kept = F.filter(placed, lambda p: ~cut | (p["start"] != edge if left else p["start"] + F.length(p["term"]) != edge))
    return F.slice(F.reverse(kept) if left else kept, 1, NEAR)


def contexts(found: DataFrame) -> DataFrame:
    """Terms beside entities: ``rid``, ``e`` (hash of the entity), ``t`` (hash of the term), ``start``, ``end`` and
    ``context`` (hash of what stands beside the entity)."""
    def beside(x: Column) -> Column:
        near = F.concat(_neighbours(x["left"], True, x["start"] - F.length(x["left"])), _neighbours(x["right"], False, x["end"]))
        return F.struct(F.xxhash64(x["kind"], x["value"]).alias("e"), F.xxhash64(x["left"], x["right"]).alias("context"), near.alias("near"))

    one = found.where(F.size("found") > 0).select("rid", F.explode(F.transform("found", beside)).alias("x"))
    each = one.select("rid", "x.e", "x.context", F.explode("x.near").alias("p"))
    return each.select("rid", "e", "context", F.xxhash64(term_key(F.col("p.term"))).alias("t"), F.col("p.start").alias("start"),
                       (F.col("p.start") + F.length("p.term")).alias("end"))


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``t`` (hash of the term) and ``n``, the number of documents that hold it."""
    terms = F.array_distinct(F.regexp_extract_all(term_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(TERM), F.lit(0)))
    return docs.select(F.explode(terms).alias("w")).groupBy(F.xxhash64("w").alias("t")).agg(F.count(F.lit(1)).alias("n"))


def disclosures(docs: DataFrame, found: DataFrame, near: DataFrame, generalise: float = GENERALISE,
                least: int = LEAST, text_col: str = "text") -> DataFrame:
    """Pairs of entity and term whose share of disclosed information is at least ``generalise``: ``e``, ``t``,
    ``share``. A pair needs ``least`` different contexts, so copies of one passage do not make a term telling."""
    total = found.count()
    holds = found.where(F.size("found") > 0).select(F.explode(F.array_distinct(
        F.transform("found", lambda x: F.xxhash64(x["kind"], x["value"])))).alias("e"))
    of_entity = holds.groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    # A document with several contexts of a pair counts once, and so does a context with several documents.
    both = near.select("e", "t", "rid").distinct().groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"))
    apart = near.select("e", "t", "context").distinct().groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_contexts"))
    pairs = both.join(apart.where(F.col("n_contexts") >= least), ["e", "t"])
    counted = pairs.join(of_entity, "e").join(document_counts(docs, text_col), "t")
    whole = F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))
    told = F.log2(F.lit(float(max(total, 1))) * F.col("n_et") / (F.col("n") * F.col("n_e")))
    share = F.when(whole > 0, told / whole).otherwise(F.lit(0.0))
    return counted.select("e", "t", share.alias("share")).where(F.col("share") >= generalise)


def terms_to_hide(near: DataFrame, telling: DataFrame, remove: float = REMOVE) -> DataFrame:
    """``rid`` and ``terms``: places of the terms to hide, ``removed`` or ``general``, in order of start."""
    salted = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = near.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["e", "t", "salt"])
    one = hit.groupBy("rid", "start", "end").agg(F.max("share").alias("share"))
    span = F.struct("start", "end", F.when(F.col("share") >= remove, "removed").otherwise("general").alias("kind"))
    return one.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("terms"))


def personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, least: int = LEAST,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``rid``, ``doc_id``, ``found`` (see ``entities``) and ``terms`` (see
    ``terms_to_hide``; empty where there are none).

    Null and empty texts hold nothing. Rows may repeat an id or a whole row; each is a document of its own.
    An empty table gives an empty result.
    """
    found = stored(entities(docs, id_col, text_col))
    near = stored(contexts(found))
    telling = stored(disclosures(docs, found, near, generalise, least, text_col))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    hidden = terms_to_hide(near, telling, remove)
    return found.join(hidden, "rid", "left").withColumn("terms", F.coalesce("terms", none))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the places of personal data, and all places including the hidden terms,
    which come after the other kinds (``general``, then ``removed``)."""
    def of_kind(spans: str, kind: str) -> Column:
        return F.filter(spans, lambda x: x["kind"] == kind)

    terms = F.concat(of_kind("terms", "general"), of_kind("terms", "removed"))
    base = span_list(F.col("found"))
    counts = [F.size(of_kind("found", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.concat_ws(",", *[F.nullif(c, F.lit("")) for c in (base, span_list(terms))])
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
                        F.size("terms").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, least: int = LEAST,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` without personal data: entities are replaced by their kind in brackets, telling
    terms are removed or replaced by what kind of word they are. Where spans overlap the first one counts."""
    found = personal_data(docs, generalise, remove, least, id_col, text_col)
    rows = rows_of(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    spans = F.sort_array(F.concat(
        F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))), "terms"))
    joined = rows.join(found.select("rid", spans.alias("_spans")), "rid")

    def put(acc: Column, x: Column) -> Column:
        word = F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])
        general = F.when(word.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        shown = F.when(x["kind"] == "removed", F.lit("")).when(x["kind"] == "general", general).otherwise(
            F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(
            x["end"].alias("at"), F.concat(acc["out"], F.array(F.concat(gap, shown))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return joined.select("doc_id", F.aggregate("_spans", start, put, tail).alias("text"))
