"""Language proportions of documents by expectation-maximisation.

A language is a distribution over hashed character trigrams. Each word of a document has a likelihood
under every language; expectation-maximisation over the words gives the document's proportions. The set
of languages grows one by one as long as the gain in log-likelihood exceeds a penalty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import held_out, rows_of

BITS = 16
FIT_ROWS = 3000
"""Rows per language the distributions are counted on, about: a bound of the training sample."""
ROUNDS = 8
PENALTY = 3.0
"""Log-likelihood a further language must gain, per natural logarithm of the number of words."""
CHUNK = 100
LETTER = re.compile(r"[^\W\d_]").search
_LETTER_BYTE = np.zeros(256, dtype=bool)
_LETTER_BYTE[ord("a"):ord("z") + 1] = True
_LETTER_BYTE[128:] = True


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every trigram inside a word or at its edge, the first trigram of each word, and the
    text number of each word."""
    raw = [(" " + t.lower() + "  ").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    inside = _LETTER_BYTE[data]
    data = np.where(inside, data, np.uint8(32)).astype(np.uint32)
    middle = np.flatnonzero(inside)
    grams = data[middle - 1] << np.uint32(16) | data[middle] << np.uint32(8) | data[middle + 1]
    grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    starts = np.flatnonzero(~inside[middle - 1])
    doc = np.searchsorted(np.cumsum(sizes), middle[starts], side="right")
    return grams, starts, doc


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray
    """Log-probability of each bucket (rows) under each language (columns)."""


def fit(docs: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Languages:
    """Distributions of the languages named in ``lang_col``, from about ``rows`` documents each that are
    not held out. Rows with null language or id teach nothing."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & ~held_out(F.col("doc_id")))
    numbers = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(numbers)
    if not names:
        return Languages([], np.zeros((1 << BITS, 0), dtype=np.float32))
    share = F.lit(0)
    for name in names:
        share = F.when(F.col("lang") == name, int(min(1.0, rows / numbers[name]) * (1 << 30))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < share)
    at_of = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), 1 << BITS), dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            which = np.array([at_of[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for at in range(0, len(texts), CHUNK):
                grams, starts, doc = word_grams(texts[at:at + CHUNK])
                per = np.repeat(which[at:at + CHUNK][doc], np.diff(np.append(starts, len(grams))))
                sums += np.bincount(per << BITS | grams, minlength=sums.size).reshape(sums.shape)
        yield pa.RecordBatch.from_pydict({"lang": names, "n": [s.tobytes() for s in sums]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(n, dtype=np.int64) for n in frame["n"]], axis=0)
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "n": [total.tobytes()]})

    sums = drawn.select("text", "lang").mapInArrow(count, "lang string, n binary").groupBy(
        "lang").applyInPandas(add, "lang string, n binary").collect()
    got = {r["lang"]: np.frombuffer(r["n"], dtype=np.int64) for r in sums}
    table = np.stack([got.get(name, np.zeros(1 << BITS, dtype=np.int64)) for name in names], axis=1) + 0.1
    return Languages(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def _mixtures(p: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts by languages) and log-likelihood per text from word likelihoods ``p``."""
    share = np.full((n, p.shape[1]), 1 / p.shape[1])
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    for _ in range(ROUNDS):
        joint = share[owner] * p
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.stack([np.bincount(owner, weights=joint[:, k], minlength=n) for k in range(p.shape[1])], axis=1)
        share /= words[:, None]
    return share, np.bincount(owner, weights=np.log((share[owner] * p).sum(axis=1)), minlength=n)


def proportions(texts: list[str], model: Languages) -> np.ndarray:
    """Share of each language in each text; a row of zeros for a text without words."""
    n, k = len(texts), len(model.names)
    out = np.zeros((n, k))
    grams, starts, doc = word_grams(texts)
    if not len(starts) or not k:
        return out
    log_p = np.add.reduceat(model.log_p[grams], starts, axis=0).astype(np.float64)
    top = log_p.max(axis=1)
    p = np.exp(np.maximum(log_p - top[:, None], -60))
    base = np.bincount(doc, weights=top, minlength=n)
    words = np.bincount(doc, minlength=n)
    single = np.stack([np.bincount(doc, weights=log_p[:, j], minlength=n) for j in range(k)], axis=1)
    members = np.zeros((n, k), dtype=bool)
    some = words > 0
    members[np.flatnonzero(some), single[some].argmax(axis=1)] = True
    best = single.max(axis=1)
    out[members] = 1.0
    price = PENALTY * np.log(words + 1.0)
    growing = some.copy()
    while growing.any():
        pick = growing[doc]
        owner, mine = doc[pick], p[pick]
        gain, choice, shares = best.copy(), np.full(n, -1), out.copy()
        for j in range(k):
            able = growing & ~members[:, j]
            if not able.any():
                continue
            allowed = members.copy()
            allowed[:, j] = True
            part = able[owner]
            share, fit_ = _mixtures(mine[part] * allowed[owner[part]] + 1e-300, owner[part], n)
            fit_ += base
            better = able & (fit_ > gain)
            gain[better], choice[better], shares[better] = fit_[better], j, share[better]
        growing &= (choice >= 0) & (gain - best > price)
        rows = np.flatnonzero(growing)
        members[rows, choice[rows]] = True
        best[rows], out[rows] = gain[rows], shares[rows]
        growing &= members.sum(axis=1) < k
    return out


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` (the language of the largest share), ``score`` (that share) and
    ``shares`` (every language of the chosen set with its share) of every row, from the whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when no language
    was learned. Equal shares go to the language first in order of name. Repeated rows are predicted alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.names
        for batch in batches:
            langs, scores, maps = [], [], []
            for at in range(0, batch.num_rows, CHUNK):
                texts = batch.column(1).slice(at, CHUNK).to_pylist()
                for text, row in zip(texts, proportions(texts, sent.value)):
                    told = bool(names) and row.any() and LETTER(text) is not None
                    at_most = int(row.argmax()) if told else 0
                    langs.append(names[at_most] if told else "und")
                    scores.append(min(1.0, float(row[at_most])) if told else 0.0)
                    maps.append([(names[i], float(row[i])) for i in np.flatnonzero(row)] if told else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(maps, kind)], ["doc_id", "lang_pred", "score", "shares"])

    return rows_of(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, shares map<string,double>")
