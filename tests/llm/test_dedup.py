"""Deduplication operators against plain versions over every pair, window and line."""

import re

import numpy as np
import pytest

from panelcast.llm import exchange, jaccard_join, line_dedup, substring_dedup, suffix_dedup
from panelcast.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_windows(pairs, window):
    """Kept words of each row whose id is not null, by looking every window up."""
    first, out = {}, {}
    rows = sorted((p for p in pairs if p[0] is not None), key=lambda p: p[0])
    for i, text in rows:
        w = WORD.findall(text or "")
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j:j + window]), i)
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_dedup(docs_of, corpus):
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs_of(corpus), window=50).collect()
           if r["doc_id"] is not None}
    want = plain_windows(corpus, 50)
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == want
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in got.values())
    assert sum(n for _, n, _ in want.values()) > 1000


def test_substring_dedup_null_id_and_empty(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = substring_dedup.remove_repeats(docs_of([(None, text), (5, text), (5, text), (None, None)]), digest=True).collect()
    assert len(rows) == 4 and all(r["n_removed"] == 0 for r in rows)
    assert substring_dedup.remove_repeats(docs_of([])).collect() == []


def plain_bytes(pairs, width):
    seen, out = set(), {}
    for i, text in sorted((p for p in pairs if p[0] is not None), key=lambda p: p[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if b[j:j + width] in seen:
                gone[j:j + width] = b"\1" * width
            seen.add(b[j:j + width])
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]),
                  bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("part_bytes", [suffix_dedup.PART_BYTES, 2000])
def test_suffix_dedup(docs_of, corpus, monkeypatch, part_bytes):
    """Also with shards split into parts that are merged by binary search."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part_bytes)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"]))
           for r in suffix_dedup.remove_repeats(docs_of(corpus), width=100).collect() if r["doc_id"] is not None}
    assert got == plain_bytes(corpus, 100)


def test_suffix_dedup_empty_and_null_ids(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).collect() == []
    rows = suffix_dedup.remove_repeats(docs_of([(None, "a" * 500), (None, None), (1, "")])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (0, 0), (500, 0)]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs_of([(1, "a")]), width=20)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(20):
        s = rng.integers(1, 3, rng.integers(1, 120)).astype(np.int16)
        order = suffix_dedup.suffix_array(s, 1000)
        t = s.tolist()
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want
        lcp = suffix_dedup.common_prefixes(s, order, 1000)
        for k in range(1, len(t)):
            a, b = t[want[k - 1]:], t[want[k]:]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n


def plain_components(pairs, n, percent):
    sets = {}
    for i, text in pairs:
        if i is None:
            continue
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50), (1, 100)])
def test_jaccard_components(docs_of, corpus, n, percent):
    rows = jaccard_join.join_components(docs_of(corpus), n=n, percent=percent).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == plain_components(corpus, n, percent)
    assert sorted(r["n_shingles"] for r in rows if r["doc_id"] is None)[0] == 0
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)


def test_jaccard_empty_and_repeated_rows(docs_of):
    assert jaccard_join.join_components(docs_of([])).collect() == []
    rows = jaccard_join.join_components(docs_of([(3, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(3, 3), (4, 3)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (None, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}


def plain_lines(pairs, least, keep):
    strip = " \t\n\x0b\x0c\r"
    docs = {}
    for i, text in pairs:
        for line in (text or "").split("\n"):
            docs.setdefault(line.strip(strip).translate(LOWER), set()).add((i, text or ""))
    seen, out = set(), []
    for i, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(strip).translate(LOWER)
            common = key and len(docs[key]) >= least
            if not common or keep == "first" and key not in seen:
                kept.append(line)
            seen.add(key)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup(docs_of, keep):
    pairs = [(i, f"Header\n  shared Line \t\nown {i}\n\n" + ("twice\ntwice\n" if i % 2 else "") + "x" * i) for i in range(100)]
    pairs += [(200, None), (201, ""), (202, "header"), (203, "HEADER \r\n"), (None, "shared line\nlast")]
    pairs += [(300, "\n".join(["shared line", "stay"] * 200))]
    got = line_dedup.dedup_lines(docs_of(pairs), min_docs=10, keep=keep).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, plain_lines(pairs, 10, keep)))


def test_line_dedup_edges(docs_of):
    assert line_dedup.dedup_lines(docs_of([])).collect() == []
    same = [(1, "a\nb")] * 12  # repeated rows are one document: nothing is found in ten
    assert {tuple(r) for r in line_dedup.dedup_lines(docs_of(same)).collect()} == {(1, 2, 0, "a\nb")}
    docs = docs_of([(i, "same\nown" + str(i)) for i in range(10)] + [(77, None)])
    out = line_dedup.clean_lines(docs, length_col="n_chars")
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {
        *((i, f"own{i}", 4) for i in range(10)), (77, None, None)}


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup_of_a_line_in_every_part(docs_of, keep):
    """A line of 900 documents meets its records in all parts it is dealt to; a rare one in ten."""
    pairs = [(i, f"hot\nown {i}" + ("\nrare" if i % 90 == 0 else "") + ("\nnine" if i % 100 == 7 else ""))
             for i in range(900)]
    got = line_dedup.dedup_lines(docs_of(pairs), min_docs=10, keep=keep).collect()
    assert sorted(tuple(r) for r in got) == plain_lines(pairs, 10, keep)


def test_line_dedup_is_native(docs_of):
    plan = line_dedup.dedup_lines(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_packed_arrays_round_trip():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 1 << 60, 1000).astype(np.uint64), np.zeros(0, dtype=np.int64), rng.integers(0, 9, 7).astype(np.uint16)]
    for a, b in zip(arrays, exchange.unpack(exchange.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
    words = exchange.Words(["a b a".encode(), b"", "  b".encode(), "a\0 a".encode()])
    h = words.hashes
    assert h[0] == h[2] and h[1] == h[3] and h[4] != h[5] and words.doc.tolist() == [0, 0, 0, 2, 3, 3]
