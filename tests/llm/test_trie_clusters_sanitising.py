"""Prefix tree, clusters and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelcast.llm import centroids, prefix_trie, queries, sanitise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- prefix tree ---------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, role, mark, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * words
    return {(min(m), len(p)): (min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                               hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
            for p, m in nodes.items()}


def as_nodes(df):
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def talks():
    rng = random.Random(3)
    say = ["hello", "good day to you", "how much is it", "", None, "so  be\tit", "ünï çödé", "no"]
    rows = []
    for c in [*range(-45, 130), 10**12, 10**12 + 7]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(say)))
    rows += [(500 + i, t, "user", f"copy {t}") for i in range(60) for t in range(4)]  # copies
    rows += [(700, t, "user", "long talk" if t % 7 else None) for t in range(300)]  # one long conversation
    rows += [(701, None, None, None), (701, None, "user", "x"), (701, 3, "user", "b"), (701, 3, "user", "a"), (701, 3, "user", "a")]
    rows += [(None, 0, "user", "nobody"), (702, 0, "user", "word " * 20000)]
    return rows


@pytest.mark.parametrize("alone", [60, 1 << 14])
def test_trie_against_plain_version(spark, alone):
    rows = talks()
    df = spark.createDataFrame([(*r, "q", 5) for r in rows], "conv_id long, turn long, role string, text string, c string, pid int")
    assert as_nodes(prefix_trie.trie(df.repartition(3), alone=alone)) == plain_trie(rows)


def test_trie_streams_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = [(i, 0, "user", "same") for i in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_nodes(prefix_trie.trie(df)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).collect() == []
    only = as_nodes(prefix_trie.trie(spark.createDataFrame([(7, 1, None, None)], schema)))
    assert only == plain_trie([(7, 1, None, None)])


# --- clusters ------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            own = [v for (_, v), f in zip(kept, found) if f == j]
            if own:
                at[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    inertia = defaultdict(int)
    for d, j in last:
        inertia[j] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), marks[j]) for (i, _), (d, j) in zip(kept, last)), key=repr)


def as_clusters(df):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def vectors(n=150):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 64)) * 0.2
    rows = [(i, (centers[i % 6] + rng.normal(size=64) * 0.05).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.25] * 64) for i in range(40)]  # copies
    rows += [(7, rows[3][1]), (7, rows[3][1]), (8, [-300.5] * 64)]  # repeated rows, ids that meet, an outlier
    rows += [(None, rows[5][1]), (2000, None), (2001, []), (2002, [0.1] * 63), (2003, [None] + [0.1] * 63),
             (2004, [float("nan")] + [0.1] * 63), (2005, [float("inf")] + [0.1] * 63)]
    return rows


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_clusters_against_plain_version(spark, bits):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, b"x", 2) for i, v in rows], "vec_id long, embedding array<double>, rid int, cells binary, cluster int")
    got = centroids.cluster(df.repartition(3), k=9, rounds=4, bits=bits)
    assert as_clusters(got) == plain_clusters(rows, 9, 4)


def test_clusters_of_few_and_far_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.0] * 64)]
    assert as_clusters(centroids.cluster(spark.createDataFrame(rows, schema))) == plain_clusters(rows, 40, 5)
    far = [(9, [1e300] * 64), (10, [0.0] * 63 + [3e6])]
    got = centroids.cluster(spark.createDataFrame([*rows, *far], schema))
    assert as_clusters(got.where("cluster is not null")) == plain_clusters(rows, 40, 5)
    assert sorted(r["vec_id"] for r in got.where("cluster is null and distance is null").collect()) == [9, 10]
    assert sorted(r["vec_id"] for r in centroids.cluster(spark.createDataFrame(far, schema)).collect()) == [9, 10]


# --- personal data -------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if plain_valid(k, m[0])]


def test_personal_data_against_plain_version(docs_of, sha):
    rng = random.Random(11)
    signs = list("aZ.@%+-_ 019()\n,é") + ["12.3.255.4", "4111 1111 1111 1111", "+49 30 1234567", "a.b@c.de", "256.1.1.1", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    texts += [None, "", "x@y", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8.9", "0000000255.1.1.1", "+1", "+12", "+1 (234) 567-89 ",
              "4111-1111-1111-1111 4111111111111111", "41111111111111112", "a@b.c " * 1000, "9" * 20000, "a" * 20000, "a." * 9000,
              "x@" + "a." * 5000, "1." * 9000, "+1 " + "( " * 9000, "word " * 30000 + "jo@ex.org"]
    docs = docs_of([(i % 250, t) for i, t in enumerate(texts)] + [(None, "me@here.org"), (3, texts[3])])
    rows = sanitise.digest(sanitise.personal_data(docs)).collect()
    want = []
    for i, t in [*((i % 250, t) for i, t in enumerate(texts)), (None, "me@here.org"), (3, texts[3])]:
        base = plain_base(t)
        flat = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *[sum(x[0] == k for x in base) for k in PLAIN], sha(flat), flat))
    got = [(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"],
            ",".join(x for x in r["spans"].split(",") if not x.startswith(("general", "removed")))) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_terms(texts, generalise, remove, least):
    """Places of the terms to hide, by document."""
    term = re.compile(r"(?<![^\W\d_])[^\W\d_][^\W\d_]{2,}")
    total, holds, near, hold_t = len(texts), defaultdict(set), [], defaultdict(set)
    for i, t in enumerate(texts):
        for m in term.finditer(t):
            hold_t[m[0].lower()].add(i)
        for k, a, b in plain_base(t):
            e = (k, t[a:b])
            holds[e].add(i)
            left, right = t[max(0, a - 64):a], t[b:b + 64]
            lefts = [(m[0].lower(), a - len(left) + m.start(), a - len(left) + m.end()) for m in term.finditer(left)
                     if len(left) < 64 or m.start()]
            rights = [(m[0].lower(), b + m.start(), b + m.end()) for m in term.finditer(right) if len(right) < 64 or m.end() < 64]
            near += [(i, e, (left, right), *x) for x in lefts[::-1][:5] + rights[:5]]
    docs, contexts = defaultdict(set), defaultdict(set)
    for i, e, context, t, _, _ in near:
        docs[e, t].add(i)
        contexts[e, t].add(context)
    out = defaultdict(dict)
    for i, e, _, t, a, b in near:
        information = math.log2(total / len(holds[e]))
        share = math.log2(total * len(docs[e, t]) / (len(hold_t[t]) * len(holds[e]))) / information if information else 0
        if len(contexts[e, t]) >= least and share >= generalise:
            out[i][a, b] = max(share, out[i].get((a, b), 0))
    return {i: sorted((a, b, "removed" if s >= remove else "general") for (a, b), s in v.items()) for i, v in out.items()}


def telling_texts():
    rng = random.Random(5)
    filler = "river stone window garden paper candle silver mountain yellow quiet bridge letter summer table".split()
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [prose(rng.randint(5, 40)) for _ in range(120)]
    texts += [f"{prose(rng.randint(3, 9))} Zanzibarius, wrote to jo@ex.org about {prose(4)}" for _ in range(8)]
    texts += [f"{prose(9)} falconry {prose(9)}" for _ in range(2)]
    texts += [f"{prose(4)} falconry 10.1.2.3 {prose(6)}" for _ in range(6)]
    return texts + ["copied Quixotry beside +49 30 1234567 in one passage"] * 30


def test_telling_terms_against_plain_version(spark, docs_of):
    texts = telling_texts()
    docs = docs_of(list(enumerate(texts)))
    want = plain_terms(texts, 0.7, 0.95, 3)
    rows = sanitise.personal_data(docs, generalise=0.7, remove=0.95).collect()
    got = {r["doc_id"]: [tuple(t) for t in r["terms"]] for r in rows if r["terms"]}
    assert got == want
    hidden = {texts[i][a:b] + " " + how for i, spans in got.items() for a, b, how in spans}
    assert "Zanzibarius removed" in hidden and "falconry general" in hidden and not any("Quixotry" in h for h in hidden)
    assert all(texts[i].count("@") or "10.1.2.3" in texts[i] for i in got)  # others stay as they are


def test_sanitised_text(spark, docs_of):
    texts = telling_texts()
    docs = docs_of([*enumerate(texts), (900, None), (901, "call +49 30 1234567, a@b.org!")])
    rows = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs, generalise=0.7, remove=0.95).collect()}
    assert rows[0] == texts[0] and rows[900] == "" and rows[901] == "call [PHONE], [EMAIL]!"
    assert all("jo@ex.org" not in t and "Zanzibarius" not in t for t in rows.values())
    assert any("[WORD] [IP]" in t for t in rows.values())


def test_sanitising_of_nothing(docs_of):
    assert sanitise.digest(sanitise.personal_data(docs_of([]))).collect() == []


def test_new_queries_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("op11_euler_tour_trie", "op12_va_file_clusters"):
        df = queries.QUERIES[name](spark, folder)
        res = con.execute(queries.SQL[name])
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, res.fetchall()))
