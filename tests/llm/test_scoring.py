"""Classifiers, tiling, packing, sharding and search: held-out accuracy, plain versions, round trips."""

import random
import zlib

import numpy as np
import pytest

from panelcast.llm import langid, metric_search, packing, sharding, tiling, toxicity
from panelcast.llm.queries import vocabulary

WORDS = "river stone window garden paper candle silver mountain yellow quiet bridge letter summer table".split()
BAD = "scumbag worthless idiot".split()


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def labelled(n, seed=0):
    rng = random.Random(seed)
    pairs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        pairs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return pairs, labels


def test_toxicity_on_held_out(spark, docs_of):
    pairs, labels = labelled(1500)
    docs = docs_of([*pairs, (None, None), (9000, ""), (9001, "river " * 50000)])
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (9000, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, marks))
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = dict(labels)
    test = [i for i in truth if out(i)]
    assert np.mean([rows[i]["predicted"] == truth[i] for i in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[9000]["predicted"] == rows[9001]["predicted"] == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if not r["predicted"]}


def test_toxicity_never_learns_held_out_rows(spark, docs_of):
    pairs, labels = labelled(400)
    docs, marks = docs_of(pairs), spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, 1 - y if out(i) else y) for i, y in labels], "doc_id long, toxic int")
    a, b = (toxicity.fit(toxicity.training_rows(docs, m)) for m in (marks, flipped))
    assert a.bias == pytest.approx(b.bias) and np.allclose(a.weights, b.weights)


def test_toxicity_without_labels(spark, docs_of):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs_of([(1, "a")]), empty))
    assert [r["score"] for r in toxicity.score(docs_of([(1, "a"), (2, None)]), model).collect()] == [0.5, 0.5]
    assert toxicity.score(docs_of([]), model).collect() == []


def language_corpus():
    rng = random.Random(2)
    parts = {"aa": ["the", "ing", "wh", "ou", "ea"], "bb": ["sch", "ung", "ei", "keit", "zu"], "cc": ["ión", "que", "ll", "ñ", "ado"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    pairs, langs = [], []
    for i in range(600):
        lang = rng.choice(list(parts))
        pairs.append((i, prose(lang, rng.randint(3, 80))))
        langs.append(lang)
    return pairs, langs, prose


def test_language_mixture(docs_of):
    pairs, langs, prose = language_corpus()
    model = langid.fit(docs_of([*pairs, (5000, "x"), (None, "y")], [*langs, None, "zz"]))
    assert model.names == ["aa", "bb", "cc"]
    extra = [(1000, prose("aa", 60) + " " + prose("bb", 40)), (1001, None), (1002, "12 !! --"), (1003, "")]
    rows = {r["doc_id"]: r for r in langid.predict(docs_of([*pairs, *extra]), model).collect()}
    test = [i for i, _ in pairs if out(i)]
    assert np.mean([rows[i]["lang_pred"] == langs[i] for i in test]) > 0.97
    assert set(rows[1000]["shares"]) == {"aa", "bb"} and rows[1000]["lang_pred"] == "aa"
    assert rows[1000]["shares"]["bb"] == pytest.approx(0.4, abs=0.08)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1001, 1002, 1003))


def test_language_without_training(docs_of):
    model = langid.fit(docs_of([(1, None)]))
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(docs_of([(1, "abc")]), model).collect()] == [("und", 0.0)]


def plain_coverage(doc, item, tile):
    """Words of ``item`` covered by greedy tiles, longest first."""
    free_d, free_i, least = [True] * len(doc), [True] * len(item), min(tile, len(item))
    for n in range(min(len(doc), len(item)), least - 1, -1):
        for a in range(len(doc) - n + 1):
            for b in range(len(item) - n + 1):
                if all(free_d[a:a + n]) and all(free_i[b:b + n]) and doc[a:a + n] == item[b:b + n]:
                    free_d[a:a + n], free_i[b:b + n] = [False] * n, [False] * n
                    break
    return free_i.count(False)


def test_tiling_against_plain_version(spark, docs_of):
    rng = random.Random(5)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [prose(rng.randint(10, 40)) for _ in range(12)] + [["alone", "pair"]]
    docs = []
    for i in range(60):
        words = prose(rng.randint(10, 150))
        if i % 2:
            item = items[rng.randrange(len(items))]
            cut = len(item) // 2
            words[5:5] = item[cut:] + ["between"] + item[:cut] if i % 4 == 1 else item  # reordered or verbatim
        docs.append((i, " ".join(words).upper() if i % 3 else ", ".join(words)))
    docs += [(100, None), (101, ""), (102, "alone pair"), (None, " ".join(items[0]))]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(98, None), (99, "...")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in tiling.contaminated(docs_of(docs), table).collect()}
    want = {}
    for i, text in docs:
        words = (text or "").lower().replace(",", "").split()
        for k, item in enumerate(items):
            n = plain_coverage(words, item, tiling.TILE)
            if n >= tiling.COVERAGE * len(item):
                want[i, k] = n
    assert got == want
    clean = tiling.without_contaminated(docs_of(docs), table)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert tiling.contaminated(docs_of(docs), table.limit(0)).collect() == []
    assert tiling.contaminated(docs_of([]), table).collect() == []


def test_tiling_in_several_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 40)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(20)]
    docs = [(k, "start " + text + " end") for k, text in items]
    rows = tiling.contaminated(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(k, k) for k in range(20)]


def test_packing_round_trip(docs_of):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "!!", "'s", " 12"]) for _ in range(rng.randint(0, 900)))
             for _ in range(60)]
    texts += [None, "", "ÀÉ îü, ΑΣ ς İ", "a\x85b\x1cc\td\r\ne", "<|endoftext|> x<|startoftext|>y", "don't 'twas I'll", "x" * 5000]
    docs = docs_of([*enumerate(texts), (None, "null id")])
    cut = packing.pieces(docs, vocabulary(), capacity=256)
    from panelcast.llm.common import stored

    placed = packing.place(stored(cut), 256).collect()
    for i, text in enumerate(texts):
        parts = sorted((r for r in placed if r["doc_id"] == i), key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], dtype="<u4") for r in parts]).tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
    by = {}
    for r in placed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in placed)
    assert len(by) <= total / 256 + 3
    whole = packing.sequences(packing.place(stored(cut), 256), 256).collect()
    assert all(len(r["ids"]) == 4 * (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 256) for r in whole)
    assert packing.pack(docs_of([]), vocabulary()).collect() == []


def test_least_slack_uses_everything_up():
    rng = random.Random(4)
    counts = {rng.randint(1, 200): rng.randint(1, 500) for _ in range(80)}
    used = {}
    for times, pattern in packing.least_slack(counts, 200):
        assert sum(n * c for n, c in pattern.items()) <= 200
        for n, c in pattern.items():
            used[n] = used.get(n, 0) + times * c
    assert used == counts


@pytest.mark.parametrize("hot", [False, True])
def test_sharding(docs_of, hot):
    rng = random.Random(6)
    pairs = [(i, "x" * rng.randint(0, 200)) for i in range(3000)]
    if hot:
        pairs += [(5000 + i, "same text " * 9) for i in range(1500)]
    pairs += [(None, None), (7, "again"), (7, "again")]
    rows = sharding.assign(docs_of(pairs), 8).collect()
    assert len(rows) == len(pairs)
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 8 + 400
    assert sharding.assign(docs_of([])).collect() == []
    assert len(sharding.assign(docs_of([(1, "a"), (2, None)])).collect()) == 2


def test_groups_of_equal_texts_stay_whole(spark, docs_of, monkeypatch):
    """Against the plain rule: whole unless a group fits into no shard, sizes within a hundredth or a document."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 300))) for _ in range(900)]
    texts += [f"copied {k} " * (k % 30 + 1) for k in range(200) for _ in range(rng.randint(2, 9))]
    texts += ["hot text " * 12] * 4000 + [None] * 50 + ["long " * 3000] * 2
    ids = [None if i % 97 == 0 else i % 5000 for i in range(len(texts))]
    monkeypatch.setattr(sharding, "PART_ROWS", 40)
    rows = sharding.assign(docs_of(list(zip(ids, texts))), 8).collect()
    total, homes = sum(r["size"] for r in rows), {}
    assert len(rows) == len(texts) and total == sum(len((t or "").encode()) + 1 for t in texts)
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    hot = zlib.crc32(("hot text " * 12).encode())
    assert len(homes[hot]) > 1 and all(len(at) == 1 for key, at in homes.items() if key != hot)
    assert max(sizes) - min(sizes) <= 0.02 * total / 8 + 400
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_room_for_groups_against_plain_rule():
    places, room = sharding.room_for_groups([(1, 50), (2, 30), (3, 30), (4, 5)], 160, 4)
    assert places[1] == [(0, 0), (40, 1)]  # larger than a share of 40
    assert places[2] == [(0, 2)] and places[3] in ([(0, 3)], [(0, 1)]) and len(places[4]) == 1
    assert sum(room) == 160 - 115 and min(room) >= 0
    assert sharding.room_for_groups([], 0, 3) == ({}, [0, 0, 0])


def test_anchor_windows_have_two_words(docs_of):
    from panelcast.llm import substring_dedup

    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs_of([(1, "a b")]), window=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_metric_search_is_exact(spark, monkeypatch, seed):
    monkeypatch.setattr(metric_search, "PAGE", 40)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 12))
    x = (centres[rng.integers(0, 5, 700)] + 0.1 * rng.normal(size=(700, 12))).astype(np.float32)
    x[100:300] = x[100]  # many rows share one vector
    rows = [(i, x[i].tolist()) for i in range(700)]
    bad = [(None, x[0].tolist()), (2000, None), (2020, []), (2040, [float("nan")] * 12), (2060, [None] * 12), (2080, [float("inf")] * 12)]
    frame = spark.createDataFrame([*rows, *bad, rows[3]], "vec_id long, embedding array<float>")
    got = {}
    for r in metric_search.search(frame, k=7, every=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 700, 20):
        score = v @ v[q]
        order = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:7]
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 700, 20))


def test_metric_search_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert metric_search.search(spark.createDataFrame([], schema)).collect() == []
    assert metric_search.search(spark.createDataFrame([(20, [1.0])], schema)).collect() == []
    two = metric_search.search(spark.createDataFrame([(20, [1.0, 2.0]), (21, [1.0])], schema)).collect()
    assert [tuple(r) for r in two] == [(20, 1, 21, 4096)]


def test_metric_search_large_components(spark, monkeypatch):
    monkeypatch.setattr(metric_search, "PAGE", 40)
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 24), 1 << 24, (200, 6)).astype(np.float64) + rng.integers(0, 64, (200, 6)) / 64
    x[0, 0] = x[20, 0] = x[7, 0] = float(1 << 25)  # 64 times this is beyond 31 bits
    x[90:130] = x[89]
    x[90:130, 5] += np.arange(40) / 64  # scores that float64 cannot tell apart
    x[150:] /= 1 << 20
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in metric_search.search(frame, k=7, every=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(64 * x).astype(np.int64).astype(object)
    for q in range(0, 200, 20):
        score = v @ v[q]
        order = [i for i in sorted(range(200), key=lambda i: (-score[i], i)) if i != q][:7]
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 200, 20))


def test_metric_search_far_components_and_clashing_columns(spark):
    far = [(0, [1e300, 1.0]), (20, [1.0, 2.0]), (40, [2.0 ** 54, 2.0 ** 54]), (41, [2.0 ** 54, 2.0 ** 53]), (42, [2.0 ** 54, 2.0 ** 54])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in far], "vec_id long, embedding array<double>, home int, reach string")
    got = {}
    for r in metric_search.search(frame, k=3, every=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    top = (1 << 63) - 1
    assert sorted(got[40]) == [(1, 20, top), (2, 41, top), (3, 42, top)] and set(got) == {20, 40}


def test_metric_search_leaves_pages_out(spark, monkeypatch):
    monkeypatch.setattr(metric_search, "PAGE", 25)
    written = []
    plain = metric_search.stored
    monkeypatch.setattr(metric_search, "stored", lambda df: written.append(plain(df)) or written[-1])
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 8)) * 3
    x = centres[rng.integers(0, 20, 2000)] + 0.05 * rng.normal(size=(2000, 8))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in metric_search.search(frame, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    v = np.floor(64 * x).astype(np.int64)
    for q in range(0, 2000, 20):
        order = [i for i in np.lexsort((np.arange(2000), -(v @ v[q]))) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, i) for k, i in enumerate(order)]
    pages = next(t for t in written if "radius" in t.columns and "node" in t.columns).count()
    last = [t for t in written if {"ord", "away"} <= set(t.columns)][-1]
    visited = sum(len(r["at"]) // 4 for r in last.collect())
    assert pages > 50 and visited < 0.5 * 100 * pages


def test_tiling_sees_words_behind_other_spaces_dashes_and_quotes(spark, docs_of):
    plain = "the café owner's rule is to serve naïve guests first and ask the others to wait for a table"
    copies = [
        plain,
        plain.replace(" ", " "),
        plain.replace("'", "’").upper(),
        " ".join("—" + w for w in plain.split()),
        "“" + plain.replace(" ", " – ") + "”",
        plain.replace("guests", "gue­sts").replace("é", "é"),
        "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in plain),
    ]
    clean = [" ".join(sorted(plain.split())), "", None, "—— ”"]
    items = spark.createDataFrame([(1, plain), (2, "—  "), (3, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["covered"]) for r in tiling.contaminated(
        docs_of(list(enumerate(copies + clean))), items).collect()}
    assert found == {(i, 1, 20) for i in range(len(copies))}


def test_tiling_of_a_very_long_text_with_repeated_rows(spark, docs_of):
    rng = np.random.default_rng(12)
    filler = " ".join(f"w{i}" for i in rng.integers(0, 5000, 200_000))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = [(1, filler + "\n" + passage + "\n" + filler), (1, filler), (2, passage), (2, passage)]
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    found = [(r["doc_id"], r["covered"]) for r in tiling.contaminated(docs_of(docs), items).collect()]
    assert sorted(found) == [(1, 14), (2, 14), (2, 14)]
