"""The registered queries and the pipeline over a small folder of tables, against plain versions."""

import random

import pytest
from test_dedup import plain_bytes, plain_components, plain_lines, plain_windows
from test_scoring import BAD, WORDS, plain_coverage

import corpus_pipeline
from panelcast.llm import tiling, toxicity
from panelcast.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, docs_of, corpus, tmp_path_factory):
    """Tables as the queries read them: the corpus plus toxic, contaminated and boilerplate documents."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(5)]
    pairs = [(i, t) for i, t in corpus if i is not None]
    labels = [(i, 0) for i, _ in pairs]
    for i in range(1000, 1300):
        toxic = i % 5 == 0
        words = (prose(40) + (" " + rng.choice(BAD) if toxic else "")).split()
        rng.shuffle(words)
        pairs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    pairs += [(2000 + k, prose(10) + " " + text.upper() + " " + prose(9)) for k, text in items]
    pairs += [(3000 + k, f"Terms of use apply here\n{prose(30)}\nterms OF use apply here ") for k in range(12)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs_of(pairs, clash=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path, pairs, dict(items)


def test_queries_against_plain_versions(spark, folder, sha):
    path, pairs, items = folder
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in QUERIES["op2_suffix_array_dedup"](spark, path).collect()}
    assert got == {i: (n, m, s, sha(kept)) for i, (n, m, s, kept) in plain_bytes(pairs, 100).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in QUERIES["op3_anchor_dedup"](spark, path).collect()}
    assert got == {i: (n, m, sha(kept)) for i, (n, m, kept) in plain_windows(pairs, 50).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_jaccard_join"](spark, path).collect()}
    assert got == plain_components(pairs, 4, 85)
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_greedy_string_tiling"](spark, path).collect()}
    assert got == {(2000 + k, k) for k in items}


def test_pipeline_stages(spark, folder):
    path, pairs, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, texts = docs.columns, dict(pairs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == columns
        got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
        if name == "toxicity":
            model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{path}/labels.parquet")))
            kept = {i for i, t in texts.items() if toxicity.scores([t or ""], model)[0] < 0.3}
            bad = {i for i, t in texts.items() if any(w in (t or "").split() for w in BAD)}
            assert len(bad & kept) <= 0.1 * len(bad) and len(set(texts) - kept - bad) <= 5
            texts = {i: texts[i] for i in kept}
        elif name == "line dedup":
            texts = {i: None if texts[i] is None else t for i, _, _, t in plain_lines(list(texts.items()), 10, "none")}
        elif name == "n-gram Jaccard join":
            texts = {i: texts[i] for i, (_, c) in plain_components(list(texts.items()), 5, 80).items() if c == i}
        else:
            words = {k: v.lower().split() for k, v in items.items()}
            texts = {i: t for i, t in texts.items() if not any(
                plain_coverage((t or "").lower().split(), w, tiling.TILE) >= tiling.COVERAGE * len(w) for w in words.values())}
        assert got == {i: (t, None if t is None else len(t)) for i, t in texts.items()}
        docs = corpus_pipeline.stored(out)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    assert not {2000 + k for k in items} & set(texts) and len({r["sequence_id"] for r in packed}) >= 1
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole) == sorted(
        (r["doc_id"], r["start"], r["ids_crc32"]) for r in packed)
