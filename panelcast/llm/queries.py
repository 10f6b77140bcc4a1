"""The operators as registered queries over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (
    centroids, jaccard_join, langid, line_dedup, metric_search, packing, prefix_trie, sanitise, sharding, substring_dedup,
    suffix_dedup, tiling, toxicity,
)
from panelcast.llm.common import held_out
from panelcast.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_greedy_string_tiling")
def op1(spark, folder):
    """Documents that hold benchmark items, with the tiles; clean documents have no row."""
    return tiling.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_suffix_array_dedup")
def op2(spark, folder):
    kept = suffix_dedup.remove_repeats(table(spark, folder, "documents"), width=100, digest=True)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.col("kept").cast("string").alias("kept_sha256"), "spans")


@query("op3_anchor_dedup")
def op3(spark, folder):
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"), window=50, digest=True)
    return kept.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"), "spans")


def vocabulary() -> str:
    """Place of the public vocabulary that documents are packed with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op4_min_slack_packing")
def op4(spark, folder):
    return packing.pack(table(spark, folder, "documents"), vocabulary(), end_id=1, capacity=2048)


@query("op5_ratio_toxicity")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, folder, "labels")))
    return toxicity.score(docs, model, threshold=0.3).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op6_sampled_splitters")
def op6(spark, folder):
    placed = sharding.assign(table(spark, folder, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op7_language_mixture")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.fit(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "shares")


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op8_line_dedup", OP8_SQL)
def op8(spark, folder):
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents"), min_docs=10)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_jaccard_join")
def op9(spark, folder):
    return jaccard_join.join_components(table(spark, folder, "documents"), n=4, percent=85)


OP10_SQL = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query("op10_mtree_search", OP10_SQL)
def op10(spark, folder):
    return metric_search.search(table(spark, folder, "embeddings"), k=20, every=20)


# The checksum of the decimal id, bit by bit.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
checks AS (
  SELECT c, n, c - c % 20 AS base, (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
      lambda x, y: xor(x // 2, (x % 2) * 3988292384)))) % 4 AS h FROM sizes),
convs AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS lent FROM checks a LEFT JOIN sizes b ON a.base = b.c),
rows_ AS (
  SELECT v.c, t.k AS d, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.k <= v.lent
  UNION ALL SELECT v.c, t.k - v.h + v.lent, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.k > v.h),
pre AS (
  SELECT c, d, text, string_agg(sha256(concat(length(role), ':', role, text)), '') OVER (
    PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS f FROM rows_
  UNION ALL SELECT c, 0, '', '' FROM convs),
last_ AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM pre),
nodes AS (
  SELECT d, f, min(c) AS c, count(*) AS n, max(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM last_ GROUP BY d, f),
members AS (SELECT p.c, p.d, p.f, n.c AS node FROM pre p JOIN nodes n ON p.d = n.d AND p.f = n.f),
kids AS (
  SELECT n.d, n.f, n.c, m.node AS parent FROM nodes n JOIN members m ON m.c = n.c AND m.d = n.d - 1),
counted AS (
  SELECT n.*, k.parent, coalesce(x.n_children, 0) AS n_children FROM nodes n
  LEFT JOIN kids k ON k.d = n.d AND k.f = n.f
  LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS n_children FROM kids GROUP BY ALL) x ON x.parent = n.c AND x.d = n.d),
sums AS (
  SELECT m.node, m.d, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n - 1) * u.words) AS saved
  FROM counted u JOIN members m ON m.c = u.c AND m.d <= u.d GROUP BY ALL)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, n.parent AS parent_conv_id, n.n AS n_convs, n.n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.node = n.c AND s.d = n.d"""


@query("op11_euler_tour_trie", OP11_SQL)
def op11(spark, folder):
    return prefix_trie.trie(table(spark, folder, "conversations")).drop("enter", "leave")


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round written out: distances to all centroids, then floors of the means."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [f"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM base) WHERE c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT b.rid, c.c, CAST(list_sum(list_transform(list_zip(b.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM base b CROSS JOIN c{r} c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (
    SELECT c, list({floor} ORDER BY j) AS v FROM (
      SELECT c, j, sum(x) AS s, count(*) AS n FROM (
        SELECT a.best.c AS c, unnest(b.v) AS x, generate_subscripts(b.v, 1) AS j FROM a{r} a JOIN base b USING (rid))
      GROUP BY c, j) GROUP BY c) m ON m.c = o.c)""")
    return ",".join(steps) + f"""
SELECT b.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance,
  CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM base b JOIN a{rounds} a USING (rid) JOIN c{rounds} c ON c.c = a.best.c"""


@query("op12_va_file_clusters", _op12_sql())
def op12(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings"), k=40, rounds=5).drop("fetched")


@query("op13_information_sanitising")
def op13(spark, folder):
    return sanitise.digest(sanitise.personal_data(table(spark, folder, "documents")))
