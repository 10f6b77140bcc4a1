"""Queries over sources, detection, and request intake."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import rnd
from panelcast.operators.series import clean_sales, resample_sum
from panelcast.session import shared_folder
from panelcast.sources import detect as D
from panelcast.sources import files
from panelcast.sources.tables import table
from panelcast.spec import REGISTRY, SeriesSpec, validate
from panelcast.streaming import requests as Q
from panelcast.workload.base import query, rsql


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_sales_csv", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
o_totalprice, o_orderpriority, concat('say "', o_orderpriority, '", then', chr(10), 'go') AS note
FROM orders""")
def _(spark, folder):
    path = _fresh(spark, "orders-csv")
    table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice",
        "o_orderpriority",
        F.concat(F.lit('say "'), "o_orderpriority", F.lit('", then\ngo')).alias("note"),
    ).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return files.read_sales_csv(
        spark, path, "o_orderkey long, o_orderdate date, o_totalprice double, o_orderpriority string, "
        "note string"
    )


@query("preview_table", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice,
  o_orderpriority, CAST((SELECT count(*) FROM orders) AS BIGINT) AS rows, 4 AS columns
FROM orders ORDER BY o_orderkey LIMIT 10""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice", "o_orderpriority")
    head, (rows, columns) = files.preview_table(orders, order=("o_orderkey",))
    return head.withColumn("rows", F.lit(rows).cast("long")).withColumn("columns", F.lit(columns))


SPECS = {
    "orders": SeriesSpec("o_orderdate", "o_totalprice", "D", "orders by day"),
    "lineitem": SeriesSpec("l_shipdate", "l_extendedprice", "D", "lines by day"),
    "events": SeriesSpec("ts", "value", "D", "events by day"),
}


@query("schema_registry", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{s.freq}' AS freq, count(*) AS rows, "
    f"CAST(min({s.date_col}) AS DATE) AS first_ds, CAST(max({s.date_col}) AS DATE) AS last_ds, "
    f"{rsql(f'sum({s.target})', 2, 'total')} FROM {t}" for t, s in SPECS.items()))
def _(spark, folder):
    parts = [
        clean_sales(table(spark, folder, t), s).agg(
            F.count(F.lit(1)).alias("rows"), F.min("ds").alias("first_ds"),
            F.max("ds").alias("last_ds"), rnd(F.sum("y"), 2).alias("total"),
        ).select(F.lit(t).alias("dataset"), F.lit(s.freq).alias("freq"), "*")
        for t, s in SPECS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("validate_schema", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS rows, {m} AS problem FROM {t}"
    for t, m in (("orders", "''"),
                 ("lineitem", "'required columns missing: [''o_orderdate'', ''o_totalprice'']'"),
                 ("events", "'required columns missing: [''o_orderdate'', ''o_totalprice'']'"))))
def _(spark, folder):
    parts = []
    for t in SPECS:
        df = table(spark, folder, t)
        try:
            validate(df, SPECS["orders"])
            problem = ""
        except ValueError as error:
            problem = str(error)
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(t).alias("dataset"), "rows", F.lit(problem).alias("problem")))
    return reduce(DataFrame.unionByName, parts)


@query("inject_schema", f"""SELECT event_type AS series_key, CAST(ts AS DATE) AS ds,
{rsql('sum(value)', 4, 'y')} FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2""")
def _(spark, folder):
    spec = SeriesSpec.from_mapping({
        "date_col": "ts", "target": "value", "keys": ("event_type",), "description": "events"})
    out = resample_sum(clean_sales(table(spark, folder, "events"), spec), spec.freq)
    return out.withColumn("y", rnd(F.col("y"), 4))


@query("clean_sales", f"""WITH dirty AS (SELECT o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS amount,
  CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
  FROM orders)
SELECT o_orderstatus AS series_key, try_cast(day AS DATE) AS ds,
  {rsql('try_cast(amount AS DOUBLE)', 4, 'y')} FROM dirty
WHERE try_cast(amount AS DOUBLE) IS NOT NULL AND try_cast(day AS DATE) IS NOT NULL""")
def _(spark, folder):
    key = F.col("o_orderkey")
    dirty = table(spark, folder, "orders").select(
        "o_orderstatus",
        F.when(key % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(key % 11 == 0, "unknown")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    out = clean_sales(dirty, SeriesSpec("day", "amount", keys=("o_orderstatus",)))
    return out.withColumn("y", rnd(F.col("y"), 4))


@query("missing_datasets", """SELECT * FROM (VALUES {}) AS t(dataset) WHERE dataset NOT IN
(SELECT DISTINCT CASE event_type WHEN 'click' THEN 'pharmacy_daily' WHEN 'view' THEN 'toys_games'
 ELSE 'none' END FROM events)""".format(", ".join(f"('{n}')" for n in REGISTRY)))
def _(spark, folder):
    kind = F.col("event_type")
    name = F.when(kind == "click", "pharmacy_daily").when(kind == "view", "toys_games")
    present = table(spark, folder, "events").select(name.otherwise("none").alias("dataset"))
    return files.missing_datasets(spark, present)


# --- detection ---------------------------------------------------------------------------------

@query("detect_date_simple", """SELECT 'orders' AS dataset, 'o_orderdate' AS "column"
UNION ALL SELECT 'events', min("column") FROM (SELECT CASE WHEN count(ts) > 10 THEN 'ts'
  WHEN count(try_cast(event_type AS TIMESTAMP)) > 10 THEN 'event_type' END AS "column" FROM events)""")
def _(spark, folder):
    parts = [D.detect_date_simple(table(spark, folder, t)).select(
        F.lit(t).alias("dataset"), "column") for t in ("orders", "events")]
    return parts[0].unionByName(parts[1])


_DATE_TABLES = {
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"),
               ("o_totalprice", "n"), ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "events": [("event_id", "n"), ("ts", "t"), ("user_id", "n"), ("event_type", "s"),
               ("value", "n"), ("props", "s")],
    "lineitem": [(f"l_{c}", k) for c, k in (
        ("orderkey", "n"), ("partkey", "n"), ("suppkey", "n"), ("linenumber", "n"),
        ("quantity", "n"), ("extendedprice", "n"), ("discount", "n"), ("tax", "n"),
        ("returnflag", "s"), ("linestatus", "s"), ("shipdate", "t"))],
}


def _date_scores_sql() -> str:
    rows = []
    for t, columns in _DATE_TABLES.items():
        for i, (c, kind) in enumerate(columns):
            value = {"n": f"CAST(trunc({c}) AS BIGINT)", "s": f"try_cast({c} AS TIMESTAMP)",
                     "t": c}[kind]
            year = "1970" if kind == "n" else f"year({value})"
            rows.append(f"SELECT '{t}' AS dataset, {i} AS pos, '{c}' AS \"column\", "
                        f"{D.date_name_score(c)} AS name, count({c}) AS present, "
                        f"count({value}) AS parsed, count(DISTINCT {value}) AS uniq, "
                        f"min({year}) AS y0, max({year}) AS y1 FROM {t}")
    return f"""p AS ({' UNION ALL '.join(rows)}),
s AS (SELECT *, CASE WHEN present < 5 THEN CASE WHEN name > 30 THEN name ELSE 0 END
  ELSE name + CASE WHEN parsed >= 0.8 * present AND y0 >= 1950 AND y1 <= 2100
    THEN 15 + CASE WHEN uniq > 0.5 * parsed THEN 10 ELSE 0 END ELSE 0 END END AS score FROM p)"""


@query("date_scores", f"""WITH {_date_scores_sql()} SELECT dataset, "column", parsed,
CAST(score AS INTEGER) AS score FROM s""")
def _(spark, folder):
    parts = [D.date_scores(table(spark, folder, t)).select(
        F.lit(t).alias("dataset"), "column", "parsed", F.col("score").cast("int").alias("score")) for t in _DATE_TABLES]
    return reduce(DataFrame.unionByName, parts)


@query("detect_date_scored", f"""WITH {_date_scores_sql()}, r AS (SELECT *, row_number() OVER
  (PARTITION BY dataset ORDER BY score DESC, pos) AS k FROM s WHERE score > 0),
pairs AS (SELECT a.dataset, a."column" AS ca, b."column" AS cb, a.score AS sa, b.score AS sb,
  a.parsed AS pa, b.parsed AS pb, a.y1 - a.y0 AS da, b.y1 - b.y0 AS db
  FROM r a LEFT JOIN r b ON b.dataset = a.dataset AND b.k = 2 WHERE a.k = 1),
c AS (SELECT *, coalesce(sa - sb < 20 AND (pb > pa * 1.2 OR (pa > 0 AND pb > 0 AND db > da)), false)
  AS swap FROM pairs)
SELECT dataset, CASE WHEN swap THEN cb ELSE ca END AS "column",
CAST(CASE WHEN swap THEN sb ELSE sa END AS INTEGER) AS score FROM c""")
def _(spark, folder):
    parts = [D.detect_date_scored(table(spark, folder, t)).select(
        F.lit(t).alias("dataset"), "column", F.col("score").cast("int").alias("score"))
        for t in _DATE_TABLES]
    return reduce(DataFrame.unionByName, parts)


_TARGET_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "events": ["event_id", "user_id", "value"],
}


def _target_sql(style: str) -> str:
    rows = []
    for t, columns in _TARGET_TABLES.items():
        for i, c in enumerate(columns):
            penalty = 500 if style == "cli" and set(c.split("_")) & {
                "id", "index", "code", "zip", "phone", "year", "month"} else 0
            rows.append(f"SELECT '{t}' AS dataset, {i} AS pos, '{c}' AS \"column\", "
                        f"{D.target_name_score(c)} AS name, {penalty} AS penalty, count({c}) AS n, "
                        f"count(*) AS total, count(DISTINCT {c}) AS d, avg({c}) AS m, "
                        f"stddev_samp({c}) AS sd, count(*) FILTER ({c} > 0) AS pos_n FROM {t}")
    fallback = "pos DESC" if style == "cli" else "pos"
    return f"""WITH p AS ({' UNION ALL '.join(rows)}),
s AS (SELECT *, CASE WHEN n >= 3 AND d >= 2 AND name > 0 THEN name - penalty
  + CASE WHEN pos_n >= 0.9 * n THEN 40 WHEN pos_n >= 0.7 * n THEN 20 ELSE 0 END
  + CASE WHEN m > 0 THEN 15 ELSE 0 END
  + CASE WHEN sd > 0 AND CASE WHEN m <> 0 THEN sd / abs(m) ELSE 1 END > 0.01
      AND CASE WHEN m <> 0 THEN sd / abs(m) ELSE 1 END < 5 THEN 10 ELSE 0 END
  + CASE WHEN 1 - n / total < 0.1 THEN 10 ELSE 0 END END AS score FROM p)
SELECT dataset, "column", CAST(score AS INTEGER) AS score FROM s QUALIFY row_number() OVER
 (PARTITION BY dataset ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, score DESC,
  CASE WHEN score IS NULL THEN {fallback.replace('pos DESC', '-pos')} ELSE pos END) = 1"""


def _target_query(style: str):
    def run(spark, folder):
        parts = [D.detect_target(table(spark, folder, t), style=style).select(
            F.lit(t).alias("dataset"), "column", F.col("score").cast("int").alias("score"))
            for t in _TARGET_TABLES]
        return reduce(DataFrame.unionByName, parts)

    return run


query("detect_target", _target_sql("cli"))(_target_query("cli"))
query("detect_target_ui", _target_sql("ui"))(_target_query("ui"))


def _gaps_sql(source: str) -> str:
    return f"""src AS ({source}),
u AS (SELECT DISTINCT series_key, ts FROM src WHERE ts IS NOT NULL),
g AS (SELECT series_key, ts, CAST(floor(date_diff('microsecond', lag(ts) OVER
  (PARTITION BY series_key ORDER BY ts), ts) / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS gap FROM u),
a AS (SELECT series_key, count(gap) AS gaps, median(gap) AS median_days, stddev_samp(gap) AS std_days,
  count(*) AS unique_dates, CAST(floor(date_diff('microsecond', min(ts), max(ts))
    / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS range_days FROM g GROUP BY 1),
f AS (SELECT *, CASE WHEN median_days > 0 THEN std_days / median_days END AS cv,
  CASE WHEN median_days IS NULL THEN 'D' WHEN median_days <= 1 THEN 'D' WHEN median_days <= 7 THEN 'W'
   WHEN median_days <= 31 THEN 'MS' WHEN median_days <= 93 THEN 'QS' WHEN median_days <= 366 THEN 'YS'
   ELSE 'MS' END AS freq FROM a)"""


# One series per customer: few orders each, so the gaps range from days to years.
_CUSTOMER_GAPS = _gaps_sql("SELECT CAST(o_custkey AS VARCHAR) AS series_key, o_orderdate AS ts FROM orders")
_EVENT_GAPS = _gaps_sql("SELECT event_type AS series_key, ts FROM events")


@query("infer_frequency", f"""WITH {_CUSTOMER_GAPS} SELECT series_key, CASE
WHEN median_days >= 360 THEN 'YS' WHEN median_days >= 85 THEN 'QS' WHEN median_days >= 25 THEN 'MS'
WHEN median_days >= 6 THEN 'W' ELSE 'D' END AS freq FROM f""")
def _(spark, folder):
    return D.infer_frequency(table(spark, folder, "orders"), "o_orderdate", ("o_custkey",))


def _analysis(df):
    return df.select("series_key", "freq", "confidence", rnd(F.col("median_days"), 1).alias(
        "median_days"), rnd(F.col("std_days"), 4).alias("std_days"), rnd(F.col("cv"), 4).alias("cv"),
        "range_days", "unique_dates")


_ANALYSIS_COLS = f"""series_key, freq, CASE WHEN cv < 0.2 THEN 'high' WHEN cv < 0.5 THEN 'medium'
ELSE 'low' END AS confidence, {rsql('median_days', 1, 'median_days')},
{rsql('std_days', 4, 'std_days')}, {rsql('cv', 4, 'cv')}, range_days, unique_dates"""


@query("analyze_frequency", f"WITH {_CUSTOMER_GAPS} SELECT {_ANALYSIS_COLS} FROM f")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return _analysis(D.analyze_frequency(orders, "o_orderdate", ("o_custkey",)))


@query("analyze_frequency_events", f"WITH {_EVENT_GAPS} SELECT {_ANALYSIS_COLS} FROM f")
def _(spark, folder):
    events = table(spark, folder, "events")
    return _analysis(D.analyze_frequency(events, "ts", ("event_type",)))


@query("validate_frequency", f"""WITH {_CUSTOMER_GAPS}, w AS (SELECT series_key, CASE WHEN gaps < 1
  THEN ['{D.UNKNOWN}'] ELSE list_filter([CASE WHEN freq <> 'D' AND median_days > 7
    THEN 'data is ' || printf('%.1f', median_days) || ' days apart on average, not daily' END,
  CASE WHEN round(cv, 2) > 0.5 OR (cv IS NULL AND gaps > 1) THEN '{D.IRREGULAR}' END],
  lambda x: x IS NOT NULL) END AS warnings FROM f)
SELECT series_key, CASE WHEN len(warnings) > 0 THEN 'warning' ELSE 'ok' END AS status, warnings
FROM w""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return D.validate_frequency(D.analyze_frequency(orders, "o_orderdate", ("o_custkey",)), "D")


# --- requests ----------------------------------------------------------------------------------

def _messages(spark, folder):
    """Messages made from events: every kind of subject with every kind of attachment."""
    e, kind = F.col("event_id"), F.col("event_type")
    subject = (
        F.when(e % 6 == 0, F.concat(F.lit("[FORECAST:full:"), (e % 400).cast("string"), F.lit("]")))
        .when(e % 6 == 1, "Re: my forecast").when(e % 6 == 2, "forecast please")
        .when(e % 6 == 3, F.concat(F.lit("Forecast Ready: "), kind))
        .when(e % 6 == 4, "FORECAST:quick:12").otherwise("[forecast:odd]")
    )

    def file(name, mime):
        return F.struct(name.alias("name"), F.lit(mime).alias("mime"))

    data = F.concat(kind, F.lit(" 2024.csv"))
    files_ = (
        F.when(e % 5 == 0, F.array().cast("array<struct<name:string,mime:string>>"))
        .when(e % 5 == 1, F.array(file(F.lit("Sales Data.CSV"), "application/octet-stream")))
        .when(e % 5 == 2, F.array(file(F.lit("notes.txt"), "text/plain"), file(data, "text/csv")))
        .when(e % 5 == 3, F.array(file(F.lit("notes.txt"), "text/plain")))
        .otherwise(F.array(file(F.lit("blob"), "application/csv")))
    )
    sender = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
    return table(spark, folder, "events").select(
        subject.alias("subject"), sender.alias("sender"), files_.alias("attachments"))


_MESSAGES = """m AS (SELECT CASE event_id % 6 WHEN 0 THEN '[FORECAST:full:' || (event_id % 400) || ']'
  WHEN 1 THEN 'Re: my forecast' WHEN 2 THEN 'forecast please' WHEN 3 THEN 'Forecast Ready: ' || event_type
  WHEN 4 THEN 'FORECAST:quick:12' ELSE '[forecast:odd]' END AS subject,
  'user' || user_id || '@example.com' AS sender,
  CASE event_id % 5 WHEN 1 THEN 'Sales Data.CSV' WHEN 2 THEN event_type || ' 2024.csv'
    WHEN 4 THEN 'blob' END AS file FROM events),
kept AS (SELECT * FROM m WHERE file IS NOT NULL AND NOT (lower(subject) LIKE '%no csv attached%'
  OR lower(subject) LIKE '%forecast ready%' OR lower(subject) LIKE '%forecast failed%'
  OR (lower(subject) LIKE 're:%' AND lower(subject) LIKE '%forecast%'))),
parts AS (SELECT *, lower(regexp_extract(subject, '(?i)\\[?FORECAST:?([a-zA-Z]+)?:?(\\d+)?\\]?', 1)) AS mo,
  try_cast(regexp_extract(subject, '(?i)\\[?FORECAST:?([a-zA-Z]+)?:?(\\d+)?\\]?', 2) AS INTEGER) AS pe
  FROM kept),
parsed AS (SELECT subject, sender, CASE WHEN mo IN ('quick', 'full') THEN mo ELSE 'quick' END AS mode,
  CASE WHEN pe BETWEEN 1 AND 365 THEN pe ELSE 30 END AS periods,
  regexp_replace(regexp_replace(file, '(?i)\\.csv$', ''), '[^a-zA-Z0-9_-]', '_', 'g') AS dataset
  FROM parts)"""


@query("request_filter", f"WITH {_MESSAGES} SELECT subject, sender FROM kept")
def _(spark, folder):
    return Q.request_filter(_messages(spark, folder)).select("subject", "sender")


@query("request_parse", f"WITH {_MESSAGES} SELECT * FROM parsed")
def _(spark, folder):
    return Q.request_parse(Q.request_filter(_messages(spark, folder)))


@query("request_stream", f"WITH {_MESSAGES} SELECT * FROM parsed")
def _(spark, folder):
    inbox, out = _fresh(spark, "inbox"), _fresh(spark, "answers")
    _messages(spark, folder).write.json(inbox)

    def answer(batch: DataFrame, number: int) -> None:
        # A batch that is retried replaces its own answers.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    Q.request_stream(spark, inbox, _fresh(spark, "marks"), answer).awaitTermination()
    return spark.read.parquet(out).drop("batch")
