from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from panelcast.operators import diagnostics as G
from panelcast.operators import features as X
from panelcast.sources import detect as D
from panelcast.sources import files
from panelcast.sources import tables as T
from panelcast.streaming import requests as Q

SMALL = "/root/testdata/sf0.001"


def test_csv_with_mark_and_with_latin_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Date,City,Revenue\n2024-01-01,Zürich,5\n".encode())
    (tmp_path / "b.csv").write_bytes("Date,City,Revenue\n2024-01-01,Zürich,5\n".encode("latin-1"))
    for name in ("a.csv", "b.csv"):
        df = files.read_sales_csv(spark, str(tmp_path / name))
        assert df.columns == ["Date", "City", "Revenue"]
        assert df.first()["City"] == "Zürich" and dict(df.dtypes)["Revenue"] == "int"


def test_names_are_made_safe():
    assert files.safe_name("KNN (k=5)") == "KNN_k5"


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(f"2024-01-{i:02d}", i, 10.0 * i, 7, i / 3) for i in range(1, 29)]
    return spark.createDataFrame(
        rows, "day string, order_id int, `Total Revenue` double, amount_paid int, misc double")


def test_detection(sales):
    assert D.detect_date_simple(sales).first()[0] == "day"
    assert D.detect_date_scored(sales).first()["column"] == "day"
    assert D.detect_target(sales).first()["column"] == "Total Revenue"
    spec = D.infer_spec(sales)
    assert (spec.date_col, spec.target, spec.freq) == ("day", "Total Revenue", "D")


def test_target_penalty_hits_tokens_not_substrings(sales):
    df = sales.drop("Total Revenue").withColumn("amount_paid", sales.misc * 2)
    scores = {r["column"]: r["score"] for r in D.target_scores(df).collect()}
    assert scores["amount_paid"] == 500 + 40 + 15 + 10 + 10
    assert scores["order_id"] == 75 + 75 - 500 and scores["misc"] is None
    assert D.detect_target(df.select("day", "misc", "order_id").drop("order_id")).first()[0] == "misc"


def test_constant_columns_are_no_targets(sales):
    df = sales.select("day", "misc", "amount_paid")
    assert D.detect_target(df, style="ui").first()["column"] == "misc"


def test_frequency_rules(spark):
    def gaps(days):
        df = spark.createDataFrame([(datetime(2024, 1, 1 + d),) for d in days], "ts timestamp")
        return D.infer_frequency(df, "ts").first()["freq"], D.analyze_frequency(df, "ts").first()

    freq, analysis = gaps([0, 7, 14, 21])
    assert freq == "W" and (analysis.freq, analysis.confidence) == ("W", "high")
    freq, analysis = gaps([0, 3, 6])
    assert freq == "D" and analysis.freq == "W"
    one, analysis = gaps([4])
    assert one == "D" and analysis.confidence == "low"


def test_frequency_within_days_counts_zero_gaps(spark):
    stamps = [datetime(2024, 1, d, h) for d in (1, 8, 15) for h in (1, 2, 3, 4)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp")
    row = D.gap_profile(df, "ts").first()
    assert (row.gaps, row.median_days, row.max_days) == (11, 0.0, 6)
    warning = D.validate_frequency(D.analyze_frequency(df, "ts"), "D").first()
    assert warning.status == "warning" and warning.warnings == [D.IRREGULAR]


def messages(spark, rows):
    return spark.createDataFrame(rows, Q.MESSAGE_SCHEMA)


def test_requests(spark):
    csv = [("My Sales.csv", "x")]
    rows = [("[FORECAST:FULL:90]", "u", csv), ("forecast: 9999", "u", csv),
            ("Re: forecast", "u", csv), ("Your Forecast Ready", "u", csv),
            ("hello", "u", [("x.txt", "text/plain")]), ("x", "u", [(None, "text/csv")]),
            ("FORECAST:weird:0", "u", csv), ("no list", "u", None)]
    got = [(r.subject, r.mode, r.periods, r.dataset) for r in
           Q.request_parse(Q.request_filter(messages(spark, rows))).collect()]
    assert got == [("[FORECAST:FULL:90]", "full", 90, "My_Sales"),
                   ("forecast: 9999", "quick", 30, "My_Sales"),
                   ("x", "quick", 30, "attachment"),
                   ("FORECAST:weird:0", "quick", 30, "My_Sales")]


def test_stream_answers_each_message_once(spark, tmp_path):
    inbox, seen = str(tmp_path / "in"), []

    def answer(batch, number):
        seen.extend(r.subject for r in batch.collect())

    for subject in ("forecast a", "forecast b"):
        messages(spark, [(subject, "u", [("a.csv", "")])]).write.mode("append").json(inbox)
        Q.request_stream(spark, inbox, str(tmp_path / "marks"), answer).awaitTermination()
    assert seen == ["forecast a", "forecast b"]


def test_answers_are_summed_without_a_sort(spark):
    """The forecasts of all requests are many rows; a sort of them takes the memory that a task can get."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    out = entry_points.queries()["request_answers"](spark, SMALL)
    assert "SortAggregate" not in out._jdf.queryExecution().toString()
    want = con.execute(entry_points.oracle_sql()["request_answers"])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, out.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry_points(spark):
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 125
    out = entry_points.entry(spark)
    assert out.count() > 0 and "rank" in out.columns


@pytest.mark.parametrize("name", ["resample_sum", "fill_gaps", "series_summary", "acf",
                                  "forecast_metrics", "peak_trough", "pacf", "model_ar",
                                  "weighted_ensemble", "write_forecast_json"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "lineitem", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = con.execute(entry_points.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(repr([r[i] for i in order]) for r in result.fetchall())
    got = entry_points.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(repr(list(r)) for r in got) == want


@pytest.mark.parametrize("fact, keys", [
    ("orders", ()), ("orders", ("region", "status")), ("orders", ("segment",)), ("lineitem", ("brand", "nation")),
    ("lineitem", ("returnflag", "priority")), ("events", ("event_type",))])
def test_sums_before_joins_equal_sums_after(spark, fact, keys):
    rows = T.read_sales_table(spark, SMALL, fact, keys)
    want = {(r["series_key"], r["ds"]): r["s"] for r in rows.groupBy("series_key", "ds").agg(F.sum("y").alias("s")).collect()}
    got = {(r["series_key"], r["ds"]): r["y"] for r in T.read_sales_sums(spark, SMALL, fact, keys).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_sums_before_joins_shrink_what_is_joined(spark):
    plan = T.read_sales_sums(spark, SMALL, "orders", ("nation",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join") < plan.rindex("Aggregate")


def test_share_with_more_labels_than_a_list_holds(spark, monkeypatch):
    monkeypatch.setattr(G, "LABELS", 3)
    rows = [(f"r{i % 4}", None if i == 7 else f"c{i % 17}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "row string, col string, v double")
    got = {(r["row"], r["col"]): r["share"] for r in G.category_share(df, "row", "col", "v").collect()}
    total = {k: sum(v for a, _, v in rows if a == k) for k in ("r0", "r1", "r2", "r3")}
    assert len(got) == 4 * 17
    for (a, b), share in got.items():
        assert share == pytest.approx(sum(v for x, y, v in rows if (x, y) == (a, b)) / total[a])


def test_festival_scores_with_a_date_far_away(spark):
    near = spark.sql("SELECT 'a' AS series_key, explode(sequence(DATE'2024-01-01', DATE'2024-12-31')) AS ds")
    far = near.union(spark.sql("SELECT 'b', DATE'9999-06-01'"))
    rows = lambda df: {(r["series_key"], r["ds"]): r["festival_score"] for r in X.festival_join(df).collect()}
    got, want = rows(far), rows(near)
    assert len(got) == 367 and {k: v for k, v in got.items() if k[0] == "a"} == want and max(want.values()) == 1
