"""Forecasts for parsed requests, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.plans.run import dataset_of, run_rows
from panelcast.session import cut_lineage
from panelcast.streaming.requests import MODES

#: Requests of one dataset and mode that are answered together; more of them are dealt over several tasks.
TOGETHER = 10_000
FORECAST_SCHEMA = "dataset string, mode string, series_key string, model string, step int, ds date, yhat double"


def answer_requests(
    requests: DataFrame, rows: DataFrame, freq: str, models: Callable[[str], dict] | None = None, **settings
) -> tuple[DataFrame, DataFrame]:
    """Forecasts of the requested datasets, and the status of each request.

    ``requests`` are those of ``request_parse``; ``rows`` has ``(dataset, series_key, ds, y)``. A dataset is run
    once per mode, as far as the longest request reaches, whatever the number of requests. Forecasts:
    ``(subject, sender, mode, periods, dataset, series_key, model, step, ds, yhat)``. Status: the request,
    ``messages`` (how often it came) and ``answered``, ``unknown dataset``, ``too short`` or ``failed``.

    Requests for one dataset are dealt over parts by a hash, and each part gets a copy of what is known of the dataset,
    so a dataset that is asked for often does not meet all its requests in one task.
    """
    spark = rows.sparkSession
    asked = cut_lineage(requests.groupBy("subject", "sender", "mode", "periods", "dataset").agg(
        F.count(F.lit(1)).alias("messages")))
    wanted = asked.groupBy("mode", "dataset").agg(F.max("periods").alias("periods"), F.count(F.lit(1)).alias("requests"))
    modes = wanted.groupBy("mode").agg(F.max("periods").alias("periods"), F.max("requests").alias("requests")).collect()
    reach = {r["mode"]: r["periods"] for r in modes}
    parts = -(-max([r["requests"] for r in modes], default=1) // TOGETHER)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("subject", "sender", "periods"), F.lit(parts)))
    places = cut_lineage(asked.select("dataset", "mode", "part").distinct())
    forecasts, modelled = [spark.createDataFrame([], FORECAST_SCHEMA)], []
    for mode in (m for m in MODES if m in reach):
        needed = wanted.where(F.col("mode") == mode).select("dataset")
        chosen = rows.join(needed, "dataset", "left_semi").select(
            F.concat_ws("/", "dataset", "series_key").alias("series_key"), "ds", "y")
        run = run_rows(chosen, freq, reach[mode], mode, models=models(mode) if models else None, **settings)
        of = {"dataset": dataset_of(F.col("series_key")), "mode": F.lit(mode)}
        forecasts.append(run.forecast.withColumns(of).withColumn(
            "series_key", F.expr("substring(series_key, length(dataset) + 2)")))
        modelled.append(run.series.select("series_key").withColumns(of).select("dataset", "mode").distinct())
    forecast = cut_lineage(reduce(DataFrame.unionByName, forecasts))
    copies = places.join(forecast, ["dataset", "mode"])
    answers = asked.join(copies, ["dataset", "mode", "part"]).where(F.col("step") <= F.col("periods")).select(
        "subject", "sender", "mode", "periods", "dataset", "series_key", "model", "step", "ds", "yhat")
    made = forecast.where(F.col("yhat").isNotNull()).groupBy("dataset", "mode").agg(F.lit(True).alias("made"))
    known = rows.select("dataset").distinct().withColumn("known", F.lit(True))
    found = places.join(known, "dataset", "left").join(made, ["dataset", "mode"], "left")
    long = reduce(DataFrame.unionByName, modelled).withColumn("long", F.lit(True)) if modelled else None
    found = found.join(long, ["dataset", "mode"], "left") if long is not None else found.withColumn("long", F.lit(False))
    state = F.when(F.col("made"), "answered").when(F.col("known").isNull(), "unknown dataset").when(
        F.col("long"), "failed").otherwise("too short")
    status = asked.join(found.select("dataset", "mode", "part", state.alias("status")), ["dataset", "mode", "part"], "left")
    return answers, status.select("subject", "sender", "mode", "periods", "dataset", "messages",
                                  F.coalesce("status", F.lit("unknown dataset")).alias("status"))


def forecast_answers(
    rows: DataFrame, freq: str, out: str, models: Callable[[str], dict] | None = None, **settings
) -> Callable[[DataFrame, int], None]:
    """Callback for ``request_stream`` that writes ``out/forecast`` and ``out/status``, a folder per batch. A batch
    that is retried replaces its own answers."""
    def answer(batch: DataFrame, number: int) -> None:
        answers, status = answer_requests(batch, rows, freq, models, **settings)
        answers.write.mode("overwrite").parquet(f"{out}/forecast/batch={number}")
        status.write.mode("overwrite").parquet(f"{out}/status/batch={number}")

    return answer
