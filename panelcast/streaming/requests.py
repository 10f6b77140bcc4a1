"""Forecast requests as messages: which to answer, what they ask for, and a stream of them.

A message is ``(subject string, sender string, attachments array<struct<name, mime>>)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE_SCHEMA = (
    "subject string, sender string, attachments array<struct<name: string, mime: string>>"
)
# Subjects of the engine's own replies, and what counts as a CSV attachment.
OWN_REPLIES = ("no csv attached", "forecast ready", "forecast failed")
CSV_TYPES = ("text/csv", "application/csv")
REQUEST_PATTERN = r"(?i)\[?FORECAST:?([a-zA-Z]+)?:?(\d+)?\]?"
MODES = ("quick", "full")
DEFAULT_MODE, DEFAULT_PERIODS, MAX_PERIODS = "quick", 30, 365


def is_own_reply(subject: Column) -> Column:
    lowered = F.lower(F.coalesce(subject, F.lit("")))
    answered = lowered.startswith("re:") & lowered.contains("forecast")
    for phrase in OWN_REPLIES:
        answered = answered | lowered.contains(phrase)
    return answered


def is_csv(attachment: Column) -> Column:
    name = F.lower(F.coalesce(attachment["name"], F.lit("")))
    mime = F.lower(F.coalesce(attachment["mime"], F.lit("")))
    return name.endswith(".csv") | mime.isin(*CSV_TYPES)


def request_filter(messages: DataFrame) -> DataFrame:
    """Messages with a CSV attachment that are no replies of the engine."""
    has_csv = F.exists(F.coalesce("attachments", F.array()), is_csv)
    return messages.where(~is_own_reply(F.col("subject")) & has_csv)


def request_parse(messages: DataFrame) -> DataFrame:
    """Mode, number of periods and dataset name of each request.

    Unknown modes and period counts outside 1 to 365 fall back to the defaults.
    """
    subject = F.coalesce("subject", F.lit(""))
    mode = F.lower(F.regexp_extract(subject, REQUEST_PATTERN, 1))
    asked = F.regexp_extract(subject, REQUEST_PATTERN, 2).try_cast("int")
    file = F.coalesce(
        F.element_at(F.filter("attachments", is_csv), 1)["name"], F.lit("attachment.csv")
    )
    stem = F.regexp_replace(file, r"(?i)\.csv$", "")
    return messages.select(
        "subject", "sender",
        F.when(mode.isin(*MODES), mode).otherwise(DEFAULT_MODE).alias("mode"),
        F.when(asked.between(1, MAX_PERIODS), asked).otherwise(DEFAULT_PERIODS).alias("periods"),
        F.regexp_replace(stem, r"[^a-zA-Z0-9_-]", "_").alias("dataset"),
    )


def clamp_periods(periods: Column) -> Column:
    """Period count of a direct call, kept within 1 and 365."""
    return F.greatest(F.lit(1), F.least(periods, F.lit(MAX_PERIODS)))


def request_stream(
    spark: SparkSession, inbox: str, checkpoint: str,
    answer: Callable[[DataFrame, int], None], every: str | None = None,
) -> StreamingQuery:
    """Read messages that arrive as JSON files, and hand the parsed requests of each batch on.

    The checkpoint marks what was read, so every message is answered once. Without ``every`` the
    stream ends after the messages present.
    """
    messages = spark.readStream.schema(MESSAGE_SCHEMA).json(inbox)
    requests = request_parse(request_filter(messages))
    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
