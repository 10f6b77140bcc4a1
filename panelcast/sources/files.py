"""CSV and JSON in and out, named datasets, and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelcast.spec import REGISTRY, registry_table

BOM = "﻿"


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, else ISO-8859-1, which decodes any byte."""
    lines = spark.read.text(path)
    return "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def read_sales_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None,
    encoding: str | None = None, multiline: bool = True,
) -> DataFrame:
    """CSV with a header; quotes inside quotes are doubled. A given schema saves the pass that finds the
    types, a given encoding the pass that checks the bytes. With ``multiline`` values may hold line
    breaks, and a file is read by one task; large files without such values are better read without."""
    encoding = encoding or csv_encoding(spark, path)
    reader = spark.read.option("header", True).option("encoding", encoding).option(
        "multiLine", multiline).option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def preview_table(
    df: DataFrame, rows: int = 10, order: tuple[str, ...] = ()
) -> tuple[DataFrame, tuple[int, int]]:
    """First rows in the given order (by all columns without one), and number of rows and columns."""
    return df.orderBy(*(order or df.columns)).limit(rows), (df.count(), len(df.columns))


def missing_datasets(spark: SparkSession, present: DataFrame) -> DataFrame:
    """Registered names for which ``present(dataset)`` has no row."""
    return registry_table(spark).select("dataset").join(
        present.select("dataset").where(F.col("dataset").isin(*REGISTRY)).distinct(),
        "dataset", "left_anti",
    )


def safe_name(name: str) -> str:
    """File name part of a model name: spaces to underscores, parentheses and equals signs gone."""
    return name.replace(" ", "_").translate(str.maketrans("", "", "()="))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    writer = writer.partitionBy(*by) if by else writer
    writer.option("header", True).save(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(metrics, path, fmt, ("dataset",) if "dataset" in metrics.columns else ())


def write_forecast(forecast: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(forecast, path, fmt, ("dataset",) if "dataset" in forecast.columns else ())


def write_json_lines(result: DataFrame, path: str) -> None:
    """One JSON document per line from the ``json`` column."""
    result.select("json").write.mode("overwrite").text(path)
