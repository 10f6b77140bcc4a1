"""Finding the date column, the target column and the frequency of an unknown table.

Each detector profiles all rows in one distributed pass and scores the few resulting rows, one per
column, inside Spark. Column names are scored when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.dates import as_timestamp
from panelcast.operators.series import key_of
from panelcast.spec import SeriesSpec

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Parts of a column name that suggest a date.
SIMPLE_DATE_WORDS = ("date", "time", "period", "day", "month", "week")
DATE_WORDS = (
    (50, ("date", "datetime", "timestamp", "time")),
    (25, ("period", "day", "month", "year", "week")),
    (15, ("created", "updated", "modified", "added", "closed")),
)
DATE_ENDINGS = ((30, ("_date", "_datetime", "_timestamp")), (25, ("_time", "_at")))
DATE_SHORT_NAMES = ("dt", "ts", "d", "t")

# Target names. The first list wins outright; the rest is scored.
FIRST_TARGETS = ("revenue", "final_amount", "sales")
EXACT_TARGETS = {
    1000: (
        "total_revenue", "gross_revenue", "net_revenue", "sales_revenue", "total_sales",
        "gross_sales", "net_sales", "sale", "sales_amount", "total_income", "gross_income",
        "net_income", "income", "business_income", "total_profit", "gross_profit", "net_profit",
        "profit", "operating_profit", "final_amount", "gross_margin", "turnover",
        "revenue_total", "sales_total", "order_value", "order_amount", "transaction_value",
        "transaction_amount", "sales_value", "sales_volume", "sales_income", "monthly_sales",
        "daily_sales", "annual_revenue", "monthly_revenue", "annual_sales", "weekly_revenue",
        "weekly_sales",
    ),
    500: (
        "price", "value", "amount", "invoice_amount", "billing_amount", "payment_amount",
        "earnings", "operating_income", "total_earnings", "purchase_price", "selling_price",
        "unit_price", "product_price", "avg_price", "average_price", "contract_value",
        "due_amount", "amount_paid", "amount_received", "total_amount", "gross_amount",
        "net_amount", "profit_margin",
    ),
    200: (
        "transaction", "order", "billing", "margin", "growth", "volume", "retail_sales",
        "online_sales", "wholesale_sales", "product_sales", "revenue_growth", "sales_growth",
        "profit_growth", "gains", "proceeds", "quantity", "qty", "units", "count", "paid",
        "received", "earned",
    ),
}
PARTIAL_TARGETS = {
    300: ("revenue", "sales", "profit", "income"),
    150: ("amount", "value", "price", "earning", "turnover", "margin"),
    75: ("transaction", "order", "billing", "volume", "gains"),
}
ID_WORDS = ("id", "index", "code", "zip", "phone", "year", "month")
ID_PENALTY = 500


def is_numeric(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def is_temporal(dtype: str) -> bool:
    return dtype == "date" or dtype.startswith("timestamp")


def _columns(df: DataFrame) -> list[tuple[int, str, str]]:
    return [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]


def detect_date_simple(df: DataFrame) -> DataFrame:
    """First column with a date-like name, else the first text or date column of which more than
    ten values parse: one row ``(column)``, none when there is no candidate."""
    spark = df.sparkSession
    for _, name, _ in _columns(df):
        if any(word in name.lower() for word in SIMPLE_DATE_WORDS):
            return spark.createDataFrame([(name,)], "column string")
    candidates = [(i, n, t) for i, n, t in _columns(df) if t == "string" or is_temporal(t)]
    if not candidates:
        return spark.createDataFrame([], "column string")
    cells = [
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("column"),
                 F.count(as_timestamp(F.col(n), t)).alias("parsed"))
        for i, n, t in candidates
    ]
    profile = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return profile.where(F.col("parsed") > 10).orderBy("pos").limit(1).select("column")


def date_name_score(name: str) -> int:
    name = name.lower()
    score = sum(points for points, words in DATE_WORDS for w in words if w in name)
    score += sum(points for points, endings in DATE_ENDINGS if name.endswith(endings))
    return score + (10 if name in DATE_SHORT_NAMES else 0)


def _parsed(name: str, dtype: str) -> tuple[Column, Column]:
    """Value of a column read as a date, as one number, and its year. A number reads as nanoseconds
    since 1970."""
    c = F.col(f"`{name}`")
    if is_numeric(dtype):
        nanos = c.try_cast("bigint")
        return nanos, F.year(F.timestamp_micros(F.floor(nanos / 1000).cast("bigint")))
    if dtype == "string" or is_temporal(dtype):
        when = as_timestamp(c, dtype)
        return F.unix_micros(when), F.year(when)
    return F.lit(None).cast("bigint"), F.lit(None).cast("int")


def date_profile(df: DataFrame) -> list[dict]:
    """Per column its name score, non-null and parsed values, and first and last year.

    One pass without any exchange of rows; the result is one entry per column.
    """
    cells = []
    for _, name, dtype in _columns(df):
        value, year = _parsed(name, dtype)
        cells.append(F.struct(
            F.count(F.col(f"`{name}`")).alias("present"), F.count(value).alias("parsed"),
            F.min(year).alias("first_year"), F.max(year).alias("last_year")))
    out = []
    for (pos, name, _), cell in zip(_columns(df), df.agg(F.array(*cells)).first()[0], strict=True):
        seen = cell.asDict()
        dated = (
            seen["present"] > 0 and seen["parsed"] >= 0.8 * seen["present"]
            and seen["first_year"] >= 1950 and seen["last_year"] <= 2100
        )
        out.append({"pos": pos, "column": name, "name_score": date_name_score(name),
                    "dated": dated, **seen})
    return out


def distinct_values(df: DataFrame, names: list[str]) -> DataFrame:
    """Exact number of distinct dates of some columns: ``(column, distinct)``.

    Values are grouped with their column name first, which spreads every column over all tasks.
    """
    types = dict(df.dtypes)
    pairs = [F.struct(F.lit(n).alias("column"), _parsed(n, types[n])[0].alias("value"))
             for n in names]
    values = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def date_scores(df: DataFrame, undecided_only: bool = False) -> DataFrame:
    """Name score plus data score of every column.

    Distinct values matter only for columns full of dates in range. With ``undecided_only`` they are
    counted just for the columns whose score can still change the choice of the best one.
    """
    profile = date_profile(df)
    wanted = [p for p in profile if p["dated"] and p["present"] >= 5]
    if undecided_only and wanted:
        best = max(p["name_score"] + 15 for p in wanted)
        wanted = [p for p in wanted if p["name_score"] + 25 > best - 20]
    schema = ("pos int, column string, name_score int, dated boolean, present long, parsed long, "
              "first_year int, last_year int")
    fields = [f.split()[0] for f in schema.split(", ")]
    spark = df.sparkSession
    table = spark.createDataFrame([tuple(p[f] for f in fields) for p in profile], schema)
    counted = (
        distinct_values(df, [p["column"] for p in wanted]) if wanted
        else spark.createDataFrame([], "column string, distinct long")
    )
    unique = F.coalesce(F.try_divide(F.col("distinct"), F.col("parsed")) > 0.5, F.lit(False))
    data = F.when(F.col("dated"), F.lit(15) + unique.cast("int") * 10).otherwise(0)
    few = F.when(F.col("name_score") > 30, F.col("name_score")).otherwise(0)
    score = F.when(F.col("present") < 5, few).otherwise(F.col("name_score") + data)
    return table.join(counted, "column", "left").withColumn("score", score)


def detect_date_scored(df: DataFrame) -> DataFrame:
    """The best date column: ``(column, score)``.

    When the runner-up is less than 20 points behind, it wins with 20 % more parsed values, or with
    a longer span of years.
    """
    scores = date_scores(df, undecided_only=True)
    fits = (F.col("present") > 10) & (F.try_divide(F.col("parsed"), F.col("present")) > 0.9)
    # Without any scored column: the first one that parses, else the first one.
    tier = F.when(F.col("score") > 0, 0).when(fits, 1).otherwise(2)
    order = F.when(F.col("score") > 0, -F.col("score")).otherwise(0)
    entry = F.struct(
        tier.alias("tier"), order.alias("order"), "pos", "column", "score", "parsed",
        (F.col("last_year") - F.col("first_year")).alias("span"),
    )
    # One entry per column of the table.
    ranked = scores.agg(F.array_sort(F.collect_list(entry)).alias("r"))
    pair = ranked.select(F.get("r", F.lit(0)).alias("a"), F.get("r", F.lit(1)).alias("b"))
    a, b = F.col("a"), F.col("b")
    close = (b["score"] > 0) & (a["score"] - b["score"] < 20)
    swap = close & (
        (b["parsed"] > a["parsed"] * 1.2)
        | ((a["parsed"] > 0) & (b["parsed"] > 0) & (b["span"] > a["span"]))
    )
    chosen = F.when(F.coalesce(swap, F.lit(False)), b).otherwise(a)
    return pair.select(chosen["column"].alias("column"), chosen["score"].alias("score"))


def target_name_score(name: str) -> int:
    name = _plain(name)
    for points, words in EXACT_TARGETS.items():
        if name in words:
            return points
    return max((p for p, words in PARTIAL_TARGETS.items() if any(w in name for w in words)),
               default=0)


def _plain(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def target_scores(df: DataFrame, exclude: tuple[str, ...] = (), id_penalty: bool = True) -> DataFrame:
    """Profile and score of every numeric column from one aggregation without exchange of rows.

    Two different values exist exactly when minimum and maximum differ, so no distinct count runs.
    """
    cells = []
    for i, name, dtype in _columns(df):
        if not is_numeric(dtype) or name in exclude:
            continue
        c = F.col(f"`{name}`").cast("double")
        c = F.when(~F.isnan(c), c)
        plain = _plain(name)
        penalty = ID_PENALTY if id_penalty and set(plain.split("_")) & set(ID_WORDS) else 0
        first = any(w in plain for w in FIRST_TARGETS)
        cells.append(F.struct(
            F.lit(i).alias("pos"), F.lit(name).alias("column"), F.lit(first).alias("first"),
            F.lit(target_name_score(name)).alias("name_score"), F.lit(penalty).alias("penalty"),
            F.count(F.lit(1)).alias("rows"), F.count(c).alias("present"),
            (F.min(c) < F.max(c)).alias("varies"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("sd"), F.count_if(c > 0).alias("positive"),
        ))
    if not cells:
        raise ValueError("the table has no numeric column")
    profile = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    ratio = F.try_divide(F.col("positive"), F.col("present"))
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean")).otherwise(F.lit(1.0))
    nulls = F.lit(1.0) - F.try_divide(F.col("present"), F.col("rows"))
    bonus = (
        F.when(ratio >= 0.9, 40).when(ratio >= 0.7, 20).otherwise(0)
        + F.when(F.col("mean") > 0, 15).otherwise(0)
        + F.when((F.col("sd") > 0) & (cv > 0.01) & (cv < 5.0), 10).otherwise(0)
        + F.when(nulls < 0.1, 10).otherwise(0)
    )
    usable = (F.col("present") >= 3) & F.coalesce("varies", F.lit(False))
    scored = F.when(
        usable & (F.col("name_score") > 0), F.col("name_score") + bonus - F.col("penalty")
    )
    return profile.withColumn("usable", usable).withColumn("score", scored)


def detect_target(df: DataFrame, exclude: tuple[str, ...] = (), style: str = "cli") -> DataFrame:
    """The target column: ``(column, score)``.

    Without a scored column ``style="cli"`` takes the last numeric column, ``style="ui"`` the first
    usable one. Only the first style penalises identifiers.
    """
    scores = target_scores(df, exclude, id_penalty=style == "cli")
    first = F.col("first") & F.col("usable")
    tier = F.when(first, 0).when(F.col("score").isNotNull(), 1)
    if style == "ui":
        tier = tier.when(F.col("usable"), 2)
        last = F.col("pos")
    else:
        last = -F.col("pos")
    tier = tier.otherwise(3)
    within = F.when(tier == 0, F.lit(0)).when(tier == 1, -F.col("score")).otherwise(F.lit(0))
    place = F.when(tier == 3, last).otherwise(F.col("pos"))
    return scores.orderBy(tier, within, place).limit(1).select("column", "score")


def gap_profile(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Days between consecutive distinct timestamps of each key: median, deviation, range.

    The distinct timestamps of a day differ by less than a day, so a day contributes its count minus
    one gaps of 0 and one gap to the day before. Only days, not timestamps, reach the window.
    """
    ts = as_timestamp(F.col(column), dict(df.dtypes)[column])
    distinct = df.select(key_of(keys).alias("series_key"), ts.alias("ts")).where(
        F.col("ts").isNotNull()
    ).distinct()
    days = distinct.groupBy("series_key", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    before = F.lag("hi").over(Window.partitionBy("series_key").orderBy("day"))
    gap = F.timestamp_diff("DAY", before, F.col("lo"))
    pairs = days.withColumn("gap", gap).select(
        "series_key", "n", "lo", "hi",
        F.inline(F.array(
            F.struct(F.col("gap").alias("days"), F.lit(1).cast("bigint").alias("weight")),
            F.struct(F.lit(0).cast("bigint").alias("days"), (F.col("n") - 1).alias("weight")),
        )),
    )
    real = F.col("days").isNotNull() & (F.col("weight") > 0)
    w = F.when(real, F.col("weight")).otherwise(F.lit(0))
    d = F.coalesce("days", F.lit(0))
    stats = pairs.groupBy("series_key").agg(
        F.sum(w).alias("gaps"), F.sum(w * d).alias("s1"), F.sum(w * d * d).alias("s2"),
        F.percentile(F.when(real, F.col("days")).cast("double"), F.lit(0.5), w).alias("median_days"),
        F.min(F.when(real, F.col("days"))).alias("min_days"),
        F.max(F.when(real, F.col("days"))).alias("max_days"),
        F.min("lo").alias("first"), F.max("hi").alias("last"),
    )
    n = F.col("gaps").cast("double")
    variance = F.try_divide(F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), n), n - 1)
    sd = F.when(F.col("gaps") > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))
    return stats.select(
        "series_key", "gaps", "median_days", sd.alias("std_days"), "min_days", "max_days",
        F.when(F.col("median_days") > 0, sd / F.col("median_days")).alias("cv"),
        F.timestamp_diff("DAY", F.col("first"), F.col("last")).alias("range_days"),
        (F.col("gaps") + 1).alias("unique_dates"),
    )


# The two frequency rules, as (limit in days, frequency).
FLOOR_RULE = ((360, "YS"), (85, "QS"), (25, "MS"), (6, "W"))
CEILING_RULE = ((1, "D"), (7, "W"), (31, "MS"), (93, "QS"), (366, "YS"))


def floor_frequency(median: Column) -> Column:
    """The coarsest frequency whose limit the median gap reaches; daily below all."""
    rule = F.when(F.lit(False), F.lit(""))
    for limit, freq in FLOOR_RULE:
        rule = rule.when(median >= limit, F.lit(freq))
    return rule.otherwise(F.lit("D"))


def ceiling_frequency(median: Column) -> Column:
    """The finest frequency whose limit the median gap keeps; monthly above all."""
    rule = F.when(median.isNull(), F.lit("D"))
    for limit, freq in CEILING_RULE:
        rule = rule.when(median <= limit, F.lit(freq))
    return rule.otherwise(F.lit("MS"))


def infer_frequency(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return gap_profile(df, column, keys).select(
        "series_key", floor_frequency(F.col("median_days")).alias("freq")
    )


def analyze_frequency(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Frequency with a confidence from how regular the gaps are."""
    cv = F.col("cv")
    confidence = F.when(cv < 0.2, "high").when(cv < 0.5, "medium").otherwise("low")
    return (
        gap_profile(df, column, keys)
        .withColumn("freq", ceiling_frequency(F.col("median_days")))
        .withColumn("confidence", confidence)
    )


# Largest median gap in days for which a chosen frequency is fine.
TOO_FINE = {"D": 7, "W": 35, "MS": 180, "QS": 400}
_FINE_TEXT = {
    "D": "data is {} days apart on average, not daily",
    "W": "data is less frequent than weekly",
    "MS": "data is less frequent than monthly",
    "QS": "data is less frequent than quarterly",
}
IRREGULAR = "date intervals are highly irregular"
UNKNOWN = "data structure could not be analysed"


def validate_frequency(analysis: DataFrame, chosen: str) -> DataFrame:
    """Warnings about choosing a frequency: ``(series_key, status, warnings)``."""
    warnings = []
    if chosen in TOO_FINE:
        median = F.format_string("%.1f", "median_days")
        before, _, after = _FINE_TEXT[chosen].partition("{}")
        text = F.concat(F.lit(before), median, F.lit(after)) if after else F.lit(before)
        differs = F.col("freq") != chosen
        warnings.append(F.when(differs & (F.col("median_days") > TOO_FINE[chosen]), text))
    irregular = F.coalesce(F.round("cv", 2) > 0.5, F.col("gaps") > 1)
    warnings.append(F.when(irregular, F.lit(IRREGULAR)))
    found = F.when(F.col("gaps") < 1, F.array(F.lit(UNKNOWN))).otherwise(
        F.array_compact(F.array(*warnings)))
    return analysis.select(
        "series_key", F.when(F.size(found) > 0, "warning").otherwise("ok").alias("status"),
        found.alias("warnings"),
    )


def infer_spec(df: DataFrame, description: str = "auto-detected", style: str = "cli") -> SeriesSpec:
    """Specification of an unknown table: date, target and frequency are detected in turn."""
    finder = detect_date_simple if style == "cli" else detect_date_scored
    found = finder(df).first()
    if found is None:
        raise ValueError("no date column found; give a mapping")
    date_col = found["column"]
    target = detect_target(df, (date_col,), style).first()["column"]
    finder = infer_frequency if style == "cli" else analyze_frequency
    freq = finder(df, date_col).first()
    return SeriesSpec(date_col, target, freq["freq"] if freq else "D", description)
