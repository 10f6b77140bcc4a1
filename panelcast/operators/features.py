"""History features: lags, rolling statistics, exponential means, and the whole feature matrix.

Every feature of a row uses only earlier rows of its series. All windows share one partitioning by
``series_key``, so the panel is exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.calendar import CALENDAR_NAMES, calendar_features, festival_days
from panelcast.functions.numeric import clip, tidy
from panelcast.operators.series import by_key, by_time

MAX_LAGS = 30
SEASONAL_LAGS = (182, 365)
ROLL_WINDOWS = (3, 7, 14, 30, 60, 90)
EWM_SPANS = (7, 30)
BOUND = 1e15
# Every series has every column, whatever the lengths of the others; what reaches before its own start
# is 0. A smaller number leaves out the columns that look further back.
EVERY = 1_000_000_000
# Rows of one block of the exponential mean at least; wider spans take longer blocks.
EWM_BLOCK = 512


def checked_lags(lags: int) -> int:
    """``lags``, if the feature matrix has so many."""
    if not 0 <= lags <= MAX_LAGS:
        raise ValueError(f"between 0 and {MAX_LAGS} lags, not {lags}")
    return lags


def lag_features(lags: int) -> dict[str, Column]:
    checked_lags(lags)
    w, zero = by_time(), F.lit(0.0)
    return {f"lag_{k}": F.coalesce(F.lag("y", k).over(w), zero) for k in range(1, lags + 1)}


def lag_diff(lags: int) -> dict[str, Column]:
    """Differences of two lags; 0 while either of them lies before the start."""
    def difference(k: int) -> Column:
        gap = F.lag("y", 1).over(by_time()) - F.lag("y", k).over(by_time())
        return F.coalesce(gap, F.lit(0.0))

    out = {}
    if lags >= 2:
        out["lag_diff_1"] = difference(2)
    if lags >= 8:
        out["lag_diff_7"] = difference(7)
    return out


def seasonal_lags(longest: int = EVERY) -> dict[str, Column]:
    """Half-year and year lags."""
    return {f"lag_{k}": F.coalesce(F.lag("y", k).over(by_time()), F.lit(0.0))
            for k in SEASONAL_LAGS if longest > k}


def window_plan(windows: tuple[int, ...]) -> dict[int, tuple[int, int] | None]:
    """For each window the two smaller ones it is the sum of, or nothing when it has none."""
    plan: dict[int, tuple[int, int] | None] = {}
    for k in sorted(windows):
        plan[k] = next(((a, k - a) for a in sorted(plan, reverse=True) if k - a in plan), None)
    return plan


def with_rolling(
    series: DataFrame, longest: int = EVERY, windows: tuple[int, ...] = ROLL_WINDOWS
) -> DataFrame:
    """Mean, deviation, maximum, minimum and variation of the k rows before; 0 until k rows exist.

    A window that is the sum of two smaller ones is merged from them (60 days from 30 and the 30
    before), with squared deviations merged so that no digits cancel. Only the others slide over
    their rows, which keeps the cost per row near that of the largest of them.
    """
    plan = window_plan(tuple(k for k in windows if longest > k))
    if not plan:
        return series
    base = series.columns
    slides: dict[str, Column] = {"_row": F.row_number().over(by_time())}
    for k, halves in plan.items():
        if halves is None:
            frame = by_time().rowsBetween(-k, -1)
            slides |= {f"_mean{k}": F.avg("y").over(frame), f"_var{k}": F.var_pop("y").over(frame),
                       f"_max{k}": F.max("y").over(frame), f"_min{k}": F.min("y").over(frame)}
    df = series.withColumns(slides)
    for k, halves in plan.items():
        if halves is None:
            continue
        (a, b) = halves
        near = {s: F.col(f"_{s}{a}") for s in ("mean", "var", "max", "min")}
        far = {s: F.lag(f"_{s}{b}", a).over(by_time()) for s in near}
        df = df.withColumns({f"_far_{s}": x for s, x in far.items()})
        gap = F.col("_far_mean") - near["mean"]
        pa, pb = F.lit(a / k), F.lit(b / k)
        df = df.withColumns({
            f"_mean{k}": near["mean"] * pa + F.col("_far_mean") * pb,
            f"_var{k}": near["var"] * pa + F.col("_far_var") * pb + gap * gap * pa * pb,
            f"_max{k}": F.greatest(near["max"], F.col("_far_max")),
            f"_min{k}": F.least(near["min"], F.col("_far_min")),
        }).drop(*[f"_far_{s}" for s in far])
    out = []
    for k in plan:
        mean = F.col(f"_mean{k}")
        sd = F.sqrt(F.col(f"_var{k}") * F.lit(k / max(k - 1, 1)))
        cv = clip(F.coalesce(F.try_divide(sd, mean + F.lit(1e-9)), F.lit(0.0)), -BOUND, BOUND)
        stats = {"mean": mean, "std": sd, "max": F.col(f"_max{k}"), "min": F.col(f"_min{k}"),
                 "cv": cv}
        out += [F.when(F.col("_row") > k, x).otherwise(F.lit(0.0)).alias(f"roll_{name}_{k}")
                for name, x in stats.items()]
    return df.select(*base, *out)


def ewm_block(span: int) -> int:
    return max(min(EWM_BLOCK, 300 * (span + 1)), 17 * (span + 1))


def with_ewm(series: DataFrame, spans: tuple[int, ...] = EWM_SPANS) -> DataFrame:
    """Exponentially weighted means of the earlier rows (adjusted weights), one column per span.

    The recursion num ← num·(1−a) + y is a weighted prefix sum. It is taken within blocks of rows,
    where the rescaled weights stay in range, plus the decayed total of the block before. A block has
    17 times the widest span, so what lies further back weighs less than 1e-14; spans too narrow for
    the weights of such a block are taken apart. The cost per row does not depend on the span.
    """
    if min(spans) < 1:
        raise ValueError("spans are 1 or more")
    if 1 in spans:  # only the last value counts
        last = F.coalesce(F.lag("y", 1).over(by_time()), F.lit(0.0)).alias("ewm_mean_1")
        rest = tuple(s for s in spans if s != 1)
        return (with_ewm(series, rest) if rest else series).select("*", last)
    for one in sorted(spans)[1:]:
        if ewm_block(one) > 300 * (min(spans) + 1):
            near = tuple(s for s in spans if s < one)
            wide = tuple(s for s in spans if s >= one)
            return with_ewm(with_ewm(series, near), wide)
    size = ewm_block(max(spans))
    key = by_key()
    block = Window.partitionBy("series_key", "_blk")
    upto = block.orderBy("_off").rowsBetween(Window.unboundedPreceding, -1)
    prior = key.orderBy("_blk").rangeBetween(-1, -1)
    zero, pos, off = F.lit(0.0), F.col("_pos").cast("double"), F.col("_off").cast("double")
    decays = {span: 1.0 - 2.0 / (span + 1.0) for span in spans}
    df = (
        series.withColumn("_pos", F.row_number().over(by_time()) - 1)
        .withColumn("_blk", F.floor(F.col("_pos") / size).cast("int"))
        .withColumn("_off", (F.col("_pos") % size).cast("int"))
        .withColumns({f"_g{s}": F.col("y") * F.pow(F.lit(d), -off) for s, d in decays.items()})
    )
    # Per row the weighted sum of the earlier rows of its block, and of the whole block; then the
    # sum of the block before. The three kinds of window run once for all spans.
    df = df.withColumns({f"_in{s}": F.sum(f"_g{s}").over(upto) for s in spans})
    df = df.withColumns({f"_all{s}": F.sum(f"_g{s}").over(block) for s in spans})
    df = df.withColumns({f"_was{s}": F.max(f"_all{s}").over(prior) for s in spans})
    means = {}
    for s, d in decays.items():
        own = F.coalesce(f"_in{s}", zero) * F.pow(F.lit(d), off - 1)
        carried = F.coalesce(f"_was{s}", zero) * F.pow(F.lit(d), off + (size - 1))
        mass = (F.lit(1.0) - F.pow(F.lit(d), pos)) / (1.0 - d)
        means[f"ewm_mean_{s}"] = F.when(pos > 0, (own + carried) / mass).otherwise(zero)
    return df.withColumns(means).drop(
        "_pos", "_blk", "_off", *[f"{p}{s}" for s in spans for p in ("_g", "_in", "_all", "_was")]
    )


def history_names(lags: int, longest: int) -> list[str]:
    """Names of the history features, in matrix order."""
    checked_lags(lags)
    names = [f"lag_{k}" for k in range(1, lags + 1)]
    names += ["lag_diff_1"] if lags >= 2 else []
    names += ["lag_diff_7"] if lags >= 8 else []
    names += [f"lag_{k}" for k in SEASONAL_LAGS if longest > k]
    for k in ROLL_WINDOWS:
        if longest > k:
            names += [f"roll_{stat}_{k}" for stat in ("mean", "std", "max", "min", "cv")]
    return names + [f"ewm_mean_{s}" for s in EWM_SPANS]


def feature_names(lags: int, longest: int = EVERY) -> list[str]:
    return [*CALENDAR_NAMES, *history_names(lags, longest)]


def short_windows(longest: int = EVERY) -> list[int]:
    return [k for k in (*SEASONAL_LAGS, *ROLL_WINDOWS) if longest > k]


# What pooled regressors see in place of a level that reaches before the start of its series.
STAND_IN = f"ewm_mean_{EWM_SPANS[-1]}"


def level_columns(k: int) -> list[str]:
    """Features of window ``k`` that are on the level of the series."""
    seasonal = [f"lag_{k}"] if k in SEASONAL_LAGS else []
    return seasonal + ([f"roll_{s}_{k}" for s in ("mean", "max", "min")] if k in ROLL_WINDOWS else [])


def model_names(lags: int, longest: int = EVERY) -> list[str]:
    """Inputs of the pooled regressors: the features, and for each long window whether the row lies
    before its first full one."""
    return [*feature_names(lags, longest), *[f"short_{k}" for k in short_windows(longest)]]


def history_features(series: DataFrame, lags: int, longest: int) -> DataFrame:
    """The series with all history columns."""
    # Lags come last: the windows before them then carry narrow rows.
    return with_ewm(with_rolling(series, longest)).withColumns(
        {**lag_features(lags), **lag_diff(lags), **seasonal_lags(longest)}
    )


def feature_matrix(
    series: DataFrame, lags: int = 14, longest: int = EVERY, warmup: str = "zero"
) -> DataFrame:
    """``(series_key, ds, y, features...)``, finite and clipped.

    ``warmup="drop"`` leaves out the rows whose lags reach before the start of the series.
    """
    extra = [c for c in series.columns if c not in ("series_key", "ds", "y")]
    # With a finite, bounded target every feature derived from it is finite too.
    series = series.withColumn("y", tidy(F.col("y"), BOUND))
    frame = history_features(series, lags, longest)
    frame = frame.withColumns(
        {c: x.cast("double") for c, x in calendar_features(F.col("ds")).items()}
    )
    if warmup == "drop":
        placed = frame.withColumn("_pos", F.row_number().over(by_time()))
        frame = placed.where(F.col("_pos") > lags).drop("_pos")
    names = feature_names(lags, longest)
    return frame.select(
        "series_key", "ds", *extra, "y", *names
    )


def feature_cleanup(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c)) for c in columns})


def last_feature_row(series: DataFrame, lags: int = 14, longest: int = EVERY) -> DataFrame:
    """Features of the newest row only, computed from the tail each of them can reach."""
    reach = max(checked_lags(lags), max(ROLL_WINDOWS), max(SEASONAL_LAGS) + 1) + 1
    newest_first = Window.partitionBy("series_key").orderBy(F.desc("ds"))
    tail = (
        series.withColumn("_back", F.row_number().over(newest_first))
        .where(F.col("_back") <= reach)
    )
    full = feature_matrix(tail, lags, min(longest, reach))
    return full.where(F.col("_back") == 1).drop("_back")


def festival_join(series: DataFrame) -> DataFrame:
    """Festival score of each row through the lookup of dates near a festival.

    The lookup keeps the dates that the series have, so a single date far away does not make it large, and
    the join carries no hint.
    """
    spark = series.sparkSession
    years = series.agg(F.min(F.year("ds")), F.max(F.year("ds"))).first()
    lookup = festival_days(spark, years[0] or 2000, years[1] or 2000).join(
        series.select("ds").distinct(), "ds", "left_semi")
    score = F.coalesce("score", F.lit(0.0))
    return (
        series.join(lookup, "ds", "left")
        .select("series_key", "ds", score.alias("festival_score"),
                (score > 0).cast("int").alias("near_festival"))
    )
