"""Regressors fitted by Spark ML on the feature rows of all series together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import CALENDAR_NAMES, calendar_features
from panelcast.models.base import Read, series_arrays
from panelcast.models.binned import TreeSettings, bin_panel, fit_ensembles
from panelcast.models.gram import bayesian_ridge, gram, ridge
from panelcast.models.predictors import FourierPredictor, LinearPredictor, TreePredictor
from panelcast.models.recursion import roll_forward
from panelcast.operators.features import (
    EVERY,
    ROLL_WINDOWS,
    STAND_IN,
    feature_matrix,
    level_columns,
    model_names,
    short_windows,
)
from panelcast.operators.series import log1p_transform, with_position

SEED = 42


def future_calendars(future: DataFrame) -> DataFrame:
    """Date features of the coming steps of each series, as one array per series in step order."""
    dated = future.withColumns(calendar_features(F.col("ds"))).select(
        "series_key", "step", "ds", *[F.col(c).cast("double").alias(c) for c in CALENDAR_NAMES]
    )
    step = F.struct("step", "ds", F.array(*CALENDAR_NAMES).alias("calendar"))
    rows = F.sort_array(F.collect_list(step))
    return dated.groupBy("series_key").agg(rows.alias("_s")).select(
        "series_key", F.col("_s.step").alias("steps"), F.col("_s.ds").alias("dates"),
        F.col("_s.calendar").alias("calendars"),
    )


@dataclass(frozen=True)
class Fitted:
    """A fitted regressor: a predictor and how its features are formed."""

    predictor: Callable[[np.ndarray], np.ndarray]
    lags: int
    longest: int
    log: bool
    signed: bool
    importance: np.ndarray | None = None

    @property
    def names(self) -> list[str]:
        return model_names(self.lags, self.longest)

    def history(self, train: DataFrame) -> DataFrame:
        """What a forecast needs to know of each series: its values on the model's scale."""
        work = log1p_transform(train, self.log)
        flags = work.groupBy("series_key").agg(F.first("use_log").alias("use_log"))
        return series_arrays(work.drop("use_log")).join(flags, "series_key")

    def forecast(self, train: DataFrame, future: DataFrame) -> DataFrame:
        return self.forecast_from(self.history(train), future)

    def forecast_from(self, history: DataFrame, future: DataFrame) -> DataFrame:
        predictor, lags, longest, signed = self.predictor, self.lags, self.longest, self.signed
        shared = future.sparkSession.sparkContext.broadcast(predictor)

        def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            predict = shared.value
            for batch in batches:
                values = [np.asarray(v, dtype=float) for v in batch["ys"]]
                counts = batch["steps"].map(len).to_numpy()
                calendars = np.zeros((len(batch), counts.max(), len(CALENDAR_NAMES)))
                for i, rows in enumerate(batch["calendars"]):
                    calendars[i, :counts[i]] = np.stack(rows)
                paths = roll_forward(values, calendars, batch["use_log"].to_numpy(dtype=bool),
                                     predict, lags, longest, signed, marks=True)
                yield pd.DataFrame({
                    "series_key": batch["series_key"], "steps": batch["steps"],
                    "dates": batch["dates"],
                    "yhats": [p[:n] for p, n in zip(paths, counts, strict=True)],
                })

        paths = history.join(future_calendars(future), "series_key").mapInPandas(
            advance,
            "series_key string, steps array<int>, dates array<date>, yhats array<double>",
        )
        zipped = F.arrays_zip(F.col("steps").alias("step"), F.col("dates").alias("ds"),
                              F.col("yhats").alias("yhat"))
        return paths.select("series_key", F.inline(zipped)).toDF("series_key", "step", "ds", "yhat")

    def feature_importance(self, spark) -> DataFrame:
        """Importance of each feature, or size of its coefficient: ``(feature, importance)``."""
        if self.importance is None:
            return spark.createDataFrame([], "feature string, importance double")
        rows = list(zip(self.names, map(float, self.importance), strict=True))
        return spark.createDataFrame(rows, "feature string, importance double")


_KINDS = {"linear": LinearPredictor, "tree": TreePredictor, "fourier": FourierPredictor}
FITTED_SCHEMA = (
    "kind string, part string, shape array<int>, whole boolean, numbers array<double>, lags int, "
    "longest int, log boolean, signed boolean"
)


def _parts(predictor) -> list[tuple[str, np.ndarray]]:
    out = []
    for name, value in vars(predictor).items():
        if isinstance(value, LinearPredictor):
            out += [(f"{name}.{n}", v) for n, v in _parts(value)]
        else:
            out.append((name, np.asarray(value)))
    return out


def fitted_table(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """The numbers of a fitted regressor, one row per array."""
    kind = next(k for k, cls in _KINDS.items() if isinstance(fitted.predictor, cls))
    parts = _parts(fitted.predictor)
    if fitted.importance is not None:
        parts.append(("importance", fitted.importance))
    rows = [
        (kind, name, list(map(int, a.shape)), a.dtype.kind == "i", a.astype(float).ravel().tolist(),
         fitted.lags, fitted.longest, fitted.log, fitted.signed)
        for name, a in parts
    ]
    return spark.createDataFrame(rows, FITTED_SCHEMA).coalesce(1)


def fitted_from(table: DataFrame) -> Fitted:
    """The regressor that a table of ``fitted_table`` describes; its size is that of the model."""
    rows = table.collect()
    arrays = {}
    for r in rows:
        a = np.array(r["numbers"], dtype=int if r["whole"] else float).reshape(r["shape"])
        arrays[r["part"]] = a if a.shape else a.item()
    importance = arrays.pop("importance", None)
    nested = {k: v for k, v in arrays.items() if "." in k}
    plain = {k: v for k, v in arrays.items() if "." not in k}
    for outer in {k.split(".")[0] for k in nested}:
        inner = {k.split(".")[1]: v for k, v in nested.items() if k.startswith(f"{outer}.")}
        plain[outer] = LinearPredictor(**inner)
    first = rows[0]
    return Fitted(_KINDS[first["kind"]](**plain), first["lags"], first["longest"], first["log"],
                  first["signed"], importance)


def training_frame(
    train: DataFrame, lags: int, longest: int, log: bool, warmup: str = "zero"
) -> DataFrame:
    """Feature rows on the scale the regressor works in.

    Where a window or a seasonal lag reaches before the start of its series, the exponential mean stands
    in for it and a mark says so: zeros would tilt a linear model so far that its recursion can diverge.
    ``warmup="drop"`` leaves out up to a quarter of each series.
    """
    placed = with_position(feature_matrix(log1p_transform(train, log), lags, longest))
    for k in short_windows(longest):
        short = F.col("pos") < k
        placed = placed.withColumns({
            f"short_{k}": short.cast("double"),
            **{c: F.when(short, F.col(STAND_IN)).otherwise(F.col(c)) for c in level_columns(k)}})
    if warmup == "zero":
        return placed.drop("pos", "n")
    return placed.where(F.col("pos") >= warm_rows(F.col("n"))).drop("pos", "n")


def warm_rows(n: Column) -> Column:
    """Rows of a series of length n that count as warm-up."""
    return F.least(F.lit(max(ROLL_WINDOWS)), F.floor(n / 4).cast("int"))


@dataclass(frozen=True)
class PooledRegressor:
    """A regressor over lag, rolling and calendar features.

    ``solve`` gets the cached feature rows and their names and returns a predictor with an optional
    importance vector. ``signed=True`` lets it predict below zero, for use on differences.
    """

    id: str
    name: str
    solve: Callable[[DataFrame, list[str]], tuple]
    lags: int = 14
    log: bool = True
    signed: bool = False
    options: dict = field(default_factory=dict, hash=False)
    warmup: str = "zero"
    pooled: bool = True

    @property
    def shape(self) -> tuple:
        """What the feature rows depend on; models of equal shape can share them."""
        return self.lags, self.log, self.warmup

    @property
    def ensemble(self) -> TreeSettings | None:
        """Settings of a tree ensemble; several of them are fitted side by side."""
        return TreeSettings(**self.options) if self.solve is solve_ensemble else None

    def features(self, train: DataFrame) -> DataFrame:
        return training_frame(train, self.lags, EVERY, self.log, self.warmup)

    def fit_on(self, frame: DataFrame) -> Fitted:
        """Fit on the feature rows of a training panel, which the caller has stored."""
        return self.fitted(*self.solve(frame, model_names(self.lags, EVERY), **self.options))

    def fitted(self, predictor: Callable, importance: np.ndarray | None) -> Fitted:
        return Fitted(predictor, self.lags, EVERY, self.log, self.signed, importance)

    def fit(self, train: DataFrame) -> Fitted:
        frame = self.features(train).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self.fit_on(frame)
        finally:
            frame.unpersist()

    def forecast(self, train: DataFrame, future: DataFrame) -> DataFrame:
        return self.fit(train).forecast(train, future)

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        fitted = self.fit(train)
        return {"regressor": fitted_table(train.sparkSession, fitted), "history": fitted.history(train)}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        return fitted_from(read("regressor")).forecast_from(read("history"), future)

    @staticmethod
    def fit_all(models: list[PooledRegressor], frame: DataFrame) -> list[Fitted]:
        """Tree ensembles of equal ``shape``, fitted on one binned copy of their feature rows."""
        panel = bin_panel(frame, model_names(models[0].lags, EVERY))
        try:
            found = fit_ensembles(panel, [m.ensemble for m in models])
        finally:
            panel.unpersist()
        return [m.fitted(*f) for m, f in zip(models, found, strict=True)]

    def with_options(self, **options) -> PooledRegressor:
        return replace(self, options={**self.options, **options})


def assemble(frame: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(frame).select(
        "features", "y"
    )


@dataclass(frozen=True)
class Profile:
    """Row count, label deviation, and the features that vary, from one pass."""

    n: int
    deviation: float
    live: np.ndarray


def profile(frame: DataFrame, names: list[str]) -> Profile:
    ends = [F.array(F.min(c), F.max(c)) for c in names]
    row = frame.agg(F.count(F.lit(1)), F.stddev_pop("y"), F.array(*ends)).first()
    live = np.array([low != high for low, high in row[2]])
    return Profile(int(row[0]), float(row[1] or 0.0), live)


# --- linear family -----------------------------------------------------------------------------
#
# Spark scales features and label by their population deviation before it penalises, as a scaler in
# front of the regressor would. With n rows and label deviation s, the penalties of
# "squared error / 2n + a·r·|w| + a·(1−r)/2·|w|²" become:
#   lasso         regParam = a,     elasticNetParam = 1
#   elastic net   regParam = a·r + a·(1−r)·s, elasticNetParam = a·r / regParam


def _linear(frame: DataFrame, names: list[str], seen: Profile, **params) -> tuple:
    """Fit on the features that vary. A constant one would enter with a deviation of pure rounding
    noise and an arbitrarily large coefficient."""
    used = [c for c, live in zip(names, seen.live, strict=True) if live]
    model = LinearRegression(labelCol="y", standardization=True, **params).fit(
        assemble(frame, used)
    )
    w = np.zeros(len(names))
    w[seen.live] = model.coefficients.toArray()
    return LinearPredictor(w, float(model.intercept)), np.abs(w)


def solve_linear(frame: DataFrame, names: list[str]) -> tuple:
    """Shortest least-squares solution: some calendar features repeat each other, so the normal
    equations have no unique one."""
    g = gram(frame, names)
    w, b = g.plain(ridge(g, 0.0))
    return LinearPredictor(w, b), np.abs(w)


def solve_ridge(frame: DataFrame, names: list[str], alpha: float = 1.0) -> tuple:
    """From the same moments as the plain fit, in one pass."""
    g = gram(frame, names)
    w, b = g.plain(ridge(g, alpha))
    return LinearPredictor(w, b), np.abs(w)


def solve_lasso(frame: DataFrame, names: list[str], alpha: float = 0.01) -> tuple:
    return _linear(frame, names, profile(frame, names), regParam=alpha, elasticNetParam=1.0,
                   maxIter=5000, tol=1e-8)


def solve_elasticnet(
    frame: DataFrame, names: list[str], alpha: float = 0.01, ratio: float = 0.5
) -> tuple:
    seen = profile(frame, names)
    strength = alpha * ratio + alpha * (1 - ratio) * seen.deviation
    return _linear(frame, names, seen, regParam=strength,
                   elasticNetParam=alpha * ratio / strength, maxIter=5000, tol=1e-8)


def solve_huber(
    frame: DataFrame, names: list[str], epsilon: float = 1.35, alpha: float = 1e-4
) -> tuple:
    seen = profile(frame, names)
    return _linear(frame, names, seen, loss="huber", epsilon=epsilon, regParam=alpha / seen.n,
                   maxIter=600, tol=1e-4)


def solve_bayesian_ridge(frame: DataFrame, names: list[str]) -> tuple:
    w, b = bayesian_ridge(gram(frame, names))
    return LinearPredictor(w, b), np.abs(w)


# --- trees -------------------------------------------------------------------------------------


def solve_ensemble(frame: DataFrame, names: list[str], **options) -> tuple:
    """Decision trees, forests and boosted trees: see ``TreeSettings`` for the options."""
    panel = bin_panel(frame, names)
    try:
        return fit_ensembles(panel, [TreeSettings(**options)])[0]
    finally:
        panel.unpersist()


# --- kernel ------------------------------------------------------------------------------------


def _tube_sums(expanded: DataFrame, w: np.ndarray, epsilon: float, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over the rows outside the tube, each weighted by one over its distance to it: moments of the
    features, moments with the label moved to the tube, and the distances themselves."""
    size = len(w)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 2))
        for f in batches:
            z = np.column_stack([np.stack(f["z"]), np.ones(len(f))])
            y = f["y"].to_numpy(dtype=float)
            rest = y - z @ w
            out = np.abs(rest) - epsilon
            pull = np.where(out > 0, 1.0 / np.maximum(out, least), 0.0)
            weighted = z * pull[:, None]
            total[:, :size] += weighted.T @ z
            total[:, size] += weighted.T @ (y - epsilon * np.sign(rest))
            total[0, size + 1] += np.maximum(out, 0.0).sum()
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    cells = expanded.mapInPandas(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    total = np.zeros((size, size + 2))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas().itertuples():
        total[r.i, r.j] = r.v
    return total[:, :size], total[:, size], float(total[0, size + 1])


def solve_fourier(
    frame: DataFrame, names: list[str], components: int = 200, c: float = 10.0,
    epsilon: float = 0.05, rounds: int = 30, tol: float = 1e-3,
) -> tuple:
    """Support vector regression with a radial-basis kernel through random Fourier features.

    Minimises half the squared weights plus ``c`` times what lies outside the tube of ``epsilon``. Each round is
    one pass that sums a quadratic bound of the loss at the present weights; its minimum is the next ones.
    """
    stats = frame.agg(*[F.avg(x) for x in names], *[F.stddev_pop(x) for x in names], F.avg("y"), F.stddev_pop("y")).first()
    p = len(names)
    mean = np.array(stats[:p], dtype=float)
    scale = np.array(stats[p:2 * p], dtype=float)
    scale = np.where(scale > 0, scale, 1.0)
    rng = np.random.default_rng(SEED)
    weights = rng.normal(0.0, np.sqrt(2.0 / p), (p, components))
    offsets = rng.uniform(0.0, 2 * np.pi, components)
    blank = LinearPredictor(np.zeros(components), 0.0)
    fourier = FourierPredictor(mean, scale, weights, offsets, blank)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = fourier.features(batch[names].to_numpy(dtype=float))
            yield pd.DataFrame({"z": list(z), "y": batch["y"]})

    expanded = frame.select(*names, "y").mapInPandas(expand, "z array<double>, y double").persist(StorageLevel.MEMORY_AND_DISK)
    least = 1e-3 * max(float(stats[-1] or 0.0), 1e-9)
    w = np.append(np.zeros(components), float(stats[-2] or 0.0))
    free = np.diag(np.append(np.ones(components), 1e-9))
    before = np.inf
    try:
        for _ in range(rounds):
            moments, target, outside = _tube_sums(expanded, w, epsilon, least)
            value = 0.5 * float(w[:-1] @ w[:-1]) + c * outside
            if not value < before * (1 - tol):
                break
            before, w = value, np.linalg.solve(free + c * moments, c * target)
    finally:
        expanded.unpersist()
    return replace(fourier, linear=LinearPredictor(w[:-1], float(w[-1]))), None
