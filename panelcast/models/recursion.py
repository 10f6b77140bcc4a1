"""Step-by-step forecasts of regression models, many series at once inside a task.

A regressor predicts one period from features of earlier periods, so a horizon of H periods feeds
each prediction back as history. Training features come from Spark windows; here the same features
of the next period are formed for all series of an Arrow batch together, and the predictions
advance the whole batch one period at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from panelcast.operators.features import (
    EWM_SPANS,
    MAX_LAGS,
    ROLL_WINDOWS,
    SEASONAL_LAGS,
    checked_lags,
    short_windows,
)
from panelcast.operators.series import LIMIT, LOG_LIMIT

REACH = max(*SEASONAL_LAGS, *ROLL_WINDOWS, MAX_LAGS)
Predictor = Callable[[np.ndarray], np.ndarray]


class History:
    """The newest values of a batch of series, oldest first, padded with zeros on the left."""

    def __init__(self, values: list[np.ndarray], room: int) -> None:
        self.length = np.array([len(v) for v in values])
        self.buffer = np.zeros((len(values), REACH + room))
        self.end = REACH
        for row, v in enumerate(values):
            tail = v[-REACH:]
            self.buffer[row, REACH - len(tail):REACH] = tail
        self.means = {s: self._weighted(values, 1 - 2 / (s + 1)) for s in EWM_SPANS}

    @staticmethod
    def _weighted(values: list[np.ndarray], decay: float) -> list[np.ndarray]:
        """Numerator and denominator of the exponential mean of each series."""
        weights = [decay ** np.arange(len(v) - 1, -1, -1.0) for v in values]
        top = np.array([w @ v for w, v in zip(weights, values, strict=True)])
        return [top, np.array([w.sum() for w in weights])]

    def append(self, values: np.ndarray) -> None:
        self.buffer[:, self.end] = values
        self.end += 1
        self.length = self.length + 1
        for span, (top, bottom) in self.means.items():
            decay = 1 - 2 / (span + 1)
            self.means[span] = [top * decay + values, bottom * decay + 1.0]

    def lag(self, k: int) -> np.ndarray:
        return self.buffer[:, self.end - k]

    def features(self, lags: int, longest: int, marks: bool = False) -> np.ndarray:
        """History features of the next period, in the order of ``history_names``, with ``marks`` those
        of ``model_names``."""
        checked_lags(lags)
        out = [self.lag(k) for k in range(1, lags + 1)]
        for near, enough in ((2, 2), (7, 8)):
            if lags >= enough:
                known = self.length >= near
                out.append(np.where(known, self.lag(1) - self.lag(near), 0.0))
        top, bottom = self.means[EWM_SPANS[-1]]
        level = np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0) if marks else 0.0
        for k in (k for k in SEASONAL_LAGS if longest > k):
            out.append(np.where(self.length >= k, self.lag(k), level) if marks else self.lag(k))
        for k in ROLL_WINDOWS:
            if longest > k:
                full = self.length >= k
                window = self.buffer[:, self.end - k:self.end]
                mean, sd = window.mean(axis=1), window.std(axis=1, ddof=1)
                cv = np.divide(sd, mean + 1e-9, out=np.zeros_like(sd), where=mean + 1e-9 != 0)
                stats = ((mean, level), (sd, 0.0), (window.max(axis=1), level),
                         (window.min(axis=1), level), (cv, 0.0))
                out += [np.where(full, s, before) for s, before in stats]
        for span in EWM_SPANS:
            top, bottom = self.means[span]
            out.append(np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0))
        if marks:
            out += [(self.length < k).astype(float) for k in short_windows(longest)]
        return np.clip(np.nan_to_num(np.column_stack(out), posinf=0.0, neginf=0.0), -1e15, 1e15)


def roll_forward(
    values: list[np.ndarray], calendars: np.ndarray, use_log: np.ndarray, predict: Predictor,
    lags: int, longest: int, signed: bool, marks: bool = False,
) -> np.ndarray:
    """Predictions ``(series, steps)`` on the original scale.

    ``values`` are the (log) histories and ``calendars`` the date features of each coming step,
    ``(series, steps, features)``.
    """
    steps = calendars.shape[1]
    history = History(values, steps)
    limit = np.where(use_log, LOG_LIMIT, LIMIT)  # only what a number cannot hold is cut
    out = np.empty((len(values), steps))
    for step in range(steps):
        x = np.hstack([calendars[:, step, :], history.features(lags, longest, marks)])
        p = np.clip(np.nan_to_num(predict(x), nan=0.0), -limit, limit)
        out[:, step] = p
        history.append(p)
    with np.errstate(over="ignore"):
        level = np.where(use_log[:, None], np.expm1(out), out)
    return level if signed else np.maximum(level, 0.0)
