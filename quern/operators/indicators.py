"""Recursive indicators: each value needs the one before, so a symbol's bars meet in order in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean with weight 2 / (span + 1), seeded with the first value."""
    a, last, out = 2 / (span + 1), None, []
    for v in x.tolist():  # plain floats: a step is some times faster than on an array's items
        last = v if last is None else a * v + (1 - a) * last
        out.append(last)
    return np.array(out, float)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: seeded with the mean of the first n values that are there; a missing value carries the last."""
    out = np.full(len(x), np.nan)
    there = np.flatnonzero(~np.isnan(x))
    if len(there) < n:
        return out
    seed = there[n - 1]
    last = float(x[there[:n]].mean())
    smooth = [last]
    for v in x[seed + 1 :].tolist():
        last = last if v != v else (last * (n - 1) + v) / n
        smooth.append(last)
    out[seed:] = smooth
    return out


def rsi(c: np.ndarray, n: int = 14) -> np.ndarray:
    """Relative strength: no losses give 100, neither gains nor losses 50."""
    diff = np.diff(c, prepend=np.nan)
    gain, loss = wilder(np.maximum(diff, 0), n), wilder(np.maximum(-diff, 0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + gain / loss)
    out = np.where(loss == 0, 100.0, out)
    out = np.where((loss == 0) & (gain == 0), 50.0, out)
    return np.where(np.isnan(gain), np.nan, out)


def macd(c: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(c, fast) - ema(c, slow)
    sig = ema(line, signal)
    return line, sig, line - sig


def atr(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 14) -> np.ndarray:
    """Average true range; the first bar's range is high less low."""
    prev = np.concatenate([[np.nan], c[:-1]])
    tr = np.fmax(h - low, np.fmax(np.abs(h - prev), np.abs(low - prev)))
    return wilder(tr, n)


#: What each indicator's pass gives.
GIVES = {"rsi14": ("rsi14",), "macd": ("macd", "macd_signal", "macd_hist"), "atr14": ("atr14",)}


def _frame(which: tuple[str, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        c, new = pdf["c"].to_numpy(float), {}
        if "rsi14" in which:
            new["rsi14"] = rsi(c)
        if "macd" in which:
            new["macd"], new["macd_signal"], new["macd_hist"] = macd(c)
        if "atr14" in which:
            new["atr14"] = atr(pdf["h"].to_numpy(float), pdf["l"].to_numpy(float), c)
        return pdf.assign(**new)

    return run


def recursive_indicators(bars: DataFrame, which: tuple[str, ...] = tuple(GIVES)) -> DataFrame:
    """Bars (sym, d, o, h, l, c, v) with those of rsi14, macd, macd_signal, macd_hist and atr14 that the indicators ``which`` give.

    A group is one symbol's daily bars, some thousands of rows; NULL stands where a seed is not yet there.
    """
    from pyspark.sql import functions as F

    new = [c for w in which for c in GIVES[w]]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema.fields)
    out = bars.groupBy("sym").applyInPandas(_frame(which), f"{kinds}, " + ", ".join(f"{c} double" for c in new))
    return out.select(*bars.columns, *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in new))
