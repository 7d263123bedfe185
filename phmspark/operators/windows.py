"""Features of sensor windows: time-domain statistics, harmonic bands and their assembly in registry order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of the fifteen statistics, half-widths of the ten harmonic bands (Hz), base frequencies (Hz) by speed.
STATISTICS = ("rms", "mean", "kurtosis", "std", "skewness", "peak_to_peak", "crest", "clearance", "shape", "impulse", "max", "min", "mean_square", "variance", "mean_abs")
BANDWIDTHS = (5, 8, 10, 12, 12, 12, 15, 15, 15, 15)
BASES = {"6000": 100.0, "8000": 133.0, "11000": 183.0}


def statistics(x: Column) -> dict[str, Column]:
    """The fifteen statistics of a group's values; moments are biased, peaks are of x, not of its absolute value."""
    rms, mean_abs = F.sqrt(F.avg(x * x)), F.avg(F.abs(x))
    return {
        "rms": rms,
        "mean": F.avg(x),
        "kurtosis": F.kurtosis(x) + 3,
        "std": F.stddev_pop(x),
        "skewness": F.skewness(x),
        "peak_to_peak": F.max(x) - F.min(x),
        "crest": F.abs(F.max(x) / F.nullif(rms, F.lit(0.0))),
        "clearance": F.abs(F.max(x)) / F.nullif(F.pow(F.avg(F.sqrt(F.abs(x))), F.lit(2.0)), F.lit(0.0)),
        "shape": rms / F.nullif(mean_abs, F.lit(0.0)),
        "impulse": F.abs(F.max(x) / F.nullif(mean_abs, F.lit(0.0))),
        "max": F.max(x),
        "min": F.min(x),
        "mean_square": F.avg(x * x),
        "variance": F.var_pop(x),
        "mean_abs": mean_abs,
    }


def window_stats(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row of fifteen statistics for each window and channel in ``keys``; one map-side-combined aggregate."""
    return samples.groupBy(*keys).agg(*(c.alias(n) for n, c in statistics(F.col(value)).items()))


def cut_windows(rows: DataFrame, keys: list[str], order: list[str], size: int = 10_000) -> DataFrame:
    """``rows`` with win (from 0): runs of ``size`` rows of each recorder in order; what does not fill a window is left out."""
    own = Window.partitionBy(*keys).orderBy(*order)
    placed = rows.withColumn("_k", F.row_number().over(own) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    win = F.floor(F.col("_k") / size)
    return placed.withColumn("win", win).filter((F.col("win") + 1) * size <= F.col("_n")).drop("_k", "_n")


def harmonic_bands(windows: DataFrame, samples: str, fs: float, base: str, bandwidths: tuple = BANDWIDTHS) -> DataFrame:
    """``windows`` and bands: for each harmonic h the largest amplitude 2/N |FFT| of the first N/2 bins within
    base * h +- bandwidth (edges included), 0 where no bin is. ``base`` is a column; windows may differ in length."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, b in zip(batch[samples], batch[base], strict=True):
                n = len(x)
                amplitude = np.abs(np.fft.rfft(np.asarray(x, dtype=float)))[: n // 2] * 2 / max(n, 1)
                at = np.arange(n // 2) * fs / max(n, 1)
                out.append([float(amplitude[np.abs(at - b * (h + 1)) <= w].max(initial=0.0)) for h, w in enumerate(bandwidths)])
            yield batch.assign(bands=out)

    return windows.mapInPandas(run, kept + ", bands array<double>")


def band_bins(n: int, fs: float, base: float, bandwidths: tuple = BANDWIDTHS) -> list[tuple[int, int]]:
    """(harmonic, bin) of every bin in a band, of windows of ``n`` samples."""
    return [(h + 1, k) for h, w in enumerate(bandwidths) for k in range(n // 2) if abs(k * fs / n - base * (h + 1)) <= w]


def assemble(stats: DataFrame, keys: list[str], channel: str, channels: list[str]) -> DataFrame:
    """keys and f: the channels' statistics in registry order (channel by channel), of windows that have every channel."""
    wide = stats.groupBy(*keys).pivot(channel, channels).agg(F.first(F.array(*STATISTICS)))
    return wide.filter(F.forall(F.array(*channels), lambda a: a.isNotNull())).select(*keys, F.flatten(F.array(*channels)).alias("f"))


def finite(f: Column) -> Column:
    """Whether every component is a finite number."""
    return F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
