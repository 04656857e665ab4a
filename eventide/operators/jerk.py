"""Sudden changes in a score series, by the spectral residual."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 8


def spectral_residual(scores: np.ndarray, radius: int = 3) -> np.ndarray:
    """How much each sample stands out of the series' smooth spectrum, scaled to 0..1.

    The logarithm of the amplitude less its average over three bins keeps the unusual; with
    the phase kept, the inverse transform squared and smoothed shows where it is.
    """
    if len(scores) < LEAST:
        return np.zeros(len(scores))
    spectrum = np.fft.fft(scores)
    log_amplitude = np.log(np.abs(spectrum) + 1e-8)
    residual = log_amplitude - np.convolve(log_amplitude, np.full(3, 1 / 3), "same")
    saliency = np.abs(np.fft.ifft(np.exp(residual + 1j * np.angle(spectrum)))) ** 2
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at**2) / (2 * (radius / 2) ** 2))
    smooth = np.convolve(saliency, kernel / kernel.sum(), "same")
    span = smooth.max() - smooth.min()
    return np.zeros(len(scores)) if span <= 1e-9 else (smooth - smooth.min()) / span


def with_jerk(frames: DataFrame, column: str = "score") -> DataFrame:
    """Adds ``jerk_score`` per video; ``frame_idx`` is unique in a video.

    A series is one transform, so a video's numbers meet in one task: frame, time and score, and nothing else of the rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "frame_idx"])
        return frame[["video_id", "frame_idx"]].assign(jerk_score=np.round(spectral_residual(frame["value"].to_numpy(float)), 6))

    numbers = frames.select("video_id", "frame_idx", "t", F.col(column).cast("double").alias("value"))
    found = numbers.groupBy("video_id").applyInPandas(run, f"video_id {kinds['video_id']}, frame_idx {kinds['frame_idx']}, jerk_score double")
    return frames.join(found, ["video_id", "frame_idx"])
