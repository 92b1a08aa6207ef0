"""Recordings: decode, spectrogram, slices; a file is one task's row, read with ``binaryFile``.

Neural networks are a plug-in: ``detect`` takes a function that makes a model in each worker."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SpectrogramSettings:
    """Window and overlap in seconds and as a share; band in Hz; scale 'log', 'pcen' or 'none'."""

    window: float = 512 / 256000
    overlap: float = 0.75
    low: float = 10_000
    high: float = 120_000
    scale: str = "pcen"
    denoise: bool = True
    max_scale: bool = False


def encode(rate: int, samples: np.ndarray) -> bytes:
    """A mono wav file of 16 bits from samples in [-1, 1]; what is beyond is clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.round(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode(raw: bytes, time_expansion: float = 1, target_rate: int | None = None, longest: float | None = None, scale: bool = False) -> tuple[int, np.ndarray]:
    """(rate, samples in [-1, 1]) of a mono wav file; stereo is a ValueError. Resampled by linear interpolation."""
    with wave.open(io.BytesIO(raw)) as f:
        if f.getnchannels() != 1:
            raise ValueError("only mono recordings")
        width, rate, data = f.getsampwidth(), int(f.getframerate() * time_expansion), f.readframes(f.getnframes())
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[width]
    x = np.frombuffer(data, kind).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    if target_rate and target_rate != rate:
        at = np.arange(int(len(x) * target_rate / rate)) * rate / target_rate
        x, rate = np.interp(at, np.arange(len(x)), x).astype(np.float32), target_rate
    if longest is not None:
        x = x[: int(longest * rate)]
    if scale and len(x):
        x = x - x.mean()
        x = x / (np.abs(x).max() + 1e-5)
    return rate, x


def pad(x: np.ndarray, rate: int, settings: SpectrogramSettings, divisible: int = 32, resize: float = 1.0) -> np.ndarray:
    """Samples with zeros behind, so that the spectrogram's width times ``resize`` divides."""
    nfft = int(settings.window * rate)
    step = nfft - int(settings.overlap * nfft)
    unit = int(divisible / resize)
    width = max(1, -(-max(0, len(x) - nfft) // step) + 1)
    wanted = (-(-width // unit) * unit - 1) * step + nfft
    return np.pad(x, (0, max(0, wanted - len(x))))


def pcen(s: np.ndarray, rate: int, gain: float = 0.98, bias: float = 2.0, power: float = 0.5, seconds: float = 0.06, eps: float = 1e-6) -> np.ndarray:
    """Per-channel energy normalisation with a first-order smoother."""
    t = seconds * rate / 512
    b = (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    smooth, level = np.empty_like(s), s[:, 0]
    for i in range(s.shape[1]):
        level = (1 - b) * level + b * s[:, i]
        smooth[:, i] = level
    return (s / (eps + smooth) ** gain + bias) ** power - bias**power


def spectrogram(x: np.ndarray, rate: int, settings: SpectrogramSettings = SpectrogramSettings()) -> np.ndarray:
    """Magnitudes (frequency from high to low, time), cropped to the band, scaled, without each row's mean."""
    nfft = int(settings.window * rate)
    step = nfft - int(settings.overlap * nfft)
    if len(x) < nfft:
        x = np.pad(x, (0, nfft - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, nfft)[::step]
    window = np.hanning(nfft)
    s = np.abs(np.fft.rfft(frames * window, axis=1)).T[::-1].astype(np.float32)
    top, bottom = round(settings.high * settings.window), round(settings.low * settings.window)
    if s.shape[0] < top:
        s = np.vstack([np.zeros((top - s.shape[0], s.shape[1]), s.dtype), s])
    s = s[-top : s.shape[0] - bottom]
    if settings.scale == "log":
        s = np.log1p(2.0 / rate / (window**2).sum() * s)
    elif settings.scale == "pcen":
        s = pcen(s, rate)
    if settings.denoise:
        s = np.clip(s - s.mean(axis=1, keepdims=True), 0, None)
    if settings.max_scale:
        s = s / (s.max() + 1e-5)
    return s.astype(np.float32)


def chunks(duration: float, chunk: float) -> list[tuple[float, float]]:
    """(start, end) of pieces of ``chunk`` seconds."""
    return [(i * chunk, min(duration, (i + 1) * chunk)) for i in range(int(np.ceil(duration / chunk)))]


def with_chunks(df: DataFrame, duration: str, chunk: float) -> DataFrame:
    return df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(duration) / chunk) - 1, F.lit(0)).cast("int")))).withColumn("offset", F.col("chunk") * chunk)


def call_features(s: np.ndarray, boxes: list[dict], settings: SpectrogramSettings, rate: int) -> list[dict]:
    """Per detection: duration, bounds, bandwidth, frequency of the most power in the box, in the whole height, and in its
    first and second half; -1 where that can't be told."""
    step = int(settings.window * rate) * (1 - settings.overlap) / rate
    height = s.shape[0]
    hz = lambda row: round((height - row) * (settings.high - settings.low) / height + settings.low, 2)
    peak = lambda part, top=0: hz(int(part.sum(axis=1).argmax()) + top) if part.size and part.sum() > 0 else -1.0
    out = []
    for b in boxes:
        x0, x1 = int(b["start_time"] / step), max(int(b["end_time"] / step), int(b["start_time"] / step) + 1)
        y = lambda f: int(np.clip(height - (f - settings.low) * height / (settings.high - settings.low), 0, height))
        y0, y1 = sorted((y(b["high_freq"]), y(b["low_freq"])))
        whole, mid = s[:, x0:x1], (x0 + x1) // 2
        out.append({"duration": round(b["end_time"] - b["start_time"], 5), "low_freq_bb": b["low_freq"], "high_freq_bb": b["high_freq"], "bandwidth": b["high_freq"] - b["low_freq"], "max_power_bb": peak(s[y0:y1, x0:x1], y0), "max_power": peak(whole), "max_power_first": peak(s[:, x0:mid]), "max_power_second": peak(s[:, mid:x1])})
    return out


def heatmap(shape: tuple[int, int], boxes: list[tuple[int, int]], sigma: float) -> np.ndarray:
    """Targets: a Gaussian about each (row, column), combined by the greater."""
    rows, cols = np.arange(shape[0])[:, None], np.arange(shape[1])[None]
    out = np.zeros(shape, np.float32)
    for r, c in boxes:
        np.maximum(out, np.exp(-((rows - r) ** 2 + (cols - c) ** 2) / (2 * sigma * sigma)), out=out)
    return out


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(folder)


def spectrograms(files: DataFrame, settings: SpectrogramSettings = SpectrogramSettings()) -> DataFrame:
    """(path, rate, duration, rows, cols, cells) of each recording."""

    def run(frames):
        for pdf in frames:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                rate, x = decode(raw)
                s = spectrogram(x, rate, settings)
                out.append((path, rate, len(x) / rate, s.shape[0], s.shape[1], s.ravel().tolist()))
            yield pd.DataFrame(out, columns=["path", "rate", "duration", "rows", "cols", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, duration double, rows int, cols int, cells array<float>")


def detect(files: DataFrame, load_model: Callable[[], Callable[[np.ndarray, int], pd.DataFrame]], schema: str, chunk: float = 2.0) -> DataFrame:
    """Detections of each recording: a model made once a task is given each piece's samples and rate, and returns rows with
    ``start_time`` and ``end_time`` in the piece; they come back in the file's time, with ``path`` first."""

    def run(frames):
        model = load_model()
        for pdf in frames:
            for path, raw in zip(pdf["path"], pdf["content"]):
                rate, x = decode(raw)
                for start, end in chunks(len(x) / rate, chunk):
                    found = model(x[int(start * rate) : int(end * rate)], rate)
                    if len(found):
                        found = found.assign(start_time=found["start_time"] + start, end_time=found["end_time"] + start)
                        found.insert(0, "path", path)
                        yield found

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def slice_signatures(signatures: DataFrame, detections: DataFrame) -> DataFrame:
    """Signature rows (file, time, metrics) of each detection: from the row at its start, rounded to 2 decimals (or 0.01
    before, if there is none), three in a row."""
    from pyspark.sql import Window as W

    tick = F.round(F.col("time") * 100).cast("long")
    rows = signatures.withColumn("__tick", tick).withColumn("__n", F.row_number().over(W.partitionBy("file").orderBy("time")))
    starts = rows.select("file", "__tick", F.col("__n").alias("__first"))
    at = F.round(F.col("start_time") * 100).cast("long")
    d = detections.withColumn("__try", F.explode(F.array(F.struct(F.lit(0).alias("o"), at.alias("t")), F.struct(F.lit(1).alias("o"), (at - 1).alias("t")))))
    met = d.join(starts, (d["file"] == starts["file"]) & (d["__try.t"] == starts["__tick"])).drop(starts["file"])
    first = met.groupBy("file", "id").agg(F.min_by("__first", "__try.o").alias("__first"))
    return first.join(rows, "file").where((F.col("__n") >= F.col("__first")) & (F.col("__n") < F.col("__first") + 3)).withColumn("frame", (F.col("__n") - F.col("__first")).cast("int")).drop("__n", "__first", "__tick")


def mean_signatures(df: DataFrame, metrics: list[str], name: str = "file") -> DataFrame:
    """Averages by recording (the first 31 characters of the name) and frame."""
    return df.groupBy(F.substring(name, 1, 31).alias("recording"), "frame").agg(*[F.avg(m).alias(m) for m in metrics])
