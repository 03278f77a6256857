"""Waveforms: WAV bytes, one channel at a target rate, log-mel frames and pitch, as Arrow-batched functions of a row.

A clip is one row's value and is held by itself; rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mel frames of 24 kHz speech, the least rate that may be resampled, taps on each side and roll-off of the resampling filter.
N_FFT, HOP, MELS, F_MAX, RATE, MIN_RATE = 1920, 480, 80, 8000.0, 24_000, 16_000
TAPS, ROLL_OFF = 6, 0.99
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


def parse_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """Mean of the channels (float64, PCM scaled to [-1, 1)) and the sample rate of a RIFF file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (int.from_bytes(body[24:26], "little") if kind == _EXTENSIBLE else kind, channels, rate, bits)
        elif name == b"data" and form:
            kind, channels, rate, bits = form
            body = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
            if kind == _FLOAT and bits in (32, 64):
                x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
            elif kind == _PCM and bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
            elif kind == _PCM and bits in (16, 32):
                x = np.frombuffer(body, f"<i{bits // 8}") / float(1 << bits - 1)
            elif kind == _PCM and bits == 24:
                b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
            else:
                raise ValueError(f"WAV format {kind} of {bits} bits")
            return x.reshape(-1, channels).mean(axis=1), rate
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def make_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM, one channel; values are held in range."""
    x = np.clip(np.trunc(np.asarray(samples, np.float64) * 32768), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, _PCM, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(x)) + x


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited interpolation by a Hann-windowed sinc; ceil(n x target / rate) values."""
    if rate == target or not len(x):
        return x
    g = int(np.gcd(rate, target))
    up, down = target // g, rate // g
    cut = ROLL_OFF * min(up, down) / down  # of the input's Nyquist rate
    reach = int(np.ceil(TAPS / cut))
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + 1)])
    out = np.empty(n)
    for phase in range(up):
        # Outputs phase, phase + up, ... lie equally between two inputs, so one filter serves them all.
        own = np.arange(phase, n, up)
        first, part = own * down // up, phase * down % up / up
        t = (np.arange(-reach, reach + 1) - part) * cut
        taps = np.where(np.abs(t) < TAPS, np.sinc(t) * np.cos(np.pi * t / (2 * TAPS)) ** 2, 0.0) * cut
        for k, weight in enumerate(taps):
            out[own] = weight * padded[first + k] + (out[own] if k else 0.0)
    return out


def mel_weights(n_mels: int, n_fft: int, rate: int, f_max: float) -> np.ndarray:
    """Triangles of unit area on a scale that is linear below 1000 Hz and logarithmic above."""
    step, log_step = 200 / 3, np.log(6.4) / 27
    top = f_max / step if f_max < 1000 else 15 + np.log(f_max / 1000) / log_step
    m = np.linspace(0, top, n_mels + 2)
    hz = np.where(m < 15, m * step, 1000 * np.exp(log_step * (m - 15)))
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    up, down = (f[None, :] - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - f[None, :]) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (hz[2:] - hz[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int = RATE, n_fft: int = N_FFT, hop: int = HOP, mels: int = MELS, f_max: float = F_MAX) -> np.ndarray:
    """(frames, mels): logarithms of mel magnitudes, at least 1e-5, of Hann windows `hop` apart over the mirrored signal."""
    pad = (n_fft - hop) // 2
    if len(x) <= pad:
        x = np.concatenate([x, np.zeros(pad + 1 - len(x))])
    y = np.pad(x, pad, "reflect")
    y = np.concatenate([y, np.zeros(max(0, n_fft - len(y)))])
    frames = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    weights, out = mel_weights(mels, n_fft, rate, f_max), []
    for i in range(0, len(frames), 256):
        spec = np.fft.rfft(frames[i : i + 256] * window, axis=1)
        out.append(np.log(np.maximum(np.sqrt(spec.real**2 + spec.imag**2 + 1e-9) @ weights.T, 1e-5)))
    return np.concatenate(out)


def pitch(x: np.ndarray, rate: int, hop: int, low: float = 71.0, high: float = 800.0, voiced: float = 0.5) -> np.ndarray:
    """A frequency for each hop, 0 where unvoiced: the first strong peak of the normalised autocorrelation of two longest periods."""
    least, most = int(rate / high), int(np.ceil(rate / low))
    size = 2 * most
    y = np.concatenate([np.zeros(size // 2), x, np.zeros(size)])
    out = np.zeros(len(x) // hop + 1)
    for i in range(len(out)):
        f = y[i * hop : i * hop + size]
        f = f - f.mean()
        a, b = f[:most], np.lib.stride_tricks.sliding_window_view(f, most)[: most + 1]
        norm = np.sqrt((a @ a) * (b * b).sum(1)) + 1e-12
        r = (b @ a) / norm
        k = np.arange(least + 1, most)
        peaks = k[(r[k] >= r[k - 1]) & (r[k] > r[k + 1]) & (r[k] >= voiced)]
        if len(peaks):
            j = int(peaks[r[peaks] >= 0.9 * r[peaks].max()][0])
            bend = r[j - 1] - 2 * r[j] + r[j + 1]
            out[i] = rate / (j + (0.5 * (r[j - 1] - r[j + 1]) / bend if bend else 0.0))
    return out


def _each(f: Callable, kind: str) -> Callable[..., Column]:
    """f over rows as a column function; a null argument gives null."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

    return run


def wav_bytes(samples: Column, rate: int) -> Column:
    return _each(lambda x: make_wav(np.asarray(x, np.float64), rate), "binary")(samples)


def waveform(content: Column, target: int, least: int = MIN_RATE) -> Column:
    """Samples of WAV bytes at the target rate; another rate below `least` raises."""

    def one(raw: bytes) -> np.ndarray:
        x, rate = parse_wav(raw)
        if rate != target and rate < least:
            raise ValueError(f"a sample rate of {rate}, below {least}")
        return resample(x, rate, target)

    return _each(one, "array<double>")(content)


def fbank(samples: Column, rate: int = RATE, n_fft: int = N_FFT, hop: int = HOP, mels: int = MELS, f_max: float = F_MAX) -> Column:
    return _each(lambda x: log_mel(np.asarray(x, np.float64), rate, n_fft, hop, mels, f_max).tolist(), "array<array<double>>")(samples)


def f0(samples: Column, frames: Column, rate: int = RATE, hop: int = HOP) -> Column:
    """Pitch, interpolated to a number of frames."""

    def one(x: np.ndarray, n: int) -> np.ndarray:
        p = pitch(np.asarray(x, np.float64), rate, hop)
        at = np.clip((np.arange(n) + 0.5) * len(p) / max(1, n) - 0.5, 0, len(p) - 1)
        return np.interp(at, np.arange(len(p)), p)

    return _each(one, "array<double>")(samples, frames)


def aligned(feat: Column, tokens: Column, ratio: int) -> tuple[Column, Column]:
    """Frames and tokens cut so that `ratio` frames belong to each token."""
    n = F.least(F.floor(F.size(feat) / ratio).cast("int"), F.size(tokens))
    return F.slice(feat, F.lit(1), n * ratio), F.slice(tokens, F.lit(1), n)
