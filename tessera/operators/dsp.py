"""Filters, filter banks and resampling: kernels on whole trials, one channel of a trial at a time, rows (trial_id, ch, t, x).

Filters need a trial's samples together, so a task holds one channel of one trial and a batch; trials are spread over tasks. Samples are taken in
order of t. A NaN or null sample makes the channel NaN, as a filter carries it on; an empty table stays empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "gamma": (30.0, 70.0), "highgamma": (70.0, 150.0)}
BLOCK = 256
#: Rows that a batch of results has before it is sent.
ROWS = 10_000


def kernel(df: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(trial_id, ch, t, and the columns of schema): f of each channel of each trial of df (trial_id, t, ch, x). Results of the same length keep
    their t, others are numbered from 0. Python gets batches of sorted rows, each of many trials, rather than a stream for each trial; a trial that
    goes on in the next batch waits for its end."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("trial_id", "ch")}
    names = [x.split()[0] for x in schema.split(", ")]

    def table(t: pa.Table, spans: list[tuple[int, int]], outs: list[dict[str, np.ndarray]]) -> list[pa.RecordBatch]:
        lengths = [len(o[names[0]]) for o in outs]
        first = pa.array(np.repeat([i for i, _ in spans], lengths))
        at = pa.chunked_array([part for (i, j), n in zip(spans, lengths) for part in (t.column("t").slice(i, j - i).chunks if n == j - i else [pa.array(np.arange(n), pa.int64())])], pa.int64())
        columns = [t.column("trial_id").take(first), t.column("ch").take(first), at, *(pa.array(np.concatenate([np.asarray(o[k], np.float64) for o in outs])) for k in names)]
        return pa.table(columns, names=["trial_id", "ch", "t", *names]).combine_chunks().to_batches()

    def whole(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(pieces)
        x = t.column("x").to_numpy().astype(np.float64)
        edges = [*np.flatnonzero(t.column("_r").to_numpy() == 1).tolist(), len(x)]
        spans, outs, rows = [], [], 0
        for i, j in pairwise(edges):
            spans.append((i, j))
            outs.append(f(x[i:j]))
            rows += len(outs[-1][names[0]])
            if rows >= ROWS:
                yield from table(t, spans, outs)
                spans, outs, rows = [], [], 0
        if outs:
            yield from table(t, spans, outs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column("_r").to_numpy() == 1)
            if len(starts):
                cut = int(starts[-1])
                if held or cut:
                    yield from whole([*held, b.slice(0, cut)])
                held, b = [], b.slice(cut)
            held.append(b)
        if held:
            yield from whole(held)

    rows = df.select("trial_id", "ch", F.col("t").cast("long").alias("t"), F.coalesce(F.col("x").cast("double"), F.lit(float("nan"))).alias("x"))
    order = F.col("t").asc_nulls_last()
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("trial_id", "ch").orderBy(order)))  # brings trials together; 1 begins one
    return numbered.sortWithinPartitions("trial_id", "ch", order).mapInArrow(run, f"trial_id {kinds['trial_id']}, ch {kinds['ch']}, t long, {schema}")


def butter(order: int, band: float | list[float], kind: str, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth filter: bilinear transform of the analog prototype with prewarped corners."""
    w = np.atleast_1d(np.asarray(band, float)) / (fs / 2)
    if kind not in ("lowpass", "highpass", "bandpass", "bandstop") or len(w) != 1 + kind.startswith("band"):
        raise ValueError(f"{kind} filters take {1 + kind.startswith('band')} corner frequencies")
    if not ((w > 0) & (w < 1)).all() or (len(w) > 1 and w[0] >= w[1]):
        raise ValueError("corner frequencies must rise and lie between 0 and half the sampling rate")
    p = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    w, z, k = 4 * np.tan(np.pi * w / 2), np.zeros(0, complex), 1.0
    if kind == "lowpass":
        p, k = p * w[0], w[0] ** order
    elif kind == "highpass":
        k = float(np.real(1 / np.prod(-p)))
        p, z = w[0] / p, np.zeros(order, complex)
    else:
        wide, mid = w[1] - w[0], np.sqrt(w[0] * w[1])
        if kind == "bandpass":
            half, z, k = p * wide / 2, np.zeros(order, complex), wide**order
        else:
            half, z, k = wide / 2 / p, np.repeat([1j * mid, -1j * mid], order), float(np.real(1 / np.prod(-p)))
        root = np.sqrt(half**2 - mid**2 + 0j)
        p = np.concatenate([half + root, half - root])
    k *= float(np.real(np.prod(4 - z) / np.prod(4 - p)))
    z = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))])
    return k * np.real(np.poly(z)), np.real(np.poly((4 + p) / (4 - p)))


@lru_cache(maxsize=16)
def responses(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """Of a recursive filter (coefficients of equal number), over a block: what the state gives, what drives the state, the state's step over the block,
    and the matrix of the impulse response."""
    b, a, n = np.array(b), np.array(a), len(a) - 1
    step = np.diag(np.ones(n - 1), 1)
    step[:, 0] -= a[1:]
    into = b[1:] - a[1:] * b[0]
    free, drive, m = np.empty((BLOCK, n)), np.empty((BLOCK, n)), np.eye(n)
    for i in range(BLOCK):
        free[i], drive[i], m = m[0], m @ into, step @ m
    h = np.concatenate([[b[0]], drive[: BLOCK - 1, 0]])
    return free, drive, m, np.tril(h[np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK)).clip(0)])


@lru_cache(maxsize=16)
def resting(b: tuple[float, ...], a: tuple[float, ...]) -> np.ndarray:
    """The steady state of a recursive filter on ones."""
    n = max(len(a), len(b)) - 1
    b, a = np.array(b), np.array(a)
    step = np.diag(np.ones(n - 1), 1)
    step[:, 0] -= a[1:]
    return np.linalg.solve(np.eye(n) - step, b[1:] - a[1:] * b[0])


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The recursive filter from a state (transposed direct form), block by block as products with its response matrices."""
    n = max(len(a), len(b)) - 1
    free, drive, m, toeplitz = responses(*((*map(float, c), *[0.0] * (n + 1 - len(c))) for c in (b, a)))
    out = np.empty(len(x))
    for at in range(0, len(x), BLOCK):
        u = x[at : at + BLOCK]
        s = len(u)
        out[at : at + s] = free[:s] @ state + toeplitz[:s, :s] @ u
        if s == BLOCK:
            state = m @ state + drive[::-1].T @ u
    return out


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, from the steady state, with ends continued oddly by three filter lengths."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError(f"a trial must have more than {pad} samples")
    rest = resting(tuple(map(float, b)), tuple(map(float, a)))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = lfilter(b, a, y, rest * y[0])
    y = lfilter(b, a, y[::-1], rest * y[-1])[::-1]
    return y[pad:-pad]


def filter_butter(df: DataFrame, band: float | list[float], fs: float, kind: str = "bandpass", order: int = 2) -> DataFrame:
    b, a = butter(order, band, kind, fs)
    return kernel(df, lambda x: {"x": filtfilt(b, a, x)}, "x double")


def notch_taps(f: float, fs: float, taps: int) -> np.ndarray:
    """A linear-phase notch half a hertz about f (frequency sampling, Hamming window), convolved with itself reversed, in single precision."""
    if taps % 2 == 0:
        raise ValueError("the number of taps must be odd")
    grid = 1 + 2 ** int(np.ceil(np.log2(taps)))
    at = np.linspace(0, 1, grid)
    gain = np.interp(at, np.array([0, f - 1, f - 0.5, f + 0.5, f + 1, fs / 2]) / (fs / 2), [1, 1, 0, 0, 1, 1])
    h = np.fft.irfft(gain * np.exp(-(taps - 1) / 2 * 1j * np.pi * at))[:taps] * np.hamming(taps)
    return np.convolve(h, h[::-1]).astype(np.float32).astype(np.float64)


def same(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The middle of the convolution, as long as x."""
    n = 1 << int(len(x) + len(h) - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)
    start = (len(h) - 1) // 2
    return full[start : start + len(x)]


def filter_line_noise(df: DataFrame, fs: float, f: float = 60.0, taps: int = 501, repeats: int = 1) -> DataFrame:
    """Notches at f and its multiples below half the sampling rate."""
    bank = [notch_taps(k * f, fs, taps) for k in range(1, int(np.ceil(fs / 2 / f))) if k * f < fs / 2]

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        for h in bank:
            for _ in range(repeats):
                x = same(x, h)
        return {"x": x}

    return kernel(df, run, "x double")


def centers(bands: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Centre frequencies of the Gaussian filters within the bands, and their deviations: spaced by their width up to 4 Hz, then by a seventh of an octave."""
    for low, high in bands:
        if low >= high:
            raise ValueError(f"the band {low}, {high} is empty")
    width = lambda f: 10 ** (np.log10(0.39) + 0.5 * np.log10(f))
    at, top = [0.018], np.log2((max(map(max, bands)) + 1) / 0.018)
    while np.log2(at[-1] / 0.018) < top:
        at.append(at[-1] + width(at[-1]) if at[-1] < 4 else 0.018 * 2 ** (np.log2(at[-1] / 0.018) + 1 / 7))
    c = np.array([f for f in at if any(a <= f <= z for a, z in bands)])
    for low, high in bands:
        if not ((c >= low) & (c <= high)).any():
            raise ValueError(f"no filter lies in the band {low}, {high}")
    return c, width(c) * np.sqrt(2)


def analytic(x: np.ndarray, fs: float, c: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """The analytic signal through each Gaussian filter (samples, filters); the mean is left out."""
    n = len(x)
    gain = np.exp(-0.5 * ((np.arange(n // 2 + 1)[:, None] * (fs / n) - c) / sd) ** 2)
    gain[0] = 0
    gain[1 : (n + 1) // 2] *= 2
    full = np.zeros((n, len(c)), complex)
    full[: n // 2 + 1] = np.fft.rfft(x.astype(np.float32).astype(np.float64))[:, None] * gain
    return np.fft.ifft(full, axis=0)


def filter_hilbert(df: DataFrame, fs: float, bands: list[tuple[float, float]]) -> DataFrame:
    """(trial_id, ch, t, band, phase, amp): mean phase and amplitude of the filters in each band, band numbered from 0."""
    c, sd = centers(bands)

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        h = analytic(x, fs, c, sd)
        out = {}
        for i, (low, high) in enumerate(bands):
            inside = (c >= low) & (c <= high)
            out |= {f"p{i}": np.angle(h[:, inside]).mean(1), f"a{i}": np.abs(h[:, inside]).mean(1)}
        return out

    wide = kernel(df, run, ", ".join(f"p{i} double, a{i} double" for i in range(len(bands))))
    return wide.select("trial_id", "ch", "t", F.posexplode(F.array(*[F.struct(F.col(f"p{i}").alias("phase"), F.col(f"a{i}").alias("amp")) for i in range(len(bands))])).alias("band", "v")).select("trial_id", "ch", "t", "band", "v.phase", "v.amp")


def filterbank_hilbert(df: DataFrame, fs: float, band: tuple[float, float]) -> DataFrame:
    """(trial_id, ch, t, filter, cf, phase, amp): each filter of the band by itself."""
    c, sd = centers([band])

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        h = analytic(x, fs, c, sd)
        return {k: v for i in range(len(c)) for k, v in ((f"p{i}", np.angle(h[:, i])), (f"a{i}", np.abs(h[:, i])))}

    wide = kernel(df, run, ", ".join(f"p{i} double, a{i} double" for i in range(len(c))))
    items = [F.struct(F.lit(float(f)).alias("cf"), F.col(f"p{i}").alias("phase"), F.col(f"a{i}").alias("amp")) for i, f in enumerate(c)]
    return wide.select("trial_id", "ch", "t", F.posexplode(F.array(*items)).alias("filter", "v")).select("trial_id", "ch", "t", "filter", "v.cf", "v.phase", "v.amp")


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """x with n samples, through its spectrum."""
    if not len(x) or n < 1:
        return np.zeros(max(n, 0))
    have, m = np.fft.rfft(x), min(n, len(x))
    spec = np.zeros(n // 2 + 1, complex)
    spec[: m // 2 + 1] = have[: m // 2 + 1]
    if m % 2 == 0 and n != len(x):
        spec[m // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(spec, n) * (n / len(x))


def resample(df: DataFrame, fs: float, fs_out: float) -> DataFrame:
    """Trials at another rate, numbered anew: round(n fs_out / fs) samples, halves to even."""
    return kernel(df, lambda x: {"x": resampled(x, round(fs_out / fs * len(x)))}, "x double")


def phase_amplitude(df: DataFrame, fs: float, bands: dict[str, tuple[float, float]] = BANDS, fs_out: float | None = None) -> DataFrame:
    """(trial_id, ch, t, band, phase, amp) with the bands' names, at fs_out if it is lower."""
    names, ranges = list(bands), list(bands.values())
    if len(set(ranges)) < len(ranges):
        raise ValueError("bands must be unique")
    c, sd = centers(ranges)

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        h, out = analytic(x, fs, c, sd), {}
        for i, (low, high) in enumerate(ranges):
            inside = (c >= low) & (c <= high)
            pair = np.angle(h[:, inside]).mean(1), np.abs(h[:, inside]).mean(1)
            if fs_out is not None and fs_out < fs:
                pair = tuple(resampled(v, round(fs_out / fs * len(x))) for v in pair)
            out |= {f"p{i}": pair[0], f"a{i}": pair[1]}
        return out

    wide = kernel(df, run, ", ".join(f"p{i} double, a{i} double" for i in range(len(ranges))))
    items = [F.struct(F.lit(n).alias("band"), F.col(f"p{i}").alias("phase"), F.col(f"a{i}").alias("amp")) for i, n in enumerate(names)]
    return wide.select("trial_id", "ch", "t", F.explode(F.array(*items)).alias("v")).select("trial_id", "ch", "t", "v.band", "v.phase", "v.amp")


def response_db(b: list[float], a: list[float], w: Column) -> Column:
    """20 log10 |H| at the angle w (radians a sample), by built-in expressions."""
    part = lambda c, f: sum((F.lit(float(v)) * f(w * i) for i, v in enumerate(c)), F.lit(0.0))
    power = lambda c: part(c, F.cos) ** 2 + part(c, F.sin) ** 2
    return 10 * F.log10(power(b) / power(a))
