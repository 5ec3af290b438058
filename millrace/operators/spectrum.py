"""The spectrum of series of any length, and what it says about seasonality.

A series of up to `whole` values is one Fourier transform in one task. A longer one is transformed in blocks:
as a chirp's convolution (so its length may be any number) of a power of two M = n1 * n2, whose points are seen
as a matrix. Tasks transform blocks of columns, turn them, and hand pieces to the tasks that transform blocks of
rows; the way back is the same. Every block holds about `cells` numbers, whatever the length, and of the spectrum
only counts, sums and the peak leave the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import cut
from millrace.operators.order import placed

WHOLE, CELLS = 1 << 20, 1 << 18


def shape(n: int) -> tuple[int, int]:
    """n1 and n2: the matrix of the smallest power of two that holds the convolution for n values."""
    bits = max(2 * n - 2, 1).bit_length()
    return 1 << bits // 2, 1 << bits - bits // 2


def _turns(a: np.ndarray, b: np.ndarray, m: int, sign: int) -> np.ndarray:
    """exp(sign * 2 pi i a b / m), with a b reduced in integers."""
    return np.exp(sign * 2j * np.pi * ((a * b) % m) / m)


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(pi i j^2 / n); from 3 * 10^9 values on squares are beyond 64 bits."""
    square = (j.astype(object) ** 2 % (2 * n)).astype(float) if n > 3 * 10**9 else ((j.astype(np.uint64) ** 2) % np.uint64(2 * n)).astype(float)
    return np.exp(1j * np.pi * square / n)


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _unpack(x: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(x, np.complex128).reshape(rows, -1)


def _verdict(amplitudes: np.ndarray, first: int) -> tuple[int, float, float, float, int]:
    """count, sum, sum of squares, largest and its frequency of amplitudes, the first of frequency `first`."""
    if not len(amplitudes):
        return 0, 0.0, 0.0, 0.0, 0
    at = int(amplitudes.argmax())
    return len(amplitudes), float(amplitudes.sum()), float((amplitudes**2).sum()), float(amplitudes[at]), first + at


_SUMS = "count long, total double, squares double, height double, frequency long"


def amplitudes(series: DataFrame, keys: list[str], whole: int = WHOLE, cells: int = CELLS) -> DataFrame:
    """keys, n, low, high, count, total, squares, height, frequency of the amplitudes of frequencies 1 to n // 2 - 1. series: keys, i__ (place from 0), v (never null)."""
    at = [*keys, "n"]
    sizes = cut(series.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")))
    same = [F.col(k).eqNullSafe(F.col(f"{k}__k")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    named = sizes.withColumnsRenamed({k: f"{k}__k" for k in keys})
    rows = series.join(named, condition).select(*keys, "i__", (F.col("v") - F.col("mean")).alias("v"), "n")
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    head = f"{kinds}, n long"

    def name(pdf: pd.DataFrame) -> list:
        return [pdf[k].iloc[0] for k in at]

    def short(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.empty(len(pdf))
        x[pdf["i__"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame([[*name(pdf), *_verdict(np.abs(np.fft.rfft(x))[1 : len(x) // 2], 1)]], columns=[*at, "count", "total", "squares", "height", "frequency"])

    out = rows.where(F.col("n") <= whole).groupBy(*at).applyInPandas(short, f"{head}, {_SUMS}")
    if not sizes.where(F.col("n") > whole).isEmpty():
        out = out.unionByName(_long(rows.where(F.col("n") > whole), at, head, cells))
    found = out.withColumnsRenamed({k: f"{k}__k" for k in keys}).drop("n")
    return sizes.join(found, condition).select(*at, "low", "high", "count", "total", "squares", "height", "frequency")


def _long(rows: DataFrame, at: list[str], head: str, cells: int) -> DataFrame:
    def name(pdf: pd.DataFrame) -> list:
        return [pdf[k].iloc[0] for k in at]

    def pieces(pdf: pd.DataFrame, of: dict[str, np.ndarray], axis: int, width: int) -> pd.DataFrame:
        """Rows of `block`, `of_block`: slices of arrays along an axis, width at a time."""
        length = next(iter(of.values())).shape[axis]
        out = []
        for b, a in enumerate(range(0, length, width)):
            cutout = (slice(a, a + width), slice(None)) if axis == 0 else (slice(None), slice(a, a + width))
            out.append([*name(pdf), b, int(pdf["block"].iloc[0]), *[_pack(x[cutout]) for x in of.values()]])
        return pd.DataFrame(out, columns=[*at, "block", "of_block", *of])

    def widths(n: int) -> tuple[int, int, int, int]:
        n1, n2 = shape(n)
        return n1, n2, max(1, cells // n2), max(1, cells // n1)

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        n1, n2, w1, w2 = widths(n)
        j2 = np.arange(int(pdf["block"].iloc[0]) * w2, min((int(pdf["block"].iloc[0]) + 1) * w2, n2))
        i = pdf["i__"].to_numpy(np.int64)
        x = np.zeros((n1, len(j2)), complex)
        x[i // n2, i % n2 - j2[0]] = pdf["v"].to_numpy() * _chirp(i, n).conj()
        j = np.arange(n1)[:, None] * n2 + j2
        back = n1 * n2 - j
        b = np.where((j < n) | (back < n), _chirp(np.minimum(j, back), n), 0)
        turn = _turns(np.arange(n1)[:, None], j2[None, :], n1 * n2, -1)
        return pieces(pdf, {"x": np.fft.fft(x, axis=0) * turn, "b": np.fft.fft(b, axis=0) * turn}, 0, w1)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        n1, n2, w1, w2 = widths(n)
        k1 = np.arange(int(pdf["block"].iloc[0]) * w1, min((int(pdf["block"].iloc[0]) + 1) * w1, n1))
        pdf = pdf.sort_values("of_block")
        x, b = (np.concatenate([_unpack(p, len(k1)) for p in pdf[c]], axis=1) for c in ("x", "b"))
        y = np.fft.ifft(np.fft.fft(x, axis=1) * np.fft.fft(b, axis=1), axis=1) * _turns(k1[:, None], np.arange(n2)[None, :], n1 * n2, 1)
        return pieces(pdf, {"y": y}, 1, w2)

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        n1, n2, _, w2 = widths(n)
        width = min(w2, n2 - int(pdf["block"].iloc[0]) * w2)
        pdf = pdf.sort_values("of_block")
        y = np.fft.ifft(np.concatenate([_unpack(p, len(p) // 16 // width) for p in pdf["y"]]), axis=0)
        k = np.arange(n1)[:, None] * n2 + int(pdf["block"].iloc[0]) * w2 + np.arange(width)
        wanted = (k >= 1) & (k < n // 2)
        a = np.abs(y[wanted])
        count, total, squares, height, place = _verdict(a, 0)
        return pd.DataFrame([[*name(pdf), count, total, squares, height, int(k[wanted][place]) if count else 0]], columns=[*at, "count", "total", "squares", "height", "frequency"])

    bits = F.length(F.bin(2 * F.col("n") - 2))
    n1, n2 = (F.pow(F.lit(2.0), b).cast("long") for b in (F.floor(bits / 2), bits - F.floor(bits / 2)))
    block = F.floor((F.col("i__") % n2) / F.greatest(F.lit(1), F.floor(F.lit(cells) / n1))).cast("long")
    sent = rows.withColumn("block", block).groupBy(*at, "block").applyInPandas(columns, f"{head}, block long, of_block long, x binary, b binary")
    turned = sent.groupBy(*at, "block").applyInPandas(across, f"{head}, block long, of_block long, y binary")
    found = turned.groupBy(*at, "block").applyInPandas(back, f"{head}, {_SUMS}")
    return found.groupBy(*at).agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("height").alias("height"), F.max_by("frequency", F.struct("height", -F.col("frequency"))).alias("frequency"))


def series_of(df: DataFrame, cols: list[str], keys: list[str], tie: str) -> DataFrame:
    """keys, column__, v, i__ of each column's values in time order: a place counts values only; nulls and NaN are left out."""
    long = df.select(*keys, "time", tie, F.explode(F.array(*[F.struct(F.lit(c).alias("column__"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"))
    long = long.select(*keys, "x.column__", F.col("time").alias("time__"), F.col(tie).alias("tie__"), "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    return placed(long, [*keys, "column__"], ["time__", "tie__"]).drop("time__", "tie__")


def seasonality(series: DataFrame, keys: list[str], least: int = 1000, sds: float = 3.0, whole: int = WHOLE, cells: int = CELLS) -> DataFrame:
    """keys, n, frequency, height, threshold and is_seasonal of series (see series_of) of more than `least` values: does an amplitude exceed the mean by `sds` standard deviations?

    Shorter series and constant ones are not seasonal.
    """
    a = amplitudes(series, keys, whole, cells)
    mean = F.col("total") / F.col("count")
    threshold = mean + sds * F.sqrt(F.greatest(F.col("squares") / F.col("count") - mean * mean, F.lit(0.0)))
    out = a.withColumn("threshold", F.when(F.col("count") > 0, threshold))
    found = (F.col("n") > least) & (F.col("high") > F.col("low")) & (F.col("height") > F.col("threshold"))
    return out.select(*keys, "n", "frequency", "height", "threshold", F.coalesce(found, F.lit(False)).alias("is_seasonal"))
