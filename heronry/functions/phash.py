"""Perceptual hashes of pictures: grey, 32 x 32, two-dimensional DCT, bits above the median of the low frequencies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW = 32, 8


def dct_matrix(n: int = SIDE) -> np.ndarray:
    """Orthonormal DCT-II."""
    u, x = np.arange(n)[:, None], np.arange(n)[None, :]
    c = np.cos(np.pi * u * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


_DCT = dct_matrix()


def hashes_of(pixels: np.ndarray, variant: str = "block8") -> np.ndarray:
    """int64 hashes of (n, 32, 32) grey pictures. block8 takes the bits from the 8 x 8 block of low frequencies, linear64 from
    the first 64 coefficients in row order; the median is that of the block without its first coefficient in both."""
    f = _DCT @ pixels.astype(np.float64) @ _DCT.T
    block = f[:, :LOW, :LOW].reshape(len(f), -1)
    median = np.sort(block[:, 1:], axis=1)[:, (LOW * LOW - 1) // 2]
    bits = (block if variant == "block8" else f.reshape(len(f), -1)[:, :LOW * LOW]) > median[:, None]
    bits[:, 0] = False
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()


def _lanczos(n: int, m: int) -> np.ndarray:
    """(m, n) weights of a Lanczos resize, widened when shrinking."""
    scale = n / m
    support = 3 * max(1.0, scale)
    at = (np.arange(m)[:, None] + 0.5) * scale - 0.5
    d = (np.arange(n)[None, :] - at) / max(1.0, scale)
    w = np.where(np.abs(d) * max(1.0, scale) < support, np.sinc(d) * np.sinc(d / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def resized(grey_pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    h, w = grey_pixels.shape
    return np.clip(np.rint(_lanczos(h, side) @ grey_pixels.astype(np.float64) @ _lanczos(w, side).T), 0, 255)


def grey(height, width, channels, data) -> np.ndarray | None:
    """Luma of BGR or grey bytes; None if the picture was not readable."""
    if data is None or not height or not width or height < 1 or width < 1 or len(data) != height * width * channels:
        return None
    p = np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels)).astype(np.float64)
    return p[:, :, 0] if channels == 1 else np.rint(0.114 * p[:, :, 0] + 0.587 * p[:, :, 1] + 0.299 * p[:, :, 2])


@F.pandas_udf(T.LongType())
def phash_column(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    small = [None if (g := grey(*x)) is None else resized(g) for x in zip(height, width, channels, data)]
    ok = [i for i, s in enumerate(small) if s is not None]
    out = pd.Series([None] * len(small), dtype="Int64")
    if ok:
        out.iloc[ok] = hashes_of(np.stack([small[i] for i in ok]))
    return out


def phash_of_array(pixels: Column, variant: str = "block8") -> Column:
    """Hash of an array of 1024 grey values; null for null and other lengths."""

    @F.pandas_udf(T.LongType())
    def of(p: pd.Series) -> pd.Series:
        ok = [i for i, x in enumerate(p) if x is not None and len(x) == SIDE * SIDE]
        out = pd.Series([None] * len(p), dtype="Int64")
        if ok:
            out.iloc[ok] = hashes_of(np.stack([np.asarray(p.iloc[i], np.float64).reshape(SIDE, SIDE) for i in ok]), variant)
        return out

    return of(pixels)
