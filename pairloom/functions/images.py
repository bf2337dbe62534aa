"""Images: names of files, and block hashes of decoded pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slug(text: Column) -> Column:
    """Lower-cased ASCII letters and digits, joined by single hyphens."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def image_name(prefix: str, key: Column, index: Column) -> Column:
    """The file name of a product's image: prefix, and the SHA-224 of the product's id and the image's number."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(slug(F.concat(key, F.lit("_image_"), index.cast("string"))), 224), F.lit(".jpg"))


def block_values(pixels: np.ndarray, bits: int = 8) -> np.ndarray:
    """Sums of red, green and blue over bits x bits blocks; pixels on a border count for both blocks in proportion.

    pixels: height x width x 4 (red, green, blue, opacity); a transparent pixel counts as white.
    """
    light = np.where(pixels[..., 3] == 0, 765.0, pixels[..., :3].sum(axis=2, dtype=float))

    def shares(n: int) -> np.ndarray:
        """Row i: how much of each of n lines lies in block i."""
        edges = np.arange(bits + 1) * n / bits
        lines = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], lines + 1) - np.maximum(edges[:-1, None], lines), 0, 1)

    return shares(light.shape[0]) @ light @ shares(light.shape[1]).T


def block_hash(pixels: np.ndarray, bits: int = 8) -> str:
    """Hexadecimal hash: a bit for each block, set if it is lighter than the median of its quarter of the rows.

    Blocks at the median are set if the median itself is in the lighter half of what is possible.
    """
    values = block_values(pixels, bits)
    half = pixels.shape[0] * pixels.shape[1] * 765 / (bits * bits) / 2
    bands = values.reshape(4, -1)
    median = np.median(bands, axis=1, keepdims=True)
    on = (bands > median) | ((np.abs(bands - median) < 1) & (median > half))
    return np.packbits(on.ravel()).tobytes().hex()


def image_hash(width: Column, height: Column, rgba: Column) -> Column:
    """Block hashes of decoded images: rgba has four bytes a pixel, line by line. Null where the sizes don't fit."""

    @F.pandas_udf(T.StringType())
    def made(w: pd.Series, h: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for x, y, d in zip(w, h, data, strict=True):
            fits = d is not None and not pd.isna(x) and not pd.isna(y) and x > 0 and y > 0 and len(d) == x * y * 4
            out.append(block_hash(np.frombuffer(d, np.uint8).reshape(int(y), int(x), 4)) if fits else None)
        return pd.Series(out, dtype=object)

    return made(width, height, rgba)
