"""Augmentation by epoch: affine maps of boxes and colour matrices of pixels, drawn by a hash.

A sample's draw of an epoch depends on seed, sample and epoch alone, so lost partitions and later runs draw it again.
Space: zoom about the image's centre, then a shift, then a mirror (x becomes width - x). Boxes are mapped, clipped to the
image, and go if too little of their area is left or a side falls below its least length. Colour: hue is rotated about
the grey axis, saturation scaled about the pixel's grey, contrast about a centre; all three are affine, so they are one
matrix of 3 x 4 for RGB in [0, 1].
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .randomize import uniform, unit

#: Ranges of the standard recipe, the grey of a pixel, and the grey axis.
FLIP, ZOOM, SHIFT = 0.5, (0.5, 1.5), (8.0, 8.0)
HUE, SATURATION, CONTRAST, CENTRE = 25.0, 0.2, 0.1, 0.5
LUMA = (0.299, 0.587, 0.114)
MIN_SIDE = 20.0


def draws(samples: DataFrame, epochs: int, seed: int = 0, flip: float = FLIP, zoom: tuple = ZOOM, shift: tuple = SHIFT, hue: float = HUE, saturation: float = SATURATION, contrast: float = CONTRAST) -> DataFrame:
    """samples x epochs: sample_id, epoch, mirrored, zoom, dx, dy (pixels), hue (degrees), saturation and contrast (factors)."""
    d = samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")) if epochs > 0 else samples.select("sample_id", F.lit(0).alias("epoch")).limit(0)
    u = lambda name: unit(seed, name, F.col("sample_id"), F.col("epoch"))
    around = lambda most, name: uniform(-most, most, u(name))
    return d.select(
        "sample_id", "epoch", (u("mirror") < flip).alias("mirrored"), uniform(*map(F.lit, zoom), u("zoom")).alias("zoom"), around(shift[0], "dx").alias("dx"), around(shift[1], "dy").alias("dy"),
        around(hue, "hue").alias("hue"), (1 + around(saturation, "saturation")).alias("saturation"), (1 + around(contrast, "contrast")).alias("contrast"),
    )


def augment_boxes(boxes: DataFrame, drawn: DataFrame, width: float, height: float, min_side: float = MIN_SIDE, min_share: float = 0.0) -> DataFrame:
    """boxes(sample_id, ..., x, y, w, h in pixels) of every epoch drawn; epoch, and share: how much of a mapped box is inside.

    A box stays if both its sides inside the image reach min_side and its share exceeds min_share.
    """
    own = [c for c in boxes.columns if c not in ("x", "y", "w", "h")]
    j = boxes.join(drawn.select("sample_id", "epoch", "mirrored", "zoom", "dx", "dy"), "sample_id")
    across = lambda c: F.col("zoom") * (c - width / 2) + width / 2 + F.col("dx")
    down = lambda c: F.col("zoom") * (c - height / 2) + height / 2 + F.col("dy")
    left, right = across(F.col("x")), across(F.col("x") + F.col("w"))
    left, right = F.when(F.col("mirrored"), width - right).otherwise(left), F.when(F.col("mirrored"), width - left).otherwise(right)
    clip = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(most)))
    j = j.withColumns({"__x1": clip(left, width), "__y1": clip(down(F.col("y")), height), "__x2": clip(right, width), "__y2": clip(down(F.col("y") + F.col("h")), height)})
    w, h = F.col("__x2") - F.col("__x1"), F.col("__y2") - F.col("__y1")
    share = F.coalesce(F.try_divide(w * h, F.col("zoom") * F.col("zoom") * F.col("w") * F.col("h")), F.lit(0.0))
    out = j.select(*own, "epoch", F.col("__x1").alias("x"), F.col("__y1").alias("y"), w.alias("w"), h.alias("h"), share.alias("share"))
    return out.where((F.col("w") >= min_side) & (F.col("h") >= min_side) & (F.col("share") > min_share))


def colour_matrix(hue: Column, saturation: Column, contrast: Column, centre: float = CENTRE) -> Column:
    """Twelve numbers, row by row: contrast over saturation over hue, of RGB and one."""
    c, s = F.cos(F.radians(hue)), F.sin(F.radians(hue)) / math.sqrt(3)
    third = (1 - c) / 3
    turn = [[third + (c if i == j else 0) + (0 if i == j else (s if (j - i) % 3 == 2 else -s)) for j in range(3)] for i in range(3)]
    grey = [sum((LUMA[k] * turn[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)]
    rows = [[contrast * (saturation * turn[i][j] + (1 - saturation) * grey[j]) for j in range(3)] + [centre * (1 - contrast)] for i in range(3)]
    return F.array(*[x for row in rows for x in row])


def recoloured(data: bytes, height: int, width: int, matrix) -> bytes:
    """BGR bytes under a matrix of RGB, rounded half up and clipped."""
    m = np.asarray(matrix, float).reshape(3, 4)
    rgb = np.frombuffer(data, np.uint8).reshape(-1, 3)[:, ::-1] / 255
    out = np.floor(np.clip(rgb @ m[:, :3].T + m[:, 3], 0, 1) * 255 + 0.5).astype(np.uint8)
    return out[:, ::-1].tobytes()


def augment_images(images: DataFrame, drawn: DataFrame) -> DataFrame:
    """images(sample_id, data, height, width, channels = 3): the colours of every epoch drawn; epoch is added."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, h: pd.Series, w: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([recoloured(*x) for x in zip(d, h, w, m, strict=True)])

    j = images.join(drawn.select("sample_id", "epoch", colour_matrix(F.col("hue"), F.col("saturation"), F.col("contrast")).alias("__m")), "sample_id")
    return j.select("sample_id", "epoch", run("data", "height", "width", "__m").alias("data"), "height", "width", "channels")
