"""Image tensors and sharpness from Spark's image source (BGR bytes), as Arrow batch functions.

By default in fixed-point arithmetic with 8-bit results after each step, as usual image libraries do it: bilinear weights
are multiples of 1 / 2048, rounded half to even; the columns of a row are weighed first, then the rows, whose sums lose 4,
then 16, then 2 bits; grey is a sum of 15-bit weights. `fixed=False` takes real numbers without rounding in between (pixel
centres, ITU-R 601 weights).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 640
#: Bytes of tensors that a task holds at once.
BATCH_BYTES = 8 << 20
#: Bits of a bilinear weight, and weights of red, green and blue in 1 / 32768.
WEIGHT_BITS, GREY, GREY_BITS = 11, (9798, 19235, 3735), 15


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, not keeping the aspect."""
    h, w = img.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if img.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def _taps(to: int, of: int, hold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two source places of each target place and their integer weights; hold: beyond the border one place has all."""
    at = ((np.arange(to) + 0.5) * (of / to) - 0.5).astype(np.float32)
    low = np.floor(at).astype(int)
    part = at - low.astype(np.float32)
    if hold:
        part = np.where((low < 0) | (low >= of - 1), np.float32(0), part)
    one = np.float32(1 << WEIGHT_BITS)
    return np.clip(low, 0, of - 1), np.clip(low + 1, 0, of - 1), np.rint((1 - part) * one).astype(np.int64), np.rint(part * one).astype(np.int64)


def resize_fixed(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear of bytes (rows, columns, channels) in integers, not keeping the aspect; the same size gives the same bytes."""
    h, w = img.shape[:2]
    if (h, w) == (height, width):
        return img.copy()
    x0, x1, a0, a1 = _taps(width, w, True)
    y0, y1, b0, b1 = _taps(height, h, False)
    src = img.astype(np.int64)
    rows = src[:, x0] * a0[None, :, None] + src[:, x1] * a1[None, :, None]
    top, low = (rows[y0] >> 4) * b0[:, None, None], (rows[y1] >> 4) * b1[:, None, None]
    return np.clip(((top >> 16) + (low >> 16) + 2) >> 2, 0, 255).astype(np.uint8)


def grey_fixed(bgr: np.ndarray) -> np.ndarray:
    """Bytes of grey from bytes of BGR."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return ((GREY[0] * r + GREY[1] * g + GREY[2] * b + (1 << (GREY_BITS - 1))) >> GREY_BITS).astype(np.uint8)


def to_chw(data: bytes, height: int, width: int, channels: int, size: int = SIZE, fixed: bool = True) -> np.ndarray:
    """float32 RGB in [0, 1], channels first."""
    img = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., :3]
    sized = resize_fixed(img, size, size) if fixed else resize(img.astype(np.float64), size, size)
    return (sized[..., ::-1].transpose(2, 0, 1) / (np.float32(255) if fixed else 255)).astype(np.float32)


def laplacian_variance(grey: np.ndarray) -> float:
    p = np.pad(grey, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey).var())


def to_uint8(x: np.ndarray) -> np.ndarray:
    """Truncating; channels first is turned to channels last, a batch axis of one goes."""
    x = x[0] if x.ndim == 4 else x
    x = x.transpose(1, 2, 0) if x.shape[0] in (1, 3) and x.shape[-1] not in (1, 3) else x
    return (np.clip(x, 0, 1) * 255).astype(np.uint8)


def image_tensors(images: DataFrame, size: int = SIZE, fixed: bool = True) -> DataFrame:
    """images(sample_id, data, height, width, channels) -> tensor (bytes of float32, 3 x size x size).

    A tensor is many times its image, so results leave in batches of BATCH_BYTES, whatever the batches of the images hold.
    """
    most = max(1, BATCH_BYTES // (3 * size * size * 4))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                rows = zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_chw(*x, size=size, fixed=fixed).tobytes() for x in rows], pa.binary())], ["sample_id", "tensor"])

    kind = images.schema["sample_id"].dataType.simpleString()
    return images.select("sample_id", "data", "height", "width", "channels").mapInArrow(run, f"sample_id {kind}, tensor binary")


def sharpness(images: DataFrame, size: int = SIZE, fixed: bool = True) -> DataFrame:
    """Population variance of the Laplacian of the grey, resized image."""

    @F.pandas_udf("double")
    def run(d: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        def one(data, h, w, c):
            if fixed:
                img = np.frombuffer(data, np.uint8).reshape(h, w, c)[..., :3]
                return laplacian_variance(grey_fixed(resize_fixed(img, size, size)).astype(np.float64))
            r, g, b = to_chw(data, h, w, c, size, False).astype(np.float64) * 255
            return laplacian_variance(0.299 * r + 0.587 * g + 0.114 * b)

        return pd.Series([one(*x) for x in zip(d, h, w, c, strict=True)])

    return images.select("sample_id", run("data", "height", "width", "channels").alias("sharpness"))


def read_images(spark, path: str) -> DataFrame:
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("sample_id"), "image.data", "image.height", "image.width", F.col("image.nChannels").alias("channels"))
