"""Activations, costs and conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Horizontal aperture in mm where a configuration has none.
APERTURE = 20.955


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_at(logits: Column, i: Column) -> Column:
    """Probability of class i; shifted by the largest logit."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    return F.exp(F.get(logits, i) - top) / total


def bce_with_logits(x: Column, target: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def focal_class_cost(p: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Matching cost of probability p at the true class."""
    positive = alpha * F.pow(1 - p, F.lit(gamma)) * -F.log(p + 1e-8)
    negative = (1 - alpha) * F.pow(p, F.lit(gamma)) * -F.log(1 - p + 1e-8)
    return positive - negative


def focal_loss(x: Column, target: Column, alpha: float = 0.75, gamma: float = 2.0) -> Column:
    p = sigmoid(x)
    p_true = p * target + (1 - p) * (1 - target)
    balance = alpha * target + (1 - alpha) * (1 - target)
    return balance * F.pow(1 - p_true, F.lit(gamma)) * bce_with_logits(x, target)


def focal_length(fov: Column, aperture: Column | None = None) -> Column:
    """Focal length for a field of view in degrees: the smaller the view, the longer."""
    return F.coalesce(aperture, F.lit(APERTURE)) / (2 * F.tan(F.radians(fov) / 2)) if aperture is not None else F.lit(APERTURE) / (2 * F.tan(F.radians(fov) / 2))


def rounded(text: Column, digits: int = 4) -> Column:
    """A number in a text, rounded; blank or missing raises."""
    return F.round(F.trim(text).cast("double"), digits)


def truncated(text: Column) -> Column:
    return F.trim(text).cast("double").cast("int")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_number(name: Column) -> Column:
    return F.substring_index(name, "_", -1).try_cast("int")


def subset_of(path: Column) -> Column:
    """The second element of a path without its leading slashes; empty if there is none."""
    return F.coalesce(F.get(F.split(F.ltrim(path, F.lit("/")), "/"), F.lit(1)), F.lit(""))


def reached(cuts: Column, value: Column, size: int) -> Column:
    """How many of the ascending cuts, fewer than `size`, are no larger than the value, by bisection; 0 without cuts."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(size.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))
