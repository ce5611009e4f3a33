"""Expressions over grey-value arrays (row-major page thumbnails)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Thresholds of the page measurements.
BLANK_STD, BLANK_INK, BLANK_EDGE = 10.0, 0.0020, 0.0010
INK_LEVEL = 245
SHARP_VARIANCE = 500.0
SHARPNESS_SHARE, CONTRAST_SHARE = 0.6, 0.4
HEADER_SHARE = 0.20


def _total(px: Column, f) -> Column:
    return F.aggregate(px, F.lit(0).cast("bigint"), lambda acc, p: acc + f(p.cast("bigint")))


def std_dev(px: Column) -> Column:
    """Population deviation from exact whole-number sums, so the result does not depend on summing order."""
    n = F.size(px).cast("bigint")
    spread = n * _total(px, lambda p: p * p) - F.pow(_total(px, lambda p: p), F.lit(2)).cast("bigint")
    return F.when(n > 0, F.sqrt(spread.cast("double")) / n)


def contrast(px: Column) -> Column:
    return (F.array_max(px) - F.array_min(px)) / F.lit(255.0)


def ink_share(px: Column) -> Column:
    return F.when(F.size(px) > 0, _total(px, lambda p: (p <= INK_LEVEL).cast("bigint")) / F.size(px))


def mean_hash(px: Column) -> Column:
    """SHA-256 of the above-mean bit string."""
    mean = _total(px, lambda p: p) / F.size(px)
    bits = F.array_join(F.transform(px, lambda p: F.when(p > mean, F.lit("1")).otherwise(F.lit("0"))), "")
    return F.sha2(bits, 256)


def top_rows(px: Column, width: Column, height: Column, share: float = HEADER_SHARE) -> Column:
    return F.slice(px, 1, (F.floor(height * share) * width).cast("int"))


def quality(laplacian_variance: Column, px: Column) -> Column:
    sharp = F.least(laplacian_variance / SHARP_VARIANCE, F.lit(1.0))
    return sharp * SHARPNESS_SHARE + contrast(px) * CONTRAST_SHARE


def _variances(pages: np.ndarray) -> np.ndarray:
    """Of pages of one size, stacked (page, row, column)."""
    grid = np.pad(pages, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    lap = grid[:, :-2, 1:-1] + grid[:, 2:, 1:-1] + grid[:, 1:-1, :-2] + grid[:, 1:-1, 2:] - 4 * pages
    n = pages.shape[1] * pages.shape[2]
    return (n * (lap * lap).sum(axis=(1, 2)) - lap.sum(axis=(1, 2)) ** 2) / (n * n)


STACKED = 1 << 22  # pixels that are taken together


@F.pandas_udf(DoubleType())
def laplacian_variance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Variance of the 4-neighbour Laplacian with reflected borders; pages of one size are taken together."""
    for pixels, widths in batches:
        sizes = pd.DataFrame({"n": pixels.map(len).to_numpy(), "w": widths.to_numpy(dtype=np.int64)})
        out = np.zeros(len(sizes))
        for (n, width), rows in sizes.groupby(["n", "w"]).groups.items():
            step = max(1, STACKED // max(n, 1))
            for begin in range(0, len(rows), step):
                some = rows[begin : begin + step]
                stacked = np.stack(pixels.to_numpy()[some]).astype(np.int64)
                out[some] = _variances(stacked.reshape(len(some), -1, width))
        yield pd.Series(out)
