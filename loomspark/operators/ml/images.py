"""Rectangle features of small grey images through integral images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integral(black: np.ndarray) -> np.ndarray:
    """Prefix sums over rows and columns, with a leading row and column of zeros. black: (n, rows, cols) of 0 and 1."""
    out = np.zeros((len(black), black.shape[1] + 1, black.shape[2] + 1), np.int64)
    out[:, 1:, 1:] = black.cumsum(1).cumsum(2)
    return out


def black_count(sums: np.ndarray, top: int, left: int, bottom: int, right: int) -> np.ndarray:
    """Black pixels of the rectangle, ends exclusive."""
    return sums[:, bottom, right] - sums[:, top, right] - sums[:, bottom, left] + sums[:, top, left]


def rectangles(rows: int, cols: int, count: int, low: int = 130, high: int = 170, seed: int = 1) -> list[tuple[int, int, int, int]]:
    """Random rectangles with an area from low to high."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < count:
        top, left = int(rng.integers(rows)), int(rng.integers(cols))
        bottom, right = int(rng.integers(top + 1, rows + 1)), int(rng.integers(left + 1, cols + 1))
        if low <= (bottom - top) * (right - left) <= high:
            out.append((top, left, bottom, right))
    return out


def haar(images: DataFrame, boxes: list[tuple[int, int, int, int]]) -> DataFrame:
    """(id, label, features): per rectangle the upper less the lower half, and the left less the right half.

    images (id, rows, cols, pixels binary, label); a pixel over 127 is black. All images have one size.
    """

    def run(parts):
        import pandas as pd

        for p in parts:
            if not len(p):
                continue
            h, w = int(p["rows"].iloc[0]), int(p["cols"].iloc[0])
            black = np.frombuffer(b"".join(p["pixels"]), np.uint8).reshape(-1, h, w) > 127
            s = integral(black)
            cols = []
            for t, l, b, r in boxes:
                y, x = (t + b) // 2, (l + r) // 2
                cols.append(black_count(s, t, l, y, r) - black_count(s, y, l, b, r))
                cols.append(black_count(s, t, l, b, x) - black_count(s, t, x, b, r))
            yield pd.DataFrame({"id": p["id"], "label": p["label"], "features": np.array(cols, float).T.tolist()})

    return images.select(F.col("id").cast("long"), "rows", "cols", "pixels", F.col("label").cast("int")).mapInPandas(run, "id long, label int, features array<double>")
