"""Generated corpora: each row depends on seed and position alone."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Correlation of neighbouring coordinates in the correlated corpus (fixed value).
RHO = 0.85


def rows(kind: str, dim: int, ids: np.ndarray, seed: int) -> np.ndarray:
    """Vectors of the ids: independent normals, or an autoregressive chain over the coordinates."""
    z = np.stack([np.random.Generator(np.random.PCG64([seed, int(i)])).standard_normal(dim) for i in ids]) if len(ids) else np.zeros((0, dim))
    if kind == "correlated":
        for c in range(1, dim):
            z[:, c] = RHO * z[:, c - 1] + np.sqrt(1 - RHO * RHO) * z[:, c]
    elif kind != "gaussian":
        raise ValueError(f"no corpus kind {kind!r}")
    return z.astype(np.float32)


def parse(name: str) -> tuple[str, int, int]:
    """Kind, dimension and count of ``generated-<gaussian|correlated>-<dim>x<count>``."""
    m = re.fullmatch(r"generated-(gaussian|correlated)-([1-9]\d*)x([1-9]\d*)", name)
    if not m:
        raise ValueError(f"not a generated corpus: {name!r}")
    return m[1], int(m[2]), int(m[3])


def generated(spark: SparkSession, name: str, seed: int = 0, first: int = 0) -> DataFrame:
    """``row_id, v``; a longer corpus of the same seed begins with the same rows."""
    kind, dim, count = parse(name)

    def run(batches):
        for part in batches:
            ids = part["id"].to_numpy()
            yield pd.DataFrame({"row_id": ids, "v": list(rows(kind, dim, ids, seed))})

    return spark.range(first, first + count).mapInPandas(run, "row_id long, v array<float>")


def splitmix(seed: int, n: int) -> np.ndarray:
    """n numbers in [-1, 1) from a 64-bit mixing counter, for checks that need no good randomness."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed % (1 << 64)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1.0).astype(np.float32)


def factors(ratings: np.ndarray, rank: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column factors of a matrix, each with the root of the singular values, padded with zeros to ``dim``.

    Each component has the sign that makes its largest row entry positive, so that the result is unique.
    """
    u, s, v = np.linalg.svd(ratings, full_matrices=False)
    rank = min(rank, len(s))
    u, s, v = u[:, :rank], np.sqrt(s[:rank]), v[:rank].T
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(rank)])
    sign[sign == 0] = 1
    pad = lambda x: np.pad(x, ((0, 0), (0, dim - rank))).astype(np.float32)
    return pad(u * sign * s), pad(v * sign * s)
