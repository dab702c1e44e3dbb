"""Exact search: the truth that compressed search is measured against."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillon.errors import InvalidOptions
from quillon.functions.codec import norms
from quillon.operators.blocks import batched, best, matrix, merge, shard

FOUND = "query_id long, row_id long, score double"


def exact_topk(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", dim: int = 64, exclude: str | None = None) -> DataFrame:
    """``query_id, row_id, score, rank``: the k rows of highest cosine or dot product, ties to the lower row.

    ``index`` has ``row_id, v``, ``queries`` ``query_id, v``, all vectors valid. ``exclude`` names a column of the
    queries with the row that must not come out (null: none), however alike other rows are to it. Products are
    summed in coordinate order in double precision. With fewer than k rows all come out; zero vectors have no
    cosine and neither come out nor ask.
    """
    if k < 1:
        raise InvalidOptions("k must be 1 or more")
    if metric not in ("cosine", "dot"):
        raise InvalidOptions(f"no metric {metric!r}")

    def kernel(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        x, ids = matrix(rows.v, dim).astype(np.float64), rows.row_id.to_numpy()
        n = norms(x)
        if metric == "cosine":
            x, ids = x[n > 0] / n[n > 0][:, None], ids[n > 0]
        out = []
        for block in batched(asked, 128):
            q = matrix(block.v, dim).astype(np.float64)
            m = norms(q)
            if metric == "cosine":
                q = q / np.where(m > 0, m, 1)[:, None]
            scores = np.zeros((len(q), len(x)))
            for c in range(dim):
                scores += q[:, c, None] * x[:, c]
            barred = block[exclude].tolist() if exclude else [None] * len(block)
            for i, query in enumerate(block.query_id.tolist()):
                if metric == "cosine" and m[i] == 0:
                    continue
                s, own = scores[i], ids
                if barred[i] is not None and barred[i] == barred[i]:
                    keep = ids != barred[i]
                    s, own = s[keep], ids[keep]
                at = best(s, own, k)
                out.append(pd.DataFrame({"query_id": query, "row_id": own[at], "score": s[at]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "row_id", "score"])

    columns = ["query_id", "v"] + ([exclude] if exclude and exclude not in ("query_id", "v") else [])
    return merge(shard(index.select("row_id", "v"), queries.select(*columns), kernel, FOUND), k)


def merge_topk(before: DataFrame, chunk: DataFrame, k: int) -> DataFrame:
    """The best k of each query from a former best and a new chunk's; the order of chunks does not matter."""
    columns = ("query_id", "row_id", "score")
    return merge(before.select(*columns).unionByName(chunk.select(*columns)).distinct(), k)
