"""Compressed two-stage search: scan of all codes, refinement of the best, length correction, certified intervals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.common import BROADCAST_LIMIT, parallelism
from quillon.errors import InvalidOptions
from quillon.functions import bounds, codec
from quillon.functions.codec import Model
from quillon.operators.blocks import batched, best, bytes_matrix, matrix, merge, shard
from quillon.spec import ONE, SEGMENT_ROWS

ENCODED = "row_id long, segment int, code binary, residual binary, mag_bits int, err_primary double, err_refined double, outside double"
HITS = "query_id long, rank int, row_id long, segment int, score double, lower double, upper double, magnitude double, primary_raw long, refined_raw long, recon_length double"


#: Rows, at most, that a task of the scan holds for all queries together.
HELD = 1 << 20
#: Queries, about, that are refined in one call.
REFINED = 256


@dataclass(frozen=True)
class Ranking:
    """What orders rows: keys of the integer primary scores and of the corrected ones, both from the bits of the stored
    length too, and how a corrected key and the certified cosine interval become a score and its interval, given the
    length of the query. Higher keys come first."""

    name: str
    primary: Callable[[np.ndarray, np.ndarray], np.ndarray]
    refined: Callable[[np.ndarray, np.ndarray], np.ndarray]
    score: Callable[[np.ndarray, float], np.ndarray]
    interval: Callable[[np.ndarray, np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray]]


COSINE = Ranking("cosine", lambda raw, bits: raw.astype(np.float64), lambda fixed, bits: fixed, lambda key, length: key / ONE, lambda low, high, bits, length: (low, high))


def _weighted(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    weight = codec.units(bits)
    return np.where(weight > 0, x * weight, 0.0)


DOT = Ranking("dot", lambda raw, bits: raw.astype(np.float64) * codec.units(bits), _weighted, lambda key, length: key / float(ONE) ** 2 * length, bounds.dot_interval)
RANKINGS = {r.name: r for r in (COSINE, DOT)}


def ranking_of(metric: str | Ranking) -> Ranking:
    if isinstance(metric, Ranking):
        return metric
    if metric not in RANKINGS:
        raise InvalidOptions(f"no metric {metric!r}")
    return RANKINGS[metric]


def encode_rows(rows: DataFrame, model: Model, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The codes of valid vectors ``row_id, v``; the rest of the model's work on a row is done in this one pass."""

    def run(batches):
        for docs in batches:
            x = matrix(docs.v, model.spec.dim)
            y = model.rotation.forward(codec.directions(x))
            codes, res, p, e = codec.encode(y, model)
            a, b, outside = codec.errors(y, p, e, model.centers)
            ids = docs.row_id.to_numpy()
            yield pd.DataFrame(
                {
                    "row_id": ids, "segment": (ids // segment_rows).astype(np.int32),
                    "code": [r.tobytes() for r in codec.pack(codes)], "residual": [r.tobytes() for r in res],
                    "mag_bits": codec.half_bits(codec.norms(x)), "err_primary": a, "err_refined": b, "outside": outside,
                }
            )

    return rows.select("row_id", "v").mapInPandas(run, ENCODED)


def certificates(encoded: DataFrame, model: Model) -> DataFrame:
    """Per segment: rows, the largest errors of its rows, and the bounds that follow from them."""
    spec = model.spec

    @F.pandas_udf("double")
    def eps(error: pd.Series, refined: pd.Series) -> pd.Series:
        return pd.Series([bounds.epsilon(spec, float(np.nextafter(e, np.inf)), bool(r)) for e, r in zip(error, refined)])

    return (
        encoded.groupBy("segment")
        .agg(F.min("row_id").alias("first_row"), F.count("*").alias("row_count"), F.max("err_primary").alias("err_primary"), F.max("err_refined").alias("err_refined"))
        .withColumn("eps_primary", eps("err_primary", F.lit(False)))
        .withColumn("eps_refined", eps("err_refined", F.lit(True)))
    )


def check_options(k: int, budget: int | None, rows: int, excluding: bool) -> int:
    """The effective budget."""
    if k < 1:
        raise InvalidOptions("k must be 1 or more")
    budget = max(200, 2 * k) if budget is None else budget
    if budget < k:
        raise InvalidOptions(f"a budget of {budget} for {k} hits")
    return max(0, min(budget, rows - excluding))


_POOL = "query_id long, row_id long, segment int, primary_raw long, score double"
_STORED = ", code binary, residual binary, mag_bits int"


def scan(
    index: DataFrame, queries: DataFrame, model: Model, budget: int, metric: str | Ranking = "cosine", exclude: str | None = None, rows: int | None = None, stored: bool = False, asked: int | None = None
) -> DataFrame:
    """Stage 1: ``query_id, row_id, segment, primary_raw, score, rank`` of the ``budget`` rows of highest integer score per query.

    For dot products the score is weighted by the stored length before anything is dropped. A row that a query
    excludes is passed over before it could take a place. Only codes, lengths and ids are read; with ``stored``
    residual codes too, and what is stored of the rows kept comes out with them (``code, residual, mag_bits``), so
    that the index is not looked at again.

    The index is read where it lies: every task holds the queries and their best rows so far, and no part of the
    index is shuffled. Queries are counted first; where their tables would exceed BROADCAST_LIMIT or their best
    rows HELD, queries and rows meet in blocks instead (``blocks.shard``).
    """
    spec, ranking = model.spec, ranking_of(metric)
    asked = queries.count() if asked is None else asked
    schema = _POOL + (_STORED if stored else "")
    names = [c.split()[0] for c in schema.split(", ")]
    taken = ("row_id", "segment", "code", "mag_bits", *(("residual",) if stored else ()))
    asks = queries.select(*["query_id", "v"] + ([exclude] if exclude and exclude not in ("query_id", "v") else []))

    def tables_of(part: pd.DataFrame) -> np.ndarray:
        left, _ = codec.query_tables(model.rotation.forward(codec.directions(matrix(part.v, spec.dim))), model)
        return left.astype(np.int32) if spec.dim * int(np.abs(left).max(initial=0)) < 1 << 31 else left

    def barred_of(part: pd.DataFrame) -> list:
        return [None if x is None or x != x else int(x) for x in part[exclude]] if exclude else [None] * len(part)

    def kept(block: pd.DataFrame, codes: np.ndarray, query: int, table: np.ndarray, barred: int | None, least: float | None) -> pd.DataFrame:
        """The best rows of a block for one query; none below ``least``."""
        ids, bits = block.row_id.to_numpy(), block.mag_bits.to_numpy().astype(np.int64)
        raw = codec.scan(codes, table)
        score = ranking.primary(raw, bits)
        pool = np.arange(len(ids)) if least is None else np.flatnonzero(score >= least)
        if barred is not None:
            pool = pool[ids[pool] != barred]
        at = pool[best(score[pool], ids[pool], budget)]
        some = block.iloc[at]
        out = {"query_id": np.full(len(at), query), "row_id": ids[at], "segment": some.segment.to_numpy(), "primary_raw": raw[at], "score": score[at]}
        if stored:
            out |= {"code": some.code.to_numpy(), "residual": some.residual.to_numpy(), "mag_bits": some.mag_bits.to_numpy()}
        return pd.DataFrame(out)

    if asked <= min(BROADCAST_LIMIT // (4 * spec.dim * spec.centers), HELD // budget):
        local = asks.limit(asked).toPandas().sort_values("query_id", ignore_index=True)
        shared = index.sparkSession.sparkContext.broadcast(local)

        def run(batches):
            part = shared.value
            tables = tables_of(part) if len(part) else []
            barred, state = barred_of(part), [None] * len(part)
            for block in batches:
                if not len(block):
                    continue
                codes = codec.unpack(bytes_matrix(block.code, spec.dim // 2))
                for i, query in enumerate(part.query_id.tolist()):
                    full = state[i] is not None and len(state[i]) == budget
                    new = kept(block, codes, query, tables[i], barred[i], float(state[i].score.iloc[-1]) if full else None)
                    if state[i] is not None:
                        if not len(new):
                            continue
                        new = pd.concat([state[i], new], ignore_index=True)
                        new = new.iloc[best(new.score.to_numpy(), new.row_id.to_numpy(), budget)].reset_index(drop=True)
                    state[i] = new
            for a in range(0, len(state), 64):
                some = [x for x in state[a : a + 64] if x is not None]
                if some:
                    yield pd.concat(some, ignore_index=True)[names]

        return merge(index.select(*taken).mapInPandas(run, schema), budget)

    def kernel(block: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        codes, out = codec.unpack(bytes_matrix(block.code, spec.dim // 2)), []
        for some in batched(part, 64):
            tables, barred = tables_of(some), barred_of(some)
            out.extend(kept(block, codes, query, tables[i], barred[i], None) for i, query in enumerate(some.query_id.tolist()))
        return pd.concat(out)

    return merge(shard(index.select(*taken), asks, kernel, schema, rows, asked), budget)


def search(
    index: DataFrame, queries: DataFrame, model: Model, k: int = 10, budget: int | None = None, metric: str | Ranking = "cosine", exclude: str | None = None, terms: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """Hits of each query: estimate, certified interval, stored length, and the raw scores behind them.

    ``index`` is what ``encode_rows`` gave, ``queries`` has ``query_id, v`` with valid vectors of a direction. The
    scan hands over what is stored of the candidates, which are then refined for many queries at a time. Estimates
    are corrected by the length of the reconstruction; intervals come from the raw integers and the segment's
    certificate (``terms``, derived if not given). Ties go to the lower row. ``metric`` is the name of a ranking or
    a Ranking of one's own.
    """
    rows = index.count() if rows is None else rows
    effective = check_options(k, budget, rows, exclude is not None)
    spec, ranking, asked = model.spec, ranking_of(metric), queries.count()
    pool = scan(index, queries, model, max(1, effective), ranking, exclude, rows, True, asked)
    terms = certificates(index, model) if terms is None else terms
    blocks = max(1, min(parallelism(index.sparkSession), asked), -(-asked // REFINED))
    own = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b")
    candidates = pool.join(terms.select("segment", "eps_primary", "eps_refined"), "segment").select("*", own)
    names = [x.split()[0] for x in HITS.split(", ")]

    def refine(c: pd.DataFrame, query: int, length: float, right: np.ndarray) -> pd.DataFrame:
        codes, res = codec.unpack(bytes_matrix(c.code, spec.dim // 2)), bytes_matrix(c.residual, spec.subs)
        primary = c.primary_raw.to_numpy()
        refined = codec.refine(primary, res, right)
        size = codec.lengths(codec.decode_centers(codes, model.centers), codec.decode_residual(res, model.codebook))
        fixed, bits, ids = codec.corrected(refined, size), c.mag_bits.to_numpy().astype(np.int64), c.row_id.to_numpy()
        low, high = bounds.cosine_interval(primary, refined, c.eps_primary.to_numpy(), c.eps_refined.to_numpy())
        key = ranking.refined(fixed, bits)
        score = ranking.score(key, length)
        low, high = ranking.interval(low, high, bits, length)
        at = best(key, ids, k)
        return pd.DataFrame(
            {
                "query_id": np.full(len(at), query), "rank": np.arange(1, len(at) + 1, dtype=np.int32), "row_id": ids[at], "segment": c.segment.to_numpy()[at],
                "score": score[at], "lower": low[at], "upper": high[at], "magnitude": bits[at].astype(np.uint16).view(np.float16).astype(np.float64),
                "primary_raw": primary[at], "refined_raw": refined[at], "recon_length": size[at],
            }
        )[names]

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out, of = [], {query: some for query, some in c.groupby("query_id")}
        for part in batched(q[q.query_id.isin(list(of))].sort_values("query_id"), 64):
            v = matrix(part.v, spec.dim)
            _, right = codec.query_tables(model.rotation.forward(codec.directions(v)), model)
            out.extend(refine(of[query], query, float(n), right[i]) for i, (query, n) in enumerate(zip(part.query_id.tolist(), codec.norms(v))))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    hits = candidates.groupBy("_b").cogroup(queries.select("query_id", "v", own).groupBy("_b")).applyInPandas(run, HITS)
    return hits.withColumn("rows_scanned", F.lit(rows)).withColumn("rows_refined", F.lit(effective))
