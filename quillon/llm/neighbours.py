"""The most similar vectors of every query vector (problem 2).

An inverted multi-index per corpus: both halves of a unit vector are quantised by codebooks of their own, so
that k centroids a half make k^2 cells. A query walks the cells in the order of its summed distance to their two
centroids, by a heap over the two sorted lists, until they hold a calibrated share of the corpus; the vectors in
those cells are ranked by their exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.common import BROADCAST_LIMIT, cut, spread
from quillon.operators.exact import exact_topk
from quillon.operators.select import key_of_hash, smallest_per_group

DIMENSION = 64
#: Vectors of a corpus, at most, on which its codebooks and its walk are fitted; all vectors are indexed.
TRAINING_ROWS = 16_384
#: Pilot queries of a corpus, at most, on which the length of its walk is calibrated.
PILOTS = 512
#: The share of true neighbours that the walk is to reach.
RECALL = 0.985
#: Cells that the heap of a walk gives out; a longer walk is ended by halving the distances in question.
HEAP = 1024
#: Rows of an index shard, about; also the number above which a single cell is dealt to several shards.
SHARD_ROWS = 16_384
#: Cosines that agree to so much are ties.
TIE = 1e-11
#: What single precision may be off by.
MARGIN = 4e-6
#: Queries scored at a time.
QUERY_BLOCK = 512
#: Queries of a corpus, about, that may meet in one task.
QUERY_GROUP = 32_768


@dataclass
class Model:
    """The fitted index of one corpus. ``share`` is of the sample's rows; ``sizes`` are cell sizes in the sample."""

    corpus: str
    first: np.ndarray  # k x 32
    second: np.ndarray
    sizes: np.ndarray  # k x k, in the sample
    share: float
    shards: np.ndarray  # of each first centroid
    salts: np.ndarray  # shards over which a first centroid's rows are dealt
    count: int = field(default=1)  # shards in all
    blocks: int = field(default=1)  # over which the queries are dealt


def usable(vectors: DataFrame) -> DataFrame:
    """Each vec_id once: ``vec_id, corpus, split_name, embedding``.

    Usable is a vector of exactly DIMENSION finite numbers, not all 0; null arrays or elements are not. Null id
    or corpus leaves a row out. Of several usable rows of an id that added first counts (then the smaller one);
    outer blanks and case of the split do not matter.
    """
    ok = (F.size("embedding") == DIMENSION) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("corpus").isNotNull() & ok)
        .select("vec_id", F.struct("added_at", "corpus", F.lower(F.trim("split_name")).alias("split_name"), "embedding").alias("s"))
        .groupBy("vec_id")
        .agg(F.min("s").alias("s"))
        .select("vec_id", "s.corpus", "s.split_name", "s.embedding")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float32) if len(column) else np.zeros((0, DIMENSION), np.float32)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # tiny and huge lengths would leave the range otherwise
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T
    return np.maximum(d, 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids from evenly drawn rows; an emptied one restarts at the row farthest from its own."""
    rng = np.random.default_rng(k)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].astype(np.float64)
    for _ in range(rounds):
        d = _distances(x, c.astype(np.float32))
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        c[n == 0] = x[far[: (n == 0).sum()]]
    return c.astype(np.float32)


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: float, rows: list[list[int]] | None = None) -> float:
    """The summed distance up to which cells are visited until they hold ``want`` rows (multi-sequence walk).

    ``rows`` is ``sizes`` as lists, made once for many walks."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, rows = d1[o1].tolist(), d2[o2].tolist(), rows or sizes.tolist()
    of1, of2 = o1.tolist(), o2.tolist()
    heap, seen, reach, last, given = [(a[0] + b[0], 0, 0)], 0.0, 0.0, len(b), 0
    while heap:
        given += 1
        if given > HEAP:
            return _reach(d1, d2, sizes, want, reach)
        reach, i, j = heapq.heappop(heap)
        seen += rows[of1[i]][of2[j]]
        if seen >= want:
            return reach
        if j + 1 < last:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return float("inf")


def _reach(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: float, low: float) -> float:
    """Where a walk that has come to ``low`` ends: the smallest sum of distances whose cells hold ``want`` rows."""
    sums = (d1[:, None] + d2[None, :]).ravel()
    at = np.flatnonzero((sizes.ravel() > 0) & (sums >= low))
    seen, sums, rows = float(sizes.ravel()[sums < low].sum()), sums[at], sizes.ravel()[at]
    while len(sums) > 64:
        middle = np.partition(sums, len(sums) // 2)[len(sums) // 2]
        below = sums < middle
        held = float(rows[below].sum())
        if seen + held >= want:
            sums, rows = sums[below], rows[below]
        else:
            seen, sums, rows = seen + held, sums[~below], rows[~below]
            if not below.any():
                break
    order = np.argsort(sums, kind="stable")
    reached = np.flatnonzero(seen + np.cumsum(rows[order]) >= want)
    return float(sums[order][reached[0]]) if len(reached) else float("inf")


def fit(corpus: str, sample: np.ndarray, pilots: np.ndarray, rows: int, k: int | None = None) -> Model:
    """Codebooks from the sample's directions, and the share of it that pilots must visit for RECALL.

    The pilots' true ten neighbours in the sample are found exactly; each has a rank in the pilot's order of
    cells. The share is the smallest that covers RECALL of all those. In the whole corpus neighbours are nearer
    than in the sample, so that it errs on the long side. ``rows`` is the size of the whole corpus.
    """
    x, half = _unit(sample), DIMENSION // 2
    k = min(len(x), k or max(2, min(256, int(2 ** round(np.log2(max(4.0, rows**0.5)))))))  # about as many cells as rows
    first, second = _kmeans(x[:, :half], k), _kmeans(x[:, half:], k)
    c1, c2 = _distances(x[:, :half], first).argmin(1), _distances(x[:, half:], second).argmin(1)
    sizes = np.bincount(c1 * k + c2, minlength=k * k).reshape(k, k)
    share = 1.0
    if len(pilots) and len(x) > 200:
        p, shares = _unit(pilots), []
        for a in range(0, len(p), 64):
            q = p[a : a + 64]
            near = np.argpartition(-(q @ x.T), 10, axis=1)[:, :10]
            d1, d2 = _distances(q[:, :half], first), _distances(q[:, half:], second)
            for i in range(len(q)):
                d = d1[i][c1] + d2[i][c2]
                shares.extend(np.searchsorted(np.sort(d), d[near[i]], side="right") / len(x))
        share = float(np.quantile(shares, RECALL))
    # first centroids along their main direction, so that those in one shard are near each other
    axis = np.linalg.svd(first - first.mean(0), full_matrices=False)[2][0] if k > 1 else np.ones(half)
    per = sizes.sum(1) / max(1, len(x)) * rows
    shards, salts, at, filled = np.zeros(k, np.int64), np.ones(k, np.int64), 0, 0.0
    for c in np.argsort(first @ axis, kind="stable"):
        if filled and filled + per[c] > SHARD_ROWS:
            at, filled = at + 1, 0.0
        shards[c] = at
        salts[c] = max(1, int(np.ceil(per[c] / SHARD_ROWS)))
        at, filled = at + salts[c] - 1, (filled + per[c]) if salts[c] == 1 else float(SHARD_ROWS)
    return Model(corpus, first, second, sizes, share, shards, salts, int(at) + 1)


MODEL = "corpus string, k int, share double, count long, blocks long, first binary, second binary, sizes binary, shards binary, salts binary"


def _fit_group(query_group: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        m = fit(key[0], _matrix(rows.embedding[rows.role == "index"]), _matrix(rows.embedding[rows.role == "pilot"]), int(rows.total.iloc[0]))
        blocks = max(1, -(-int(rows.asked.iloc[0]) // query_group))
        return pd.DataFrame(
            [(m.corpus, len(m.first), m.share, m.count, blocks, m.first.tobytes(), m.second.tobytes(), m.sizes.astype(np.int32).tobytes(), m.shards.tobytes(), m.salts.tobytes())],
            columns=[c.split()[0] for c in MODEL.split(", ")],
        )

    return run


def _restore(r) -> Model:
    k, of = r["k"], lambda name, kind: np.frombuffer(r[name], kind)
    return Model(
        r["corpus"], of("first", np.float32).reshape(k, -1), of("second", np.float32).reshape(k, -1), of("sizes", np.int32).reshape(k, k),
        r["share"], of("shards", np.int64), of("salts", np.int64), r["count"], r["blocks"],
    )


def fit_all(vectors: DataFrame, query_group: int = QUERY_GROUP) -> DataFrame:
    """One row per corpus with indexed vectors. Pilots come from the calibration split; without any the walk visits all."""
    totals = cut(vectors.groupBy("corpus").agg(F.count_if(F.col("split_name") == "indexed").alias("total"), F.count_if(F.col("split_name") == "queries").alias("asked")).where("total > 0"))
    key = lambda salt: key_of_hash(salt, "vec_id")

    def edge(split: str, n: int):
        """The last key and id of those drawn: one row a corpus stands for all of them."""
        ids = vectors.where(F.col("split_name") == split).select("corpus", "split_name", "vec_id", key(F.lit(split)).alias("key"), F.lit(n).alias("most"))
        return smallest_per_group(ids, ["corpus"], "key", "most", ["vec_id"]).groupBy("corpus", "split_name").agg(F.max(F.struct("key", "vec_id")).alias("edge"))

    edges = edge("indexed", TRAINING_ROWS).unionByName(edge("calibration", PILOTS)).join(totals, "corpus")
    if totals.count() * 256 <= BROADCAST_LIMIT:
        edges = F.broadcast(edges)
    role = F.when(F.col("split_name") == "indexed", "index").otherwise("pilot")
    own = F.struct(key(F.col("split_name")).alias("key"), "vec_id")
    drawn = vectors.join(edges, ["corpus", "split_name"]).where(own <= F.col("edge")).select("corpus", "vec_id", "embedding", role.alias("role"), "total", "asked")
    return drawn.groupBy("corpus").applyInPandas(_fit_group(query_group), MODEL)


def _place(models):
    """The shard and cell of each indexed vector, once for each block of queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = DIMENSION // 2
        for rows in batches:
            for corpus, part in rows.groupby("corpus", sort=False):
                m, raw = models.value[corpus], _matrix(part.embedding)
                x, ids = _unit(raw), part.vec_id.to_numpy()
                c1, c2 = _distances(x[:, :half], m.first).argmin(1), _distances(x[:, half:], m.second).argmin(1)
                shard = m.shards[c1] + (ids * 0x9E3779B1 & 0xFFFFFFFF) % m.salts[c1]
                placed = pd.DataFrame({"corpus": corpus, "shard": shard, "block": 0, "vec_id": ids, "cell": c1 * len(m.first) + c2, "raw": [r.tobytes() for r in raw]})
                for block in range(m.blocks):
                    yield placed.assign(block=block)

    return run


def _route(models):
    """The shards that each query's walk enters, and the reach of the walk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = DIMENSION // 2
        for rows in batches:
            out = []
            for corpus, part in rows.groupby("corpus", sort=False):
                m = models.value.get(corpus)
                if m is None:
                    continue
                raw = _matrix(part.embedding)
                x = _unit(raw)
                d1, d2 = _distances(x[:, :half], m.first), _distances(x[:, half:], m.second)
                held = m.sizes.tolist()
                want = max(m.share * m.sizes.sum(), min(m.sizes.sum(), 10 * len(m.first) ** 0.5))
                for i, q in enumerate(part.vec_id.tolist()):
                    reach = walk(d1[i], d2[i], m.sizes, want, held)
                    for c in np.flatnonzero(d1[i] + d2[i].min() <= reach + 1e-6):
                        out.append((corpus, m.shards[c], (q * 0x85EBCA6B & 0xFFFFFFFF) % m.blocks, m.salts[c], q, reach, raw[i].tobytes()))
            frame = pd.DataFrame(out, columns=["corpus", "shard", "block", "salts", "vec_id", "reach", "raw"]).drop_duplicates(["corpus", "shard", "vec_id"])
            frame = frame.loc[frame.index.repeat(frame.salts)]
            frame["shard"] += frame.groupby(["corpus", "shard", "vec_id"]).cumcount()
            yield frame[["corpus", "shard", "block", "vec_id", "reach", "raw"]]

    return run


def rank(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, scores within TIE of the one before ordered by id."""
    order = np.lexsort((ids, -scores))
    tied = np.cumsum(-np.diff(scores[order], prepend=scores[order][:1]) > TIE)
    return order[np.lexsort((ids[order], tied))][:k]


def _search(models, k: int):
    """The k best of one shard for each query that enters it."""

    def run(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_vec_id": pd.Series(dtype="int64"), "near_vec_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        if not len(index) or not len(queries):
            return empty
        m, half = models.value[key[0]], DIMENSION // 2
        # of equal vectors only those of lowest id can come out
        index = index.sort_values("vec_id")
        index = index[index.groupby("raw", sort=False).cumcount() < k].sort_values(["cell", "vec_id"])
        ids, cells = index.vec_id.to_numpy(), index.cell.to_numpy()
        raw = np.frombuffer(b"".join(index.raw), np.float32).reshape(-1, DIMENSION)
        unit, parts, side = _unit(raw), [], len(m.first)
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        stops = np.append(starts[1:], len(cells))
        scale = raw.astype(np.float64)
        scale /= np.abs(scale).max(axis=1, keepdims=True)
        lengths = np.sqrt((scale * scale).sum(1))
        queries = queries.sort_values("vec_id")
        for a in range(0, len(queries), QUERY_BLOCK):
            block = queries.iloc[a : a + QUERY_BLOCK]
            q_raw = np.frombuffer(b"".join(block.raw), np.float32).reshape(-1, DIMENSION)
            q, q_ids, reach = _unit(q_raw), block.vec_id.to_numpy(), block.reach.to_numpy() + 1e-6
            d1, d2 = _distances(q[:, :half], m.first), _distances(q[:, half:], m.second)
            scores = np.full((len(block), len(ids)), -9, np.float32)
            for s, e in zip(starts, stops):
                c1, c2 = divmod(int(cells[s]), side)
                entering = np.flatnonzero(d1[:, c1] + d2[:, c2] <= reach)
                if len(entering):
                    scores[entering, s:e] = q[entering] @ unit[s:e].T
            if len(ids) > k:
                limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            else:
                limit = np.full(len(block), -8, np.float32)
            rows, columns = np.nonzero(scores >= np.maximum(limit - MARGIN, -8)[:, None])
            q64 = q_raw.astype(np.float64)
            q64 /= np.abs(q64).max(axis=1, keepdims=True)
            q_lengths = np.sqrt((q64 * q64).sum(1))
            exact = np.empty(len(rows))
            for b in range(0, len(rows), 1 << 16):
                r, c = rows[b : b + (1 << 16)], columns[b : b + (1 << 16)]
                exact[b : b + (1 << 16)] = (q64[r] * scale[c]).sum(1) / (q_lengths[r] * lengths[c])
            bounds = np.searchsorted(rows, np.arange(len(block) + 1))
            for i in range(len(block)):
                s, e = bounds[i], bounds[i + 1]
                if e > s:
                    best = rank(ids[columns[s:e]], exact[s:e], k)
                    parts.append((np.full(len(best), q_ids[i]), ids[columns[s:e]][best], exact[s:e][best]))
        if not parts:
            return empty
        a, b, c = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"query_vec_id": a, "near_vec_id": b, "cosine": c})

    return run


def nearest(vectors: DataFrame, k: int = 10, query_group: int = QUERY_GROUP) -> DataFrame:
    """``query_vec_id, near_vec_id, cosine, rank``: for each usable vector of split ``queries`` the k most similar
    indexed vectors of its corpus, all if there are fewer; ties go to the lower id.

    Fitted models are sent to all executors, a few kilobytes a corpus; where they would exceed BROADCAST_LIMIT
    the corpora are worked off in groups that do not. Rows are dealt to shards by cell, a hot cell to several, and
    a query goes only to shards that its walk enters. The queries of a corpus are dealt to blocks of about
    ``query_group``, each of which meets a copy of the shard, so that no task holds more.
    """
    spark = vectors.sparkSession
    clean = cut(usable(vectors))
    models = cut(fit_all(clean, query_group))
    size = F.length("first") + F.length("second") + F.length("sizes") + F.length("shards") + F.length("salts")
    groups: list[list[str]] = [[]]
    held = 0
    for r in models.select("corpus", size.alias("size")).orderBy("corpus").toLocalIterator():
        if held + r["size"] > BROADCAST_LIMIT:
            groups.append([])
            held = 0
        groups[-1].append(r["corpus"])
        held += r["size"]
    found = None
    for group in groups:
        some = {r["corpus"]: _restore(r) for _, r in models.where(F.col("corpus").isin(group)).toPandas().iterrows()}
        shared = spark.sparkContext.broadcast(some)
        mine = clean.where(F.col("corpus").isin(group))
        entries = spread(mine.where("split_name = 'indexed'")).mapInPandas(_place(shared), "corpus string, shard long, block long, vec_id long, cell long, raw binary")
        routed = spread(mine.where("split_name = 'queries'")).mapInPandas(_route(shared), "corpus string, shard long, block long, vec_id long, reach double, raw binary")
        part = entries.groupBy("corpus", "shard", "block").cogroup(routed.groupBy("corpus", "shard", "block")).applyInPandas(_search(shared, k), "query_vec_id long, near_vec_id long, cosine double")
        found = part if found is None else found.unionByName(part)
    by_query = Window.partitionBy("query_vec_id")
    score = by_query.orderBy(F.desc("cosine"), "near_vec_id")
    tied = F.sum(F.when(F.lag("cosine").over(score) - F.col("cosine") > TIE, 1).otherwise(0)).over(score.rowsBetween(Window.unboundedPreceding, 0))
    return (
        found.withColumn("_tied", tied)
        .withColumn("rank", F.row_number().over(by_query.orderBy("_tied", "near_vec_id")))
        .where(F.col("rank") <= k)
        .select("query_vec_id", "near_vec_id", "cosine", "rank")
    )


def index_report(vectors: DataFrame) -> DataFrame:
    """Per corpus the fitted index: ``corpus, centroids`` (of each half), ``shards, query_blocks`` and
    ``share_scored``, the share of its rows that a query's walk is calibrated to visit."""
    return fit_all(usable(vectors)).select("corpus", F.col("k").alias("centroids"), F.col("count").alias("shards"), F.col("blocks").alias("query_blocks"), F.col("share").alias("share_scored"))


def recall_report(vectors: DataFrame, k: int = 10, least: float = 0.9) -> DataFrame:
    """Per corpus with queries and indexed vectors: ``corpus, queries``, and whether ``nearest`` finds at least the share
    ``least`` of the true k neighbours, which an exact search of the whole corpus gives."""
    clean = cut(usable(vectors))
    row, asked = F.col("vec_id").alias("row_id"), F.col("vec_id").alias("query_id")
    pairs = nearest(vectors, k).select(F.col("query_vec_id").alias("query_id"), F.col("near_vec_id").alias("row_id"), "rank")
    exact, found = None, cut(pairs)
    for r in clean.where("split_name = 'queries'").select("corpus").distinct().orderBy("corpus").toLocalIterator():
        own = clean.where(F.col("corpus") == r["corpus"])
        part = exact_topk(own.where("split_name = 'indexed'").select(row, F.col("embedding").alias("v")), own.where("split_name = 'queries'").select(asked, F.col("embedding").alias("v")), k, dim=DIMENSION).withColumn("corpus", F.lit(r["corpus"]))
        exact = part if exact is None else exact.unionByName(part)
    if exact is None:
        return vectors.sparkSession.createDataFrame([], "corpus string, queries long, reached boolean")
    hit = exact.join(found.select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
    return hit.groupBy("corpus").agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= least * F.count("*")).alias("reached"))
