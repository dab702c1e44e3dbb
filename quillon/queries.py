"""Queries over the driver's tables, one or more per group of operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.common import cut, ensure_checkpoint_dir, read, spread
from quillon.functions import bounds, codec, text, vectors
from quillon.functions.codec import Model
from quillon.operators import audit, drift, evaluate, exact, search
from quillon.operators.blocks import matrix
from quillon.operators.select import key_of_hex
from quillon.plans.index import Index, IndexBuilder, dense_ids
from quillon.plans.training import centers_of, train, training_matrix
from quillon.sources import generated
from quillon.spec import MAX_TRAINING, SPEC_64

Query = Callable[[SparkSession, str], DataFrame]

#: Rows per segment in the queries, so that small tables have several.
SEGMENT = 128
K = 10
BUDGETS = [10, 20, 50, 100, 200]


@cache
def frozen_model() -> Model:
    """A model of generated rows: the same for every table, so that SQL can be given its numbers."""
    return train(generated.rows("correlated", 64, np.arange(2048), 20260804), SPEC_64, 7)


def _vectors(spark: SparkSession, d: str, scaled: bool = False) -> DataFrame:
    """``row_id, v``; scaled: with lengths that differ by row."""
    e = spread(read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")))
    factor = ((1 + F.col("row_id") % 8) * 0.25).cast("float")
    return e.withColumn("v", F.transform("v", lambda x: x * factor)) if scaled else e


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return rows.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), "v", F.col("row_id").alias("own"))


def _encoded(spark: SparkSession, d: str, scaled: bool = False) -> DataFrame:
    return cut(search.encode_rows(_vectors(spark, d, scaled), frozen_model(), SEGMENT))


def _rotated(spark: SparkSession, d: str) -> DataFrame:
    model = frozen_model()

    def run(batches):
        for part in batches:
            yield pd.DataFrame({"row_id": part.row_id, "y": list(model.rotation.forward(codec.directions(matrix(part.v, 64))))})

    return _vectors(spark, d).mapInPandas(run, "row_id long, y array<float>")


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and ranked exact lists, cleaned."""
    candidates = evaluate.unique_scores(read(spark, d, "candidates"), "corrected", ("primary_raw", "refined_raw", "truth_score"))
    return candidates, evaluate.ranked(evaluate.unique_scores(read(spark, d, "neighbors"), "score"), "score", most=K)


def _drift_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "drift_rows").where("index_id IS NOT NULL AND row_id IS NOT NULL")


def _corpora(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "corpus_vectors").select("corpus", "split_name", "vec_id", F.col("embedding").alias("v")).where("corpus IS NOT NULL")


# --- exact search ---------------------------------------------------------------------------------------------


def exact_cosine_topk(spark, d):
    rows = _vectors(spark, d)
    return exact.exact_topk(rows, _asked(rows), K, exclude="own")


def exact_dot_topk(spark, d):
    rows = _vectors(spark, d, scaled=True)
    return exact.exact_topk(rows, _asked(rows), K, "dot")


def streaming_topk_merge(spark, d):
    rows = _vectors(spark, d)
    asked, state = _asked(rows), None
    for part in range(3):
        new = exact.exact_topk(rows.where(f"row_id % 3 = {part}"), asked, K)
        state = new if state is None else exact.merge_topk(state, new, K)
    return state


# --- checks and lengths ----------------------------------------------------------------------------------------


def norm_audit(spark, d):
    return audit.audit(_corpora(spark, d), ["corpus"], 64)


def norm_invalid_rows(spark, d):
    return audit.first_invalid(_corpora(spark, d), "vec_id", ["corpus"], 64)


def scale_shift(spark, d):
    rows = _corpora(spark, d)
    return audit.scale_shift(audit.audit(rows.where("split_name = 'indexed'"), ["corpus"], 64), audit.audit(rows.where("split_name = 'queries'"), ["corpus"], 64), ["corpus"], 1.05)


def unit_direction(spark, d):
    return _vectors(spark, d, scaled=True).select("row_id", vectors.norm(F.col("v")).alias("length"), F.posexplode(vectors.unit(F.col("v"))).alias("coord", "value"))


def hadamard_rows(spark, d):
    return _asked(_vectors(spark, d)).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("coord"), "v").select("query_id", "coord", vectors.hadamard_row(F.col("v"), F.col("coord"), 64).alias("value"))


# --- codec ------------------------------------------------------------------------------------------------------


def rotation_forward(spark, d):
    return _rotated(spark, d).select("row_id", F.posexplode("y").alias("coord", "value"))


def rotation_roundtrip(spark, d):
    model = frozen_model()

    def run(batches):
        for part in batches:
            x = codec.directions(matrix(part.v, 64))
            back = model.rotation.inverse(model.rotation.forward(x))
            yield pd.DataFrame({"row_id": part.row_id, "restored": (np.abs(back - x).max(1) < 1e-6)})

    return _vectors(spark, d).mapInPandas(run, "row_id long, restored boolean")


def quantile_centers(spark, d):
    return centers_of(_vectors(spark, d), SPEC_64)


def int4_encode(spark, d):
    model = frozen_model()

    @F.pandas_udf("array<int>")
    def codes(y: pd.Series) -> pd.Series:
        return pd.Series(list(codec.encode_centers(matrix(y, 64), model.centers).astype(np.int32)))

    return _rotated(spark, d).select("row_id", F.posexplode(codes("y")).alias("coord", "code"))


def int4_pack(spark, d):
    by_row = int4_encode(spark, d).groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("coord", "code"))), lambda s: s["code"]).alias("codes"))
    return by_row.select("row_id", F.posexplode(vectors.pack_nibbles(F.col("codes"))).alias("at", "byte"))


def encode_errors(spark, d):
    return _encoded(spark, d).select("row_id", "err_primary", "err_refined", "outside")


def pq_encode(spark, d):
    whole = F.hex("residual")
    return _encoded(spark, d).select("row_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sub"), whole.alias("h")).select("row_id", "sub", F.conv(F.expr("substring(h, 2 * sub + 1, 2)"), 16, 10).cast("int").alias("code"))


def block_certificates(spark, d):
    return search.certificates(_encoded(spark, d), frozen_model()).select("segment", "first_row", "row_count", "err_primary", "err_refined")


def block_check(spark, d):
    return evaluate.block_check(_encoded(spark, d))


def q24_tables(spark, d):
    model = frozen_model()

    def run(batches):
        for part in batches:
            left, _ = codec.query_tables(model.rotation.forward(codec.directions(matrix(part.v, 64))), model)
            q, c, k = np.indices(left.shape).reshape(3, -1)
            yield pd.DataFrame({"query_id": part.query_id.to_numpy()[q], "coord": c, "code": k, "entry": left.reshape(-1)})

    return _asked(_vectors(spark, d)).mapInPandas(run, "query_id long, coord int, code int, entry long")


def magnitude_units(spark, d):
    return _encoded(spark, d, scaled=True).select("row_id", "mag_bits", vectors.magnitude_units(F.col("mag_bits")).alias("units"))


def byte_accounting(spark, d):
    own = lambda c: F.sum(F.octet_length(c)).cast("long")
    return _encoded(spark, d).agg(F.count("*").alias("rows"), own("code").alias("code_bytes"), own("residual").alias("residual_bytes"), (F.count("mag_bits") * 2).alias("length_bytes"))


# --- compressed search ------------------------------------------------------------------------------------------


def primary_scan(spark, d):
    found = search.scan(_encoded(spark, d), _asked(_vectors(spark, d)), frozen_model(), 50, exclude="own")
    return found.select("query_id", "row_id", "segment", "primary_raw", "rank")


_HIT = ("query_id", "rank", "row_id", "segment", "score", "primary_raw", "refined_raw", "recon_length", "rows_scanned", "rows_refined")


def search_cosine(spark, d):
    return search.search(_encoded(spark, d), _asked(_vectors(spark, d)), frozen_model(), K, 100, exclude="own").select(*_HIT)


def search_dot(spark, d):
    return search.search(_encoded(spark, d, scaled=True), _asked(_vectors(spark, d, scaled=True)), frozen_model(), K, 100, "dot").select("query_id", "rank", "row_id", "score", "magnitude")


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """The training rows: at most so many, chosen by hash."""
    return rows.join(text.hash_sample(rows, "row_id", most, "training").select("row_id"), "row_id")


def _trained(spark, d) -> tuple[DataFrame, DataFrame, Model]:
    rows = _vectors(spark, d)
    sample = _sample(rows, 8192)
    model = train(training_matrix(sample, "row_id", SPEC_64), SPEC_64, 7, None, spark)
    return rows, cut(search.encode_rows(rows, model, SEGMENT)), model


def search_trained(spark, d):
    rows, encoded, model = _trained(spark, d)
    return search.search(encoded, _asked(rows), model, K, exclude="own")


def interval_enclosure(spark, d):
    rows, encoded, model = _trained(spark, d)
    asked = _asked(rows)
    hits = cut(search.search(encoded, asked, model, K, exclude="own"))
    truth = (
        hits.select("query_id", "row_id").join(rows, "row_id").join(asked.select("query_id", F.col("v").alias("q")), "query_id")
        .select("query_id", "row_id", (vectors.dot(F.col("q"), F.col("v")) / (vectors.norm(F.col("q")) * vectors.norm(F.col("v")))).alias("score"))
    )
    return evaluate.enclosure(hits, truth)


def trained_recall(spark, d):
    rows, encoded, model = _trained(spark, d)
    return evaluate.recall(search.search(encoded, _asked(rows), model, K, exclude="own"), exact.exact_topk(rows, _asked(rows), K, exclude="own"), K)


def original_rerank(spark, d):
    """The pool of a compressed search ranked anew by exact cosine, and the recall of both."""
    rows, encoded, model = _trained(spark, d)
    asked = _asked(rows)
    pool = search.search(encoded, asked, model, 50, exclude="own").select("query_id", "row_id", F.col("rank").alias("compressed_rank"))
    scored = (
        pool.join(rows, "row_id").join(asked.select("query_id", F.col("v").alias("q")), "query_id")
        .select("query_id", "row_id", "compressed_rank", (vectors.dot(F.col("q"), F.col("v")) / (vectors.norm(F.col("q")) * vectors.norm(F.col("v")))).alias("score"))
    )
    top = evaluate.ranked(scored, "score", most=K)
    truth = exact.exact_topk(rows, asked, K, exclude="own")
    before = evaluate.recall(pool.withColumnRenamed("compressed_rank", "rank"), truth, K).select("query_id", F.col("recall").alias("compressed_recall"))
    return evaluate.recall(top, truth, K).join(before, "query_id")


def epsilon_attribution(spark, d):
    """Per segment the parts of both bounds: transform, reconstruction, serving."""
    _, encoded, model = _trained(spark, d)
    spec = model.spec
    terms = search.certificates(encoded, model)
    kind = lambda name, refined: terms.select("segment", F.lit(name).alias("kind"), F.col(f"eps_{name}").alias("epsilon"), (F.lit(bounds.eta_transform(spec)) / F.col(f"eps_{name}")).alias("transform"), (bounds.query_norm_upper(spec) * F.col(f"err_{name}") / F.col(f"eps_{name}")).alias("reconstruction"), (F.lit(bounds.eta_serving(spec, refined)) / F.col(f"eps_{name}")).alias("serving"))
    return kind("primary", False).unionByName(kind("refined", True))


def certificate_soak(spark, d, trials: int = 20_000):
    """Random rows and queries: whether each true cosine lies in its row's own interval, over seeds of the rotation."""
    seeds = 8

    def run(batches):
        models = {}
        for part in batches:
            for seed, ids in part.groupby("seed").id:
                if seed not in models:
                    models[seed] = train(generated.rows("gaussian", 64, np.arange(400), seed), SPEC_64, int(seed))
                m = models[seed]
                x, q = (generated.rows("gaussian", 64, ids.to_numpy(), 1000 * int(seed) + s) for s in (1, 2))
                y = m.rotation.forward(codec.directions(x))
                codes, res, p, e = codec.encode(y, m)
                a, b, _ = codec.errors(y, p, e, m.centers)
                left, right = codec.query_tables(m.rotation.forward(codec.directions(q)), m)
                at = np.arange(len(x))
                primary = left[at[:, None], np.arange(64), codes].sum(1)
                refined = primary + right[at[:, None], np.arange(8), res].sum(1)
                eps = [np.array([bounds.epsilon(m.spec, float(np.nextafter(v, np.inf)), r) for v in err]) for err, r in ((a, False), (b, True))]
                low, high = bounds.cosine_interval(primary, refined, *eps)
                x64, q64 = x.astype(np.float64), q.astype(np.float64)
                true = (x64 * q64).sum(1) / np.sqrt((x64**2).sum(1) * (q64**2).sum(1))
                yield pd.DataFrame({"seed": [int(seed)], "trials": [len(x)], "violations": [int(((true < low) | (true > high)).sum())]})

    each = evaluate.spread_trials(trials, seeds)
    plan = spark.createDataFrame([(s, n) for s, n in enumerate(each)], "seed int, n int").select("seed", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))).alias("id"))
    return plan.repartition(seeds, "seed").mapInPandas(run, "seed int, trials long, violations long").groupBy("seed").agg(F.sum("trials").alias("trials"), F.sum("violations").alias("violations"))


def append_generations(spark, d):
    """Two appends to a stored index, trained on three quarters of the rows or MAX_TRAINING of them, and searched in both generations."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    rows = _vectors(spark, d)
    builder = IndexBuilder.create(spark, path, _sample(rows.where("row_id % 4 <> 0"), MAX_TRAINING), 7, spec=SPEC_64, segment_rows=SEGMENT)
    builder.push(rows.where("row_id % 2 = 0"), "row_id")
    builder.commit()
    builder.push(rows.where("row_id % 2 = 1"), "row_id")
    builder.commit()
    asked = _asked(rows).drop("own")
    return Index.open(spark, path, 1).search(asked, K).unionByName(Index.open(spark, path).search(asked, K))


# --- evaluation of stored lists ---------------------------------------------------------------------------------


def recall_at_k(spark, d):
    candidates, truth = _lists(spark, d)
    return evaluate.recall(evaluate.ranked(candidates, "corrected", most=K), truth, K)


def budget_sweep(spark, d):
    return evaluate.budget_sweep(*_lists(spark, d), K, BUDGETS)


def loss_attribution(spark, d):
    return evaluate.loss_attribution(*_lists(spark, d), K)


def stored_alignment(spark, d):
    rows = evaluate.unique_scores(read(spark, d, "candidates"), "corrected", ("refined_raw", "recon_length"))
    return evaluate.stored_alignment(rows, _lists(spark, d)[1], K)


def selection_losses(spark, d):
    return evaluate.missed(*_lists(spark, d), K)


def primary_rank_of_truth(spark, d):
    return evaluate.primary_rank_of_truth(*_lists(spark, d), K)


def rank_gap(spark, d):
    return evaluate.rank_gap(evaluate.unique_scores(read(spark, d, "neighbors"), "score"), "score", K)


def score_errors(spark, d):
    rows = evaluate.unique_scores(read(spark, d, "candidates"), "corrected", ("truth_score", "segment"))
    return evaluate.error_summary(rows.where("segment IS NOT NULL"), F.col("corrected"), F.col("truth_score"), ["segment"])


def prune_survivors(spark, d):
    rows = evaluate.unique_scores(read(spark, d, "candidates").where("primary_raw IS NOT NULL"), "corrected", ("primary_raw",))
    value = F.col("primary_raw") / F.lit(float(1 << 24))
    return evaluate.survivors(rows.select("query_id", "row_id", (value - 0.0625).alias("lower"), (value + 0.0625).alias("upper")), K)


def bootstrap_recall(spark, d):
    """The difference in recall between ranking by the corrected and by the refined score, resampled over queries."""
    losses = evaluate.loss_attribution(*_lists(spark, d), K)
    hist = losses.groupBy((F.col("delivered") - F.col("by_refined")).alias("delta"), "wanted").agg(F.count("*").alias("n")).toPandas()
    return evaluate.bootstrap((hist.delta / hist.wanted).to_numpy(float), spark, counts=hist.n.to_numpy())


def label_relevance(spark, d):
    """First rank, reciprocal rank and hit at 10, neighbours of the query's label being the relevant ones."""
    labels = read(spark, d, "embeddings").select("vec_id", "label")
    found = exact_cosine_topk(spark, d)
    asked = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(labels, "label").select("query_id", F.col("vec_id").alias("row_id"))
    return evaluate.relevance(found, relevant, K)


def uncovered_queries(spark, d):
    """Queries of the exact lists that have no candidates."""
    return read(spark, d, "neighbors").select("query_id").distinct().join(read(spark, d, "candidates").select("query_id").distinct(), "query_id", "left_anti")


def segment_of_row(spark, d):
    """Candidates per segment that their row id gives, and how many say another."""
    rows = read(spark, d, "candidates").where("row_id IS NOT NULL")
    return rows.withColumn("expected", F.floor(F.col("row_id") / 65_536)).groupBy("expected").agg(F.count("*").alias("rows"), F.count_if(F.col("segment") != F.col("expected")).alias("others"))


# --- drift --------------------------------------------------------------------------------------------------------


def drift_quantiles(spark, d):
    rows = _drift_rows(spark, d)
    share = rows.groupBy("index_id").agg(F.count("*").alias("rows"), F.avg(F.col("outside_fraction").cast("double")).alias("outside"))
    return drift.nearest_rank(["err_primary", "err_refined"], (50, 95, 99), ["index_id"], rows.where("NOT isnan(err_primary) AND NOT isnan(err_refined)")).join(share, "index_id")


def drift_warning(spark, d):
    base = read(spark, d, "drift_indexes").select("index_id", "baseline_refined_p99")
    rows = _drift_rows(spark, d).where("err_refined IS NOT NULL").join(base, "index_id")
    said = rows.groupBy("index_id").agg(F.count("*").alias("sample"), F.count_if(F.col("err_refined").cast("double") > F.col("baseline_refined_p99")).alias("exceeding"))
    return said.withColumn("warned", drift.warning(F.col("sample"), F.lit(0.0), F.col("exceeding"), F.lit(1.0)))


def drift_reservoir(spark, d):
    rows = _drift_rows(spark, d).select("index_id", "row_id").distinct()
    chosen = drift.reservoir(rows, key_of_hex(F.sha2(F.concat_ws("|", "row_id", "index_id"), 256)), 40, ["index_id"])
    return chosen


# --- preparation of corpora ---------------------------------------------------------------------------------------


def dense_row_ids(spark, d):
    return dense_ids(read(spark, d, "corpus_vectors").where("vec_id IS NOT NULL").select("vec_id").distinct(), ["vec_id"])


def positional_split(spark, d):
    rows = _vectors(spark, d).select("row_id")
    return text.positional_split(rows, "row_id", 60, 40, rows.count()).groupBy("split").agg(F.count("*").alias("rows"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


def hash_split(spark, d):
    rows = _vectors(spark, d)
    held = text.hash_sample(rows, "row_id", 100, "7").select("row_id", F.lit(True).alias("validation"))
    return rows.select("row_id").join(held, "row_id", "left").select("row_id", F.coalesce("validation", F.lit(False)).alias("validation"))


def split_disjointness(spark, d):
    rows = read(spark, d, "split_records")
    name = F.lower(F.trim("split_name"))
    return text.shared_texts(rows.where(name.isin("tuning", "test")), rows.where(name.isin("indexed", "calibration")), "text")


def text_dedup(spark, d):
    return text.distinct_texts(read(spark, d, "split_records"), "text", "rec_no")


def hash_sample(spark, d):
    return text.hash_sample(read(spark, d, "documents"), "doc_id", 200, "sample")


def trial_spread(spark, d):
    return spark.createDataFrame(list(enumerate(evaluate.spread_trials(1000, 64))), "seed int, trials int")


def generated_corpus(spark, d):
    rows = generated.generated(spark, "generated-correlated-64x500", 3)
    return rows.select("row_id", vectors.norm(F.col("v")).alias("length"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "oracle_sql", "frozen_model")}


# --- the same in SQL ------------------------------------------------------------------------------------------------

_SQUARES = "list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1]::DOUBLE * t[2]::DOUBLE))"
_ROUND = "CASE WHEN {x} >= 0 THEN floor({x} + 0.5) ELSE ceil({x} - 0.5) END::BIGINT"


def _literal(a: np.ndarray) -> str:
    return "[" + ", ".join(_literal(x) if x.ndim else f"{float(x)!r}::FLOAT" if x.dtype.kind == "f" else str(int(x)) for x in a) + "]"


def _rows_sql(scaled: bool) -> str:
    v = "list_transform(embedding, lambda x: (x * (((1 + vec_id % 8) * 0.25)::FLOAT))::FLOAT)" if scaled else "embedding"
    return f"rows AS (SELECT vec_id AS row_id, {v} AS v, sqrt({_SQUARES.format(v=v)}) AS n FROM embeddings)"


def _exact_sql(metric: str, k: int, exclude: bool, scaled: bool) -> str:
    d = "list_transform(v, lambda x: x::DOUBLE / n)" if metric == "cosine" else "v"
    where = "q.row_id % 50 = 0" + (" AND q.row_id <> r.row_id" if exclude else "")
    return f"""WITH {_rows_sql(scaled)}, u AS (SELECT row_id, {d} AS d FROM rows),
s AS (SELECT q.row_id AS query_id, r.row_id, {_DOT.format(a='q.d', b='r.d')} AS score FROM u q CROSS JOIN u r WHERE {where})
SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INTEGER AS rank FROM s QUALIFY rank <= {k}"""


def _codec_sql(scaled: bool = False) -> str:
    """Rotation, codes, residual codes and reconstruction of all rows, with the frozen model's tables as literals."""
    m = frozen_model()
    ctes = [_rows_sql(scaled), "y0 AS (SELECT row_id, v, n, list_transform(v, lambda x: (x::DOUBLE / n)::FLOAT) AS y FROM rows)"]
    scale = float(np.float32(1) / np.sqrt(np.float32(m.spec.block)))
    at = 0
    for signs, order in zip(m.rotation.signs, m.rotation.order):
        ctes.append(f"y{at + 1} AS (SELECT row_id, v, n, list_transform({_literal(order)}, lambda p: (y[p + 1] * ({_literal(signs)})[p + 1])::FLOAT) AS y FROM y{at})")
        at += 1
        h = 1
        while h < m.spec.block:
            ctes.append(f"y{at + 1} AS (SELECT row_id, v, n, list_transform(range(0, 64), lambda i: CASE WHEN (i & {h}) = 0 THEN y[i + 1] + y[i + {h} + 1] ELSE y[i - {h} + 1] - y[i + 1] END) AS y FROM y{at})")
            at += 1
            h *= 2
        ctes.append(f"y{at + 1} AS (SELECT row_id, v, n, list_transform(y, lambda x: x * {scale!r}::FLOAT) AS y FROM y{at})")
        at += 1
    nearest = "list_transform(range(1, 65), lambda c: list_position(list_transform(centers[c], lambda z: abs(y[c] - z)), list_min(list_transform(centers[c], lambda z: abs(y[c] - z)))) - 1)"
    distance = "list_sum(list_transform(range(1, 9), lambda l: (r[s * 8 + l]::DOUBLE - z[l]::DOUBLE) * (r[s * 8 + l]::DOUBLE - z[l]::DOUBLE)))"
    distances = f"list_transform(book[s + 1], lambda z: {distance})"
    ctes += [
        f"tables AS (SELECT {_literal(m.centers)} AS centers, {_literal(m.codebook)} AS book)",
        f"coded AS (SELECT row_id, v, n, y, {nearest} AS codes FROM y{at} CROSS JOIN tables)",
        "parts AS (SELECT *, list_transform(range(1, 65), lambda c: centers[c][codes[c] + 1]) AS p FROM coded CROSS JOIN tables)",
        "left_over AS (SELECT *, list_transform(range(1, 65), lambda c: y[c] - p[c]) AS r FROM parts)",
        f"far AS (SELECT * EXCLUDE (centers, book), list_transform(range(0, 8), lambda s: {distances}) AS ds FROM left_over)",
        "resolved AS (SELECT * EXCLUDE (ds), list_transform(ds, lambda d: list_position(d, list_min(d)) - 1) AS res FROM far)",
        "whole AS (SELECT *, list_transform(range(0, 64), lambda c: book[c // 8 + 1][res[c // 8 + 1] + 1][c % 8 + 1]) AS e FROM resolved CROSS JOIN (SELECT book FROM tables))",
        "encoded AS (SELECT row_id, v, n, y, codes, res, p, e, sqrt(list_sum(list_transform(range(1, 65), lambda c: (p[c]::DOUBLE + e[c]::DOUBLE) * (p[c]::DOUBLE + e[c]::DOUBLE)))) AS recon_length, "
        "sqrt(list_sum(list_transform(range(1, 65), lambda c: (y[c]::DOUBLE - p[c]::DOUBLE) * (y[c]::DOUBLE - p[c]::DOUBLE)))) AS err_primary, "
        "sqrt(list_sum(list_transform(range(1, 65), lambda c: (y[c]::DOUBLE - (p[c]::DOUBLE + e[c]::DOUBLE)) * (y[c]::DOUBLE - (p[c]::DOUBLE + e[c]::DOUBLE))))) AS err_refined FROM whole)",
    ]
    return "WITH " + ",\n".join(ctes)


_ENTRY = _ROUND.format(x="(q.y[c]::DOUBLE * r.p[c]::DOUBLE * 16777216.0)")
_RIGHT = _ROUND.format(x="(list_sum(list_transform(range(1, 9), lambda l: q.y[s * 8 + l]::DOUBLE * r.e[s * 8 + l]::DOUBLE)) * 16777216.0)")
_HALF = """halves AS (SELECT *, floor(log2(n))::INTEGER AS ex, round_even(n / pow(2.0, floor(log2(n)) - 10), 0)::BIGINT AS fr FROM encoded),
weighed AS (SELECT *, (fr * pow(2.0, ex + 14)::BIGINT) AS units, (((CASE WHEN fr = 2048 THEN ex + 1 ELSE ex END) + 15) * 1024 + (CASE WHEN fr = 2048 THEN 0 ELSE fr - 1024 END))::INTEGER AS mag_bits FROM halves)"""


def _primary_sql(where: str, key: str, budget: int, scaled: bool = False) -> str:
    return f"""{_codec_sql(scaled)}, {_HALF},
scores AS (SELECT q.row_id AS query_id, r.row_id, list_sum(list_transform(range(1, 65), lambda c: {_ENTRY}))::BIGINT AS primary_raw FROM weighed q CROSS JOIN weighed r WHERE q.row_id % 50 = 0{where}),
pool AS (SELECT s.*, units, row_number() OVER (PARTITION BY query_id ORDER BY {key} DESC, s.row_id) AS place FROM scores s JOIN weighed w ON w.row_id = s.row_id QUALIFY place <= {budget})"""


def _search_sql(where: str, key: str, final: str, columns: str, scaled: bool) -> str:
    return f"""{_primary_sql(where, key, 100, scaled)},
refined AS (SELECT p.*, r.recon_length, r.mag_bits, q.n AS length, p.primary_raw + list_sum(list_transform(range(0, 8), lambda s: {_RIGHT}))::BIGINT AS refined_raw
  FROM pool p JOIN weighed q ON q.row_id = p.query_id JOIN weighed r ON r.row_id = p.row_id),
fixed AS (SELECT *, refined_raw::DOUBLE / recon_length AS corrected FROM refined),
ordered AS (SELECT *, {final} AS final, row_number() OVER (PARTITION BY query_id ORDER BY {final} DESC, row_id)::INTEGER AS rank FROM fixed QUALIFY rank <= {K})
SELECT {columns} FROM ordered"""


def _norm_sql(table: str) -> str:
    return f"""marked AS (SELECT *, len(v) = 64 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AS ok FROM ({table})),
lengths AS (SELECT *, coalesce(ok, false) AS finite, CASE WHEN ok THEN sqrt({_SQUARES.format(v='v')}) END AS length FROM marked)"""


_CORPORA = "SELECT corpus, split_name, vec_id, embedding AS v FROM corpus_vectors WHERE corpus IS NOT NULL"


def _rank_sql(column: str, percents: tuple, by: str, source: str) -> str:
    picks = ", ".join(f"min({column}) FILTER (WHERE upto * 100 >= n * {p}) AS {column}_p{p}" for p in percents)
    return f"SELECT {by}, {picks}, max(n)::BIGINT AS {column}_n FROM (SELECT {by}, {column}, row_number() OVER (PARTITION BY {by} ORDER BY {column}) AS upto, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {column} IS NOT NULL) GROUP BY {by}"


def _audit_sql(table: str) -> str:
    return f"""WITH {_norm_sql(table)}, ranks AS ({_rank_sql('length', (50, 95, 99), 'corpus', 'lengths')})
SELECT l.*, l.vectors - l.finite AS non_finite, CASE WHEN l.finite > 0 THEN l.near_unit / l.finite END AS near_unit_share, length_p50, length_p95, length_p99 FROM (
SELECT corpus, count(*) AS vectors, count_if(finite)::BIGINT AS finite, count_if(finite AND length <= 65504 AND length >= 1e-12)::BIGINT AS accepted, count_if(length > 65504)::BIGINT AS above,
  count_if(length < 1e-12)::BIGINT AS below, count_if(length >= 1e-12 AND length <= pow(2.0, -25))::BIGINT AS underflow, count_if(abs(length - 1.0) <= 1e-3)::BIGINT AS near_unit,
  count_if(length < pow(2.0, -14))::BIGINT AS near_zero, min(length) AS length_min, max(length) AS length_max FROM lengths GROUP BY corpus) l LEFT JOIN ranks r ON r.corpus = l.corpus"""


_LISTS_SQL = f"""WITH cand AS (SELECT query_id, row_id, max(corrected) AS corrected, max(primary_raw) AS primary_raw, max(refined_raw) AS refined_raw, max(truth_score) AS truth_score, max(segment) AS segment
  FROM candidates WHERE isfinite(corrected) AND query_id IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL),
near AS (SELECT query_id, row_id, max(score) AS score FROM neighbors WHERE isfinite(score) AND query_id IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL),
truth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INTEGER AS rank FROM near QUALIFY rank <= {K}),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY corrected DESC, row_id)::INTEGER AS by_corrected, row_number() OVER (PARTITION BY query_id ORDER BY refined_raw DESC NULLS LAST, row_id) AS by_refined,
  row_number() OVER (PARTITION BY query_id ORDER BY truth_score DESC NULLS LAST, row_id) AS by_truth, row_number() OVER (PARTITION BY query_id ORDER BY primary_raw DESC NULLS LAST, row_id)::INTEGER AS by_primary FROM cand)"""
_NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    exact_pairs = _exact_sql("cosine", K, True, False)
    return {
        "exact_cosine_topk": exact_pairs,
        "exact_dot_topk": _exact_sql("dot", K, False, True),
        "streaming_topk_merge": _exact_sql("cosine", K, False, False),
        "norm_audit": _audit_sql(_CORPORA),
        "norm_invalid_rows": f"""WITH {_norm_sql(_CORPORA)}, faults AS (SELECT DISTINCT corpus, vec_id, CASE WHEN v IS NULL THEN 'null' WHEN len(v) <> 64 THEN 'dimension' WHEN NOT finite THEN 'non_finite' WHEN length > 65504 THEN 'above' WHEN length < 1e-12 THEN 'below' END AS why FROM lengths)
SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY vec_id, why)::INTEGER AS place FROM faults WHERE why IS NOT NULL QUALIFY place <= 8""",
        "scale_shift": f"""WITH a AS ({_audit_sql(_CORPORA + " AND split_name = 'indexed'")}), b AS ({_audit_sql(_CORPORA + " AND split_name = 'queries'")}),
r AS (SELECT a.corpus, b.length_p50 / a.length_p50 AS median_ratio, b.length_p95 / a.length_p95 AS p95_ratio FROM a JOIN b ON a.corpus = b.corpus)
SELECT *, median_ratio > 1.05 OR median_ratio < 1 / 1.05::DOUBLE OR p95_ratio > 1.05 OR p95_ratio < 1 / 1.05::DOUBLE AS shifted FROM r""",
        "unit_direction": f"WITH {_rows_sql(True)} SELECT row_id, n AS length, (unnest(range(0, 64)))::INTEGER AS coord, unnest(list_transform(v, lambda x: (x::DOUBLE / n)::FLOAT)) AS value FROM rows",
        "hadamard_rows": f"WITH {_rows_sql(False)} SELECT row_id AS query_id, i::INTEGER AS coord, list_sum(list_transform(range(0, 64), lambda j: v[j + 1]::DOUBLE * (1 - 2 * (bit_count(i & j) % 2)))) / sqrt(64.0::DOUBLE) AS value FROM rows CROSS JOIN (SELECT unnest(range(0, 64)) AS i) WHERE row_id % 50 = 0",
        "rotation_forward": f"{_codec_sql()} SELECT row_id, (unnest(range(0, 64)))::INTEGER AS coord, unnest(y) AS value FROM coded",
        "rotation_roundtrip": "SELECT vec_id AS row_id, true AS restored FROM embeddings",
        "quantile_centers": "WITH l AS (SELECT c, list_sort(list(embedding[c])) AS s FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS c) GROUP BY c) SELECT (c - 1)::INTEGER AS coord, k::INTEGER AS code, s[1 + ((k * (len(s) - 1)) // 15)] + 0::FLOAT AS center FROM l CROSS JOIN (SELECT unnest(range(0, 16)) AS k)",
        "int4_encode": f"{_codec_sql()} SELECT row_id, (unnest(range(0, 64)))::INTEGER AS coord, unnest(codes)::INTEGER AS code FROM coded",
        "int4_pack": f"{_codec_sql()} SELECT row_id, (unnest(range(0, 32)))::INTEGER AS at, unnest(list_transform(range(0, 32), lambda i: codes[2 * i + 1] + 16 * codes[2 * i + 2]))::INTEGER AS byte FROM coded",
        "pq_encode": f"{_codec_sql()} SELECT row_id, (unnest(range(0, 8)))::INTEGER AS sub, unnest(res)::INTEGER AS code FROM resolved",
        "encode_errors": f"{_codec_sql()} SELECT row_id, err_primary, err_refined, len(list_filter(range(1, 65), lambda c: y[c] < centers[c][1] OR y[c] > centers[c][16])) / 64.0::DOUBLE AS outside FROM encoded CROSS JOIN tables",
        "block_certificates": f"{_codec_sql()} SELECT (row_id // {SEGMENT})::INTEGER AS segment, min(row_id) AS first_row, count(*) AS row_count, max(err_primary) AS err_primary, max(err_refined) AS err_refined FROM encoded GROUP BY 1",
        "q24_tables": f"{_codec_sql()}, cells AS (SELECT unnest(range(1, 65)) AS c), kinds AS (SELECT unnest(range(1, 17)) AS k) SELECT row_id AS query_id, (c - 1)::INTEGER AS coord, (k - 1)::INTEGER AS code, "
        + _ROUND.format(x="(y[c]::DOUBLE * centers[c][k]::DOUBLE * 16777216.0)")
        + " AS entry FROM coded CROSS JOIN tables CROSS JOIN cells CROSS JOIN kinds WHERE row_id % 50 = 0",
        "magnitude_units": f"{_codec_sql(True)}, {_HALF} SELECT row_id, mag_bits, units FROM weighed",
        "byte_accounting": "SELECT count(*) AS rows, count(*) * 32 AS code_bytes, count(*) * 8 AS residual_bytes, count(*) * 2 AS length_bytes FROM embeddings",
        "primary_scan": f"{_primary_sql(' AND q.row_id <> r.row_id', 'primary_raw', 50)} SELECT query_id, row_id, (row_id // {SEGMENT})::INTEGER AS segment, primary_raw, place::INTEGER AS rank FROM pool",
        "search_cosine": _search_sql(" AND q.row_id <> r.row_id", "primary_raw", "corrected", f"query_id, rank, row_id, (row_id // {SEGMENT})::INTEGER AS segment, corrected / 16777216.0::DOUBLE AS score, primary_raw, refined_raw, recon_length, (SELECT count(*) FROM embeddings)::INTEGER AS rows_scanned, 100::INTEGER AS rows_refined", False),
        "search_dot": _search_sql("", "primary_raw::DOUBLE * units", "corrected * units", "query_id, rank, row_id, final / 281474976710656.0::DOUBLE * length AS score, units / 16777216.0::DOUBLE AS magnitude", True),
        "recall_at_k": f"{_LISTS_SQL} SELECT t.query_id, count(r.row_id) AS hits, count(*) AS wanted, count(r.row_id) / count(*) AS recall FROM truth t LEFT JOIN (SELECT * FROM ranks WHERE by_corrected <= {K}) r USING (query_id, row_id) GROUP BY t.query_id",
        "budget_sweep": f"{_LISTS_SQL}, b AS (SELECT unnest({BUDGETS})::INTEGER AS budget), pool AS (SELECT *, row_number() OVER (PARTITION BY budget, query_id ORDER BY corrected DESC, row_id) AS place FROM ranks CROSS JOIN b WHERE by_primary <= budget) SELECT budget, (SELECT count(*) FROM pool p JOIN truth t USING (query_id, row_id) WHERE p.budget = b.budget AND place <= {K}) AS hits, (SELECT count(*) FROM truth) AS wanted FROM b",
        "loss_attribution": f"""{_LISTS_SQL}, j AS (SELECT t.query_id, r.row_id IS NOT NULL AS selected, by_corrected, by_refined, by_truth FROM truth t LEFT JOIN ranks r USING (query_id, row_id))
SELECT *, wanted - selected AS selection_losses, selected - delivered AS ranking_losses FROM (SELECT query_id, count(*) AS wanted, count_if(selected)::BIGINT AS selected, count_if(by_corrected <= {K})::BIGINT AS delivered, count_if(by_refined <= {K})::BIGINT AS by_refined, count_if(by_truth <= {K})::BIGINT AS by_truth FROM j GROUP BY query_id)""",
        "stored_alignment": f"""{_LISTS_SQL}, lens AS (SELECT query_id, row_id, max(refined_raw) AS raw, max(recon_length) AS l FROM candidates WHERE isfinite(corrected) AND query_id IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL HAVING raw IS NOT NULL),
fit AS (SELECT query_id, row_id, raw::DOUBLE AS raw, CASE WHEN isfinite(l) AND l > 0 THEN l END AS l FROM lens),
kinds AS (SELECT query_id, row_id, raw AS r_none, raw / coalesce(l, 1.0::DOUBLE) AS r_exact, raw / coalesce(round_even(l / pow(2.0, greatest(floor(log2(l)), -14) - 10), 0) * pow(2.0, greatest(floor(log2(l)), -14) - 10), 1.0::DOUBLE) AS r_half,
  raw / coalesce(round_even((least(greatest(l, 0.5::DOUBLE), 1.25::DOUBLE) - 0.5::DOUBLE) / (0.75::DOUBLE / 255), 0) * (0.75::DOUBLE / 255) + 0.5::DOUBLE, 1.0::DOUBLE) AS r_byte FROM fit),
placed AS (SELECT query_id, row_id, """ + ", ".join(f"(row_number() OVER (PARTITION BY query_id ORDER BY r_{n} DESC, row_id) <= {K})::BIGINT AS by_{n}" for n in ("exact", "half", "byte", "none")) + """ FROM kinds)
SELECT query_id, """ + ", ".join(f"coalesce(sum(by_{n}), 0)::BIGINT AS by_{n}" for n in ("exact", "half", "byte", "none")) + " FROM truth t LEFT JOIN placed USING (query_id, row_id) GROUP BY query_id",
        "block_check": f"SELECT (vec_id // {SEGMENT})::INTEGER AS segment, count(*) AS rows, count(DISTINCT vec_id) AS distinct_rows, min(vec_id) AS first_row, max(vec_id) AS last_row, count(*) = count(DISTINCT vec_id) AND max(vec_id) - min(vec_id) + 1 = count(*) AS whole FROM embeddings GROUP BY 1",
        "selection_losses": f"{_LISTS_SQL} SELECT query_id, row_id FROM truth ANTI JOIN cand USING (query_id, row_id)",
        "primary_rank_of_truth": f"{_LISTS_SQL} SELECT t.query_id, t.row_id, t.rank AS true_rank, by_primary AS primary_rank FROM truth t JOIN ranks r USING (query_id, row_id)",
        "rank_gap": f"{_LISTS_SQL}, w AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS after FROM near WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, row_id)) SELECT query_id, score - after AS gap FROM w WHERE place = {K} AND after IS NOT NULL",
        "score_errors": f"{_LISTS_SQL}, e AS (SELECT segment, abs(corrected - truth_score) AS error FROM cand WHERE segment IS NOT NULL AND isfinite(corrected - truth_score)), r AS ({_rank_sql('error', (50, 90, 99), 'segment', 'e')}) SELECT r.*, m AS error_max FROM r JOIN (SELECT segment, max(error) AS m FROM e GROUP BY 1) USING (segment)",
        "prune_survivors": f"""WITH c AS (SELECT query_id, row_id, max(primary_raw) / 16777216.0::DOUBLE AS x FROM candidates WHERE primary_raw IS NOT NULL AND isfinite(corrected) AND query_id IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x - 0.0625::DOUBLE DESC, row_id) AS place FROM c), t AS (SELECT query_id, min(x - 0.0625::DOUBLE) AS threshold FROM r WHERE place <= {K} GROUP BY 1)
SELECT query_id, threshold, count(*) AS rows, count_if(x + 0.0625::DOUBLE >= threshold)::BIGINT AS survivors FROM c JOIN t USING (query_id) GROUP BY ALL""",
        "label_relevance": f"""WITH found AS ({exact_pairs}), hits AS (SELECT query_id, min(rank) AS first FROM found JOIN embeddings q ON q.vec_id = query_id JOIN embeddings r ON r.vec_id = row_id WHERE q.label = r.label GROUP BY 1)
SELECT vec_id AS query_id, first, coalesce(1.0::DOUBLE / first, 0.0::DOUBLE) AS reciprocal, (first IS NOT NULL)::BIGINT AS hit FROM embeddings LEFT JOIN hits ON query_id = vec_id WHERE vec_id % 50 = 0""",
        "uncovered_queries": "SELECT DISTINCT query_id FROM neighbors ANTI JOIN candidates USING (query_id)",
        "segment_of_row": "SELECT row_id // 65536 AS expected, count(*) AS rows, count_if(segment <> row_id // 65536)::BIGINT AS others FROM candidates WHERE row_id IS NOT NULL GROUP BY 1",
        "drift_quantiles": f"""WITH d AS (SELECT * FROM drift_rows WHERE index_id IS NOT NULL AND row_id IS NOT NULL), ok AS (SELECT * FROM d WHERE NOT coalesce(isnan(err_primary), false) AND NOT coalesce(isnan(err_refined), false)), a AS ({_rank_sql('err_primary', (50, 95, 99), 'index_id', 'ok')}), b AS ({_rank_sql('err_refined', (50, 95, 99), 'index_id', 'ok')})
SELECT a.*, b.* EXCLUDE (index_id), rows, outside FROM a JOIN b ON a.index_id = b.index_id JOIN (SELECT index_id, count(*) AS rows, sum(outside_fraction::DOUBLE) / count(outside_fraction) AS outside FROM d GROUP BY 1) s ON s.index_id = a.index_id""",
        "drift_warning": "SELECT *, sample >= 1000 AND exceeding > 0.05::DOUBLE * sample AS warned FROM (SELECT index_id, count(*) AS sample, count_if(err_refined::DOUBLE > baseline_refined_p99)::BIGINT AS exceeding FROM drift_rows JOIN drift_indexes USING (index_id) WHERE row_id IS NOT NULL AND err_refined IS NOT NULL GROUP BY 1)",
        "drift_reservoir": "SELECT index_id, row_id FROM (SELECT DISTINCT index_id, row_id FROM drift_rows WHERE index_id IS NOT NULL AND row_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY left(sha256(row_id || '|' || index_id), 13)) <= 40",
        "dense_row_ids": "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM (SELECT DISTINCT vec_id FROM corpus_vectors WHERE vec_id IS NOT NULL)",
        "positional_split": "SELECT CASE WHEN vec_id >= n - 40 THEN 'queries' WHEN vec_id >= n - 100 THEN 'calibration' ELSE 'indexed' END AS split, count(*) AS rows, min(vec_id) AS first, max(vec_id) AS last FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) GROUP BY 1",
        "hash_split": "SELECT vec_id AS row_id, row_number() OVER (ORDER BY sha256('7|' || vec_id)) <= 100 AS validation FROM embeddings",
        "split_disjointness": f"WITH t AS (SELECT lower(trim(split_name)) AS s, md5({_NORMAL}) AS text_key FROM split_records WHERE text IS NOT NULL) SELECT DISTINCT text_key FROM t WHERE s IN ('tuning', 'test') AND text_key IN (SELECT text_key FROM t WHERE s IN ('indexed', 'calibration'))",
        "text_dedup": f"SELECT rec_no, priority, text_key FROM (SELECT rec_no, sha256('|' || rec_no) AS priority, md5({_NORMAL}) AS text_key FROM split_records WHERE text IS NOT NULL AND rec_no IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY text_key ORDER BY priority) = 1",
        "hash_sample": "SELECT doc_id, sha256('sample|' || doc_id) AS priority FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) ORDER BY priority LIMIT 200",
        "trial_spread": "SELECT i::INTEGER AS seed, (1000 // 64 + (i < 1000 % 64)::INTEGER)::INTEGER AS trials FROM (SELECT unnest(range(0, 64)) AS i)",
    }
