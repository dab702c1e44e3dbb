"""Queries that qualify the engine's own search, with the frozen model so that SQL can say the same."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import queries as base
from quillon import sqlapi
from quillon.common import cut, ensure_checkpoint_dir, read
from quillon.functions import bounds, codec, vectors
from quillon.operators import drift, evaluate, exact, search
from quillon.operators.blocks import bytes_matrix, matrix
from quillon.operators.select import key_of_hex
from quillon.plans import measure
from quillon.plans.index import Index, IndexBuilder
from quillon.queries import K, SEGMENT, frozen_model
from quillon.sources import files
from quillon.sources.generated import splitmix
from quillon.spec import LEAST_NORM, MAX_NORM, ONE, SPEC_64
from quillon.streaming.ingest import StreamingTopK

#: Budgets of the sweep over the engine's own search, and of all other searches.
SWEEP = (10, 20, 50, 100, 200)
BUDGET = 100


def _round(c: str):
    """Bounds are compared to nine places: SQL has no step to the next number."""
    return F.round(F.col(c), 9).alias(c)


def _pieces(spark, d, scaled: bool = False):
    rows = base._vectors(spark, d, scaled)
    return rows, base._asked(rows), base._encoded(spark, d, scaled), frozen_model()


def _cosines(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Exact cosines of pairs ``query_id, row_id``."""
    q, v = F.col("q"), F.col("v")
    return (
        pairs.select("query_id", "row_id").join(rows, "row_id").join(asked.select("query_id", F.col("v").alias("q")), "query_id")
        .select("query_id", "row_id", (vectors.dot(q, v) / (vectors.norm(q) * vectors.norm(v))).alias("score"))
    )


def search_intervals(spark, d):
    _, asked, encoded, model = _pieces(spark, d)
    return search.search(encoded, asked, model, K, BUDGET, exclude="own").select("query_id", "rank", "row_id", _round("lower"), _round("upper"))


def dot_intervals(spark, d):
    _, asked, encoded, model = _pieces(spark, d, True)
    return search.search(encoded, asked, model, K, BUDGET, "dot").select("query_id", "rank", "row_id", _round("lower"), _round("upper"))


def certificate_bounds(spark, d):
    return search.certificates(base._encoded(spark, d), frozen_model()).select("segment", _round("eps_primary"), _round("eps_refined"))


def epsilon_parts(spark, d):
    """Per segment the shares of both bounds: transform, reconstruction, serving."""
    spec, terms = frozen_model().spec, search.certificates(base._encoded(spark, d), frozen_model())
    kind = lambda name, refined: terms.select(
        "segment", F.lit(name).alias("kind"), F.round(F.lit(bounds.eta_transform(spec)) / F.col(f"eps_{name}"), 9).alias("transform"),
        F.round(bounds.query_norm_upper(spec) * F.col(f"err_{name}") / F.col(f"eps_{name}"), 9).alias("reconstruction"), F.round(F.lit(bounds.eta_serving(spec, refined)) / F.col(f"eps_{name}"), 9).alias("serving"),
    )
    return kind("primary", False).unionByName(kind("refined", True))


def enclosure_of_hits(spark, d):
    """Whether the exact cosine of every hit lies in its interval, and the widest half interval."""
    rows, asked, encoded, model = _pieces(spark, d)
    hits = cut(search.search(encoded, asked, model, K, BUDGET, exclude="own"))
    return evaluate.enclosure(hits, _cosines(hits, rows, asked)).select("hits", "violations", _round("widest_half"))


def search_recall(spark, d):
    rows, asked, encoded, model = _pieces(spark, d)
    return evaluate.recall(search.search(encoded, asked, model, K, BUDGET, exclude="own"), exact.exact_topk(rows, asked, K, exclude="own"), K)


def search_rerank(spark, d):
    """The best fifty of a compressed search ranked anew by exact cosine."""
    rows, asked, encoded, model = _pieces(spark, d)
    pool = search.search(encoded, asked, model, 50, BUDGET, exclude="own")
    top = evaluate.ranked(_cosines(pool, rows, asked), "score", most=K)
    return evaluate.recall(top, exact.exact_topk(rows, asked, K, exclude="own"), K)


def search_budgets(spark, d):
    """Per budget: hits among the true ten and the true hundred, violated intervals and the widest half of one."""
    rows, asked, encoded, model = _pieces(spark, d)
    terms, n = cut(search.certificates(encoded, model)), encoded.count()
    truth = cut(exact.exact_topk(rows, asked, 100, exclude="own")).select("query_id", "row_id", F.col("rank").alias("true_rank"))
    out = None
    for budget in SWEEP:
        hits = cut(search.search(encoded, asked, model, min(100, budget), budget, exclude="own", terms=terms, rows=n))
        j = hits.join(truth, ["query_id", "row_id"], "left").join(_cosines(hits, rows, asked).withColumnRenamed("score", "true_score"), ["query_id", "row_id"])
        part = j.agg(
            F.lit(budget).alias("budget"), F.count_if((F.col("rank") <= 10) & (F.col("true_rank") <= 10)).alias("hits_10"), F.count_if(F.col("true_rank").isNotNull()).alias("hits_100"),
            F.count_if((F.col("true_score") < F.col("lower")) | (F.col("true_score") > F.col("upper"))).alias("violations"), F.round(F.max((F.col("upper") - F.col("lower")) / 2), 9).alias("widest_half"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def dot_qualification(spark, d):
    """Hits among the true ten by dot product: of the compressed dot search, of the compressed cosine search, and of the
    exact cosine lists."""
    rows, asked, encoded, model = _pieces(spark, d, True)
    truth = cut(exact.exact_topk(rows, asked, K, "dot"))
    lists = {
        "compressed_dot": search.search(encoded, asked, model, K, BUDGET, "dot"), "compressed_cosine": search.search(encoded, asked, model, K, BUDGET),
        "exact_cosine": exact.exact_topk(rows, asked, K),
    }
    out = None
    for name, found in lists.items():
        part = evaluate.recall(found.select("query_id", "row_id", "rank"), truth, K).agg(F.lit(name).alias("kind"), F.sum("hits").alias("hits"), F.sum("wanted").alias("wanted"))
        out = part if out is None else out.unionByName(part)
    return out


def _root_length(x, bits):
    return x * np.sqrt(codec.units(bits).astype(np.float64))


#: A ranking between cosine and dot product: by the root of the length.
ROOT = search.Ranking("root", lambda raw, bits: _root_length(raw.astype(np.float64), bits), _root_length, lambda key, length: key / ONE, lambda low, high, bits, length: (low, high))


def search_given_ranking(spark, d):
    _, asked, encoded, model = _pieces(spark, d, True)
    return search.search(encoded, asked, model, K, BUDGET, ROOT).select("query_id", "rank", "row_id", F.round(F.col("score"), 6).alias("score"))


def stored_search(spark, d):
    """Both generations of a stored index, reopened and verified: half of the rows, then all."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    rows = base._vectors(spark, d)
    half = rows.count() // 2
    builder = IndexBuilder.create(spark, path, None, spec=SPEC_64, segment_rows=SEGMENT, model=frozen_model())
    for part in (rows.where(F.col("row_id") < half), rows.where(F.col("row_id") >= half)):
        builder.push(part, "row_id")
        builder.commit()
    asked = base._asked(rows).drop("own")
    own = ("generation", "query_id", "rank", "row_id", "segment", "score", "refined_raw", "rows_scanned")
    return Index.open(spark, path, 1).search(asked, K, BUDGET).select(*own).unionByName(Index.open(spark, path).search(asked, K, BUDGET).select(*own))


def streaming_class_topk(spark, d):
    """Three micro-batches through the streaming operator, the last of them twice."""
    ensure_checkpoint_dir(spark)
    rows = base._vectors(spark, d)
    top = StreamingTopK(spark, base._asked(rows), K, f"{spark.sparkContext.getCheckpointDir()}/topk-{uuid.uuid4().hex}")
    for epoch, part in ((0, 0), (1, 1), (2, 2), (2, 2)):
        top.update(rows.where(f"row_id % 3 = {part}"), epoch)
    return top.at(2)


def stored_lists(spark, d):
    """Exact lists written, and read again with their checks."""
    ensure_checkpoint_dir(spark)
    path, rows = f"{spark.sparkContext.getCheckpointDir()}/lists-{uuid.uuid4().hex}", base._vectors(spark, d)
    files.write_lists(base.exact_cosine_topk(spark, d), path, rows.count() - 1, K)
    return files.read_lists(spark, path)[0]


def drift_merge(spark, d):
    """Reservoirs of odd and even generations merged into that of all."""
    key = key_of_hex(F.sha2(F.concat_ws("|", "row_id", "index_id"), 256))
    rows = base._drift_rows(spark, d)
    odd = F.coalesce(F.col("generation") % 2 == 1, F.lit(False))
    a, b = (drift.reservoir(rows.where(w).select("index_id", "row_id").distinct(), key, 40, ["index_id"]) for w in (odd, ~odd))
    return drift.merge_reservoirs(a, b, key, 40, ["index_id"])


def stable_fingerprint(spark, d):
    """Whether the exact bits of all hits are the same for any partitioning of the rows."""
    _, asked, encoded, model = _pieces(spark, d)
    prints = [measure.distributed_fingerprint(search.search(encoded.repartition(n), asked, model, K, BUDGET, exclude="own")) for n in (1, 7)]
    return prints[0].join(prints[1].select(F.col("hits").alias("h"), F.col("x").alias("y"), F.col("s").alias("t"))).select("hits", ((F.col("hits") == F.col("h")) & (F.col("x") == F.col("y")) & (F.col("s") == F.col("t"))).alias("same"))


def candidate_scores(spark, d):
    """Of each query's ten best by integer score: the primary score in single precision, and the refined integer score
    from decoded centroids."""
    _, asked, encoded, model = _pieces(spark, d)
    pool = search.scan(encoded, asked, model, 10, exclude="own", stored=True).join(asked.select("query_id", "v"), "query_id")

    def run(batches):
        for part in batches:
            y = model.rotation.forward(codec.directions(matrix(part.v, 64)))
            codes, res, primary = codec.unpack(bytes_matrix(part.code, 32)), bytes_matrix(part.residual, 8), part.primary_raw.to_numpy()
            decoded = [int(codec.refine_decoded(primary[i : i + 1], res[i : i + 1], y[i], model.codebook)[0]) for i in range(len(part))]
            yield pd.DataFrame({"query_id": part.query_id, "row_id": part.row_id, "float_score": codec.float_score(y, codes, model.centers), "refined_decoded": decoded})

    return pool.mapInPandas(run, "query_id long, row_id long, float_score float, refined_decoded long")


def query_errors(spark, d):
    """Per query: what its integer primary and refined scores can be off from the sums they stand for."""
    model, (_, asked, _, _) = frozen_model(), _pieces(spark, d)

    def run(batches):
        for part in batches:
            p, r = bounds.query_errors(model.rotation.forward(codec.directions(matrix(part.v, 64))), model.centers, model.codebook)
            yield pd.DataFrame({"query_id": part.query_id, "primary_error": p, "refined_error": r})

    scale = lambda c: F.round(F.col(c) * F.lit(float(ONE)), 6).alias(c)
    return asked.mapInPandas(run, "query_id long, primary_error double, refined_error double").select("query_id", scale("primary_error"), scale("refined_error"))


def half_length_error(spark, d):
    """Per corpus: lengths that can be stored, and the largest relative error of storing them in half precision."""
    v = F.col("v")
    lengths = base._corpora(spark, d).where(vectors.fault(v, 64).isNull()).select("corpus", vectors.norm(v).alias("n"))
    return lengths.groupBy("corpus").agg(F.count("*").alias("lengths"), F.round(F.max(F.abs(evaluate.as_half(F.col("n")) - F.col("n")) / F.col("n")), 9).alias("largest_error"))


def drift_against_first(spark, d):
    """Rows of later generations against the first one of their index, both arms of the warning."""
    rows = base._drift_rows(spark, d).where("err_refined IS NOT NULL AND NOT isnan(err_refined) AND generation IS NOT NULL")
    marked = rows.join(rows.groupBy("index_id").agg(F.min("generation").alias("_g")), "index_id").withColumn("_first", F.col("generation") == F.col("_g"))
    base_ = drift.nearest_rank(["err_refined"], (95, 99), ["index_id"], marked.where("_first")).select("index_id", F.col("err_refined_p95").alias("baseline_p95"), F.col("err_refined_p99").alias("baseline_p99"))
    later = marked.where("NOT _first")
    p95 = drift.nearest_rank(["err_refined"], (95,), ["index_id"], later).select("index_id", F.col("err_refined_p95").alias("p95"))
    counts = later.join(base_, "index_id").groupBy("index_id").agg(F.count("*").alias("sample"), F.count_if(F.col("err_refined") > F.col("baseline_p99")).alias("exceeding"))
    wide = lambda c: F.col(c).cast("double").alias(c)
    joined = counts.join(p95, "index_id").join(base_, "index_id").select("index_id", "sample", "exceeding", wide("p95"), wide("baseline_p95"), wide("baseline_p99"))
    return joined.withColumn("warned", drift.warning(F.col("sample"), F.col("p95"), F.col("exceeding"), F.col("baseline_p95")))


def loss_trace(spark, d):
    """The rank of each true neighbour by every kind of score; null where it was not selected."""
    rows = evaluate.unique_scores(read(spark, d, "candidates"), "corrected", ("primary_raw", "refined_raw", "truth_score", "recon_length"))
    return evaluate.loss_trace(rows, base._lists(spark, d)[1], K)


def loss_trace_audit(spark, d):
    """Totals of the trace, and rows of it that contradict each other."""
    t = loss_trace(spark, d)
    ranks = [F.col(c) for c in evaluate.TRACE]
    some, whole = F.coalesce(*ranks).isNotNull(), F.lit(True)
    for c in ranks:
        whole = whole & c.isNotNull()
    return t.agg(F.count("*").alias("wanted"), F.count_if(some).alias("selected"), *(F.count_if(F.col(c) <= K).alias(f"within_{c}") for c in evaluate.TRACE), F.count_if(some & ~whole).alias("contradictions"))


def recall_gate(spark, d):
    """Whether each smaller budget loses more than a point of the recall of the largest."""
    sweep = base.budget_sweep(spark, d)
    best = sweep.where(F.col("budget") == max(base.BUDGETS)).select(F.col("hits").alias("best"))
    return sweep.join(best).select("budget", evaluate.recall_gate(F.col("best"), F.col("hits"), F.col("wanted")).alias("passes"))


def id_coverage(spark, d):
    """Queries that only one of candidates and exact lists has, and those of both."""
    a, b = (read(spark, d, t).where("query_id IS NOT NULL").select("query_id").distinct().withColumn(t, F.lit(1)) for t in ("candidates", "neighbors"))
    j = a.join(b, "query_id", "full")
    return j.agg(F.count_if(F.col("neighbors").isNull()).alias("only_candidates"), F.count_if(F.col("candidates").isNull()).alias("only_neighbors"), F.count_if(F.col("candidates").isNotNull() & F.col("neighbors").isNotNull()).alias("both"))


def sql_functions(spark, d):
    """The functions that SQL can call."""
    sqlapi.register(spark, frozen_model())
    read(spark, d, "embeddings").createOrReplaceTempView("quillon_embeddings")
    return spark.sql(
        "SELECT a.vec_id AS a, b.vec_id AS b, vec_norm(a.embedding) AS length, dot(a.embedding, b.embedding) AS product, cosine_sim(a.embedding, b.embedding) AS cosine "
        "FROM quillon_embeddings a JOIN quillon_embeddings b ON b.vec_id = a.vec_id + 1"
    )


def splitmix_numbers(spark, d):
    """Sixteen numbers for each nation's key as a seed."""

    @F.pandas_udf("array<float>")
    def numbers(seed: pd.Series) -> pd.Series:
        return pd.Series([splitmix(int(s), 16) for s in seed])

    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed"), F.posexplode(numbers("n_nationkey")).alias("spot", "value"))


def trained_quality(spark, d):
    """A model trained on the table's own rows: queries, whether recall@10 is at least 0.8, intervals violated, and
    whether every sub-quantiser was moved at least once."""
    rows, encoded, model = base._trained(spark, d)
    asked = base._asked(rows)
    hits = cut(search.search(encoded, asked, model, K, exclude="own"))
    recall = evaluate.recall(hits, exact.exact_topk(rows, asked, K, exclude="own"), K).agg(F.count("*").alias("queries"), (F.sum("hits") >= 0.8 * F.sum("wanted")).alias("recalled"))
    bad = evaluate.enclosure(hits, _cosines(hits, rows, asked)).select("violations")
    return recall.join(bad).withColumn("trained", F.lit(model.baseline["training_iterations"] >= model.spec.subs and model.baseline["training_moves"] > 0))


def append_counts(spark, d):
    """Of both generations of an index trained on its own table: hits, rows scanned, and whether all came from it."""
    hits = base.append_generations(spark, d)
    return hits.groupBy("generation").agg(F.count("*").alias("hits"), F.max("rows_scanned").cast("long").alias("scanned"), (F.max("row_id") < F.max("rows_scanned")).alias("within"))


def generated_growth(spark, d):
    """Rows of a generated corpus that a longer one of the same seed repeats to the bit, and of another seed that it does not."""
    from quillon.sources.generated import generated

    keyed = lambda name, seed: generated(spark, name, seed).select("row_id", F.xxhash64("v").alias("h"))
    short, long = keyed("generated-correlated-64x300", 3), keyed("generated-correlated-64x900", 3).withColumnRenamed("h", "g")
    other = keyed("generated-correlated-64x300", 4).withColumnRenamed("h", "o")
    return short.join(long, "row_id").join(other, "row_id").agg(F.count("*").alias("rows"), F.count_if(F.col("h") == F.col("g")).alias("repeated"), F.count_if(F.col("h") == F.col("o")).alias("of_another_seed"))


def soak_totals(spark, d):
    """Random rows and queries against intervals of their own, in all."""
    return base.certificate_soak(spark, d, 4000).agg(F.count("*").alias("seeds"), F.sum("trials").alias("trials"), F.sum("violations").alias("violations"))


def generated_lengths(spark, d):
    """Whether generated rows have, on average, the length that independent and correlated coordinates have."""
    from quillon.sources.generated import generated

    out = None
    for kind in ("gaussian", "correlated"):
        part = generated(spark, f"generated-{kind}-64x4000", 3).agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), (F.abs(F.avg(vectors.norm(F.col("v")) ** 2) / 64 - 1) < 0.05).alias("as_expected"))
        out = part if out is None else out.unionByName(part)
    return out


# --- the same in SQL ------------------------------------------------------------------------------------------------

_SPEC = SPEC_64
_N = "(SELECT count(*) FROM embeddings)"


def _eps_sql(name: str) -> str:
    refined = name == "refined"
    return f"({bounds.eta_transform(_SPEC)!r}::DOUBLE + {bounds.query_norm_upper(_SPEC)!r}::DOUBLE * err_{name} * {1 + bounds.SLACK!r}::DOUBLE + {bounds.eta_serving(_SPEC, refined)!r}::DOUBLE) * {1 + bounds.SLACK!r}::DOUBLE"


_SEGMENTS = f"segments AS (SELECT (row_id // {SEGMENT})::INTEGER AS segment, max(err_primary) AS err_primary, max(err_refined) AS err_refined FROM encoded GROUP BY 1)"
_TERMS = f"{_SEGMENTS}, terms AS (SELECT *, {_eps_sql('primary')} AS eps_primary, {_eps_sql('refined')} AS eps_refined FROM segments)"
_LOW = f"greatest(primary_raw / {ONE}.0::DOUBLE - eps_primary, refined_raw / {ONE}.0::DOUBLE - eps_refined, {-1 - bounds.SLACK!r}::DOUBLE)"
_HIGH = f"least(primary_raw / {ONE}.0::DOUBLE + eps_primary, refined_raw / {ONE}.0::DOUBLE + eps_refined, {1 + bounds.SLACK!r}::DOUBLE)"


def _hits_sql(where: str = " AND q.row_id <> r.row_id", key: str = "primary_raw", final: str = "corrected", scaled: bool = False, k: int = K, budget: int = BUDGET) -> str:
    """CTEs up to ``hits``: all that a search finds, with its interval by cosine and the pieces of its length."""
    return f"""{base._primary_sql(where, key, budget, scaled)}, {_TERMS},
refined AS (SELECT p.*, r.recon_length, r.mag_bits, r.ex, r.fr, q.n AS length, p.primary_raw + list_sum(list_transform(range(0, 8), lambda s: {base._RIGHT}))::BIGINT AS refined_raw
  FROM pool p JOIN weighed q ON q.row_id = p.query_id JOIN weighed r ON r.row_id = p.row_id),
fixed AS (SELECT f.*, f.refined_raw::DOUBLE / f.recon_length AS corrected, {_LOW} AS low, {_HIGH} AS high FROM refined f JOIN terms t ON t.segment = f.row_id // {SEGMENT}),
hits AS (SELECT *, {final} AS final, row_number() OVER (PARTITION BY query_id ORDER BY {final} DESC, row_id)::INTEGER AS rank FROM fixed QUALIFY rank <= {k})"""


def _recall_sql(found: str, truth: str) -> str:
    return f"SELECT t.query_id, count(f.row_id) AS hits, count(*) AS wanted, count(f.row_id) / count(*) AS recall FROM {truth} t LEFT JOIN {found} f USING (query_id, row_id) GROUP BY t.query_id"


_EXACT = f"unit AS (SELECT row_id, list_transform(v, lambda x: x::DOUBLE / n) AS d FROM rows), cosines AS (SELECT q.row_id AS query_id, r.row_id, {base._DOT.format(a='q.d', b='r.d')} AS cosine FROM unit q CROSS JOIN unit r WHERE q.row_id % 50 = 0 AND q.row_id <> r.row_id)"
_TRUTH = _EXACT + ", truth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS true_rank FROM cosines QUALIFY true_rank <= {0})"


def _length_sql() -> str:
    """The lengths that round to a stored one: fr * 2^(ex - 10), halfway to its neighbours."""
    value, above = "f * pow(2.0::DOUBLE, e - 10)", "(f + 1) * pow(2.0::DOUBLE, e - 10)"
    below = "CASE WHEN f = 1024 THEN 2047 * pow(2.0::DOUBLE, e - 11) ELSE (f - 1) * pow(2.0::DOUBLE, e - 10) END"
    return f"halved AS (SELECT *, CASE WHEN fr = 2048 THEN 1024 ELSE fr END AS f, CASE WHEN fr = 2048 THEN ex + 1 ELSE ex END AS e FROM hits), spans AS (SELECT *, ({value} + {below}) / 2 * {1 - bounds.SLACK!r}::DOUBLE AS a, ({value} + {above}) / 2 * {1 + bounds.SLACK!r}::DOUBLE AS b FROM halved)"


_SPLIT = 1 << 64


def _splitmix_sql() -> str:
    times = lambda x, c: f"(({x}::UHUGEINT * {c}::UHUGEINT) % {_SPLIT}::UHUGEINT)::UBIGINT"
    return f"""WITH s AS (SELECT n_nationkey::BIGINT AS seed, unnest(range(0, 16)) AS spot FROM nation),
a AS (SELECT seed, spot, ((seed::UHUGEINT + (spot + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % {_SPLIT}::UHUGEINT)::UBIGINT AS z FROM s),
b AS (SELECT seed, spot, {times('xor(z, z >> 30)', '13787848793156543929')} AS z FROM a),
c AS (SELECT seed, spot, {times('xor(z, z >> 27)', '10723151780598845931')} AS z FROM b),
e AS (SELECT seed, spot, xor(z, z >> 31) AS z FROM c)
SELECT seed, spot::INTEGER AS spot, ((z >> 11)::DOUBLE / 4503599627370496.0::DOUBLE - 1.0::DOUBLE)::FLOAT AS value FROM e"""


def oracle_sql() -> dict[str, str]:
    half, by = f"({_N} // 2)", "row_number() OVER (PARTITION BY query_id ORDER BY {0} DESC NULLS LAST, row_id)"
    generation = lambda g, where, rows, segment: (
        f"SELECT {g}::INTEGER AS generation, query_id, rank, row_id, ({segment})::INTEGER AS segment, corrected / {ONE}.0::DOUBLE AS score, refined_raw, ({rows})::INTEGER AS rows_scanned FROM ({_hits_sql(where)} SELECT * FROM hits)"
    )
    halved = "CASE WHEN isfinite(l) AND l > 0 THEN round_even(l / pow(2.0, greatest(floor(log2(l)), -14) - 10), 0) * pow(2.0, greatest(floor(log2(l)), -14) - 10) ELSE 1.0::DOUBLE END"
    trace = base._LISTS_SQL + f""", lens AS (SELECT query_id, row_id, max(recon_length) AS l FROM candidates WHERE isfinite(corrected) AND query_id IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL),
placed AS (SELECT c.query_id, c.row_id, {by.format('primary_raw')}::INTEGER AS by_primary, {by.format('refined_raw')}::INTEGER AS by_refined, {by.format('corrected')}::INTEGER AS by_corrected, {by.format(f'(refined_raw / {halved})')}::INTEGER AS by_stored,
  {by.format('truth_score')}::INTEGER AS by_exact FROM cand c JOIN lens USING (query_id, row_id)),
trace AS (SELECT t.query_id, t.row_id, t.rank AS true_rank, by_primary, by_refined, by_corrected, by_stored, by_exact FROM truth t LEFT JOIN placed p USING (query_id, row_id))"""
    entry = "abs(y[c]::DOUBLE * {0}::DOUBLE)"
    sums = "list_max(list_transform(range(0, 8), lambda s: list_max(list_transform(book[s + 1], lambda z: list_sum(list_transform(range(1, 9), lambda l: abs(y[s * 8 + l]::DOUBLE * z[l]::DOUBLE)))))))"
    largest = f"list_max(list_transform(range(1, 65), lambda c: greatest({entry.format('centers[c][1]')}, {entry.format('centers[c][16]')})))"
    return {
        "search_intervals": f"{_hits_sql()} SELECT query_id, rank, row_id, round(low, 9) AS lower, round(high, 9) AS upper FROM hits",
        "dot_intervals": f"{_hits_sql('', 'primary_raw::DOUBLE * units', 'corrected * units', True)}, {_length_sql()}, "
        "firsts AS (SELECT *, least(low * a, low * b, high * a, high * b) AS l, greatest(low * a, low * b, high * a, high * b) AS h FROM spans) "
        f"SELECT query_id, rank, row_id, round(least(l * length * {1 - bounds.SLACK!r}::DOUBLE, l * length * {1 + bounds.SLACK!r}::DOUBLE), 9) AS lower, round(greatest(h * length * {1 - bounds.SLACK!r}::DOUBLE, h * length * {1 + bounds.SLACK!r}::DOUBLE), 9) AS upper FROM firsts",
        "certificate_bounds": f"{base._codec_sql()}, {_TERMS} SELECT segment, round(eps_primary, 9) AS eps_primary, round(eps_refined, 9) AS eps_refined FROM terms",
        "epsilon_parts": f"{base._codec_sql()}, {_TERMS} " + " UNION ALL ".join(
            f"SELECT segment, '{k}' AS kind, round({bounds.eta_transform(_SPEC)!r}::DOUBLE / eps_{k}, 9) AS transform, round({bounds.query_norm_upper(_SPEC)!r}::DOUBLE * err_{k} / eps_{k}, 9) AS reconstruction, round({bounds.eta_serving(_SPEC, k == 'refined')!r}::DOUBLE / eps_{k}, 9) AS serving FROM terms" for k in ("primary", "refined")
        ),
        "enclosure_of_hits": f"{_hits_sql()}, {_EXACT} SELECT count(*) AS hits, count_if(cosine < low OR cosine > high)::BIGINT AS violations, round(max((high - low) / 2), 9) AS widest_half FROM hits JOIN cosines USING (query_id, row_id)",
        "search_recall": f"{_hits_sql()}, {_TRUTH.format(K)} {_recall_sql('hits', 'truth')}",
        "search_rerank": f"{_hits_sql(k=50)}, {_TRUTH.format(K)}, again AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS spot FROM hits JOIN cosines USING (query_id, row_id) QUALIFY spot <= {K}) {_recall_sql('again', 'truth')}",
        "search_budgets": f"""{_hits_sql(k=200, budget=200)}, {_TRUTH.format(100)}, b AS (SELECT unnest({list(SWEEP)})::INTEGER AS budget),
lists AS (SELECT budget, h.*, row_number() OVER (PARTITION BY budget, h.query_id ORDER BY corrected DESC, h.row_id) AS spot FROM hits h CROSS JOIN b WHERE place <= budget QUALIFY spot <= least(100, budget))
SELECT budget, count_if(spot <= 10 AND true_rank <= 10)::BIGINT AS hits_10, count_if(true_rank IS NOT NULL)::BIGINT AS hits_100, count_if(c.cosine < low OR c.cosine > high)::BIGINT AS violations, round(max((high - low) / 2), 9) AS widest_half
FROM lists l JOIN cosines c ON c.query_id = l.query_id AND c.row_id = l.row_id LEFT JOIN truth t ON t.query_id = l.query_id AND t.row_id = l.row_id GROUP BY budget""",
        "dot_qualification": "WITH "
        + f"truth AS ({base._exact_sql('dot', K, False, True)}), d AS ({_hits_sql('', 'primary_raw::DOUBLE * units', 'corrected * units', True)} SELECT * FROM hits), c AS ({_hits_sql('', scaled=True)} SELECT * FROM hits), x AS ({base._exact_sql('cosine', K, False, True)}) "
        + " UNION ALL ".join(f"SELECT '{name}' AS kind, count(f.row_id)::BIGINT AS hits, count(*)::BIGINT AS wanted FROM truth t LEFT JOIN {of} f ON f.query_id = t.query_id AND f.row_id = t.row_id" for name, of in (("compressed_dot", "d"), ("compressed_cosine", "c"), ("exact_cosine", "x"))),
        "search_given_ranking": f"{_hits_sql('', 'primary_raw::DOUBLE * sqrt(units::DOUBLE)', 'corrected * sqrt(units::DOUBLE)', True)} SELECT query_id, rank, row_id, round(final / {ONE}.0::DOUBLE, 6) AS score FROM hits",
        "stored_search": generation(1, f" AND r.row_id < {half}", half, f"row_id // {SEGMENT}") + " UNION ALL " + generation(2, "", _N, f"CASE WHEN row_id < {half} THEN row_id // {SEGMENT} ELSE ({half} + {SEGMENT - 1}) // {SEGMENT} + (row_id - {half}) // {SEGMENT} END"),
        "streaming_class_topk": base._exact_sql("cosine", K, False, False),
        "stored_lists": base.oracle_sql()["exact_cosine_topk"],
        "drift_merge": base.oracle_sql()["drift_reservoir"],
        "stable_fingerprint": f"SELECT (count(*) FILTER (WHERE vec_id % 50 = 0) * {K})::BIGINT AS hits, true AS same FROM embeddings",
        "candidate_scores": f"{_hits_sql(k=10, budget=10)} SELECT h.query_id, h.row_id, list_reduce(list_transform(range(1, 65), lambda c: (q.y[c] * r.p[c])::FLOAT), lambda a, x: (a + x)::FLOAT) AS float_score, refined_raw AS refined_decoded FROM hits h JOIN weighed q ON q.row_id = h.query_id JOIN weighed r ON r.row_id = h.row_id",
        "query_errors": f"{base._codec_sql()}, m AS (SELECT row_id AS query_id, {largest} AS p, {sums} AS r FROM coded CROSS JOIN tables WHERE row_id % 50 = 0) "
        f"SELECT query_id, round((64 * p * {bounds.gamma(66, 2.0**-53)!r}::DOUBLE + 64 * {0.5 / ONE!r}::DOUBLE) * {1 + bounds.SLACK!r}::DOUBLE * {ONE}.0::DOUBLE, 6) AS primary_error, round(((64 * p + 8 * r) * {bounds.gamma(138, 2.0**-53)!r}::DOUBLE + 72 * {0.5 / ONE!r}::DOUBLE) * {1 + bounds.SLACK!r}::DOUBLE * {ONE}.0::DOUBLE, 6) AS refined_error FROM m",
        "half_length_error": f"WITH {base._norm_sql(base._CORPORA)}, h AS (SELECT corpus, length AS n, pow(2.0::DOUBLE, greatest(floor(log2(length)), -14) - 10) AS step FROM lengths WHERE finite AND length <= {MAX_NORM} AND length >= {LEAST_NORM}) SELECT corpus, count(*) AS lengths, round(max(abs(round_even(n / step, 0) * step - n) / n), 9) AS largest_error FROM h GROUP BY 1",
        "drift_against_first": f"""WITH d AS (SELECT * FROM drift_rows WHERE index_id IS NOT NULL AND row_id IS NOT NULL AND err_refined IS NOT NULL AND NOT isnan(err_refined) AND generation IS NOT NULL),
m AS (SELECT *, generation = min(generation) OVER (PARTITION BY index_id) AS first FROM d), f AS (SELECT * FROM m WHERE first), l AS (SELECT * FROM m WHERE NOT first),
b AS ({base._rank_sql('err_refined', (95, 99), 'index_id', 'f')}), p AS ({base._rank_sql('err_refined', (95,), 'index_id', 'l')}),
c AS (SELECT l.index_id, count(*) AS sample, count_if(err_refined > err_refined_p99)::BIGINT AS exceeding FROM l JOIN b USING (index_id) GROUP BY 1)
SELECT c.*, p.err_refined_p95::DOUBLE AS p95, b.err_refined_p95::DOUBLE AS baseline_p95, b.err_refined_p99::DOUBLE AS baseline_p99, sample >= 1000 AND (p.err_refined_p95::DOUBLE > 1.25::DOUBLE * b.err_refined_p95::DOUBLE OR exceeding > 0.05::DOUBLE * sample) AS warned
FROM c JOIN p ON p.index_id = c.index_id JOIN b ON b.index_id = c.index_id""",
        "loss_trace": f"{trace} SELECT * FROM trace",
        "loss_trace_audit": f"{trace} SELECT count(*) AS wanted, count(by_primary) AS selected, " + ", ".join(f"count_if({c} <= {K})::BIGINT AS within_{c}" for c in evaluate.TRACE) + ", 0::BIGINT AS contradictions FROM trace",
        "recall_gate": f"WITH s AS ({base.oracle_sql()['budget_sweep']}) SELECT budget, (SELECT hits FROM s WHERE budget = {max(base.BUDGETS)}) * 100 <= hits * 100 + wanted AS passes FROM s",
        "id_coverage": "WITH a AS (SELECT DISTINCT query_id FROM candidates WHERE query_id IS NOT NULL), b AS (SELECT DISTINCT query_id FROM neighbors WHERE query_id IS NOT NULL) SELECT (SELECT count(*) FROM a ANTI JOIN b USING (query_id)) AS only_candidates, (SELECT count(*) FROM b ANTI JOIN a USING (query_id)) AS only_neighbors, (SELECT count(*) FROM a JOIN b USING (query_id)) AS both",
        "sql_functions": f"WITH {base._rows_sql(False)} SELECT a.row_id AS a, b.row_id AS b, a.n AS length, {base._DOT.format(a='a.v', b='b.v')} AS product, {base._DOT.format(a='a.v', b='b.v')} / (a.n * b.n) AS cosine FROM rows a JOIN rows b ON b.row_id = a.row_id + 1",
        "trained_quality": "SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS queries, true AS recalled, 0::BIGINT AS violations, true AS trained FROM embeddings",
        "append_counts": f"WITH c AS (SELECT count(*) FILTER (WHERE vec_id % 50 = 0) * {K} AS hits, count(*) FILTER (WHERE vec_id % 2 = 0) AS even, count(*) AS n FROM embeddings) SELECT 1::INTEGER AS generation, hits, even AS scanned, true AS within FROM c UNION ALL SELECT 2, hits, n, true FROM c",
        "generated_growth": "SELECT 300::BIGINT AS rows, 300::BIGINT AS repeated, 0::BIGINT AS of_another_seed",
        "soak_totals": "SELECT 8::BIGINT AS seeds, 4000::BIGINT AS trials, 0::BIGINT AS violations",
        "splitmix_numbers": _splitmix_sql(),
        "generated_lengths": "SELECT unnest(['gaussian', 'correlated']) AS kind, 4000::BIGINT AS rows, true AS as_expected",
        "certificate_soak": "SELECT unnest(range(0, 8))::INTEGER AS seed, 2500::BIGINT AS trials, 0::BIGINT AS violations",
    }


def queries() -> dict[str, base.Query]:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "oracle_sql")}
