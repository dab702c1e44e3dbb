"""Queries p1_ to p8_ and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.common import read

#: In the mixes a document's chance grows with the square root of its tokens: long texts are worth more, without
#: crowding out short ones.
SIZE_POWER = 0.5

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.sampling import threshold_sample

    return threshold_sample(read(spark, d, "drift_rows"), read(spark, d, "drift_indexes")).select("index_id", "row_id")


def p1_frozen_batches(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.sampling import frozen_batches, shown_rows

    shown = shown_rows(read(spark, d, "drift_rows"), read(spark, d, "drift_indexes"))
    return frozen_batches(shown, "index_id", "generation", "key", "rate", ["row_id"]).select("index_id", "generation", "row_id", "priority")


def p1_sample_growth(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.sampling import sample_growth

    return sample_growth(read(spark, d, "drift_rows"), read(spark, d, "drift_indexes"))


def p1_commits(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.sampling import growth_and_commits

    return growth_and_commits(read(spark, d, "drift_rows"), read(spark, d, "drift_indexes"), read(spark, d, "drift_commits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.neighbours import nearest

    return nearest(read(spark, d, "corpus_vectors")).select("query_vec_id", "near_vec_id")


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.neighbours import nearest

    return nearest(read(spark, d, "corpus_vectors"))


def p2_index(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.neighbours import index_report

    return index_report(read(spark, d, "corpus_vectors"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.neighbours import recall_report

    return recall_report(read(spark, d, "corpus_vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillon.llm.overlap import overlaps

    pair = (F.least("eval_rec", "train_rec").alias("rec_lo"), F.greatest("eval_rec", "train_rec").alias("rec_hi"))
    return overlaps(read(spark, d, "split_records")).where("eval_rec <> train_rec").select(*pair).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.overlap import report

    return report(read(spark, d, "split_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.topn import best_lists

    return best_lists(read(spark, d, "candidates"), read(spark, d, "neighbors")).select("list_name", "query_id", "row_id")


def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.topn import best_lists

    return best_lists(read(spark, d, "candidates"), read(spark, d, "neighbors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.percentiles import deviations

    return deviations(read(spark, d, "bound_widths"), read(spark, d, "budget_outcomes"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.percentiles import daily_sketches, measured, merge_sketches, summaries

    return summaries(merge_sketches(daily_sketches(measured(read(spark, d, "bound_widths"))))).drop("percent")


def p5_enclosure(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.percentiles import enclosure

    return enclosure(read(spark, d, "bound_widths"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.packing import named_capacities, pack
    from quillon.llm.tokens import sized

    sizes = list(named_capacities(read(spark, d, "pack_capacities"), upto="trainer"))
    return pack(sized(read(spark, d, "documents")), sizes).where("piece > 0").select("doc_id").distinct()


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.packing import named_capacities, pack
    from quillon.llm.tokens import sized

    return pack(sized(read(spark, d, "documents")), list(named_capacities(read(spark, d, "pack_capacities"))))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.packing import fill_report, named_capacities

    return fill_report(p6_pack(spark, d), named_capacities(read(spark, d, "pack_capacities")))


def p6_placement(spark: SparkSession, d: str) -> DataFrame:
    from quillon.common import cut
    from quillon.llm.packing import check_placement, named_capacities, pack
    from quillon.llm.tokens import sized

    sizes, documents = list(named_capacities(read(spark, d, "pack_capacities"))), sized(read(spark, d, "documents"))
    return check_placement(cut(pack(documents, sizes)), documents, sizes)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).where("short AND reached_tokens < target_tokens").select("plan_name", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.mixing import shares
    from quillon.llm.tokens import sized

    return shares(sized(read(spark, d, "documents")), read(spark, d, "mix_targets"), power=SIZE_POWER)


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source keeps to its repeats, and whether it reaches its target within a document or is short of it."""
    from pyspark.sql import functions as F

    from quillon.llm.mixing import shares
    from quillon.llm.tokens import sized

    documents = sized(read(spark, d, "documents"))
    longest = documents.agg(F.max("tokens").alias("longest"))
    s = shares(documents, read(spark, d, "mix_targets"), power=SIZE_POWER).join(longest)  # one row
    near = F.abs(F.col("reached_tokens") - F.least(F.col("target_tokens"), F.col("max_repeats") * F.col("available"))) <= F.col("longest")
    return s.select("plan_name", "source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), near.alias("as_near_as_can_be"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.mixing import allocate, mix
    from quillon.llm.tokens import sized

    documents = sized(read(spark, d, "documents"))
    return mix(documents, allocate(documents, read(spark, d, "mix_targets")), power=SIZE_POWER)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.truncation import truncated

    return truncated(read(spark, d, "documents")).where("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    from quillon.llm.truncation import rates, truncated

    return rates(truncated(read(spark, d, "documents")))


_SHOWN = """
known AS (SELECT lower(replace(index_id, '-', '')) AS id, index_id, sample_permille AS permille FROM drift_indexes),
spelt AS (SELECT regexp_replace(lower(trim(index_id)), '^(urn:uuid:|0x)|[-{}[:space:]]', '', 'g') AS id, row_id, generation FROM drift_rows WHERE row_id IS NOT NULL),
first AS (SELECT id, row_id, coalesce(min(generation), -1)::INTEGER AS generation FROM spelt WHERE regexp_full_match(id, '[0-9a-f]{32}') GROUP BY id, row_id),
hexed AS (SELECT *, printf('%016x', row_id) AS h FROM first),
shown AS (SELECT k.index_id, row_id, generation, permille,
  sha256(unhex(h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] || s.id)) AS priority
  FROM hexed s JOIN known k ON k.id = s.id)"""
_BATCHES = _SHOWN + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY index_id, generation ORDER BY left(priority, 13), row_id) AS rn,
  count(*) OVER (PARTITION BY index_id, generation) AS n FROM shown),
drawn AS (SELECT * FROM ranked WHERE rn <= ceil(round(permille / 1000.0 * n, 9)))"""

_BEST = """
SELECT '{0}' AS list_name, query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INTEGER AS rank
FROM (SELECT query_id, row_id, max({1} + 0.0) AS score FROM {0} WHERE isfinite({1}) AND query_id IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL)
QUALIFY rank <= 10"""
_LISTS = f"({_BEST.format('candidates', 'corrected')} UNION ALL {_BEST.format('neighbors', 'score')})"

_P5 = """
WITH once AS (SELECT sample_id, min_by(struct_pack(run_id, candidate_budget, p := primary_bound_width, r := refined_bound_width), coalesce(arrived_at, TIMESTAMPTZ '1900-01-01')) AS s
  FROM bound_widths WHERE sample_id IS NOT NULL GROUP BY sample_id),
long AS (SELECT s.run_id, s.candidate_budget, 'primary' AS width_kind, s.p AS w FROM once UNION ALL SELECT s.run_id, s.candidate_budget, 'refined', s.r FROM once),
ordered AS (SELECT *, row_number() OVER (PARTITION BY run_id, candidate_budget, width_kind ORDER BY w) AS pos,
  count(*) OVER (PARTITION BY run_id, candidate_budget, width_kind) AS n FROM long WHERE w >= 0 AND isfinite(w)),
exact AS (SELECT run_id, candidate_budget, width_kind, 'p' || p AS statistic, max(w) FILTER (WHERE pos = (p * n + 99) // 100) AS v
  FROM ordered CROSS JOIN (VALUES (50), (90), (99)) AS t(p) GROUP BY ALL),
said AS (""" + " UNION ALL ".join(f"SELECT run_id, candidate_budget, '{k}' AS width_kind, '{p}' AS statistic, {k}_bound_width_percentiles.{p} AS v FROM budget_outcomes" for k in ("primary", "refined") for p in ("p50", "p90", "p99")) + """)
SELECT DISTINCT run_id, candidate_budget, width_kind, statistic FROM said s JOIN exact e USING (run_id, candidate_budget, width_kind, statistic)
WHERE abs(s.v - e.v) > 0.05 * abs(e.v)"""


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    once = """once AS (SELECT vec_id, corpus, lower(trim(split_name)) AS split FROM corpus_vectors WHERE vec_id IS NOT NULL AND corpus IS NOT NULL AND len(embedding) = 64
  AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY added_at NULLS FIRST, corpus, lower(trim(split_name)) NULLS FIRST) = 1)"""
    return {
        "p2_recall": f"WITH {once} SELECT corpus, count(*) FILTER (WHERE split = 'queries') AS queries, true AS reached FROM once GROUP BY corpus HAVING queries > 0 AND count(*) FILTER (WHERE split = 'indexed') > 0",
        "p5_enclosure": _P5[: _P5.index("said AS (")].rstrip().rstrip(",").replace("max(w) FILTER (WHERE pos = (p * n + 99) // 100) AS v", "max(n) AS n, count(*) AS c") + " SELECT run_id, candidate_budget, width_kind, statistic, n, true AS inside FROM exact",
        # the texts keep clear of the border: four bytes a token, give or take a factor of two, tell the same texts
        "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND strlen(text) > 4 * (SELECT max(capacity_tokens) FROM pack_capacities WHERE container_name = 'trainer')",
        # the choice of tokenizer does not matter: sizes in bytes give the same sources
        "p7_found": """WITH held AS (SELECT source, sum(strlen(text)) AS size FROM documents GROUP BY source)
SELECT DISTINCT plan_name, m.source FROM mix_targets m LEFT JOIN held h ON h.source = m.source WHERE plan_name IS NOT NULL AND m.source IS NOT NULL AND max_repeats * coalesce(size, 0) < target_share * (SELECT sum(size) FROM held)""",
        "p6_placement": "SELECT count(*) AS documents, 0::BIGINT AS lost, 0::BIGINT AS needless_splits, 0::BIGINT AS overfull, 0::BIGINT AS oversized FROM documents WHERE length(text) > 0",
        "p7_limits": "SELECT DISTINCT plan_name, source, true AS within_repeats, true AS as_near_as_can_be FROM mix_targets WHERE plan_name IS NOT NULL AND source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL",
        "p1_found": f"WITH {_SHOWN} SELECT index_id, row_id FROM shown WHERE ('0x' || left(priority, 13))::BIGINT::HUGEINT * 1000 < permille::HUGEINT * 4503599627370496",
        "p1_frozen_batches": f"WITH {_BATCHES} SELECT index_id, generation, row_id, priority FROM drawn",
        "p1_sample_growth": f"""WITH {_BATCHES},
by_batch AS (SELECT index_id, generation, count(*) AS batch_seen, count(*) FILTER (WHERE rn <= ceil(round(permille / 1000.0 * n, 9))) AS batch_sampled FROM ranked GROUP BY ALL)
SELECT *, (sum(batch_seen) OVER w)::BIGINT AS seen_count, (sum(batch_sampled) OVER w)::BIGINT AS sample_size FROM by_batch
WINDOW w AS (PARTITION BY index_id ORDER BY generation)""",
        "p1_commits": f"""WITH {_BATCHES},
counted AS (SELECT index_id, generation, count(*) AS n, count(*) FILTER (WHERE ('0x' || left(priority, 13))::BIGINT::HUGEINT * 1000 < permille::HUGEINT * 4503599627370496) AS u,
  count(*) FILTER (WHERE rn <= ceil(round(permille / 1000.0 * n, 9))) AS q FROM ranked GROUP BY ALL),
running AS (SELECT index_id, generation, (sum(n) OVER w)::BIGINT AS seen_count, (sum(u) OVER w)::BIGINT AS threshold_size, (sum(q) OVER w)::BIGINT AS batch_size FROM counted
  WINDOW w AS (PARTITION BY index_id ORDER BY generation)),
published AS (SELECT k.index_id, c.generation, first(c.seen_count ORDER BY committed_at DESC NULLS LAST, c.seen_count DESC NULLS LAST, c.sample_size DESC NULLS LAST) AS published_seen,
  first(c.sample_size ORDER BY committed_at DESC NULLS LAST, c.seen_count DESC NULLS LAST, c.sample_size DESC NULLS LAST) AS published_size
  FROM drift_commits c JOIN known k ON k.id = regexp_replace(lower(trim(c.index_id)), '^(urn:uuid:|0x)|[-{{}}[:space:]]', '', 'g') WHERE c.generation IS NOT NULL GROUP BY ALL)
SELECT index_id, generation, published_seen::DOUBLE AS published_seen, seen_count, published_size::DOUBLE AS published_size, threshold_size, batch_size, coalesce(published_seen = seen_count, false) AS seen_agrees
FROM published LEFT JOIN running USING (index_id, generation)""",
        "p4_found": f"SELECT list_name, query_id, row_id FROM {_LISTS}",
        "p4_ranked": f"SELECT * FROM {_LISTS}",
        "p5_found": _P5,
    }
