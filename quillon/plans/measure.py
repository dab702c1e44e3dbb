"""Measuring the engine: timed search batches, fingerprints of results, latency limits, where and how it ran."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import struct
import resource
import subprocess
import time
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import InvalidOptions
from quillon.plans.index import Index
from quillon.spec import SEGMENT_ROWS

#: Queries of one probe request (fixed value).
PROBE_QUERIES = 8
#: Rows of an index: limits of the median and the 99th percentile in milliseconds; queries and warm-ups they need (fixed values).
LIMITS_MS = {1_000_000: (150.0, 300.0), 10_000_000: (1500.0, 3000.0)}
LATENCY_QUERIES, LATENCY_WARM_UP = 1000, 50


def fingerprint(hits: Iterable) -> str:
    """A hash of the exact bits of hits ``query_id, rank, row_id, score, lower, upper`` in order of query and rank."""
    h = hashlib.sha256()
    for r in sorted(hits, key=lambda r: (r["query_id"], r["rank"])):
        h.update(struct.pack("<qiqddd", r["query_id"], r["rank"], r["row_id"], r["score"], r["lower"], r["upper"]))
    return h.hexdigest()


def distributed_fingerprint(hits: DataFrame) -> DataFrame:
    """One row that changes with any bit of any hit, without bringing hits together."""
    h = F.xxhash64("query_id", "rank", "row_id", "score", "lower", "upper")
    return hits.agg(F.count("*").alias("hits"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 24)).alias("s"))


def probe(index: Index, requests: Iterable[str], k: int = 10) -> Iterator[str]:
    """JSON-lines protocol: each request ``{"metric": ..., "queries": [[...], ...]}`` of 1 to 8 vectors gives a line
    with its time and the fingerprint of its hits; a bad one gives a line with ``error``."""
    for line in requests:
        try:
            asked = json.loads(line)
            vectors = asked["queries"]
            if not 1 <= len(vectors) <= PROBE_QUERIES or asked["metric"] not in ("cosine", "dot"):
                raise InvalidOptions("1 to 8 queries by cosine or dot")
            frame = index.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, v array<float>")
            began = time.perf_counter()
            hits = index.search(frame, k, metric=asked["metric"]).collect()
            yield json.dumps({"seconds": time.perf_counter() - began, "queries": len(vectors), "hits": len(hits), "fingerprint": fingerprint(hits)})
        except Exception as e:
            yield json.dumps({"error": f"{type(e).__name__}: {e}"[:500]})


def percentiles(samples: list[float], percents: tuple[int, ...] = (50, 90, 99)) -> dict[str, float]:
    """Nearest ranks of a list of measurements, and its maximum."""
    ordered = sorted(samples)
    return {f"p{p}": ordered[max(0, -(-len(ordered) * p // 100) - 1)] for p in percents} | {"max": ordered[-1]}


def throughput(items: int, seconds: float) -> float | None:
    return items / seconds if seconds > 0 else None


def latency_gate(rows: int, queries: int, warm_up: int, clean: bool, mains: bool, p50_ms: float, p99_ms: float) -> dict:
    """Whether a measurement may be judged, and if so whether it keeps the limits."""
    eligible = clean and mains and queries >= LATENCY_QUERIES and warm_up >= LATENCY_WARM_UP and rows in LIMITS_MS
    most = LIMITS_MS.get(rows, (None, None))
    return {"eligible": eligible, "passed": (p50_ms <= most[0] and p99_ms <= most[1]) if eligible else None}


def measure_latency(index: Index, queries: list[list[float]], k: int = 10, metric: str = "cosine", warm_up: int = 1) -> dict:
    """Serial searches of one query each, and all of them in one batch, which is how the engine is meant to be asked."""
    frame = lambda vs: index.spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "query_id long, v array<float>")
    for v in queries[:warm_up]:
        index.search(frame([v]), k, metric=metric).collect()
    each = []
    for v in queries:
        began = time.perf_counter()
        index.search(frame([v]), k, metric=metric).collect()
        each.append(1000 * (time.perf_counter() - began))
    began = time.perf_counter()
    index.search(frame(queries), k, metric=metric).collect()
    took = time.perf_counter() - began
    return {"serial_ms": percentiles(each), "batch_seconds": took, "batch_queries_per_second": throughput(len(queries), took), "rows": len(index)}


def measure_callers(index: Index, queries: list[list[float]], callers: tuple[int, ...] = (1, 2, 4, 8), k: int = 10, metric: str = "cosine") -> list[dict]:
    """Searches of one query each from so many callers at once: how long each takes, and how many are answered a second.
    The callers share the session, whose scheduler shares out the cores."""
    out = []

    def ask(v: list[float]) -> float:
        began = time.perf_counter()
        index.search(index.spark.createDataFrame([(0, v)], "query_id long, v array<float>"), k, metric=metric).collect()
        return 1000 * (time.perf_counter() - began)

    for n in callers:
        began = time.perf_counter()
        with ThreadPoolExecutor(n) as pool:
            each = list(pool.map(ask, queries))
        out.append({"callers": n, "ms": percentiles(each), "queries_per_second": throughput(len(queries), time.perf_counter() - began)})
    return out


def compare_builds(a: Index, b: Index, queries: DataFrame, k: int = 10, metric: str = "cosine", rounds: int = 3) -> dict:
    """Two builds asked in turn: whether all their hits are the same to the bit, and the median of the paired ratios of
    their times (of the second to the first)."""
    ratios, prints = [], []
    for r in range(rounds):
        took = {}
        for name, index in (("a", a), ("b", b)) if r % 2 == 0 else (("b", b), ("a", a)):
            began = time.perf_counter()
            prints.append(tuple(distributed_fingerprint(index.search(queries, k, metric=metric)).first()))
            took[name] = time.perf_counter() - began
        ratios.append(took["b"] / took["a"])
    return {"same": len(set(prints)) == 1, "ratio": float(np.median(ratios)), "rounds": rounds}


def memory(spark: SparkSession) -> dict[str, int]:
    """Bytes that this machine's part of the engine holds: the driver's Python at its peak, and the JVM now."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return {"python_peak": 1024 * resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, "jvm_used": runtime.totalMemory() - runtime.freeMemory(), "jvm_most": runtime.maxMemory()}


def build_memory_bound(training_rows: int, dim: int) -> int:
    """Bytes of the training matrix, its rotation and its residuals, all that the driver holds of the data."""
    return 3 * 4 * training_rows * dim + 4 * SEGMENT_ROWS


def provenance() -> dict:
    """Machine, software, commit and time of a measurement."""
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, check=False, cwd=os.path.dirname(__file__)).stdout.strip()
    return {
        "system": platform.platform(), "machine": platform.machine(), "cpus": os.cpu_count(), "python": platform.python_version(), "numpy": np.__version__,
        "commit": git("rev-parse", "HEAD") or None, "dirty": bool(git("status", "--porcelain")), "time": datetime.now(UTC).isoformat(timespec="seconds"),
    }
