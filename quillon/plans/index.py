"""A persistent index: immutable segments in Parquet, manifests that form a chain, and one pointer.

    CURRENT                   generation and hash of its manifest
    LOCK                      held by the one builder that is publishing
    staging-<commit>          marks rows that a builder has written and not yet published
    manifest-<generation>     all segments of that generation, and the hash of the manifest before
    model-<identity>          the frozen model
    segments/<commit>         Parquet of one commit, partitioned by segment, sorted by row

Several builders may stage rows at once. Publishing is one at a time under LOCK, and only on top of the generation
that a builder began with: the first wins, another is refused with Conflict and begins again.

Readers take the files from the manifest, never from a listing, so what was not committed is invisible, and a
reader keeps its generation while others are added.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.common import cut, fresh
from quillon.errors import AlreadyExists, CommitOutcomeUnknown, Conflict, Corrupt, EmptyCommit, IdentityMismatch, IndexFault, InvalidVector, NotFound, RowLimit, SegmentLimit
from quillon.functions.bounds import check_terms
from quillon.functions.codec import Model
from quillon.functions.vectors import fault
from quillon.operators import drift, search
from quillon.plans.store import Files, check_segments, model_payload, pack_container, restore_model, unpack_container
from quillon.plans.training import train, training_matrix
from quillon.spec import MAX_ROWS, MAX_SEGMENTS, SEGMENT_ROWS, SPEC_768, CodecSpec


def dense_ids(rows: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """``rows`` with a ``row_id`` that counts from ``first`` in the given order, without sorting in one task.

    Rows are range-partitioned and sorted; each partition's ids start after the rows of those before, of which
    only the counts, one a partition, come to the driver. The order should be total, else equal rows may swap.
    """
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    part, place = fresh(rows, "_p", "_i")
    numbered = parts.withColumn(part, F.shiftright(at, 33).cast("int")).withColumn(place, at.bitwiseAND((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in numbered.groupBy(F.col(part).alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], first
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    start = F.array(*(F.lit(o).cast("long") for o in offsets)) if offsets else F.array(F.lit(0).cast("long"))
    return numbered.withColumn("row_id", start[F.col(part)] + F.col(place)).drop(part, place)


def refuse_invalid(rows: DataFrame, position: str, dim: int) -> None:
    """Raise InvalidVector for the first row, by position, that cannot be stored."""
    faults = rows.select(F.col(position).alias("p"), fault(F.col("v"), dim).alias("why")).where("why IS NOT NULL")
    worst = faults.agg(F.min(F.struct("p", "why")).alias("x")).first()["x"]
    if worst is not None:
        raise InvalidVector(worst["p"], worst["why"])


@dataclass(frozen=True)
class CommitReport:
    generation: int
    first_row: int
    rows_added: int
    drift: dict
    cleanup_complete: bool


#: Seconds after which rows that were staged and never published are garbage.
STAGED = 7 * 24 * 3600


def _load(files: Files) -> tuple[int, dict, str]:
    try:
        text = files.read("CURRENT")
    except NotFound:
        text = files.read("CURRENT.old")  # a crash between two renames, see Files.replace
    current = unpack_container("current", text)
    return current["generation"], *_manifest(files, current["generation"], current["manifest"])


def _manifest(files: Files, generation: int, digest: str | None) -> tuple[dict, str]:
    text = files.read(f"manifest-{generation}")
    own = hashlib.sha256(text.encode()).hexdigest()
    if digest is not None and own != digest:
        raise Corrupt(f"manifest {generation} is not the one pointed to")
    manifest = unpack_container("manifest", text)
    if manifest["generation"] != generation:
        raise IdentityMismatch(f"manifest {generation} says it is {manifest['generation']}")
    check_segments(manifest["segments"], manifest["total_rows"])
    return manifest, own


def _digest():
    """Order-free content hash of rows, by segment."""
    h = F.xxhash64("row_id", "code", "residual", "mag_bits", "err_primary", "err_refined", "outside")
    return [F.sum(F.pmod(h, F.lit(1 << 40))).alias("low"), F.sum(F.shiftrightunsigned(h, 40)).alias("high"), F.min("row_id").alias("first_row"), F.count("*").alias("row_count")]


def _rows_of(spark: SparkSession, files: Files, commits: list[str]) -> DataFrame:
    """One scan over the files of all commits."""
    return spark.read.schema(search.ENCODED).parquet(*(files.at(f"segments/{c}") for c in commits))


class IndexBuilder:
    """Creates an index or adds a generation to it. Rows become visible by ``commit`` alone."""

    def __init__(self, spark: SparkSession, files: Files, model: Model, base: dict | None, digest: str | None, segment_rows: int, index_id: str):
        self.spark, self.files, self.model, self.segment_rows, self.index_id = spark, files, model, segment_rows, index_id
        self._base, self._digest, self._pushed, self._staged, self._broken = base, digest, 0, [], False

    @classmethod
    def create(cls, spark: SparkSession, path: str, training: DataFrame | None, seed: int = 0, validation_rows: int | None = None, spec: CodecSpec = SPEC_768, order: str = "row_id", segment_rows: int = SEGMENT_ROWS, files: Files | None = None, model: Model | None = None) -> IndexBuilder:
        """An empty index with a model trained on ``order, v``; training rows are not searchable unless pushed. A
        ``model`` trained before may be given instead."""
        files = files or Files(spark, path)
        if files.exists("CURRENT") or files.exists("CURRENT.old"):
            raise AlreadyExists(path)
        if model is None:
            refuse_invalid(training, order, spec.dim)
            model = train(training_matrix(training, order, spec), spec, seed, validation_rows, spark)
        files.write(f"model-{model.identity}", pack_container("model", model_payload(model)))
        return cls(spark, files, model, None, None, segment_rows, uuid.uuid4().hex)

    @classmethod
    def append(cls, spark: SparkSession, path: str, verify: bool = True, files: Files | None = None) -> IndexBuilder:
        """A further generation with the same model; what is there is verified first."""
        files = files or Files(spark, path)
        index = Index.open(spark, path, verify=verify, files=files)
        return cls(spark, files, index.model, index.manifest, index.digest, index.manifest["segment_rows"], index.manifest["index_id"])

    @property
    def first_row(self) -> int:
        return self._base["total_rows"] if self._base else 0

    def push(self, rows: DataFrame, order: str) -> DataFrame:
        """Encode and stage rows ``order, v`` in the order of that unique column; gives ``order, row_id``.

        An invalid row is refused with its position in the order, before anything is staged or an id used.
        """
        if self._broken:
            raise IndexFault("an earlier push failed half-way; begin again")
        first = self.first_row + self._pushed
        numbered = cut(dense_ids(rows.select(order, "v"), [order], first))
        added = numbered.count()
        if first + added > MAX_ROWS:
            raise RowLimit(str(first + added))
        refuse_invalid(numbered.withColumn("_at", F.col("row_id") - first), "_at", self.model.spec.dim)
        if added:
            commit = uuid.uuid4().hex
            self.files.create(f"staging-{commit}", self.index_id)
            try:
                encoded = search.encode_rows(numbered, self.model, self.segment_rows)
                # ids are in order already: the sort only fixes the files' row groups for look-ups by row
                encoded.sortWithinPartitions("row_id").write.parquet(self.files.at(f"segments/{commit}"))
            except Exception:
                self._broken = True
                raise
            self._staged.append(commit)
            self._pushed += added
        return numbered.select(order, "row_id")

    def commit(self, epoch: int | None = None) -> CommitReport:
        """Publish what was pushed as one generation: manifest first, then the pointer in one step."""
        if not self._pushed:
            raise EmptyCommit("nothing was pushed")
        files, before = self.files, self._base
        staged = _rows_of(self.spark, files, self._staged)
        rank = F.col("row_id") - self.first_row
        own = staged.withColumn("segment", F.floor(rank / self.segment_rows).cast("int"))
        offset = len(before["segments"]) if before else 0
        terms = {r["segment"]: r.asDict() for r in search.certificates(own, self.model).collect()}
        segments = [
            {
                "segment": offset + r["segment"], "first_row": r["first_row"], "row_count": r["row_count"], "low": str(r["low"]), "high": str(r["high"]),
                **{c: terms[r["segment"]][c] for c in ("err_primary", "err_refined", "eps_primary", "eps_refined")},
            }
            for r in own.groupBy("segment").agg(*_digest()).orderBy("segment").collect()
        ]
        if offset + len(segments) > MAX_SEGMENTS:
            raise SegmentLimit(str(offset + len(segments)))
        manifest = self._next(
            total_rows=self.first_row + self._pushed, segments=(before["segments"] if before else []) + segments,
            commits=(before["commits"] if before else []) + self._staged, epoch=epoch if epoch is not None else (before or {}).get("epoch"),
        )
        added, first = self._pushed, self.first_row
        clean = self._publish(manifest)
        said = drift.report(staged, self.model.baseline)
        self._pushed, self._staged = 0, []
        return CommitReport(manifest["generation"], first, added, said, clean)

    def compact(self, files_wanted: int) -> CommitReport:
        """The rows of all commits in one commit of so many files, as a generation of its own. Former generations
        keep their files. Many small commits, as a stream makes them, are then one scan of few files."""
        if self._pushed or not self._base:
            raise EmptyCommit("publish what was pushed first")
        commit = uuid.uuid4().hex
        self.files.create(f"staging-{commit}", self.index_id)
        rows = _rows_of(self.spark, self.files, self._base["commits"])
        rows.repartitionByRange(files_wanted, "row_id").sortWithinPartitions("row_id").write.parquet(self.files.at(f"segments/{commit}"))
        self._staged = [commit]
        manifest = self._next(total_rows=self._base["total_rows"], segments=self._base["segments"], commits=[commit], epoch=self._base.get("epoch"))
        clean = self._publish(manifest)
        self._staged = []
        return CommitReport(manifest["generation"], self.first_row, 0, {}, clean)

    def discard(self) -> None:
        """Remove what was staged and not published."""
        for commit in self._staged:
            self.files.remove(f"segments/{commit}")
            self.files.remove(f"staging-{commit}")
        self._pushed, self._staged = 0, []

    def _next(self, **parts) -> dict:
        generation = self._base["generation"] + 1 if self._base else 1
        manifest = {"index_id": self.index_id, "generation": generation, "previous": self._digest, "model": self.model.identity, "segment_rows": self.segment_rows} | parts
        check_segments(manifest["segments"], manifest["total_rows"])
        return manifest

    def _publish(self, manifest: dict) -> bool:
        """Under the lock: refuse if another has published, then manifest, pointer and garbage."""
        owner = uuid.uuid4().hex
        self.files.lock(owner)
        try:
            there = _load(self.files)[2] if self.files.exists("CURRENT") or self.files.exists("CURRENT.old") else None
            if there != self._digest:
                raise Conflict(f"generation {manifest['generation']} is published already")
            return self._move(manifest)
        finally:
            self.files.unlock(owner)

    def _move(self, manifest: dict) -> bool:
        files, generation, text = self.files, manifest["generation"], pack_container("manifest", manifest)
        files.write(f"manifest-{generation}", text)
        files.write("CURRENT.tmp", pack_container("current", {"generation": generation, "manifest": hashlib.sha256(text.encode()).hexdigest()}))
        try:
            files.replace("CURRENT.tmp", "CURRENT")
        except Exception as e:
            try:
                published = _load(files)[0] == generation
            except Exception:
                raise CommitOutcomeUnknown(generation) from e
            if not published:
                raise
        self._base, self._digest = manifest, hashlib.sha256(text.encode()).hexdigest()
        try:
            for commit in self._staged:
                files.remove(f"staging-{commit}")
            _sweep(files)
        except Exception:
            return False
        return True


def collect_garbage(files: Files) -> list[str]:
    """Remove files of this format that no manifest of the chain names; anything else is left alone, and so is what a
    builder has staged within STAGED seconds. No builder publishes meanwhile."""
    owner = uuid.uuid4().hex
    files.lock(owner)
    try:
        return _sweep(files)
    finally:
        files.unlock(owner)


def _sweep(files: Files) -> list[str]:
    generation, manifest, _ = _load(files)
    kept = {f"manifest-{g}" for g in range(1, generation + 1)} | {f"model-{manifest['model']}", "CURRENT"}
    names = files.names()
    gone = [n for n in names if n not in kept and (n.startswith(("manifest-", "model-")) or n in ("CURRENT.tmp", "CURRENT.old"))]
    marks = {n.removeprefix("staging-"): files.age(n) for n in names if n.startswith("staging-")}
    commits, at = set(manifest["commits"]), manifest
    while at["generation"] > 1:
        at = _manifest(files, at["generation"] - 1, at["previous"])[0]
        commits |= set(at["commits"])
    held = commits | {c for c, age in marks.items() if age < STAGED}
    gone += [f"segments/{n}" for n in files.names("segments") if n not in held and len(n) == 32 and set(n) <= set("0123456789abcdef")]
    gone += [f"staging-{c}" for c in marks if c not in held]
    for name in gone:
        files.remove(name)
    return gone


class Index:
    """One immutable generation of an index."""

    def __init__(self, spark: SparkSession, files: Files, manifest: dict, digest: str, model: Model):
        self.spark, self.files, self.manifest, self.digest, self.model = spark, files, manifest, digest, model

    @classmethod
    def open(cls, spark: SparkSession, path: str, generation: int | None = None, verify: bool = True, files: Files | None = None) -> Index:
        """The present generation or a former one. ``verify`` reads all rows and compares them with the manifest."""
        files = files or Files(spark, path)
        latest, manifest, digest = _load(files)
        while generation is not None and manifest["generation"] > generation:
            manifest, digest = _manifest(files, manifest["generation"] - 1, manifest["previous"])
        if generation is not None and manifest["generation"] != generation:
            raise NotFound(f"generation {generation} of {latest}")
        index = cls(spark, files, manifest, digest, restore_model(unpack_container("model", files.read(f"model-{manifest['model']}"))))
        for s in manifest["segments"]:
            for kind in ("primary", "refined"):
                check_terms(index.model.spec, {"reconstruction_error": float(np.nextafter(s[f"err_{kind}"], np.inf)), "epsilon": s[f"eps_{kind}"]}, kind == "refined")
        if verify:
            index.verify()
        return index

    def __len__(self) -> int:
        return self.manifest["total_rows"]

    @property
    def generation(self) -> int:
        return self.manifest["generation"]

    @property
    def segment_count(self) -> int:
        return len(self.manifest["segments"])

    @cached_property
    def certificates(self) -> DataFrame:
        """The bounds of each segment; at most MAX_SEGMENTS rows."""
        names = ("segment", "first_row", "row_count", "err_primary", "err_refined", "eps_primary", "eps_refined")
        return self.spark.createDataFrame([tuple(s[n] for n in names) for s in self.manifest["segments"]], "segment int, first_row long, row_count long, err_primary double, err_refined double, eps_primary double, eps_refined double")

    @cached_property
    def rows(self) -> DataFrame:
        """The encoded rows with the segment the manifest gives them."""
        starts = [s["first_row"] for s in self.manifest["segments"]]
        own = F.array(*(F.lit(s).cast("long") for s in starts))
        frame = _rows_of(self.spark, self.files, self.manifest["commits"])
        if len(starts) <= 64:
            return frame.withColumn("segment", (F.size(F.filter(own, lambda s: s <= F.col("row_id"))) - 1).cast("int"))
        spans = self.certificates.select(F.col("segment").alias("_s"), "first_row", "row_count")
        cells = spans.select("_s", "first_row", "row_count", F.explode(F.sequence(F.floor(F.col("first_row") / SEGMENT_ROWS), F.floor((F.col("first_row") + F.col("row_count") - 1) / SEGMENT_ROWS))).alias("_c"))
        inside = (F.col("row_id") >= F.col("first_row")) & (F.col("row_id") < F.col("first_row") + F.col("row_count"))
        return frame.withColumn("_c", F.floor(F.col("row_id") / SEGMENT_ROWS)).join(cells, "_c").where(inside).withColumn("segment", F.col("_s")).select(*frame.columns)

    def verify(self) -> None:
        """Compare count, first row and content hash of every segment with the manifest."""
        there = {r["segment"]: r for r in self.rows.groupBy("segment").agg(*_digest()).collect()}
        for s in self.manifest["segments"]:
            r = there.pop(s["segment"], None)
            if r is None or (r["first_row"], r["row_count"], str(r["low"]), str(r["high"])) != (s["first_row"], s["row_count"], s["low"], s["high"]):
                raise Corrupt(f"segment {s['segment']} is not what was written")
        if there:
            raise Corrupt(f"segments {sorted(there)} are not in the manifest")

    def search(self, queries: DataFrame, k: int = 10, budget: int | None = None, metric: str = "cosine", exclude: str | None = None) -> DataFrame:
        """Hits of queries ``query_id, v`` (see operators.search.search); queries are checked first."""
        search.check_options(k, budget, len(self), exclude is not None)
        refuse_invalid(queries, "query_id", self.model.spec.dim)
        return search.search(self.rows, queries, self.model, k, budget, metric, exclude, self.certificates.drop("first_row", "row_count"), len(self)).withColumn("generation", F.lit(self.generation))
