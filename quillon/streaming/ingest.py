"""Micro-batches: appending to an index and keeping exact lists, safe to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.errors import NotFound
from quillon.operators.exact import exact_topk, merge_topk
from quillon.operators.select import key_of_hash
from quillon.operators.drift import merge_reservoirs
from quillon.plans.index import Index, IndexBuilder
from quillon.plans.store import Files


def append_batch(spark: SparkSession, path: str, order: str):
    """A function for ``foreachBatch``: each batch becomes one generation. The epoch stands in the manifest, so
    a batch that comes again after a failure is passed over. Empty batches add nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        done = Index.open(spark, path, verify=False).manifest["epoch"]
        if (done is not None and epoch <= done) or batch.isEmpty():
            return
        builder = IndexBuilder.append(spark, path, verify=False)
        builder.push(batch, order)
        builder.commit(epoch=epoch)

    return run


def append_stream(stream: DataFrame, path: str, order: str, checkpoint: str) -> StreamingQuery:
    """Feed a stream of ``order, v`` into an existing index."""
    return stream.writeStream.foreachBatch(append_batch(stream.sparkSession, path, order)).option("checkpointLocation", checkpoint).start()


class StreamingTopK:
    """The exact best k of fixed queries over all batches so far, kept as one Parquet folder per epoch.

    State is bounded by queries x k rows; each epoch reads the state before and writes its own, so replaying an
    epoch gives the same.
    """

    def __init__(self, spark: SparkSession, queries: DataFrame, k: int, path: str, metric: str = "cosine", dim: int = 64):
        self.spark, self.queries, self.k, self.path, self.metric, self.dim = spark, queries, k, path.rstrip("/"), metric, dim

    def _state(self, epoch: int) -> str:
        return f"{self.path}/epoch={epoch}"

    def _epochs(self) -> list[int]:
        """The epochs whose state is whole, from one listing."""
        files = Files(self.spark, self.path)
        return sorted(e for n in files.names() if n.startswith("epoch=") and (e := int(n.removeprefix("epoch="))) >= 0 and files.exists(f"{n}/_SUCCESS"))

    def at(self, epoch: int) -> DataFrame:
        """The best so far after an epoch; an epoch that was empty has the state before it."""
        there = [e for e in self._epochs() if e <= epoch]
        if not there:
            raise NotFound(self.path)
        return self.spark.read.parquet(self._state(there[-1])).select("query_id", "row_id", "score", "rank")

    def forget(self, before: int) -> None:
        """Remove the states of epochs before the last one that is at most ``before``; a stream replays its last epoch
        only, so its checkpoint's epoch less one is what to give."""
        files = Files(self.spark, self.path)
        for e in [e for e in self._epochs() if e <= before][:-1]:
            files.remove(f"epoch={e}")

    def update(self, batch: DataFrame, epoch: int) -> None:
        new = exact_topk(batch, self.queries, self.k, self.metric, self.dim)
        try:
            new = merge_topk(self.at(epoch - 1), new, self.k)
        except NotFound:
            pass
        new.write.mode("overwrite").parquet(self._state(epoch))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()


def merge_drift(before: DataFrame, batch: DataFrame, ident: str = "row_id", size: int = 65_536) -> DataFrame:
    """A drift reservoir after one more batch."""
    return merge_reservoirs(before, batch, key_of_hash(ident), size)
