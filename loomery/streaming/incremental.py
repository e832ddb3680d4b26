"""Entity resolution over arriving batches: each micro-batch of cells is resolved against the entities before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomery.functions import text
from loomery.plans.resolution import Config, Prepared, resolve_source

PARTS = ["data", "text", "real", "types", "tags", "values", "documents"]


class ResolutionState:
    """Prepared entities and their clusters under a folder, a version per batch; an unfinished version is never read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def last(self) -> int | None:
        if not self._fs.exists(self._path(self.path)):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return max((int(n[2:]) for n in names if n.startswith("v-")), default=None)

    def load(self) -> tuple[Prepared | None, DataFrame | None]:
        version = self.last()
        if version is None:
            return None, None
        read = lambda part: self.spark.read.parquet(f"{self.path}/v-{version}/{part}")
        return Prepared(**{p: read(p) for p in PARTS}), read("clusters")

    def store(self, version: int, prepared: Prepared, clusters: DataFrame) -> None:
        staging = f"{self.path}/staging-{version}"
        for p in PARTS:
            getattr(prepared, p).write.mode("overwrite").parquet(f"{staging}/{p}")
        clusters.write.mode("overwrite").parquet(f"{staging}/clusters")
        if not self._fs.rename(self._path(staging), self._path(f"{self.path}/v-{version}")):
            raise OSError(f"version {version} of {self.path} could not be put in place")


def resolve_batch(state: ResolutionState, features: DataFrame, thresholds: DataFrame, config: Config = Config(), tokens=text.bare_tokens) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that was stored already, as after a restart, changes nothing."""

    def run(cells: DataFrame, batch_id: int) -> None:
        last = state.last()
        if last is not None and batch_id <= last:
            return
        before, clusters = state.load()
        state.store(batch_id, *resolve_source(cells, features, thresholds, before, clusters, config, tokens))

    return run


def start(cells: DataFrame, state: ResolutionState, checkpoint: str, features: DataFrame, thresholds: DataFrame, **options) -> StreamingQuery:
    """Run over a stream of cells (entity_id, tag_id, value) until its present end."""
    sink = cells.writeStream.foreachBatch(resolve_batch(state, features, thresholds, **options))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
