"""Content-addressed stores, caches, materialization and lineage on shared storage. All files go through Spark, so any path that it can open will do."""

from __future__ import annotations

import base64
import hashlib
import json
import pickle
import warnings
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kairospark.files import exists
from kairospark.plans.specs import Artifact, FeatureFrame, FeatureRealization, FitState


class Store(Protocol):
    def exists_frame(self, rid: str) -> bool: ...

    def get_frame(self, rid: str) -> FeatureFrame | None: ...

    def put_frame(self, rid: str, frame: FeatureFrame) -> Artifact: ...

    def put_state(self, state: FitState, payload: bytes) -> Artifact: ...

    def get_state(self, state_id: str) -> bytes: ...


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *(p.replace(":", "_") for p in parts)))

    def there(self, path: str, mark: str = "/_SUCCESS") -> bool:
        return exists(self.spark, path + mark)

    def written(self, df: DataFrame, path: str) -> int:
        """Writes df and gives the number of its rows, counted on the way."""
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
        return seen.get["n"]

    def put_text(self, path: str, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").parquet(path)

    def text(self, path: str) -> str:
        return self.spark.read.parquet(path).first()[0]

    def _indexed(self, name: str, kind: str, path: str, rows: int | None, cols: int | None) -> None:
        row = self.spark.createDataFrame([(name, kind, path, rows, cols)], "name string, kind string, path string, n_rows long, n_cols long").withColumn("created", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/index")

    def index(self) -> DataFrame:
        """The latest row of each name."""
        return self.spark.read.parquet(f"{self.root}/index").groupBy("name", "kind").agg(F.max_by(F.struct("path", "n_rows", "n_cols", "created"), "created").alias("r")).select("name", "kind", "r.*")


class ParquetStore(_Files):
    """Frames by id: features, catalog and meta each in a directory; a frame is there once both features and meta are complete. An index row for each frame and state has its path, time and size."""

    def exists_frame(self, rid: str) -> bool:
        return self.there(self.path("frames", rid)) and self.there(self.path("meta", rid))

    def get_frame(self, rid: str) -> FeatureFrame | None:
        if not self.exists_frame(rid):
            return None
        said = json.loads(self.text(self.path("meta", rid)))
        return FeatureFrame(self.spark.read.parquet(self.path("frames", rid)), said["catalog"], said["meta"], {k: Artifact(**v) for k, v in said["artifacts"].items()}, said["labels"])

    def put_frame(self, rid: str, frame: FeatureFrame) -> Artifact:
        path = self.path("frames", rid)
        rows = self.written(frame.x.sortWithinPartitions("entity_id", "ts_utc"), path)
        if frame.catalog:
            frame.catalog_frame().coalesce(1).write.mode("overwrite").parquet(self.path("catalogs", rid))
        said = {"meta": frame.meta, "catalog": frame.catalog, "artifacts": {k: asdict(v) for k, v in frame.artifacts.items()}, "labels": frame.labels}
        self.put_text(self.path("meta", rid), json.dumps(said, default=str))
        self._indexed(rid, "frame", path, rows, len(frame.x.columns))
        return Artifact(rid, "frame", path)

    def put_state(self, state: FitState, payload: bytes) -> Artifact:
        path = self.path("states", state.state_id)
        self.put_text(path, json.dumps({"meta": state.meta, "payload": base64.b64encode(payload).decode()}, default=str))
        self._indexed(state.state_id, "state", path, None, None)
        return Artifact(state.state_id, "state", path, state.meta)

    def get_state(self, state_id: str) -> bytes:
        path = self.path("states", state_id)
        if not self.there(path):
            raise KeyError(state_id)
        return base64.b64decode(json.loads(self.text(path))["payload"])


class RawCache(_Files):
    """Fetched tables by key, with an index row for each; a missing or unreadable one is None."""

    def _at(self, key: str) -> str:
        return self.path(hashlib.sha1(key.encode()).hexdigest())

    def get(self, key: str) -> DataFrame | None:
        if not self.there(self._at(key)):
            return None
        try:
            return self.spark.read.parquet(self._at(key))
        except (PySparkException, Py4JJavaError):
            return None

    def set(self, key: str, df: DataFrame) -> None:
        self._indexed(key, "raw", self._at(key), self.written(df, self._at(key)), len(df.columns))


class FetchCache(_Files):
    """One table of bars partitioned by cache key; setting a key replaces its rows alone. Files are sorted by date and entity; a DataFrame has no order, so sort what is shown."""

    columns = ("date", "entity_id", "open", "high", "low", "close", "volume")

    def get(self, key: str) -> DataFrame | None:
        if not self.there(self.root, ""):
            return None
        df = self.spark.read.parquet(self.root).where(F.col("cache_key") == key).drop("cache_key")
        return None if df.isEmpty() else df

    def set(self, key: str, df: DataFrame) -> None:
        own = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in self.columns), F.lit(key).alias("cache_key"))
        own.sortWithinPartitions("date", "entity_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(self.root)


@dataclass
class LineageGraph:
    nodes: dict[str, dict[str, Any]] = field(default_factory=dict)
    edges: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, node: str, **meta: Any) -> None:
        self.nodes[node] = meta

    def link(self, parent: str, child: str, kind: str = "derives") -> None:
        self.edges.append((parent, child, kind))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Nodes (node, meta_json) and edges (parent, child, kind)."""
        return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, default=str)) for k, v in self.nodes.items()], "node string, meta_json string"), spark.createDataFrame(self.edges, "parent string, child string, kind string")


@dataclass(frozen=True)
class MaterializationPolicy:
    """persist_mode: never, selected (templates named in `selected`) or always. cache_ephemeral: what isn't stored is kept in Spark's cache, once it is first read."""

    persist_mode: str = "selected"
    cache_ephemeral: bool = True
    selected: tuple[str, ...] = ()

    def stores(self, template: str) -> bool:
        return self.persist_mode == "always" or self.persist_mode == "selected" and template in self.selected


def materialize(ctx: Any, template: Any, realization: FeatureRealization, policy: MaterializationPolicy = MaterializationPolicy(), lineage: LineageGraph | None = None, fit_slice: Any = None) -> FeatureFrame:
    """The frame of a realization: from the store if it is there, else fitted, transformed, checked and, by policy, stored and read back, which cuts its lineage. A fitted state is stored as its pickle, so read states only from stores that you trust; the lineage has a node for it, linked from the frame."""
    rid = realization.id()
    if lineage is not None:
        lineage.add(rid, kind="feature", template=realization.template, version=realization.version, params=realization.params, slice=vars(realization.slice))
    if ctx.store is not None and (hit := ctx.store.get_frame(rid)) is not None:
        return hit
    try:
        state = template.fit(ctx, realization.params, fit_slice or realization.slice)
    except Exception as e:  # a template without a usable fit goes on without state
        warnings.warn(f"{realization.template}: fit failed: {e}", RuntimeWarning, stacklevel=2)
        state = None
    if state is not None and ctx.store is not None:
        kept = ctx.store.put_state(FitState(f"state:{rid}", {"realization_id": rid}), pickle.dumps(state, protocol=pickle.HIGHEST_PROTOCOL))
        if lineage is not None:
            lineage.add(kept.artifact_id, kind="artifact", type=kept.kind, uri=kept.uri)
            lineage.link(rid, kept.artifact_id)
    frame = template.transform(ctx, realization.params, realization.slice, state)
    frame.meta |= {"realization_id": rid, "template": realization.template, "version": realization.version, "params": realization.params, "slice": vars(realization.slice), "upstream_snapshot": realization.upstream_snapshot}
    frame.validate()
    if ctx.store is not None and policy.stores(realization.template):
        ctx.store.put_frame(rid, frame)
        return ctx.store.get_frame(rid)
    if policy.cache_ephemeral:
        frame.x = frame.x.persist()
    return frame
