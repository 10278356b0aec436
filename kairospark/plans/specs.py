"""What to build: slices, features, targets, datasets. What comes out: frames and artifacts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.operators.panel import KEYS
from kairospark.plans.ids import digest, tags_text


@dataclass(frozen=True)
class ParamSpec:
    type: str  # int, float, categorical or bool
    default: Any = None
    low: Any = None
    high: Any = None
    choices: Sequence[Any] | None = None
    log: bool = False

    def check(self, value: Any) -> Any:
        """The value, or ValueError if it is out of bounds."""
        if self.choices is not None and value not in self.choices or self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{value!r} is not allowed")
        return value


@dataclass(frozen=True)
class SliceSpec:
    start: Any
    end: Any
    entities: Sequence[str] | DataFrame | None = None
    asof: Any = None
    grid: str | None = None


@dataclass(frozen=True)
class SliceOverride:
    lookback: timedelta | None = None
    grid: str | None = None
    asof: Any = None

    def applied(self, base: SliceSpec) -> SliceSpec:
        return SliceSpec(base.start - self.lookback if self.lookback else base.start, base.end, base.entities, base.asof if self.asof is None else self.asof, self.grid or base.grid)


CATALOG = "feature_id string, group_path string, family string, transform string, source_table string, source_col string, tags map<string,string>, tags_json string, dow int, one_hot boolean"


@dataclass(frozen=True)
class Artifact:
    artifact_id: str
    kind: str
    uri: str
    meta: dict[str, Any] = field(default_factory=dict)


@dataclass
class FeatureFrame:
    """x: ts_utc, entity_id and a column for each feature. catalog: a row (dict) for each feature; small, so it lives on the driver. labels: session (ts_utc are session labels), instant, or None if not said."""

    x: DataFrame
    catalog: list[dict[str, Any]]
    meta: dict[str, Any] = field(default_factory=dict)
    artifacts: dict[str, Artifact] = field(default_factory=dict)
    labels: str | None = None

    @property
    def features(self) -> list[str]:
        return [c for c in self.x.columns if c not in KEYS]

    def validate(self) -> FeatureFrame:
        if any(k not in self.x.columns for k in KEYS):
            raise ValueError("a frame has ts_utc and entity_id")
        known = {row["feature_id"] for row in self.catalog}
        if self.features and known and (lacking := [f for f in self.features if f not in known]):
            raise ValueError(f"not in the catalog: {lacking}")
        return self

    def with_tags(self, tags: dict[str, Any], overwrite: bool = True) -> FeatureFrame:
        """All features tagged: tags replaced, or merged with new ones winning."""
        rows = []
        for row in self.catalog:
            now = dict(tags) if overwrite else {**row.get("tags", {}), **tags}
            rows.append(row | {"tags": now, "tags_json": tags_text(now)})
        return FeatureFrame(self.x, rows, self.meta, self.artifacts, self.labels)

    def catalog_frame(self) -> DataFrame:
        rows = [tuple({**{k: None for k in ("group_path", "family", "transform", "source_table", "source_col", "dow", "one_hot")}, **r, "tags": {k: str(v) for k, v in r.get("tags", {}).items()}, "tags_json": r.get("tags_json", tags_text(r.get("tags", {})))}[n.split(" ")[0]] for n in CATALOG.split(", ")) for r in self.catalog]
        return self.x.sparkSession.createDataFrame(rows, CATALOG)


@dataclass
class TargetFrame:
    """y: ts_utc, y, and entity_id unless one value holds for all entities."""

    y: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)


@runtime_checkable
class FeatureTemplate(Protocol):
    name: str
    version: str
    param_space: dict[str, ParamSpec]

    def requires(self, params: dict[str, Any]) -> list[tuple[str, Any]]: ...

    def fit(self, ctx: Any, params: dict[str, Any], slice: SliceSpec) -> Any: ...

    def transform(self, ctx: Any, params: dict[str, Any], slice: SliceSpec, state: Any) -> FeatureFrame: ...


TargetTemplate = FeatureTemplate


@dataclass(frozen=True)
class FeatureRequest:
    """broadcast_entities: the features have no entity of the dataset (a macro series) and hold for all of them."""

    template: Any
    params: dict[str, Any] = field(default_factory=dict)
    slice_override: SliceOverride | None = None
    key: str | None = None
    tags: dict[str, Any] = field(default_factory=dict)
    broadcast_entities: bool = False


@dataclass(frozen=True)
class TargetRequest:
    template: Any
    params: dict[str, Any] = field(default_factory=dict)
    horizon: int = 1
    name: str = "target"
    slice_override: SliceOverride | None = None


@dataclass(frozen=True)
class UniverseSpec:
    entities: Sequence[str] | DataFrame  # names, or a DataFrame with entity_id


@dataclass(frozen=True)
class TimeSpec:
    start: Any
    end: Any
    calendar: str = "XNYS"
    grid: Any = "B"
    asof: Any = None


@dataclass(frozen=True)
class JoinPolicy:
    """sort_index: the data in the order of their keys, by ranges over all tasks, and the catalog by feature. Off unless asked for, since it is one more shuffle and joins and tables keep no order."""

    how: str = "inner"
    sort_index: bool = False


@dataclass(frozen=True)
class MissingnessPolicy:
    final_row_policy: str = "drop_if_any_nan"  # or keep


@dataclass(frozen=True)
class DatasetSpec:
    universe: UniverseSpec
    time: TimeSpec
    target: TargetRequest
    features: Sequence[FeatureRequest] = ()
    join_policy: JoinPolicy = JoinPolicy()
    missingness: MissingnessPolicy = MissingnessPolicy()
    name: str = "dataset"
    tags: dict[str, Any] = field(default_factory=dict)


@dataclass
class DatasetArtifact:
    """data: ts_utc, entity_id, the features and the target, lazy."""

    data: DataFrame
    features: list[str]
    target: str
    catalog: list[dict[str, Any]]
    meta: dict[str, Any] = field(default_factory=dict)
    aux: dict[str, Any] = field(default_factory=dict)

    @property
    def x(self) -> DataFrame:
        return self.data.drop(self.target)

    @property
    def y(self) -> DataFrame:
        return self.data.select(*KEYS, F.col(f"`{self.target}`"))

    def n_rows(self) -> int:
        return self.data.count()

    def described(self) -> dict[str, Any]:
        """meta with n_rows, which takes a job unless the data were persisted."""
        return self.meta | {"n_rows": self.meta["n_rows"] if "n_rows" in self.meta else self.n_rows()}


@dataclass(frozen=True)
class FitState:
    state_id: str
    meta: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class FeatureRealization:
    template: str
    version: str
    params: dict[str, Any]
    slice: SliceSpec
    upstream_snapshot: str | None = None

    def id(self) -> str:
        said = lambda t: None if t is None else str(t)
        s = self.slice
        if isinstance(s.entities, DataFrame):
            raise TypeError("a realization is identified by a list of entities, not a DataFrame")
        # The names in the payload, of which the id is a digest.
        where = dict(asof=said(s.asof), end=str(s.end), entities=None if s.entities is None else list(s.entities), grid=s.grid, start=str(s.start))
        own = dict(params=self.params, slice=where, template=self.template, upstream_snapshot=self.upstream_snapshot, version=self.version)
        return ":".join((self.template, self.version, digest(own, 16)))
