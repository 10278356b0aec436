"""Series as a Spark data source in Python: batch reads with pushed filters, and streams by offsets.

A series store is a folder of Parquet files on shared storage, each with some series in order of time. It stands for any service that gives rows by series and time: another one subclasses SeriesReader and says how its partitions are listed and read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from kairospark.sources.catalog import Query, TableSchema

NAME = "kairospark_series"
SCHEMA = "series_id string, date timestamp_ntz, value double, asof_utc timestamp_ntz"
_COMPARED = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class FilePartition(InputPartition):
    path: str


def _files(path: str) -> tuple[Any, list[str]]:
    """The store's file system, and its data files in order of name."""
    from pyarrow import fs

    system, root = _files_of(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_")))


def _batches(path: str, file: str, terms: Sequence[tuple[str, str, Any]]) -> Iterator[Any]:
    """The file's rows that meet all terms, as Arrow batches; row groups whose bounds rule them out aren't read."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    system, _ = _files_of(path)
    names = ["series_id", "date", "value", "asof_utc"]
    kinds = pa.schema([("series_id", pa.string()), ("date", pa.timestamp("us")), ("value", pa.float64()), ("asof_utc", pa.timestamp("us"))])
    own = ds.dataset(file, filesystem=system, format="parquet", schema=kinds)
    keep = None
    for name, sign, value in terms:
        field = ds.field(name)
        value = [pa.scalar(v, kinds.field(name).type) for v in value] if sign == "in" else pa.scalar(value, kinds.field(name).type)
        one = field.isin(pa.array([v.as_py() for v in value], kinds.field(name).type)) if sign == "in" else {"==": field == value, ">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value}[sign]
        keep = one if keep is None else keep & one
    yield from own.to_batches(columns=names, filter=keep, use_threads=False)


def _files_of(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class SeriesReader(DataSourceReader):
    """One partition a file."""

    def __init__(self, options: dict[str, str]):
        self.path, self.terms = options["path"], []

    def partitions(self) -> Sequence[InputPartition]:
        return [FilePartition(f) for f in _files(self.path)[1]]

    def read(self, partition: InputPartition) -> Iterator[Any]:
        yield from _batches(self.path, partition.path, self.terms)


class FilteringSeriesReader(SeriesReader):
    """Takes over the filters on series and date that Spark pushes down, and applies them to row groups and rows; all others stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            sign = _COMPARED.get(type(f))
            if sign and f.attribute in (("series_id",), ("date",)):
                self.terms.append((f.attribute[0], sign, list(f.value) if sign == "in" else f.value))
            else:
                yield f


class SeriesStreamReader(DataSourceStreamReader):
    """Offsets count the store's files in order of name: files that come later sort later, as those of an append-only log do. A batch reads the files between two offsets, so one that is read again has the same rows."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        return {"files": len(_files(self.path)[1])}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> Sequence[InputPartition]:
        return [FilePartition(f) for f in _files(self.path)[1][start["files"] : end["files"]]]

    def read(self, partition: InputPartition) -> Iterator[Any]:
        yield from _batches(self.path, partition.path, ())


class SeriesData(DataSource):
    """spark.read.format("kairospark_series").option("path", ...), and readStream the same. The option pushdown is for sessions with spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> SeriesReader:
        # Spark refuses a reader that takes filters where the session doesn't push them.
        return FilteringSeriesReader(self.options) if self.options.get("pushdown", "false") == "true" else SeriesReader(self.options)

    def streamReader(self, schema: Any) -> SeriesStreamReader:  # noqa: N802
        return SeriesStreamReader(self.options)


@dataclass(frozen=True)
class StoredSeries:
    """A source for the context over a series store. Bounds and entities of a query are filters that reach the reader where the session pushes filters to Python sources (spark.sql.python.filterPushdown.enabled); else Spark applies them."""

    spark: SparkSession
    name: str
    table: str
    path: str
    native_freq: str | None = None

    def schemas(self) -> dict[str, TableSchema]:
        return {self.table: TableSchema(self.table, entity_column="series_id", time_column="date", native_freq=self.native_freq)}

    def fetch(self, q: Query) -> DataFrame:
        self.spark.dataSource.register(SeriesData)
        df = self.spark.read.format(NAME).option("path", self.path).option("pushdown", self.spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()
        if q.entities is not None and not isinstance(q.entities, DataFrame):
            df = df.where(F.col("series_id").isin([str(e) for e in q.entities]))
        bounds = [("date", ">=", q.start), ("date", "<=", q.end), ("date", "<=", q.asof)]
        for column, sign, value in bounds:
            if value is not None:
                text = F.lit(_text(value)).cast("timestamp_ntz")
                df = df.where(F.col(column) >= text if sign == ">=" else F.col(column) <= text)
        return df


def _text(x: datetime) -> str:
    return x.isoformat(sep=" ")


def put_series(rows: DataFrame, path: str, files: int = 8) -> None:
    """A series store of rows (series_id, date, value, asof_utc): ranges of series by file, so that bounds of row groups tell series apart."""
    rows.select("series_id", "date", F.col("value").cast("double").alias("value"), "asof_utc").repartitionByRange(files, "series_id", "date").sortWithinPartitions("series_id", "date").write.parquet(path)
