"""Fingerprints of tables, so that a changed source is known by itself, and what was built from it is built again where it changed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairospark.files import exists, names, remove

_MODULUS = 1 << 64


def _hash(df: DataFrame, seed: int) -> Column:
    """A row's 64-bit hash with its columns' names; NULL and where it stands count."""
    parts = [c for f in sorted(df.columns) for c in (F.lit(f), F.col(f"`{f}`").isNull(), F.col(f"`{f}`"))]
    return F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")


def prints(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns `by`, n_rows and print: a fingerprint of the rows with those values, as a multiset: their order, partitions and the order of columns don't matter, repeated rows do.

    Two sums of 64-bit row hashes, so prints of parts can be added up by sums, partial aggregation sends a row for each part and task, and two tables agree by chance with probability 2**-128 or so. Columns are of any type but maps. An empty table without `by`: one row.
    """
    sums = [F.coalesce(F.sum(_hash(df, k)), F.lit(0)) for k in (1, 2)]
    out = df.groupBy(*by).agg(F.count("*").alias("n_rows"), *(s.cast("decimal(38,0)").alias(f"__s{k}") for k, s in enumerate(sums)))
    wrapped = [F.pmod(F.col(f"__s{k}"), F.lit(str(_MODULUS)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string") for k in range(2)]
    return out.select(*by, "n_rows", F.concat_ws("-", F.col("n_rows").cast("string"), *wrapped).alias("print"))


def upstream_snapshot(df: DataFrame) -> str:
    """A table's fingerprint as a short text, for FeatureRealization.upstream_snapshot: a changed source then has another realization id. One aggregate job."""
    kinds = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    return hashlib.sha256(f"{kinds}|{prints(df).first()['print']}".encode()).hexdigest()[:16]


def touched(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, gone): the parts whose prints differ between two results of prints(), those that are only in one among them; gone: those that are only in the old one."""
    a = old.select(F.struct(*by, F.lit(0).alias("__none")).alias("part"), F.col("print").alias("was"), F.lit(None).cast("string").alias("now"))
    b = new.select(F.struct(*by, F.lit(0).alias("__none")).alias("part"), F.lit(None).cast("string").alias("was"), F.col("print").alias("now"))
    met = a.unionByName(b).groupBy("part").agg(F.max("was").alias("was"), F.max("now").alias("now"))
    return met.where(~F.col("was").eqNullSafe(F.col("now"))).select(*(F.col("part")[c].alias(c) for c in by), F.col("now").isNull().alias("gone"))


def refreshed(spark: SparkSession, root: str, source: DataFrame, by: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Brings what `build` makes of each part of the source up to date under root, and gives the parts that were built again or removed: (by, gone).

    build gets whole parts and gives rows with the column `by`. Prints of all parts are compared with those of the last run; only parts that differ are read for the build, and only their folders are written. The prints are replaced last, so a run that fails is repeated by the next. Parts with NULL in `by` are built too. How many parts there are is for the caller to keep in bounds, as for any partitioned table.
    """
    data, known = f"{root.rstrip('/')}/data", f"{root.rstrip('/')}/prints"
    now = prints(source, [by])
    runs = sorted(int(n.removeprefix("r-")) for n in _names(spark, known))
    old = spark.read.parquet(f"{known}/r-{runs[-1]}") if runs else now.limit(0)
    step = (runs[-1] if runs else 0) + 1
    now.write.mode("overwrite").parquet(f"{known}/t-{step}")
    now = spark.read.parquet(f"{known}/t-{step}")
    parts = touched(old, now, [by]).persist()
    fresh, gone = parts.where("not gone").select(by), parts.where("gone").select(by)
    if not fresh.isEmpty():
        s = source.alias("s")
        own = s.join(F.broadcast(fresh.withColumnRenamed(by, "__by")), F.col(f"s.{by}").eqNullSafe(F.col("__by")), "left_semi")
        build(own).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(data)
    for row in gone.collect():
        remove(spark, f"{data}/{by}={'__HIVE_DEFAULT_PARTITION__' if row[0] is None else row[0]}")
    now.write.parquet(f"{known}/r-{step}")
    remove(spark, f"{known}/t-{step}")
    for n in runs[:-1]:
        remove(spark, f"{known}/r-{n}")
    return parts


def _names(spark: SparkSession, path: str) -> list[str]:
    return [n for n in names(spark, path) if n.startswith("r-") and exists(spark, f"{path}/{n}/_SUCCESS")]
