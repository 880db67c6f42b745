"""Collection browsing: tables with their sizes, a sampled schema, pages and samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collections(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``name, count``, largest first; counts come from file footers where the source has them."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("name"), "count")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "name string, count long")
    return out.orderBy(F.desc("count"), "name")


def describe(df: DataFrame, key: str) -> DataFrame:
    """``name, type`` of the fields of the row of least key: arrays with their size, long strings with their length, null as such."""
    row = df.orderBy(key).limit(1)
    kinds = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        label = F.lit(f.dataType.simpleString())
        if isinstance(f.dataType, T.ArrayType):
            label = F.concat(F.lit("array["), F.size(c).cast("string"), F.lit("]"))
        elif isinstance(f.dataType, T.StringType):
            label = F.when(F.length(c) > 100, F.concat(F.lit("string ("), F.length(c).cast("string"), F.lit(" chars)"))).otherwise("string")
        kinds.append(F.struct(F.lit(f.name).alias("name"), F.when(c.isNull(), "null").otherwise(label).alias("type")))
    return row.select(F.explode(F.array(*kinds)).alias("f")).select("f.name", "f.type")


def page(df: DataFrame, key: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of rows in key order."""
    return df.orderBy(key).offset(skip).limit(limit)


def sample(df: DataFrame, n: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """Exactly n random rows: those of least digest of key and seed, so the same sample comes out on any cluster and engine."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))) if key else F.rand(seed)).limit(n)
