"""Volumes derived from relational tables: which columns become axes and what becomes the value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeflow.descriptor import Axis, Channel, Descriptor, Layout

LIN_SHAPE = (50, 10, 30)
LIN = Descriptor(
    (Axis(50, "Sample", "ms", 0, 98), Axis(10, "Crossline", "unitless", 100, 118), Axis(30, "Inline", "unitless", 1000, 1145)),
    (Channel("Amplitude", "R64", range_min=900.0, range_max=105000.0, use_novalue=True, novalue=-999.25),),
    Layout(brick_log2=5, neg_margin=4, pos_margin=4, lods=3),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lin_cell() -> list:
    return [(F.col("l_quantity").cast("long") - 1).alias("d0"), (F.col("l_suppkey") % 10).alias("d1"), (F.col("l_partkey") % 30).alias("d2")]


def lin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-D: quantity x supplier mod 10 x part mod 30, the smallest price; cells without lines have no row."""
    return read(spark, sf_dir, "lineitem").groupBy(*lin_cell()).agg(F.min("l_extendedprice").alias("value"))


def big(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """3-D: quantity x supplier x part, the smallest price, and its shape, which grows with the tables."""
    t = read(spark, sf_dir, "lineitem")
    n1, n2 = t.agg(F.max("l_suppkey") + 1, F.max("l_partkey") + 1).first()
    cell = [(F.col("l_quantity").cast("long") - 1).alias("d0"), F.col("l_suppkey").alias("d1"), F.col("l_partkey").alias("d2")]
    return t.groupBy(*cell).agg(F.min("l_extendedprice").alias("value")), (50, n1, n2)


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D: element x vec_id."""
    t = read(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("d1"), F.posexplode("embedding").alias("d0", "value")).select(F.col("d0").cast("long").alias("d0"), "d1", F.col("value").cast("double").alias("value"))


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D: hour since 2024-01-01 x user, the largest value."""
    t = read(spark, sf_dir, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000)
    return t.groupBy(hour.alias("d0"), F.col("user_id").alias("d1")).agg(F.max("value").alias("value"))


def user_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PerTrace values of EVT: (d1, n, lo, hi)."""
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("d1")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace headers: a trace a line item, with a total order."""
    t = read(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("pkey"), F.col("l_linenumber").cast("long").alias("skey"), F.col("l_suppkey").alias("off"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
