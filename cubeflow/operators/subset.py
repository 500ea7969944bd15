"""Subsets, slices and levels of detail of the voxel view: rows (d0, d1, ..., value), null value = NoValue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeflow.descriptor import InvalidArgument, check_region, lod_length


def axes_of(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c[0] == "d" and c[1:].isdigit())


def in_region(low: tuple[int, ...], high: tuple[int, ...], prefix: str = "d") -> Column:
    """Voxels within [low, high)."""
    return reduce(lambda a, b: a & b, [(F.col(f"{prefix}{d}") >= a) & (F.col(f"{prefix}{d}") < b) for d, (a, b) in enumerate(zip(low, high))])


def subset(df: DataFrame, low: tuple[int, ...], high: tuple[int, ...], shape: tuple[int, ...] | None = None) -> DataFrame:
    """The voxels of a hyper-rectangle, min-inclusive, max-exclusive."""
    if shape is not None:
        check_region(shape, low, high)
    return df.where(in_region(low, high))


def slice_at(df: DataFrame, dim: int, index: int) -> DataFrame:
    """A slice: the subset of thickness 1 along a dimension, without that dimension's column."""
    return df.where(F.col(f"d{dim}") == index).drop(f"d{dim}")


def subset_lod(level: DataFrame, low: tuple[int, ...], high: tuple[int, ...], lod: int, full_res_dim: int = -1) -> DataFrame:
    """A region of full resolution read from a level of detail; output indices count from the region's low end."""
    out = level
    for d, (a, b) in enumerate(zip(low, high)):
        shift = 0 if d == full_res_dim else lod
        first, n = a >> shift, lod_length(a, b, shift)
        name = f"d{d}"
        out = out.where((F.col(name) >= first) & (F.col(name) < first + n)).withColumn(name, F.col(name) - first)
    return out


def _halved(names: list[str], full_res_dim: int) -> tuple[list[Column], Column]:
    cells, order = [], F.lit(0)
    for d, name in enumerate(names):
        if d == full_res_dim or d > 2:
            cells.append(F.col(name))
        else:
            cells.append(F.shiftright(F.col(name), 1).alias(name))
            order = order + F.col(name) % 2 * (1 << d)
    return cells, order


def decimate(df: DataFrame, full_res_dim: int = -1) -> DataFrame:
    """The next level of detail: of each cell of two voxels a dimension the first that has a value.

    "First" runs along dimension 0, then 1, then 2.  A cell without any value is null.
    """
    cells, order = _halved(axes_of(df), full_res_dim)
    picked = F.min(F.when(F.col("value").isNotNull(), F.struct(order.alias("o"), "value")))["value"]
    return df.groupBy(*cells).agg(picked.alias("value"))


def decimate_bits(df: DataFrame, full_res_dim: int = -1) -> DataFrame:
    """The next level of a bit channel: set where any voxel of the cell is."""
    cells, _ = _halved(axes_of(df), full_res_dim)
    return df.groupBy(*cells).agg(F.bool_or("value").alias("value"))


def pyramid(df: DataFrame, lods: int, full_res_dim: int = -1, bits: bool = False) -> list[DataFrame]:
    """Levels 0 to ``lods``; each is made of the one before."""
    out = [df]
    for _ in range(lods):
        out.append((decimate_bits if bits else decimate)(out[-1], full_res_dim))
    return out


def dense(spark: SparkSession, low: tuple[int, ...], high: tuple[int, ...]) -> DataFrame:
    """Every index of a region, from one range: no cross joins."""
    n = 1
    for a, b in zip(low, high):
        if b <= a:
            raise InvalidArgument("an empty region")
        n *= b - a
    rest, cols = F.col("id"), []
    for d, (a, b) in enumerate(zip(low, high)):
        cols.append((F.pmod(rest, F.lit(b - a)) + a).alias(f"d{d}"))
        rest = F.floor(rest / F.lit(b - a))
    return spark.range(n).select(*cols)


def densified(df: DataFrame, low: tuple[int, ...], high: tuple[int, ...], replacement: float | None = None) -> DataFrame:
    """A region with a row for every voxel: null, or the replacement, where there is no value."""
    names = [f"d{d}" for d in range(len(low))]
    out = dense(df.sparkSession, low, high).join(subset(df, low, high), names, "left")
    value = F.col("value") if replacement is None else F.coalesce("value", F.lit(replacement))
    return out.select(*names, value.alias("value"))


def per_trace(df: DataFrame, trace_values: DataFrame) -> DataFrame:
    """Voxels with their traces' values: the two share all dimensions but the first."""
    names = [c for c in axes_of(df) if c != "d0"]
    return df.join(trace_values, names)


def to_traces(df: DataFrame, n: int) -> DataFrame:
    """The trace view: (d1, ..., values), dimension 0 as an array of length ``n`` with nulls for NoValue."""
    names = [c for c in axes_of(df) if c != "d0"]
    got = df.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct(F.col("d0").cast("int"), "value"))).alias("m"))
    return got.select(*names, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("m")[i]).alias("values"))


def from_traces(traces: DataFrame) -> DataFrame:
    """The voxel view of a trace view."""
    names = axes_of(traces)
    return traces.select(*names, F.posexplode("values").alias("d0", "value")).select(F.col("d0").cast("long").alias("d0"), *names, "value")
