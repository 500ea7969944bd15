"""Deterministic test volumes made in the JVM: smooth noise from hashed lattice values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeflow.operators.subset import dense


def _lattice(index: list[Column], seed: int) -> Column:
    """A value in [-1, 1) for an integer point."""
    return F.pmod(F.xxhash64(F.lit(seed), *index), F.lit(1 << 20)).cast("double") / F.lit(float(1 << 19)) - 1.0


def noise_value(index: list[Column], frequency: tuple[float, ...], shape: tuple[int, ...], seed: int = 345) -> Column:
    """Lattice values interpolated smoothly; ``frequency`` counts lattice cells over each axis."""
    at = [c.cast("double") * F.lit(f / n) for c, f, n in zip(index, frequency, shape)]
    base = [F.floor(a).cast("long") for a in at]
    t = [a - b for a, b in zip(at, base)]
    ease = [x * x * (3.0 - 2.0 * x) for x in t]
    out = None
    for corner in range(1 << len(at)):
        bits = [(corner >> d) & 1 for d in range(len(at))]
        weight = None
        for d, b in enumerate(bits):
            w = ease[d] if b else 1.0 - ease[d]
            weight = w if weight is None else weight * w
        part = weight * _lattice([b + k for b, k in zip(base, bits)], seed)
        out = part if out is None else out + part
    return out


def noise(spark: SparkSession, shape: tuple[int, ...], frequency: tuple[float, ...] = (0.6, 2.0, 4.0), scale: float = 0.1234, threshold: float | None = None, seed: int = 345) -> DataFrame:
    """A voxel view of noise within +-scale; below the threshold there is no value."""
    names = [f"d{d}" for d in range(len(shape))]
    value = noise_value([F.col(n) for n in names], tuple(frequency[: len(shape)]) + (1.0,) * (len(shape) - len(frequency)), shape, seed) * scale
    df = dense(spark, (0,) * len(shape), shape).withColumn("value", value)
    return df if threshold is None else df.withColumn("value", F.when(F.col("value") >= threshold, F.col("value")))


def bits(spark: SparkSession, shape: tuple[int, ...], share: float = 0.8, seed: int = 123) -> DataFrame:
    """A voxel view of independent bits, set with a probability."""
    names = [F.col(f"d{d}") for d in range(len(shape))]
    draw = (_lattice(names, seed) + 1.0) / 2.0
    return dense(spark, (0,) * len(shape), shape).withColumn("value", draw < share)
