"""Sampling at positions between voxels: points, traces and planes.

Voxel i spans [i, i + 1) and its centre is i + 0.5.  A method names its taps, the neighbours that
it looks at; taps meet voxels in an equi-join on integer indices and come back to their position as
an array in tap order, on which the method is a column expression.  Taps outside the volume are
clamped to it.  Up to three dimensions are interpolated; further ones take the nearest voxel.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeflow.descriptor import Channel, InvalidArgument, InvalidOperation
from cubeflow.operators.subset import axes_of, dense

METHODS = ("nearest", "linear", "cubic", "angular", "triangular")


def method_for(method: str, channel: Channel | None) -> str:
    """Discrete values are not interpolated."""
    if method not in METHODS:
        raise InvalidArgument(f"unknown interpolation {method}")
    return "nearest" if channel is not None and channel.forces_nearest else method


def _offsets(method: str, n_dims: int) -> list[tuple[int, ...]]:
    """Index offsets of the taps from floor(p - 0.5); dimension 0 runs fastest."""
    free = min(n_dims, 3)
    per = {"nearest": (0,), "linear": (0, 1), "angular": (0, 1), "cubic": (-1, 0, 1, 2), "triangular": (0, 1)}[method]
    used = min(free, 2) if method == "triangular" else free
    return [tuple(reversed(t)) + (0,) * (n_dims - used) for t in itertools.product(per, repeat=used)]


def _base(name: str) -> Column:
    return F.floor(F.col(name) - 0.5)


def _fraction(name: str) -> Column:
    return F.col(name) - _base(name) - 0.5


def _clamp(c: Column, n: int) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("long")


def tap_indices(method: str, shape: tuple[int, ...]) -> Column:
    """array<struct<tap, d0, d1, ...>> for positions p0, p1, ..."""
    n = len(shape)
    plain = {"triangular": 2}.get(method, 3) if method != "nearest" else 0
    out = []
    for tap, offsets in enumerate(_offsets(method, n)):
        at = [_clamp(_base(f"p{d}") + offsets[d] if d < min(plain, n) else F.floor(F.col(f"p{d}")), shape[d]) for d in range(n)]
        out.append(F.struct(F.lit(tap).alias("tap"), *[c.alias(f"d{d}") for d, c in enumerate(at)]))
    return F.array(*out)


def gather(positions: DataFrame, voxels: DataFrame, method: str, shape: tuple[int, ...]) -> DataFrame:
    """``positions`` (id, p0, p1, ...) with ``taps``: array<double> of the voxels' values in tap order."""
    names = [f"d{d}" for d in range(len(shape))]
    taps = positions.select("id", F.explode(tap_indices(method, shape)).alias("t")).select("id", "t.*")
    value = F.col("value") if isinstance(voxels.schema["value"].dataType, T.StructType) or method == "nearest" else F.col("value").cast("double")
    found = taps.join(voxels.select(*names, value.alias("value")), names, "left")
    if method == "nearest":
        values = found.select("id", F.array("value").alias("taps"))
    else:
        values = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tap", "value"))).alias("tv")).select("id", F.col("tv.value").alias("taps"))
    return positions.join(values, "id")


def _cubic_weights(f: Column) -> list[Column]:
    """Catmull-Rom."""
    f2, f3 = f * f, f * f * f
    return [-0.5 * f3 + f2 - 0.5 * f, 1.5 * f3 - 2.5 * f2 + 1.0, -1.5 * f3 + 2.0 * f2 + 0.5 * f, 0.5 * (f3 - f2)]


def _product(factors: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, factors)


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _nearest_tap(method: str, n_dims: int) -> Column:
    """Number of the tap that is the voxel the position lies in."""
    at, width = F.lit(0), 4 if method == "cubic" else 2
    for d in range(min(n_dims, 3)):
        up = F.when(_fraction(f"p{d}") >= 0.5, 1).otherwise(0) + (1 if method == "cubic" else 0)
        at = at + up * width**d
    return at


def value_at(method: str, n_dims: int, value_range: tuple[float, float] | None = None, taps: Column | None = None) -> Column:
    """The interpolated value of a gathered row; null where the nearest voxel has none."""
    taps = F.col("taps") if taps is None else taps
    offsets = _offsets(method, n_dims)
    free = min(n_dims, 3)
    if method == "nearest":
        return F.get(taps, 0)
    if method == "triangular":
        return _triangular(taps)
    nearest = F.get(taps, _nearest_tap(method, n_dims))
    per = [_cubic_weights(_fraction(f"p{d}")) if method == "cubic" else [1.0 - _fraction(f"p{d}"), _fraction(f"p{d}")] for d in range(free)]
    low = min(o[0] for o in offsets)
    # per dimension an array of weights, computed once a row, and each tap's place in it as fixed numbers
    weights = F.array(*[F.array(*w) for w in per])
    place = [F.array(*[F.lit(o[d] - low) for o in offsets]) for d in range(free)]
    if method == "angular":
        if value_range is None:
            raise InvalidArgument("angular interpolation needs a value range")
        width = value_range[1] - value_range[0]
    centre = {o: k for k, o in enumerate(offsets)}
    # a tap of the cubic counts only if the tap between it and the position has a value as well
    inner = F.array(*[F.lit(centre[tuple(min(max(x, 0), 1) for x in o)]) for o in offsets])

    def mixed(b: Column) -> Column:
        values, w = b["values"], b["weights"]
        if method == "angular":
            values = F.transform(values, lambda v: v - F.floor((v - nearest) / width + 0.5) * width)

        def tap(v, i):
            weight = _product([F.get(F.get(w, d), F.get(place[d], i)) for d in range(free)])
            return F.struct((v.isNotNull() & F.get(values, F.get(inner, i)).isNotNull()).alias("ok"), weight.alias("w"), v.alias("v"))

        def add(s, t):
            part = lambda x: F.when(t["ok"], x).otherwise(0.0)
            return F.struct((s["total"] + part(t["w"] * t["v"])).alias("total"), (s["weight"] + part(t["w"])).alias("weight"), (s["every"] & t["ok"]).alias("every"))

        zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weight"), F.lit(True).alias("every"))
        return F.aggregate(F.transform(values, tap), zero, add, lambda s: F.when(s["every"], s["total"]).otherwise(s["total"] / s["weight"]))

    out = F.element_at(F.transform(F.array(F.struct(taps.alias("values"), weights.alias("weights"))), mixed), 1)
    if method == "angular":
        out = out - F.floor((out - value_range[0]) / width) * width
    return F.when(nearest.isNotNull(), out)


def _triangular(taps: Column) -> Column:
    """Heights over two triangles of a cell: split along one diagonal, or the other where a corner has no value."""
    u, v = _fraction("p0"), _fraction("p1")
    v00, v10, v01, v11 = (F.get(taps, k) for k in range(4))
    both, other = v10.isNotNull() & v01.isNotNull(), v00.isNotNull() & v11.isNotNull()
    return (
        F.when(both & (u <= 1.0 - v) & v00.isNotNull(), v00 + u * (v10 - v00) + v * (v01 - v00))
        .when(both & (u >= 1.0 - v) & v11.isNotNull(), v11 + (1.0 - u) * (v01 - v11) + (1.0 - v) * (v10 - v11))
        .when(~both & other & (u >= v) & v10.isNotNull(), v10 + (1.0 - u) * (v00 - v10) + v * (v11 - v10))
        .when(~both & other & (u <= v) & v01.isNotNull(), v01 + u * (v11 - v01) + (1.0 - v) * (v00 - v01))
        .when(~both & v00.isNotNull() & (u == 0) & (v == 0), v00)
        .when(~both & v00.isNotNull() & (u == 0) & v01.isNotNull(), v00 + v * (v01 - v00))
        .when(~both & v00.isNotNull() & (v == 0) & v10.isNotNull(), v00 + u * (v10 - v00))
    )


def samples(positions: DataFrame, voxels: DataFrame, shape: tuple[int, ...], method: str = "cubic", channel: Channel | None = None, replacement: float | None = None, value_range: tuple[float, float] | None = None) -> DataFrame:
    """(id, value) for every position (id, p0, p1, ...).

    NoValue at the nearest voxel gives NoValue whatever the other taps have; else the weights of
    the valid taps are scaled to sum to one.
    """
    method = method_for(method, channel)
    bounds = value_range or ((channel.range_min, channel.range_max) if channel else None)
    kind = voxels.schema["value"].dataType

    def one(taps: Column | None = None) -> Column:
        value = value_at(method, len(shape), bounds, taps)
        return value if replacement is None else F.coalesce(value, F.lit(replacement))

    def component(name: str) -> Column:
        return F.transform("taps", lambda t: t[name] if method == "nearest" else t[name].cast("double"))

    if isinstance(kind, T.StructType):  # components, each by itself
        value = F.struct(*[one(component(f.name)).alias(f.name) for f in kind])
    else:
        value = one()
    return gather(positions, voxels, method, shape).select("id", value.alias("value"))


def traces(positions: DataFrame, voxels: DataFrame, shape: tuple[int, ...], trace_dim: int = 0, method: str = "cubic", lod: int = 0, full_res_dim: int = -1, **options) -> DataFrame:
    """(id, sample, value): complete lines along ``trace_dim`` through positions; their own coordinate along it is ignored.

    ``voxels`` and ``shape`` are those of the level of detail; positions are of full resolution.
    """
    if not 0 <= trace_dim < len(shape):
        raise InvalidArgument(f"trace dimension {trace_dim}")
    scale = [1 if d == full_res_dim else 1 << lod for d in range(len(shape))]
    at = [(F.col("sample") + 0.5).alias(f"p{d}") if d == trace_dim else (F.col(f"p{d}") / F.lit(scale[d])).alias(f"p{d}") for d in range(len(shape))]
    lines = positions.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(shape[trace_dim] - 1))))
    lines = lines.select(F.struct("id", "sample").alias("id"), *at)
    return samples(lines, voxels, shape, method, **options).select("id.id", F.col("id.sample").cast("long").alias("sample"), "value")


def project(voxels: DataFrame, shape: tuple[int, ...], plane: tuple[float, float, float, float], along: int, low: tuple[int, ...], high: tuple[int, ...], method: str = "linear", lod: int = 0, channel: Channel | None = None, **options) -> DataFrame:
    """A plane a*p0 + b*p1 + c*p2 + t = 0 sampled over [low, high) and projected along a dimension.

    Rows (d_i, d_j, value) for the two other dimensions, counted from the region's low end; the
    plane is clamped to half a voxel within the volume; the other two positions are voxel centres.
    """
    if len(shape) != 3 or not 0 <= along < 3:
        raise InvalidArgument("a plane cuts three dimensions")
    if channel is not None and channel.components > 1:
        raise InvalidOperation("only channels of one component can be projected")
    if not plane[along]:
        raise InvalidArgument("the plane is perpendicular to the projection")
    kept = [d for d in range(3) if d != along]
    step = 1 << lod
    n = [((high[d] - low[d] - 1) >> lod) + 1 for d in kept]
    grid = dense(voxels.sparkSession, (0, 0), tuple(n))
    at = {d: F.col(f"d{k}") * step + low[d] for k, d in enumerate(kept)}
    z = F.lit(float(plane[3]))
    for d in kept:
        z = z + F.lit(float(plane[d])) * (at[d] + step / 2.0)
    z = F.least(F.greatest(z / F.lit(-float(plane[along])), F.lit(0.5)), F.lit(shape[along] - 0.5))
    # level-of-detail voxels are 2^lod wide
    points = {d: (F.floor(c / F.lit(step)) + 0.5) for d, c in at.items()} | {along: z / F.lit(float(step)) if lod else z}
    positions = grid.select(F.struct("d0", "d1").alias("id"), *[points[d].cast("double").alias(f"p{d}") for d in range(3)])
    level = tuple(((m - 1) >> lod) + 1 for m in shape)
    out = samples(positions, voxels, level, method, channel=channel, **options)
    return out.select(F.col("id.d0").alias(f"d{kept[0]}"), F.col("id.d1").alias(f"d{kept[1]}"), "value")


def points(voxels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: (id, d0, ...) with the values there, null where none is."""
    names = axes_of(voxels)
    return wanted.join(voxels, names, "left").select("id", *names, "value")


def updated(voxels: DataFrame, changes: DataFrame) -> DataFrame:
    """Voxels with new values set; a change to null clears a value, one elsewhere adds a voxel."""
    names = axes_of(voxels)
    new = changes.select(*names, F.col("value").alias("_new"), F.lit(True).alias("_set"))
    return voxels.join(new, names, "full").select(*names, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value")).alias("value"))
