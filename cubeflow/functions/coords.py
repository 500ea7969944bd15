"""Index, annotation and world coordinates.

IJK indices count samples of three chosen dimensions; annotation coordinates are those of the axes;
world coordinates follow from an origin and a step vector for each of I, J and K.  Positions put
sample i's centre at i + 0.5; indices round half up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeflow.descriptor import Axis, InvalidArgument

Vector = tuple[float, float, float]


def index_to_coordinate(index: Column, axis: Axis) -> Column:
    return F.lit(axis.coord_min) + index * F.lit(axis.step)


def coordinate_to_index(coordinate: Column, axis: Axis) -> Column:
    """Nearest sample, rounded half up."""
    return F.floor(_fraction(coordinate, axis) * F.lit(float(axis.num_samples - 1)) + 0.5).cast("long")


def coordinate_to_position(coordinate: Column, axis: Axis) -> Column:
    """The place along the axis at which a sample's centre is its index and a half."""
    return _fraction(coordinate, axis) * F.lit(float(axis.num_samples - 1)) + 0.5


def _fraction(coordinate: Column, axis: Axis) -> Column:
    width = axis.coord_max - axis.coord_min
    return (coordinate - axis.coord_min) / F.lit(width) if width else F.lit(0.0)


def inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a 3 x 3 matrix."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if not det:
        raise InvalidArgument("the step vectors lie in a plane")
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def dot(a: Vector, b: Vector) -> float:
    return sum(x * y for x, y in zip(a, b))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vector) -> float:
    return math.sqrt(dot(a, a))


def normalize(a: Vector) -> Vector:
    n = length(a)
    return tuple(x / n for x in a) if n else a


@dataclass(frozen=True)
class Transformer:
    """World, IJK, annotation and voxel coordinates of a volume.

    ``dims`` says which volume dimension each of I, J and K is; ``axes`` are the volume's.
    """

    axes: tuple[Axis, ...]
    origin: Vector
    i_step: Vector
    j_step: Vector
    k_step: Vector
    dims: tuple[int, int, int] = (2, 1, 0)

    @property
    def _steps(self) -> list[list[float]]:
        return [[s[r] for s in (self.i_step, self.j_step, self.k_step)] for r in range(3)]

    @property
    def sizes(self) -> tuple[int, ...]:
        return tuple(self.axes[d].num_samples for d in self.dims)

    # --- columns: three in, three out ---

    def ijk_to_world(self, ijk: list[Column]) -> list[Column]:
        return [F.lit(float(o)) + sum((c * F.lit(float(w)) for c, w in zip(ijk[1:], row[1:])), ijk[0] * F.lit(float(row[0]))) for o, row in zip(self.origin, self._steps)]

    def world_to_ijk(self, xyz: list[Column]) -> list[Column]:
        rel = [c - F.lit(float(o)) for c, o in zip(xyz, self.origin)]
        return [sum((c * F.lit(w) for c, w in zip(rel[1:], row[1:])), rel[0] * F.lit(row[0])) for row in inverse(self._steps)]

    def ijk_to_annotation(self, ijk: list[Column]) -> list[Column]:
        return [index_to_coordinate(c, self.axes[d]) for c, d in zip(ijk, self.dims)]

    def annotation_to_ijk(self, annotation: list[Column]) -> list[Column]:
        return [_fraction(c, self.axes[d]) * F.lit(float(self.axes[d].num_samples - 1)) for c, d in zip(annotation, self.dims)]

    def ijk_to_voxel(self, ijk: list[Column]) -> dict[int, Column]:
        return {d: c for d, c in zip(self.dims, ijk)}

    def voxel_to_ijk(self, voxel: dict[int, Column]) -> list[Column]:
        return [voxel[d] for d in self.dims]

    def voxel_to_world(self, voxel: dict[int, Column]) -> list[Column]:
        return self.ijk_to_world(self.voxel_to_ijk(voxel))

    def world_to_voxel(self, xyz: list[Column]) -> dict[int, Column]:
        return self.ijk_to_voxel(self.world_to_ijk(xyz))

    def voxel_to_annotation(self, voxel: dict[int, Column]) -> list[Column]:
        return self.ijk_to_annotation(self.voxel_to_ijk(voxel))

    def annotation_to_voxel(self, annotation: list[Column]) -> dict[int, Column]:
        return self.ijk_to_voxel(self.annotation_to_ijk(annotation))

    def world_to_annotation(self, xyz: list[Column]) -> list[Column]:
        return self.ijk_to_annotation(self.world_to_ijk(xyz))

    def annotation_to_world(self, annotation: list[Column]) -> list[Column]:
        return self.ijk_to_world(self.annotation_to_ijk(annotation))

    def position_to_index(self, ijk: list[Column]) -> list[Column]:
        """Indices of the nearest samples, or -1 in all three where one is over half a sample outside."""
        outside = self.position_out_of_range(ijk)
        return [F.when(outside, -1).otherwise(F.floor(c + 0.5)).cast("long") for c in ijk]

    def position_out_of_range(self, ijk: list[Column], slack: float = 0.5) -> Column:
        out = F.lit(False)
        for c, n in zip(ijk, self.sizes):
            out = out | (c < -slack) | (c >= n - 1 + slack)
        return out

    def index_out_of_range(self, ijk: list[Column]) -> Column:
        out = F.lit(False)
        for c, n in zip(ijk, self.sizes):
            out = out | (c < 0) | (c > n - 1)
        return out


def transformer_from_metadata(axes: tuple[Axis, ...], metadata: dict[tuple[str, str], object]) -> Transformer:
    """The grid that the survey metadata define.

    Step vectors for I, J and K if given; else origin and spacings of inlines and crosslines in
    the plane, with K downwards; else a unit grid along the axes.
    """
    get = lambda name: metadata.get(("SurveyCoordinateSystem", name))
    names = {a.name: d for d, a in enumerate(axes)}
    origin = get("Origin") or (0.0, 0.0, 0.0)
    origin = tuple(origin) + (0.0,) * (3 - len(origin))
    if all(get(n) is not None for n in ("IStepVector", "JStepVector", "KStepVector")):
        dims = tuple(names.get(n, d) for n, d in (("I", 2), ("J", 1), ("K", 0)))
        return Transformer(axes, origin, *(tuple(get(n)) for n in ("IStepVector", "JStepVector", "KStepVector")), dims=dims)
    inline, crossline = get("InlineSpacing"), get("CrosslineSpacing")
    if inline is not None and crossline is not None:
        dims = (names.get("Inline", 2), names.get("Crossline", 1), names.get("Sample", 0))
        i, j, k = (axes[d] for d in dims)
        # spacings are per annotation unit, and the origin is where the annotations are 0
        i_step = tuple(x * i.step for x in inline) + (0.0,)
        j_step = tuple(x * j.step for x in crossline) + (0.0,)
        at = tuple(o + a * i.coord_min + b * j.coord_min for o, a, b in zip(origin, (*inline, 0.0), (*crossline, 0.0)))
        return Transformer(axes, (at[0], at[1], -k.coord_min), i_step, j_step, (0.0, 0.0, -k.step), dims)
    return Transformer(axes, origin, (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
