"""Index algebra of chunks: voxel, local and chunk-local indices and offsets into a chunk's data, as columns.

A voxel index counts from the volume's corner; a local index counts samples from the corner of a
chunk's data, margins included; a chunk-local index counts from the chunk without margins.  At a
level of detail a sample is 2^lod voxels wide.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeflow.descriptor import Axis
from cubeflow.plans.grid import Grid


@dataclass(frozen=True)
class Indexer:
    """Indices of one chunk of a grid."""

    grid: Grid
    chunk: int

    @property
    def bounds(self):
        return self.grid.bounds(self.chunk)

    @property
    def wide_bounds(self):
        return self.grid.bounds(self.chunk, margin=True)

    def shift(self, d: int) -> int:
        return 0 if d == self.grid.full_res_dim or d not in self.grid.dims else self.grid.lod

    @property
    def size(self) -> tuple[int, ...]:
        return self.grid.stored_size(self.chunk, margin=True)

    @property
    def pitch(self) -> tuple[int, ...]:
        out, p = [], 1
        for n in self.size:
            out.append(p)
            p *= n
        return tuple(out)

    def voxel_to_local(self, voxel: list[Column]) -> list[Column]:
        return [F.shiftright(v - a, s) if s else v - a for (v, a, s) in zip(voxel, self.wide_bounds[0], map(self.shift, range(len(voxel))))]

    def local_to_voxel(self, local: list[Column]) -> list[Column]:
        return [F.shiftleft(i, s) + a if s else i + a for (i, a, s) in zip(local, self.wide_bounds[0], map(self.shift, range(len(local))))]

    def local_to_chunk_local(self, local: list[Column]) -> list[Column]:
        return [i - ((a - b) >> s) for i, a, b, s in zip(local, self.bounds[0], self.wide_bounds[0], map(self.shift, range(len(local))))]

    def chunk_local_to_local(self, index: list[Column]) -> list[Column]:
        return [i + ((a - b) >> s) for i, a, b, s in zip(index, self.bounds[0], self.wide_bounds[0], map(self.shift, range(len(index))))]

    def voxel_to_chunk_local(self, voxel: list[Column]) -> list[Column]:
        return self.local_to_chunk_local(self.voxel_to_local(voxel))

    def local_to_offset(self, local: list[Column]) -> Column:
        """Place in the chunk's data, dimension 0 fastest."""
        return reduce(lambda a, b: a + b, [i * p for i, p in zip(local, self.pitch)]).cast("long")

    def offset_to_local(self, offset: Column) -> list[Column]:
        out, rest = [], offset
        for n in self.size:
            out.append(F.pmod(rest, F.lit(n)))
            rest = F.floor(rest / F.lit(n))
        return out

    def voxel_to_offset(self, voxel: list[Column]) -> Column:
        return self.local_to_offset(self.voxel_to_local(voxel))

    def bit_offset(self, local: list[Column]) -> tuple[Column, Column]:
        """(byte, bit) of packed bits, lowest first; rows of dimension 0 begin on whole bytes."""
        row = -(-self.size[0] // 8)
        pitch, p = [0], row
        for n in self.size[1:]:
            pitch.append(p)
            p *= n
        at = reduce(lambda a, b: a + b, [i * k for i, k in list(zip(local, pitch))[1:]], F.floor(local[0] / F.lit(8)))
        return at.cast("long"), (local[0] % 8).cast("int")

    def voxel_in_volume(self, voxel: list[Column]) -> Column:
        return self._within(voxel, (0,) * len(voxel), self.grid.shape)

    def voxel_in_process_area(self, voxel: list[Column]) -> Column:
        return self._within(voxel, *self.bounds)

    def local_in_process_area(self, local: list[Column]) -> Column:
        return self._within(local, (0,) * len(local), self.size)

    def chunk_local_in_process_area(self, index: list[Column]) -> Column:
        return self._within(index, (0,) * len(index), self.grid.stored_size(self.chunk))

    @staticmethod
    def _within(index: list[Column], low, high) -> Column:
        return reduce(lambda a, b: a & b, [(i >= a) & (i < b) for i, a, b in zip(index, low, high)])

    def relative_position(self, voxel: Column, d: int) -> Column:
        """0 at the first and 1 at the last sample of an axis."""
        n = self.grid.shape[d]
        return voxel / F.lit(float(max(n - 1, 1)))

    def coordinate(self, voxel: Column, d: int, axis: Axis) -> Column:
        return F.lit(axis.coord_min) + voxel * F.lit(axis.step)

    # --- compositions ---

    def chunk_local_to_voxel(self, index: list[Column]) -> list[Column]:
        return self.local_to_voxel(self.chunk_local_to_local(index))

    def chunk_local_to_offset(self, index: list[Column]) -> Column:
        return self.local_to_offset(self.chunk_local_to_local(index))

    def offset_to_voxel(self, offset: Column) -> list[Column]:
        return self.local_to_voxel(self.offset_to_local(offset))

    def offset_to_chunk_local(self, offset: Column) -> list[Column]:
        return self.local_to_chunk_local(self.offset_to_local(offset))

    def voxel_to_bit_offset(self, voxel: list[Column]) -> tuple[Column, Column]:
        return self.bit_offset(self.voxel_to_local(voxel))

    def chunk_local_to_bit_offset(self, index: list[Column]) -> tuple[Column, Column]:
        return self.bit_offset(self.chunk_local_to_local(index))

    def bit_offset_to_local(self, byte: Column, bit: Column) -> list[Column]:
        """The inverse of ``bit_offset``."""
        row = -(-self.size[0] // 8)
        out, rest = [F.pmod(byte, F.lit(row)) * 8 + bit], F.floor(byte / F.lit(row))
        for n in self.size[1:]:
            out.append(F.pmod(rest, F.lit(n)))
            rest = F.floor(rest / F.lit(n))
        return out

    def local_in_volume(self, local: list[Column]) -> Column:
        return self.voxel_in_volume(self.local_to_voxel(local))

    def chunk_local_in_volume(self, index: list[Column]) -> Column:
        return self.voxel_in_volume(self.chunk_local_to_voxel(index))

    def relative_to_voxel(self, relative: Column, d: int) -> Column:
        """The voxel nearest a relative position on an axis."""
        return F.floor(relative * F.lit(float(max(self.grid.shape[d] - 1, 1))) + 0.5)

    def local_to_relative(self, local: list[Column], d: int) -> Column:
        return self.relative_position(self.local_to_voxel(local)[d], d)

    def coordinate_to_voxel(self, coordinate: Column, d: int, axis: Axis) -> Column:
        """The voxel nearest a coordinate; 0 on an axis of one sample."""
        return F.floor((coordinate - axis.coord_min) / F.lit(axis.step) + 0.5) if axis.step else F.lit(0).cast("long")

    def local_to_coordinate(self, local: list[Column], d: int, axis: Axis) -> Column:
        return self.coordinate(self.local_to_voxel(local)[d], d, axis)

    def voxel_to_world(self, voxel: list[Column], transformer) -> tuple[Column, Column, Column]:
        return transformer.voxel_to_world(dict(enumerate(voxel)))

    def local_to_world(self, local: list[Column], transformer) -> tuple[Column, Column, Column]:
        return self.voxel_to_world(self.local_to_voxel(local), transformer)

    def world_to_voxel(self, world, transformer) -> list[Column]:
        """The nearest voxel, by dimension."""
        found = transformer.ijk_to_voxel(transformer.position_to_index(transformer.world_to_ijk(world)))
        return [found[d] for d in range(3)]

    def world_to_local(self, world, transformer) -> list[Column]:
        return self.voxel_to_local(self.world_to_voxel(world, transformer))
