"""Partition arithmetic: which chunk holds which voxels, in plain Python and as DataFrame columns.

Chunk numbers are mixed-radix with dimension 0 running fastest.  Dimensions outside the chunks'
group have a chunk for each sample.  Where a grid has more chunks than 64-bit numbers, columns name
a chunk by its position, array<long>; plain Python numbers have no such limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeflow.descriptor import MOST_CHUNKS, Descriptor, IndexOutOfRange, InvalidArgument


def _over(c: Column, n: int) -> Column:
    """floor(c / n) in integers, as doubles do not hold all of 64 bits."""
    c = c.cast("long")
    return F.shiftright(c, n.bit_length() - 1) if n & (n - 1) == 0 else F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


@dataclass(frozen=True)
class Grid:
    """Chunks of one dimension group at one level of detail."""

    shape: tuple[int, ...]
    dims: tuple[int, ...]
    brick: int
    lod: int = 0
    neg_margin: int = 0
    pos_margin: int = 0
    full_res_dim: int = -1

    @classmethod
    def of(cls, d: Descriptor, dims: tuple[int, ...] | None = None, lod: int = 0) -> Grid:
        dims = dims or tuple(range(min(3, d.dimensionality)))
        if not 2 <= len(dims) <= 3 or sorted(set(dims)) != list(dims) or dims[-1] >= d.dimensionality:
            raise InvalidArgument(f"dimension group {dims}")
        if not 0 <= lod <= d.layout.lods:
            raise InvalidArgument(f"level {lod} is not produced")
        two = len(dims) == 2
        return cls(d.shape, dims, d.layout.effective_brick(len(dims)), lod, 0 if two else d.layout.neg_margin, 0 if two else d.layout.pos_margin, d.layout.full_res_dim)

    def size(self, dim: int) -> int:
        """Voxels that a chunk spans along a dimension, without margins."""
        if dim not in self.dims:
            return 1
        return self.brick if dim == self.full_res_dim else self.brick << self.lod

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple((n - 1) // self.size(d) + 1 for d, n in enumerate(self.shape))

    @property
    def total(self) -> int:
        return math.prod(self.counts)

    def position(self, chunk: int) -> tuple[int, ...]:
        if not 0 <= chunk < self.total:
            raise IndexOutOfRange(f"chunk {chunk} of {self.total}")
        out = []
        for n in self.counts:
            out.append(chunk % n)
            chunk //= n
        return tuple(out)

    def number(self, position: tuple[int, ...]) -> int:
        out, factor = 0, 1
        for p, n in zip(position, self.counts):
            out += p * factor
            factor *= n
        return out

    def chunk_at(self, voxel: tuple[int, ...]) -> int | None:
        """The chunk that holds a voxel; None outside the volume."""
        if any(not 0 <= v < n for v, n in zip(voxel, self.shape)):
            return None
        return self.number(tuple(v // self.size(d) for d, v in enumerate(voxel)))

    def bounds(self, chunk: int, margin: bool = False) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """[min, max) of a chunk's voxels, with or without its margins."""
        low, high = [], []
        for d, (p, n) in enumerate(zip(self.position(chunk), self.shape)):
            inside = d in self.dims and margin
            scale = 0 if d == self.full_res_dim else self.lod
            low.append(max(0, p * self.size(d) - inside * (self.neg_margin << scale)))
            high.append(min(n, (p + 1) * self.size(d) + inside * (self.pos_margin << scale)))
        return tuple(low), tuple(high)

    def stored_size(self, chunk: int, margin: bool = False) -> tuple[int, ...]:
        """Samples that a chunk stores at its level of detail."""
        low, high = self.bounds(chunk, margin)
        shift = [0 if d == self.full_res_dim or d not in self.dims else self.lod for d in range(len(low))]
        return tuple((b - a + (1 << s) - 1) >> s for a, b, s in zip(low, high, shift))

    def chunks_in(self, low: tuple[int, ...], high: tuple[int, ...]) -> list[tuple[int, int]]:
        """For each dimension the range [first, last] of chunk positions that a region meets."""
        return [(a // self.size(d), (b - 1) // self.size(d)) for d, (a, b) in enumerate(zip(low, high))]

    def mapped_chunk(self, chunk: int) -> int:
        """The chunk of a PerTrace channel, which lacks dimension 0."""
        return chunk // self.counts[0]

    def primary_chunk(self, mapped: int, along: int = 0) -> int:
        return mapped * self.counts[0] + along

    # --- columns ---

    def chunk_column(self, names: list[str] | None = None) -> Column:
        if self.total > MOST_CHUNKS:
            raise InvalidArgument(f"{self.total:,} chunks, more than {MOST_CHUNKS:,}")
        names = names or [f"d{d}" for d in range(len(self.shape))]
        out, factor = F.lit(0).cast("long"), 1
        for d, (name, n) in enumerate(zip(names, self.counts)):
            out = out + _over(F.col(name), self.size(d)) * F.lit(factor)
            factor *= n
        return out.cast("long")

    def brick_columns(self) -> list[Column]:
        """b0, b1, ...: chunk positions of the row's voxel."""
        return [_over(F.col(f"d{d}"), self.size(d)).alias(f"b{d}") for d in range(len(self.shape))]

    @property
    def numbered(self) -> bool:
        return self.total <= MOST_CHUNKS

    def no_chunk(self) -> Column:
        """What ``with_position`` adds a chunk's positions to, from dimension 0 on."""
        return F.lit(0).cast("long") if self.numbered else F.array().cast("array<long>")

    def with_position(self, chunk: Column, dim: int, position: Column) -> Column:
        return chunk + position * F.lit(math.prod(self.counts[:dim])) if self.numbered else F.concat(chunk, F.array(position))

    def chunk_name(self, positions: list[Column] | None = None) -> Column:
        """The number of the chunk at b0, b1, ..., or its position where the grid has more chunks than numbers."""
        out = self.no_chunk()
        for d, b in enumerate(positions or [F.col(f"b{d}") for d in range(len(self.shape))]):
            out = self.with_position(out, d, b)
        return out


def chunk_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """(chunk, b*, min*, max*, low*, high*, samples): every chunk's position, bounds without and with margins, and stored samples."""
    df = spark.range(grid.total).select(F.col("id").alias("chunk"))
    cols, rest, n_samples = [F.col("chunk")], F.col("chunk"), F.lit(1).cast("long")
    for d, n in enumerate(grid.counts):
        at = F.pmod(rest, F.lit(n))
        rest = F.floor((rest - at) / F.lit(n))
        size, inside = grid.size(d), d in grid.dims
        scale = 0 if d == grid.full_res_dim or not inside else grid.lod
        low, high = at * size, F.least((at + 1) * size, F.lit(grid.shape[d]))
        cols += [at.cast("long").alias(f"b{d}"), low.cast("long").alias(f"min{d}"), high.cast("long").alias(f"max{d}")]
        cols += [F.greatest(low - inside * (grid.neg_margin << scale), F.lit(0)).cast("long").alias(f"low{d}"), F.least((at + 1) * size + inside * (grid.pos_margin << scale), F.lit(grid.shape[d])).cast("long").alias(f"high{d}")]
        n_samples = n_samples * F.floor((high - low + ((1 << scale) - 1)) / F.lit(1 << scale))
    return df.select(*cols, n_samples.cast("long").alias("samples"))


def super_chunks(grids: list[Grid], chunk_column_names: list[str]) -> Column:
    """A number (a position, of more than numbers count) that chunks of several dimension groups share when they lie in one union of chunks."""
    at, factors = [], [1]
    for d in range(len(grids[0].shape)):
        size = max(g.size(d) for g in grids)
        at.append(_over(F.col(chunk_column_names[d]), size))
        factors.append(factors[-1] * ((grids[0].shape[d] - 1) // size + 1))
    if factors[-1] > MOST_CHUNKS:
        return F.array(*at)
    return sum((b * F.lit(k) for b, k in zip(at, factors)), F.lit(0).cast("long"))
