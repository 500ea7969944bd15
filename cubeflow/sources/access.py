"""Requests that give arrays: the volume API for callers who think in buffers, pages and accessors.

Results come to the driver, so this is for what fits there; everything else stays with ``Volume``,
whose DataFrames these calls are made of.  Arrays have dimension 0 last.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import functions as F

from cubeflow.descriptor import IndexOutOfRange, InvalidArgument, InvalidOperation, buffer_bytes, subset_shape
from cubeflow.sources.volume import Request, Volume, to_numpy


class ArrayRequest(Request):
    """A request whose rows fill an array."""

    def __init__(self, frame, fill) -> None:
        super().__init__(frame)
        self._fill, self._array = fill, None

    @property
    def data(self) -> np.ndarray:
        """Waits, then gives the array."""
        if self._array is None:
            if not self.is_completed:
                self.wait()
            self._array = self._fill(self._rows)
        return self._array

    def __await__(self):
        """The array; the request runs in a thread of its own meanwhile."""
        import asyncio

        return asyncio.get_running_loop().run_in_executor(None, lambda: self.data).__await__()


def _by_index(names: list[str], shape: tuple[int, ...]):
    def fill(rows) -> np.ndarray:
        out = np.full(tuple(reversed(shape)), math.nan)
        for r in rows:
            if r["value"] is not None:
                out[tuple(r[n] for n in reversed(names))] = r["value"]
        return out

    return fill


class AccessManager:
    """Requests by (min, max), positions and planes, with the usual defaults: level 0, channel 0, cubic sampling."""

    def __init__(self, volume: Volume) -> None:
        self.volume = volume

    def requestVolumeSubset(self, min, max, dimensionGroup=None, lod=0, channel=0, format=None, replacementNoValue=None) -> ArrayRequest:  # noqa: N802, A002
        frame = self.volume.subset(tuple(min), tuple(max), lod, channel, dimensionGroup, format, replacementNoValue)
        shape = subset_shape(min, max, lod, self.volume.descriptor.layout.full_res_dim)
        return ArrayRequest(frame, _by_index([f"d{d}" for d in range(len(shape))], shape))

    def requestProjectedVolumeSubset(self, min, max, voxelPlane, projectedDimension, lod=0, channel=0, interpolationMethod="nearest", replacementNoValue=None) -> ArrayRequest:  # noqa: N802, A002
        frame = self.volume.project(tuple(voxelPlane), projectedDimension, min, max, lod, channel, interpolationMethod, replacementNoValue)
        kept = [d for d in range(3) if d != projectedDimension]
        shape = tuple(((max[d] - min[d] - 1) >> lod) + 1 for d in kept)
        return ArrayRequest(frame, _by_index([f"d{d}" for d in kept], shape))

    def _positions(self, positions: Iterable):
        rows = [(k, *map(float, p)) for k, p in enumerate(positions)]
        n = self.volume.descriptor.dimensionality
        if any(len(r) < n + 1 for r in rows):
            raise InvalidArgument(f"positions have {n} coordinates")
        return len(rows), self.volume.spark.createDataFrame([r[: n + 1] for r in rows], "id long, " + ", ".join(f"p{d} double" for d in range(n)))

    def requestVolumeSamples(self, samplePositions, lod=0, channel=0, interpolationMethod="cubic", replacementNoValue=None) -> ArrayRequest:  # noqa: N802
        n, frame = self._positions(samplePositions)
        out = self.volume.samples(frame, lod, channel, interpolationMethod, replacementNoValue)
        return ArrayRequest(out, _by_index(["id"], (n,)))

    def requestVolumeTraces(self, tracePositions, traceDimension, lod=0, channel=0, interpolationMethod="cubic", replacementNoValue=None) -> ArrayRequest:  # noqa: N802
        n, frame = self._positions(tracePositions)
        out = self.volume.traces(frame, traceDimension, lod, channel, interpolationMethod, replacementNoValue)
        return ArrayRequest(out, _by_index(["sample", "id"], (self.volume.level_shape(lod)[traceDimension], n)))

    def prefetchVolumeChunk(self, chunk: int, lod=0, channel=0) -> Request:  # noqa: N802
        return Request(self.volume.prefetch(chunk, lod, channel))

    def getVolumeSubsetBufferSize(self, min, max, lod=0, channel=0, format=None) -> int:  # noqa: N802, A002
        return self.volume.buffer_bytes(min, max, lod, format, channel)

    def getProjectedVolumeSubsetBufferSize(self, min, max, projectedDimension, lod=0, format="R32") -> int:  # noqa: N802, A002
        low = [0 if d == projectedDimension else a for d, a in enumerate(min)]
        high = [1 if d == projectedDimension else b for d, b in enumerate(max)]
        return buffer_bytes(low, high, lod, format)

    def getVolumeSamplesBufferSize(self, sampleCount: int) -> int:  # noqa: N802
        return 4 * sampleCount

    def getVolumeTracesBufferSize(self, traceCount: int, traceDimension: int, lod=0) -> int:  # noqa: N802
        return 4 * traceCount * self.volume.level_shape(lod)[traceDimension]

    def getVDSProduceStatus(self, dimensionGroup, lod=0, channel=0) -> str:  # noqa: N802
        return self.volume.produce_status(tuple(dimensionGroup), lod, channel)

    def createPageAccessor(self, lod=0, channel=0, dimensionGroup=None) -> PageAccessor:  # noqa: N802
        return PageAccessor(self.volume, lod, channel, dimensionGroup)

    def createValueAccessor(self, lod=0, channel=0, interpolation=None) -> ValueAccessor:  # noqa: N802
        return ValueAccessor(self.volume, lod, channel, interpolation)


class PageAccessor:
    """Chunks as arrays; pages written are kept until ``commit``."""

    def __init__(self, volume: Volume, lod=0, channel=0, dims=None) -> None:
        self.volume, self.lod, self.channel, self.dims = volume, lod, channel, dims
        self.grid = volume._level_grid(lod, dims)
        self._written: dict[int, np.ndarray] = {}

    def __enter__(self) -> PageAccessor:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def getChunkCount(self) -> int:  # noqa: N802
        return self.grid.total

    def getChunkMinMax(self, chunk: int):  # noqa: N802
        return self.grid.bounds(chunk, margin=True)

    def getChunkMinMaxExcludingMargin(self, chunk: int):  # noqa: N802
        return self.grid.bounds(chunk)

    def getChunkIndex(self, position) -> int | None:  # noqa: N802
        return self.grid.chunk_at(tuple(position))

    def getMappedChunkIndex(self, chunk: int) -> int:  # noqa: N802
        return self.grid.mapped_chunk(chunk)

    def getChunkVolumeDataHash(self, chunk: int) -> int | None:  # noqa: N802
        """None for a chunk that is not stored, all of NoValue."""
        row = self.volume.chunk(chunk, self.lod, self.channel, self.dims).select("hash").first()
        return row and row[0]

    def readPage(self, chunk: int) -> np.ndarray:  # noqa: N802
        low, high = self.grid.bounds(chunk)
        from cubeflow.operators import bricks

        rows = bricks.from_bricks(self.volume.chunk(chunk, self.lod, self.channel, self.dims), self.grid)
        rows = rows.select(*[(F.col(f"d{d}") - a).alias(f"d{d}") for d, a in enumerate(low)], "value")
        return to_numpy(rows, tuple(b - a for a, b in zip(low, high)))

    def readPageAtPosition(self, position) -> np.ndarray | None:  # noqa: N802
        chunk = self.getChunkIndex(position)
        return None if chunk is None else self.readPage(chunk)

    def writePage(self, chunk: int, values: np.ndarray) -> None:  # noqa: N802
        """Sets a whole chunk; NaN is NoValue."""
        low, high = self.grid.bounds(chunk)
        if np.shape(values) != tuple(b - a for a, b in zip(low, high))[::-1]:
            raise InvalidArgument("the values do not have the chunk's shape")
        if self.lod:
            raise InvalidOperation("levels of detail are made from level 0")
        self._written[chunk] = np.array(values, dtype=np.float64)

    def commit(self) -> None:
        import pandas as pd

        parts = []
        for chunk, values in self._written.items():
            low, _ = self.grid.bounds(chunk)
            index = np.unravel_index(np.arange(values.size), values.shape)
            columns = {f"d{d}": index[values.ndim - 1 - d].astype(np.int64) + a for d, a in enumerate(low)}
            parts.append(pd.DataFrame(columns | {"value": values.ravel()}))
        if parts:
            frame = self.volume.spark.createDataFrame(pd.concat(parts))
            self.volume.update(frame.withColumn("value", F.when(~F.isnan("value"), F.col("value"))), self.channel)
        self._written.clear()


class ValueAccessor:
    """Single values by index, outermost dimension first; interpolated at positions if a method is given."""

    def __init__(self, volume: Volume, lod=0, channel=0, interpolation=None) -> None:
        self.volume, self.lod, self.channel, self.interpolation = volume, lod, channel, interpolation
        self._changes: dict[tuple[int, ...], float | None] = {}

    def getValues(self, indices: list) -> list:  # noqa: N802
        """One job for all of them."""
        positions = [tuple(reversed(i)) for i in indices]
        if self.interpolation is None:
            shape = self.volume.level_shape(self.lod)
            for p in positions:
                if any(not 0 <= x < n for x, n in zip(p, shape)):
                    raise IndexOutOfRange(f"{p} is not in {shape}")
            positions = [tuple(x + 0.5 for x in p) for p in positions]
            if self.lod:
                keep = self.volume.descriptor.layout.full_res_dim
                positions = [tuple(x if d == keep else x * (1 << self.lod) for d, x in enumerate(p)) for p in positions]
        request = AccessManager(self.volume).requestVolumeSamples(positions, self.lod, self.channel, self.interpolation or "nearest")
        return [None if math.isnan(v) else float(v) for v in request.data]

    def getValue(self, index):  # noqa: N802
        return self.getValues([index])[0]

    def setValue(self, index, value: float | None) -> None:  # noqa: N802
        self._changes[tuple(reversed(index))] = value

    def cancel(self) -> None:
        self._changes.clear()

    def commit(self) -> None:
        if self._changes:
            n = self.volume.descriptor.dimensionality
            schema = ", ".join(f"d{d} long" for d in range(n)) + ", value double"
            self.volume.update(self.volume.spark.createDataFrame([(*i, v) for i, v in self._changes.items()], schema), self.channel)
        self._changes.clear()
