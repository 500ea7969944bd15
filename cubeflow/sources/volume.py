"""Volumes at rest: a directory with a descriptor, brick tables by channel and level, trace tables and metadata.

``Volume`` is the request API: subsets, slices, samples, traces, projections, chunk access, writing
with or without levels of detail, copying and maintenance.  Reads plan their bricks first, so that
predicates on brick positions reach the Parquet scan, and are lazy DataFrames like any other.

A table is written to a folder of its own and then entered in the list of tables, which is replaced in
one rename: a writer that dies leaves what was there, and readers see a table old or new.  Values are
stored in their channel's own type.
"""

from __future__ import annotations

import json
import math
import threading
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeflow.descriptor import Channel, Descriptor, InvalidArgument, InvalidOperation, MetadataItem, ReadError, buffer_bytes, can_remap, check_region, dimension_groups, layer_name, subset_shape
from cubeflow.functions import convert
from cubeflow.functions.coords import Transformer, transformer_from_metadata
from cubeflow.operators import bricks, interp, stats, subset
from cubeflow.plans.grid import Grid, chunk_grid

METADATA_SCHEMA = "category string, name string, type string, int_v array<int>, float_v array<float>, double_v array<double>, string_v string, blob binary, at long"
ACCESS_MODES = ("ReadOnly", "ReadWrite", "Create", "CreateWithoutLODGeneration", "ReadWriteWithoutLODGeneration")
PRODUCE_STATUS = ("Normal", "Remapped", "Unavailable")
_MEMORY: dict[str, dict] = {}
#: The list of a dataset's tables.
TABLES = "tables.json"


def metadata_frame(spark: SparkSession, items: list[MetadataItem]) -> DataFrame:
    """One row an item, in the order given."""
    rows = []
    for at, m in enumerate(items):
        many = list(m.value) if isinstance(m.value, (tuple, list)) else [m.value]
        rows.append((m.category, m.name, m.type, many if m.type.startswith("Int") else None, [float(v) for v in many] if m.type.startswith("Float") else None, [float(v) for v in many] if m.type.startswith("Double") else None, m.value if m.type == "String" else None, m.value if m.type == "BLOB" else None, at))
    return spark.createDataFrame(rows, METADATA_SCHEMA)


def select_metadata(frame: DataFrame, category: str | None = None, name: str | None = None) -> DataFrame:
    if category is not None:
        frame = frame.where(F.col("category") == category)
    return frame if name is None else frame.where(F.col("name") == name)


def copy_metadata(target: DataFrame, source: DataFrame, category: str) -> DataFrame:
    """``target`` with the items of ``source`` in a category; those of the same type and name are replaced."""
    new = source.where(F.col("category") == category)
    kept = target.join(new.select("category", "name", "type"), ["category", "name", "type"], "left_anti")
    return kept.unionByName(new)


def clear_metadata(frame: DataFrame, category: str, name: str | None = None) -> DataFrame:
    gone = F.col("category") == category
    return frame.where(~(gone if name is None else gone & (F.col("name") == name)))


class Request:
    """A request under way: it runs in a thread of its own, and its jobs carry a tag, by which they can be cancelled."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame, self.tag, self._rows, self._cancelled = frame, f"request-{uuid.uuid4().hex}", None, False
        self._thread: threading.Thread | None = None
        self._error: BaseException | None = None

    def submit(self) -> Request:
        """Starts the request, once, and returns at once."""
        if self._cancelled:
            raise InvalidOperation("the request was cancelled")
        if self._thread is None:
            self._thread = threading.Thread(target=self._run, name=self.tag, daemon=True)
            self._thread.start()
        return self

    def _run(self) -> None:
        sc = self.frame.sparkSession.sparkContext
        sc.addJobTag(self.tag)
        try:
            self._rows = self.frame.collect()
        except BaseException as e:  # handed to whoever waits
            self._error = e
        finally:
            sc.removeJobTag(self.tag)

    def wait(self, timeout: float | None = None) -> list:
        """The request's rows; TimeoutError if it has not ended in so many seconds, after which it still goes on."""
        self.submit()._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(f"the request has not ended in {timeout} s")
        if self._cancelled:
            raise InvalidOperation("the request was cancelled")
        if self._error is not None:
            raise self._error
        return self._rows

    @property
    def is_completed(self) -> bool:
        return self._rows is not None

    @property
    def is_cancelled(self) -> bool:
        return self._cancelled

    def cancel(self) -> None:
        self._cancelled = True
        self.frame.sparkSession.sparkContext.cancelJobsWithTag(self.tag)

    def completion_factor(self) -> float:
        """Share of the running jobs' tasks that have ended."""
        if self.is_completed:
            return 1.0
        tracker = self.frame.sparkSession.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getActiveJobsIds() for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
        total = sum(s.numTasks for s in stages if s)
        return sum(s.numCompletedTasks for s in stages if s) / total if total else 0.0


class Volume:
    """An open dataset at a path that Spark can read, or, as memory://name, in the session."""

    def __init__(self, spark: SparkSession, path: str, descriptor: Descriptor, mode: str = "ReadOnly") -> None:
        if mode not in ACCESS_MODES:
            raise InvalidArgument(f"unknown access mode {mode}")
        self.spark, self.path, self.descriptor, self.mode = spark, path.rstrip("/"), descriptor, mode

    # --- open, create, close ---

    @classmethod
    def create(cls, spark: SparkSession, path: str, descriptor: Descriptor, metadata: list[MetadataItem] = (), mode: str = "Create") -> Volume:
        """A new dataset; fails if there is one at the path."""
        v = cls(spark, path, descriptor.validate(), mode)
        if v._in_memory:
            if v.path in _MEMORY:
                raise InvalidOperation(f"{path} exists")
            _MEMORY[v.path] = {"descriptor": descriptor, "tables": {}}
        else:
            spark.createDataFrame([(descriptor.to_json(),)], "json string").coalesce(1).write.mode("errorifexists").text(f"{v.path}/descriptor")
        v._write("metadata", metadata_frame(spark, list(metadata)))
        return v

    @classmethod
    def open(cls, spark: SparkSession, path: str, mode: str = "ReadOnly") -> Volume:
        path = path.rstrip("/")
        if path.startswith("memory://"):
            if path not in _MEMORY:
                raise ReadError(f"nothing at {path}")
            return cls(spark, path, _MEMORY[path]["descriptor"], mode)
        try:
            text = spark.read.text(f"{path}/descriptor", wholetext=True).first()[0]
        except Exception as e:
            raise ReadError(f"no dataset at {path}: {e}") from e
        return cls(spark, path, Descriptor.from_json(text), mode)

    def close(self) -> None:
        """Nothing is pending: every write is committed when it returns.  The object takes no more writes."""
        self.mode = "Closed"

    def __enter__(self) -> Volume:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def _in_memory(self) -> bool:
        return self.path.startswith("memory://")

    def _tables(self) -> dict[str, dict]:
        """What is stored: by name its folder and schema."""
        where = self._hadoop(TABLES)
        store = self._store(where)
        if not store.exists(where):
            return {}
        jvm, stream = self.spark.sparkContext._jvm, store.open(where)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _hadoop(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _store(self, where):
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, tables: dict[str, dict]) -> None:
        """Replaces the list of tables."""
        sc = self.spark.sparkContext
        new, old = self._hadoop(f"{TABLES}-{uuid.uuid4().hex}"), self._hadoop(TABLES)
        out = self._store(new).create(new, True)
        out.write(bytearray(json.dumps(tables, indent=1).encode()))
        out.close()
        over = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        new, old = self._store(new).makeQualified(new), self._store(old).makeQualified(old)
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration()).rename(new, old, over)

    def _write(self, name: str, df: DataFrame) -> None:
        if self.mode in ("ReadOnly", "Closed"):
            raise InvalidOperation(f"the dataset is {self.mode}")
        if self._in_memory:
            _MEMORY[self.path]["tables"][name] = df.cache()
            return
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        self._list(self._tables() | {name: {"folder": folder, "schema": df.schema.json()}})

    def _read(self, name: str) -> DataFrame:
        tables = _MEMORY[self.path]["tables"] if self._in_memory else self._tables()
        if name not in tables:
            raise ReadError(f"{self.path} has no {name}")
        if self._in_memory:
            return tables[name]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(tables[name]["schema"]))).parquet(f"{self.path}/{tables[name]['folder']}")

    def vacuum(self) -> int:
        """Deletes the folders of tables that were replaced; their number.  Not while others read them."""
        if self._in_memory:
            return 0
        tables = self._tables()
        live, gone = {t["folder"] for t in tables.values()}, 0
        for parent in {f.rpartition("/")[0] for f in live}:
            where = self._hadoop(parent) if parent else self._hadoop(".")
            for status in self._store(where).listStatus(where):
                name = f"{parent}/{status.getPath().getName()}".lstrip("/")
                if status.isDirectory() and name not in live and name.rpartition("-")[0] in tables:
                    self._store(where).delete(status.getPath(), True)
                    gone += 1
        return gone

    # --- layers ---

    def grid(self, lod: int = 0, dims: tuple[int, ...] | None = None) -> Grid:
        return Grid.of(self.descriptor, dims, lod)

    def _level_grid(self, lod: int, dims: tuple[int, ...] | None = None) -> Grid:
        """The grid of a stored level in its own voxels."""
        g = self.grid(lod, dims)
        return Grid(self.level_shape(lod), g.dims, g.brick, 0, g.neg_margin, g.pos_margin, -1)

    def level_shape(self, lod: int) -> tuple[int, ...]:
        keep = self.descriptor.layout.full_res_dim
        return tuple(n if d == keep or d > 2 else ((n - 1) >> lod) + 1 for d, n in enumerate(self.descriptor.shape))

    def _layer(self, channel: Channel, lod: int, dims: tuple[int, ...] | None = None) -> str:
        g = self.grid(lod, dims)
        return f"layers/{layer_name(g.dims, lod, None if channel.name == self.descriptor.channels[0].name else channel.name)}"

    def write(self, voxels: DataFrame, channel: int | str = 0, dims: tuple[int, ...] | None = None, lods: bool | None = None) -> None:
        """Stores a channel's voxels as bricks, and its levels of detail unless the access mode leaves them out."""
        c = self.descriptor.channel(channel)
        if c.mapping == "PerTrace":
            raise InvalidOperation(f"{c.name} is a PerTrace channel; use write_traces")
        lods = not self.mode.endswith("WithoutLODGeneration") if lods is None else lods
        level = self._typed(voxels, c)
        for lod in range(self.descriptor.layout.lods + 1 if lods else 1):
            if lod:
                # from the level just stored, so that each is computed once
                level = self._decimated(self.voxels(channel, lod - 1, dims), c)
            self._write(self._layer(c, lod, dims), bricks.to_bricks(level, self._level_grid(lod, dims)))

    def _typed(self, voxels: DataFrame, c: Channel) -> DataFrame:
        """Values in the channel's own type; components are fields c0, c1, ... of a struct."""
        return voxels.withColumn("value", F.col("value").cast(c.spark_type))

    def _decimated(self, level: DataFrame, c: Channel) -> DataFrame:
        return (subset.decimate_bits if c.format == "1Bit" else subset.decimate)(level, self.descriptor.layout.full_res_dim)

    def write_traces(self, rows: DataFrame, channel: str) -> None:
        """Stores a PerTrace channel: (d1, ..., values)."""
        self._write(f"layers/{channel}", rows)

    def traces_of(self, channel: str) -> DataFrame:
        return self._read(f"layers/{channel}")

    def bricks(self, channel: int | str = 0, lod: int = 0, dims: tuple[int, ...] | None = None) -> DataFrame:
        return self._read(self._layer(self.descriptor.channel(channel), lod, dims))

    def voxels(self, channel: int | str = 0, lod: int = 0, dims: tuple[int, ...] | None = None) -> DataFrame:
        return bricks.from_bricks(self.bricks(channel, lod, dims), self._level_grid(lod, dims))

    def produce_status(self, dims: tuple[int, ...], lod: int = 0, channel: int | str = 0) -> str:
        """Normal if stored, Remapped if it can be made of what is stored, else Unavailable."""
        stored = self.stored_layers(channel)
        if (tuple(dims), lod) in stored:
            return "Normal"
        return "Remapped" if any(at <= lod and can_remap(g, tuple(dims)) for g, at in stored) else "Unavailable"

    def stored_layers(self, channel: int | str = 0) -> set[tuple[tuple[int, ...], int]]:
        c = self.descriptor.channel(channel)
        tables = _MEMORY[self.path]["tables"] if self._in_memory else self._tables()
        levels = range(self.descriptor.layout.lods + 1)
        return {(g, lod) for g in dimension_groups(self.descriptor.dimensionality) for lod in levels if self._layer(c, lod, g) in tables}

    def layers(self) -> DataFrame:
        """(channel, dims, lod, status, chunks, valid_chunks, constant_chunks, samples): what is stored of each layer.

        chunks is null where 64 bits do not hold it.
        """
        out = self.spark.createDataFrame([], "channel string, dims string, lod int, status string, chunks long, valid_chunks long, constant_chunks long, samples long")
        for c in self.descriptor.channels:
            if c.mapping == "Direct":
                for g, lod in sorted(self.stored_layers(c.name)):
                    grid = self._level_grid(lod, g)
                    own = self.bricks(c.name, lod, g).agg(F.count("*").alias("valid_chunks"), F.count("const_value").alias("constant_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
                    about = [F.lit(c.name).alias("channel"), F.lit("".join(map(str, g))).alias("dims"), F.lit(lod).alias("lod"), F.lit("Normal").alias("status"), (F.lit(grid.total) if grid.numbered else F.lit(None)).cast("long").alias("chunks")]
                    out = out.unionByName(own.select(*about, "valid_chunks", "constant_chunks", "samples"))
        return out

    # --- requests ---

    def _source(self, dims: tuple[int, ...] | None, lod: int, channel: int | str) -> tuple[tuple[int, ...], int]:
        """The stored layer to read: the wished one, else another group's of its level."""
        wanted = self.grid(0, dims).dims
        stored = self.stored_layers(channel)
        if not stored:
            raise ReadError(f"channel {channel} is not stored")
        for g in (wanted, *sorted(g for g, at in stored if at == lod and can_remap(g, wanted))):
            if (g, lod) in stored:
                return g, lod
        raise InvalidOperation(f"level {lod} of {wanted} is not available")

    def _nearest(self, dims: tuple[int, ...] | None, lod: int, channel: int | str) -> tuple[tuple[int, ...], int]:
        """The stored layer from which a level can be read or made: the highest at or below it."""
        for at in range(lod, -1, -1):
            try:
                return self._source(dims, at, channel)
            except InvalidOperation:
                if not at:
                    raise

    def subset(self, low, high, lod: int = 0, channel: int | str = 0, dims=None, fmt: str | None = None, replacement: float | None = None) -> DataFrame:
        """A hyper-rectangle in voxels of full resolution; indices count from its low end."""
        low, high = tuple(low), tuple(high)
        layout, c = self.descriptor.layout, self.descriptor.channel(channel)
        if c.mapping == "PerTrace":
            return self._trace_subset(low, high, lod, c, fmt, replacement)
        check_region(self.descriptor.shape, low, high, lod, layout.lods)
        g, stored_lod = self._nearest(dims, lod, channel)
        keep = layout.full_res_dim
        shift = [0 if d == keep or d > 2 else lod for d in range(len(low))]
        first = tuple(a >> s for a, s in zip(low, shift))
        last = tuple(f + n for f, n in zip(first, subset_shape(low, high, 0) if not lod else tuple(((b - a - 1) >> s) + 1 for a, b, s in zip(low, high, shift))))
        shape = self.level_shape(lod)
        last = tuple(min(b, n) for b, n in zip(last, shape))
        # a level that is not stored is made of the one below that is
        up = [0 if d == keep or d > 2 else lod - stored_lod for d in range(len(low))]
        under = self.level_shape(stored_lod)
        grid = self._level_grid(stored_lod, g)
        out = bricks.subset_bricked(self.bricks(channel, stored_lod, g), grid, tuple(a << u for a, u in zip(first, up)), tuple(min(b << u, n) for b, u, n in zip(last, up, under)))
        for _ in range(lod - stored_lod):
            out = self._decimated(out, c)
        return self._delivered(out, first, last, c, fmt, replacement)

    def _delivered(self, out: DataFrame, first: tuple[int, ...], last: tuple[int, ...], c: Channel, fmt: str | None, replacement: float | None) -> DataFrame:
        """Values of a region as asked for: filled, converted (each component), counted from its low end."""
        if replacement is not None:
            fill = F.lit(replacement).cast(c.spark_type) if c.components == 1 else F.struct(*[F.lit(replacement).cast(f.dataType).alias(f.name) for f in c.spark_type])
            out = subset.densified(out, first, last).withColumn("value", F.coalesce("value", fill))
        value = F.col("value")
        if fmt is not None:
            one = lambda v: convert.convert(v if c.format == "1Bit" else v.cast("double"), c, fmt, replacement)
            value = one(value) if c.components == 1 else F.when(value.isNotNull(), F.struct(*[one(value[f.name]).alias(f.name) for f in c.spark_type]))
        return out.select(*[(F.col(f"d{d}") - a).alias(f"d{d}") for d, a in enumerate(first)], value.alias("value"))

    def _trace_subset(self, low, high, lod: int, c: Channel, fmt: str | None, replacement: float | None) -> DataFrame:
        """A region of a PerTrace channel, whose dimension 0 counts its values; it has no levels of detail."""
        check_region((c.mapped_values, *self.descriptor.shape[1:]), low, high, lod, 0)
        rows = self.traces_of(c.name)
        names = [f"d{d}" for d in range(1, len(low))]
        for name, a, b in zip(names, low[1:], high[1:]):
            rows = rows.where((F.col(name) >= a) & (F.col(name) < b))
        own = F.slice("values", low[0] + 1, high[0] - low[0])
        out = rows.select(*names, F.posexplode(own).alias("d0", "value"))
        out = out.select((F.col("d0") + low[0]).cast("long").alias("d0"), *names, F.col("value").cast(c.spark_type).alias("value"))
        return self._delivered(out, low, high, c, fmt, replacement)

    def slice(self, dim: int, index: int, **options) -> DataFrame:
        low, high = [0] * self.descriptor.dimensionality, list(self.descriptor.shape)
        low[dim], high[dim] = index, index + 1
        return self.subset(low, high, **options).drop(f"d{dim}")

    def _near_positions(self, positions: DataFrame, lod: int, channel, along: int | None = None) -> tuple[DataFrame, tuple[int, ...]]:
        """Voxels of the bricks that positions and their taps lie in, or all such along a dimension: the others are not read."""
        g, _ = self._source(None, lod, channel)
        grid, shape = self._level_grid(lod, g), self.level_shape(lod)
        taps = positions.select(F.explode(interp.tap_indices("cubic", shape)).alias("t")).select("t.*")
        brick = grid.brick_columns()
        names = [f"b{d}" for d in range(len(shape)) if d != along]
        needed = taps.select(*[c for d, c in enumerate(brick) if d != along]).distinct()
        own = self.bricks(channel, lod, g).join(needed, names, "left_semi")
        return bricks.from_bricks(own, grid), shape

    def samples(self, positions: DataFrame, lod: int = 0, channel: int | str = 0, method: str = "cubic", replacement: float | None = None) -> DataFrame:
        """(id, value) at positions (id, p0, p1, ...) of full resolution."""
        keep = self.descriptor.layout.full_res_dim
        if lod:
            names = [f"p{d}" for d in range(self.descriptor.dimensionality)]
            positions = positions.select("id", *[(F.col(p) / (1 if d == keep else 1 << lod)).alias(p) for d, p in enumerate(names)])
        voxels, shape = self._near_positions(positions, lod, channel)
        return interp.samples(positions, voxels, shape, method, self.descriptor.channel(channel), replacement)

    def traces(self, positions: DataFrame, trace_dim: int = 0, lod: int = 0, channel: int | str = 0, method: str = "cubic", replacement: float | None = None) -> DataFrame:
        """(id, sample, value): whole lines along a dimension."""
        keep, shape = self.descriptor.layout.full_res_dim, self.level_shape(lod)
        if not 0 <= trace_dim < len(shape):
            raise InvalidArgument(f"trace dimension {trace_dim}")
        # a line meets the bricks that its positions' taps lie in, whatever those are along the line
        at = [F.lit(0.5).alias(f"p{d}") if d == trace_dim else (F.col(f"p{d}") / (1 if d == keep else 1 << lod)).alias(f"p{d}") for d in range(len(shape))]
        voxels, _ = self._near_positions(positions.select("id", *at), lod, channel, along=trace_dim)
        return interp.traces(positions, voxels, shape, trace_dim, method, lod, self.descriptor.layout.full_res_dim, channel=self.descriptor.channel(channel), replacement=replacement)

    def project(self, plane, along: int, low, high, lod: int = 0, channel: int | str = 0, method: str = "linear", replacement: float | None = None) -> DataFrame:
        """A plane's samples, projected along a dimension; only bricks that the plane meets are read."""
        check_region(self.descriptor.shape, tuple(low), tuple(high), lod, self.descriptor.layout.lods)
        if lod and self.descriptor.layout.full_res_dim >= 0:
            raise InvalidOperation("planes at a level of detail need all dimensions reduced")
        g, _ = self._source(None, lod, channel)
        grid = self._level_grid(lod, g)
        near = self._near_plane(self.bricks(channel, lod, g), grid, plane, along, lod)
        return interp.project(bricks.from_bricks(near, grid), self.descriptor.shape, plane, along, tuple(low), tuple(high), method, lod, self.descriptor.channel(channel), replacement=replacement)

    def _near_plane(self, rows: DataFrame, grid: Grid, plane, along: int, lod: int) -> DataFrame:
        """Bricks between the smallest and largest height of the plane over their corners, two voxels to spare."""
        if not plane[along]:
            raise InvalidArgument("the plane is perpendicular to the projection")
        scale = 1 << lod
        low, high = F.lit(float(plane[3])), F.lit(float(plane[3]))
        for d in range(3):
            if d != along:
                a, b = (F.col(f"b{d}") * grid.size(d) - 2) * scale * float(plane[d]), ((F.col(f"b{d}") + 1) * grid.size(d) + 2) * scale * float(plane[d])
                low, high = low + F.least(a, b), high + F.greatest(a, b)
        z1, z2 = low / -float(plane[along]), high / -float(plane[along])
        top = float(self.descriptor.shape[along])
        clip = lambda z: F.least(F.greatest(z, F.lit(0.0)), F.lit(top))
        return rows.where((clip(F.greatest(z1, z2)) / scale + 2 >= F.col(f"b{along}") * grid.size(along)) & (clip(F.least(z1, z2)) / scale - 2 <= (F.col(f"b{along}") + 1) * grid.size(along)))

    def prefetch(self, chunk: int, lod: int = 0, channel: int | str = 0) -> DataFrame:
        """One chunk, kept in memory."""
        return self.chunk(chunk, lod, channel).cache()

    def chunk(self, chunk: int, lod: int = 0, channel: int | str = 0, dims=None) -> DataFrame:
        grid = self._level_grid(lod, dims)
        out = self.bricks(channel, lod, dims)
        for d, b in enumerate(grid.position(chunk)):
            out = out.where(F.col(f"b{d}") == b)
        return out

    def chunk_at(self, voxel: tuple[int, ...], lod: int = 0) -> int | None:
        return self.grid(lod).chunk_at(voxel)

    def chunk_grid(self, lod: int = 0, dims=None) -> DataFrame:
        return chunk_grid(self.spark, self.grid(lod, dims))

    def chunk_hashes(self, lod: int = 0, channel: int | str = 0) -> DataFrame:
        return self.bricks(channel, lod).select("chunk", "hash", "const_value")

    def value_range(self, channel: int | str = 0, percentile: float = 99.5) -> DataFrame:
        return stats.value_range(self.voxels(channel).withColumn("value", F.col("value").cast("double")), percentile)

    def update(self, changes: DataFrame, channel: int | str = 0) -> None:
        """Sets single voxels, in every stored dimension group, and makes anew what the levels of detail have of them.

        Only bricks with changes are put together anew; each layer is then switched as a whole.
        """
        c, keep = self.descriptor.channel(channel), self.descriptor.layout.full_res_dim
        changes = self._typed(changes, c)
        stored = self.stored_layers(channel)
        for g, lod in sorted(stored, key=lambda layer: (layer[0], layer[1])):
            if lod and (g, lod - 1) not in stored:
                raise InvalidOperation(f"level {lod} of {g} has no level below to be made of")
            grid, old = self._level_grid(lod, g), self.bricks(channel, lod, g)
            at = changes.select(*[(F.col(f"d{d}") if not lod or d == keep or d > 2 else F.shiftright(f"d{d}", lod)).alias(f"d{d}") for d in range(len(grid.shape))])
            touched = at.select(*grid.brick_columns()).distinct()
            touched = touched.select(grid.chunk_name().alias("chunk"), "*")
            if lod:
                lower = self._level_grid(lod - 1, g)
                own = self.bricks(channel, lod - 1, g).join(bricks.below(touched, grid, lower, keep), "chunk", "left_semi")
                new = self._decimated(bricks.from_bricks(own, lower), c)
            else:
                new = interp.updated(bricks.from_bricks(old.join(touched.select("chunk"), "chunk", "left_semi"), grid), changes)
            rest = old.join(touched.select("chunk"), "chunk", "left_anti")
            self._write(self._layer(c, lod, g), rest.unionByName(bricks.to_bricks(new, grid)))

    # --- metadata and information ---

    def metadata(self, category: str | None = None, name: str | None = None) -> DataFrame:
        return select_metadata(self._read("metadata"), category, name).orderBy("at")

    def set_metadata(self, items: list[MetadataItem]) -> None:
        old = [_item(r) for r in self.metadata().collect()]
        new = {(m.category, m.name, m.type): m for m in items}
        kept = [m for m in old if (m.category, m.name, m.type) not in new]
        self._write("metadata", metadata_frame(self.spark, kept + list(items)))

    def transformer(self) -> Transformer:
        values = {(r.category, r.name): _item(r).value for r in self.metadata().collect()}
        return transformer_from_metadata(self.descriptor.axes, values)

    def info(self) -> str:
        """The dataset as JSON: layout, axes, channels, layers and metadata keys."""
        d = json.loads(self.descriptor.to_json())
        d["layers"] = [r.asDict() for r in self.layers().collect()]
        d["metadata"] = [{"category": r.category, "name": r.name, "type": r.type} for r in self.metadata().collect()]
        return json.dumps(d, indent=1)

    def buffer_bytes(self, low, high, lod: int = 0, fmt: str | None = None, channel: int | str = 0) -> int:
        c = self.descriptor.channel(channel)
        return buffer_bytes(low, high, lod, fmt or c.format, c.components, self.descriptor.layout.full_res_dim)

    # --- copies and maintenance ---

    def copy_to(self, path: str, layout: dict | None = None, resume: bool = False) -> Volume:
        """A copy, re-bricked if the layout changes; resumed, only bricks that differ are written."""
        d = self.descriptor.with_layout(**layout) if layout else self.descriptor
        items = [_item(r) for r in self.metadata().collect()]
        if resume:
            out = Volume.open(self.spark, path, "ReadWrite")
            if out.descriptor.layout_hash() != d.layout_hash():
                raise InvalidOperation("a copy can only be resumed with the same layout")
        else:
            out = Volume.create(self.spark, path, d, items)
        for c in d.channels:
            if c.mapping == "PerTrace":
                try:
                    out.write_traces(self.traces_of(c.name), c.name)
                except ReadError:
                    pass
                continue
            if layout:
                out.write(self.voxels(c.name), c.name)
                continue
            for g, lod in sorted(self.stored_layers(c.name)):
                mine, name = self.bricks(c.name, lod, g), out._layer(c, lod, g)
                if not resume or (g, lod) not in out.stored_layers(c.name):
                    out._write(name, mine)
                    continue
                theirs = out.bricks(c.name, lod, g)
                new = bricks.changed(mine, theirs)
                if new.limit(1).count():
                    out._write(name, theirs.join(new.select("chunk"), "chunk", "left_anti").unionByName(new))
        return out

    def remove_chunks(self, first: int, last: int, channel: int | str = 0) -> None:
        """Takes bricks of a range of numbers out of the full-resolution layer."""
        grid = self._level_grid(0)
        first, last = max(first, 0), min(last, grid.total - 1)
        if first > last:
            return
        # in the order of numbers, which is that of positions from the last dimension on
        at = lambda number: F.struct(*[F.lit(b).cast("long") for b in reversed(grid.position(number))])
        own = F.struct(*[F.col(f"b{d}").cast("long") for d in reversed(range(len(grid.shape)))])
        self._write(self._layer(self.descriptor.channel(channel), 0), self.bricks(channel).where(~own.between(at(first), at(last))))

    def check(self, channel: int | str = 0, lod: int = 0) -> DataFrame:
        """Bricks whose stored values, count or position disagree: none in a sound dataset."""
        grid = self._level_grid(lod)
        b = self.bricks(channel, lod)
        within = reduce(lambda a, c: a & c, [F.col(f"b{d}").between(0, n - 1) for d, n in enumerate(grid.counts)])
        sound = (grid.chunk_name() == F.col("chunk")) & within & (F.col("const_value").isNotNull() | (F.size("values") == F.col("n")))
        return b.where(~sound)


def _item(r) -> MetadataItem:
    many = next((list(v) for v in (r.int_v, r.float_v, r.double_v) if v is not None), None)
    value = r.string_v if r.type == "String" else bytes(r.blob) if r.type == "BLOB" else many[0] if len(many) == 1 else tuple(many)
    return MetadataItem(r.category, r.name, r.type, value)


def from_numpy(spark: SparkSession, array) -> DataFrame:
    """The voxel view of an array whose last axis is dimension 0; NaN is NoValue."""
    import numpy as np
    import pandas as pd

    flat = np.asarray(array, dtype=np.float64).ravel()
    index = np.unravel_index(np.arange(len(flat)), np.shape(array))
    columns = {f"d{d}": index[array.ndim - 1 - d].astype(np.int64) for d in range(array.ndim)}
    frame = spark.createDataFrame(pd.DataFrame(columns | {"value": flat}))
    return frame.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def from_npz(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The voxel view of an array in a .npy or .npz file (its first one, if not named) that the driver can open."""
    import numpy as np

    data = np.load(path)
    return from_numpy(spark, data if isinstance(data, np.ndarray) else data[name or data.files[0]])


def to_numpy(df: DataFrame, shape: tuple[int, ...], novalue: float = math.nan):
    """A (small) result as an array whose last axis is dimension 0."""
    import numpy as np

    out = np.full(tuple(reversed(shape)), novalue)
    names = subset.axes_of(df)
    pdf = df.toPandas()
    out[tuple(pdf[n].to_numpy(dtype=np.int64) for n in reversed(names))] = pdf["value"].astype(float).fillna(novalue)
    return out
