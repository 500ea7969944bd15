"""The brick view: chunks with their voxels as arrays, statistics, hashes, re-bricking, halos, copies.

A brick row is (chunk, b0, b1, ..., at, values, n, lo, hi, const_value, hash); chunk is ``Grid.chunk_name``,
values have the type of the voxels' value.  Voxels of a brick are in order with dimension 0 fastest; ``at`` names their places and is
null where all are there.  A constant brick has no array but its value; one without any value is not
stored, as every reader fills what is missing with NoValue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeflow.descriptor import InvalidArgument, can_remap
from cubeflow.operators.subset import in_region
from cubeflow.plans.grid import Grid

BORDERS = ("none", "clear", "mirror", "repeat")


def _local_offset(grid: Grid) -> Column:
    """A voxel's place in its brick's array; bricks at the end of the volume keep the full brick's strides."""
    out, factor = F.lit(0).cast("long"), 1
    for d in range(len(grid.shape)):
        out = out + F.pmod(F.col(f"d{d}"), F.lit(grid.size(d))) * F.lit(factor)
        factor *= grid.size(d)
    return out


def to_bricks(voxels: DataFrame, grid: Grid) -> DataFrame:
    """Voxels of full resolution gathered into bricks, one shuffle on the chunk's position."""
    rows = voxels.where(F.col("value").isNotNull()).select(*grid.brick_columns(), _local_offset(grid).cast("int").alias("at"), "value")
    names = [f"b{d}" for d in range(len(grid.shape))]
    bricks = rows.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("cells"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    volume = F.lit(1).cast("long")
    for d, n in enumerate(grid.shape):
        volume = volume * F.least(F.lit(n) - F.col(f"b{d}") * grid.size(d), F.lit(grid.size(d)))
    constant = (F.col("lo") == F.col("hi")) & (F.col("n") == volume)
    at, values = F.col("cells.at"), F.col("cells.value")
    full = 1
    for d in range(len(grid.shape)):
        full *= grid.size(d)
    return bricks.select(grid.chunk_name().alias("chunk"), *names, F.when(~constant & (F.col("n") < full), at).alias("at"), F.when(~constant, values).alias("values"), "n", "lo", "hi", F.when(constant, F.col("lo")).alias("const_value"), F.xxhash64(at, values).alias("hash"))


def from_bricks(bricks: DataFrame, grid: Grid, keep: tuple[str, ...] = ()) -> DataFrame:
    """The voxel view of bricks, with the columns ``keep`` of each brick; NoValue has no rows."""
    names = [f"b{d}" for d in range(len(grid.shape))]
    sizes = [grid.size(d) for d in range(len(grid.shape))]
    total = 1
    for s in sizes:
        total *= s
    whole = F.sequence(F.lit(0), F.lit(total - 1))
    dense = F.transform("values", lambda v, i: F.struct(i.alias("at"), v.alias("values")))
    constant = F.transform(whole, lambda i: F.struct(i.alias("at"), F.col("const_value").alias("values")))
    cells = F.when(F.col("const_value").isNotNull(), constant).when(F.col("at").isNull(), dense).otherwise(F.arrays_zip("at", "values"))
    rows = bricks.select(*keep, *names, F.explode(cells).alias("c"))
    rest, cols = F.col("c.at").cast("long"), []
    for d, (s, n) in enumerate(zip(sizes, grid.shape)):
        first = F.col(f"b{d}").cast("long") * s
        # constant bricks at the end of the volume are cut to it
        rows = rows.where((F.col(f"b{d}") >= 0) & (rest % s < F.lit(n) - first))
        cols.append((first + rest % s).alias(f"d{d}"))
        rest = F.floor(rest / F.lit(s))
    return rows.select(*keep, *cols, F.col("c.values").alias("value"))


def prune(bricks: DataFrame, grid: Grid, low: tuple[int, ...], high: tuple[int, ...]) -> DataFrame:
    """Only bricks that meet a region, by predicates on stored columns that reach the file scan."""
    for d, (first, last) in enumerate(grid.chunks_in(low, high)):
        bricks = bricks.where((F.col(f"b{d}") >= first) & (F.col(f"b{d}") <= last))
    return bricks


def subset_bricked(bricks: DataFrame, grid: Grid, low: tuple[int, ...], high: tuple[int, ...]) -> DataFrame:
    return from_bricks(prune(bricks, grid, low, high), grid).where(in_region(low, high))


def below(chunks: DataFrame, grid: Grid, lower: Grid, full_res_dim: int = -1) -> DataFrame:
    """(chunk) of the level below, ``lower``, that (b0, b1, ...) of a level are made of: two along each halved dimension."""
    spots = F.array(lower.no_chunk())

    def spread(spots: Column, near: Column, d: int) -> Column:
        return F.flatten(F.transform(spots, lambda s: F.transform(near, lambda x: lower.with_position(s, d, x))))

    def halves(b: Column, n: int) -> Column:
        return F.filter(F.array(2 * b, 2 * b + 1), lambda x: x < n)

    for d, n in enumerate(lower.counts):
        b = F.col(f"b{d}").cast("long")
        spots = spread(spots, F.array(b) if d == full_res_dim or d > 2 else halves(b, n), d)
    return chunks.select(F.explode(spots).alias("chunk")).distinct()


def chunk_stats(voxels: DataFrame, grid: Grid) -> DataFrame:
    """(chunk, n, n_values, lo, hi): voxels, values and value range of every chunk that has rows."""
    return voxels.groupBy(grid.chunk_name(grid.brick_columns()).alias("chunk")).agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def is_constant() -> Column:
    return (F.col("n_values") > 0) & (F.col("lo") == F.col("hi"))


def is_novalue() -> Column:
    return F.col("n_values") == 0


def rebrick(bricks: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Bricks of one dimension group made of another's."""
    if not can_remap(source.dims, target.dims):
        raise InvalidArgument("the dimension groups share fewer than two dimensions")
    return to_bricks(from_bricks(bricks, source), target)


def border_index(i: Column, n: int, mode: str) -> Column:
    """The index that a voxel outside [0, n) is filled from; null: nothing."""
    if mode not in BORDERS:
        raise InvalidArgument(f"unknown border mode {mode}")
    if mode in ("none", "clear"):
        return F.when((i >= 0) & (i < n), i)
    if mode == "repeat":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    at = F.abs(i) % (2 * n)
    return F.when(at >= n, 2 * n - at - 1).otherwise(at)


def with_halo(voxels: DataFrame, grid: Grid) -> DataFrame:
    """(chunk, d*, value, inside): every voxel in its own chunk and in those whose margins it lies in.

    A voxel is sent to at most two chunks a dimension by arithmetic, without a join.
    """
    spots = F.array(F.struct(grid.no_chunk().alias("chunk"), F.lit(True).alias("inside")))
    brick = grid.brick_columns()
    for d, n in enumerate(grid.counts):
        size = grid.size(d)
        own = brick[d]
        scale = 0 if d == grid.full_res_dim else grid.lod
        neg, pos = ((grid.neg_margin << scale), (grid.pos_margin << scale)) if d in grid.dims else (0, 0)
        local = F.col(f"d{d}") - own * size
        near = F.filter(F.array(own, F.when((local < pos) & (own > 0), own - 1), F.when((local >= size - neg) & (own < n - 1), own + 1)), lambda x: x.isNotNull())
        spots = _spread(spots, near, own, grid, d)
    names = [f"d{d}" for d in range(len(grid.shape))]
    return voxels.select(F.explode(spots).alias("s"), *names, "value").select("s.chunk", *names, "value", "s.inside")


def _spread(spots: Column, near: Column, own: Column, grid: Grid, d: int) -> Column:
    return F.flatten(F.transform(spots, lambda s: F.transform(near, lambda b: F.struct(grid.with_position(s["chunk"], d, b).alias("chunk"), (s["inside"] & (b == own)).alias("inside")))))


def changed(source: DataFrame, target: DataFrame) -> DataFrame:
    """Bricks of ``source`` that ``target`` does not hold with the same hash: what an incremental copy writes."""
    return source.join(target.select("chunk", "hash"), ["chunk", "hash"], "left_anti")


def missing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Bricks that ``target`` does not hold at all: what a resumed import writes."""
    return source.join(target.select("chunk"), "chunk", "left_anti")
