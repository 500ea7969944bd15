import itertools

import pytest

from cubeflow.descriptor import Axis, Channel, Descriptor, IndexOutOfRange, InvalidArgument, InvalidOperation, Layout, buffer_bytes, can_remap, check_region, dimension_groups, layer_name, lod_length, subset_shape
from cubeflow.plans.grid import Grid, chunk_grid, super_chunks


def descriptor(**layout):
    return Descriptor((Axis(100, "Sample", "ms", 0, 4), Axis(70, "Crossline", "", 1932, 2536), Axis(50, "Inline", "", 9985, 10369)), (Channel("Amplitude"), Channel("Trace", "U8", mapping="PerTrace")), Layout(**({"brick_log2": 5, "neg_margin": 4, "pos_margin": 4, "lods": 2} | layout)))


def test_json_round_trip_and_hash():
    d = descriptor().validate()
    assert Descriptor.from_json(d.to_json()) == d and d.layout_hash() == descriptor().layout_hash() != descriptor(lods=1).layout_hash()
    assert d.channel_index("Trace") == 1 and not d.is_channel_available("Offset") and d.axes[0].step == pytest.approx(4 / 99)


@pytest.mark.parametrize("bad", [
    lambda d: Layout(brick_log2=4).validate(), lambda d: Layout(neg_margin=32).validate(), lambda d: Layout(lods=13).validate(), lambda d: Layout(brick_log2=12, mult_2d=2).validate(),
    lambda d: Axis(0, "x").validate(), lambda d: Axis(2, "x", "", 0, float("inf")).validate(), lambda d: Channel("c", "R16").validate(), lambda d: Channel("c", components=3).validate(),
    lambda d: Channel("c", "1Bit", use_novalue=True).validate(), lambda d: Channel("c", range_min=1, range_max=0).validate(), lambda d: Channel("c", mapping="PerTrace", mapped_values=0).validate(),
    lambda d: Descriptor(d.axes, (d.channels[0], d.channels[0])).validate(), lambda d: Descriptor(d.axes, (d.channels[1],)).validate(), lambda d: Descriptor(d.axes[:1], d.channels).validate(), lambda d: d.channel("none"),
])
def test_validation(bad):
    with pytest.raises(InvalidArgument):
        bad(descriptor())


def test_names_groups_and_sizes():
    assert layer_name((0, 1, 2), 3) == "Dimensions_012LOD3" and layer_name((0, 2), 0, "Trace") == "TraceDimensions_02LOD0"
    assert len(dimension_groups(6, 3)) == 20 and len(dimension_groups(6, 2)) == 15
    assert can_remap((0, 1, 2), (0, 2)) and not can_remap((0, 1), (1, 2))
    assert subset_shape((0, 0, 0), (10, 5, 3), 1, full_res_dim=0) == (10, 3, 2)
    assert buffer_bytes((0, 0), (17, 3), fmt="1Bit") == 9 and buffer_bytes((0, 0), (16, 3), 1, "R64") == 8 * 8 * 2


def test_regions():
    check_region((10, 10), (0, 9), (10, 10))
    for low, high in (((0, 0), (11, 1)), ((-1, 0), (1, 1)), ((3, 0), (3, 1))):
        with pytest.raises(IndexOutOfRange):
            check_region((10, 10), low, high)
    with pytest.raises(InvalidOperation):
        check_region((10, 10), (0, 0), (1, 1), lod=1)


@pytest.mark.parametrize("lod,dims", [(0, (0, 1, 2)), (1, (0, 1, 2)), (2, (0, 2)), (0, (1, 2))])
def test_chunks_tile_the_volume(spark, lod, dims):
    g = Grid.of(descriptor(), dims, lod)
    seen = set()
    for c in range(g.total):
        assert g.number(g.position(c)) == c
        low, high = g.bounds(c)
        wide_low, wide_high = g.bounds(c, margin=True)
        assert all(a <= b for a, b in zip(wide_low, low)) and all(a >= b for a, b in zip(wide_high, high))
        assert g.chunk_at(low) == c and g.chunk_at(tuple(h - 1 for h in high)) == c
        seen.add((low, high))
    volume = sum((b[0] - a[0]) * (b[1] - a[1]) * (b[2] - a[2]) for a, b in seen)
    assert volume == 100 * 70 * 50 and g.chunk_at((100, 0, 0)) is None
    rows = {r.chunk: r for r in chunk_grid(spark, g).collect()}
    assert len(rows) == g.total
    for c, r in itertools.islice(rows.items(), 0, None, 7):
        (low, high), (wl, wh) = g.bounds(c), g.bounds(c, margin=True)
        assert low == (r.min0, r.min1, r.min2) and high == (r.max0, r.max1, r.max2) and wl == (r.low0, r.low1, r.low2) and wh == (r.high0, r.high1, r.high2)
        n = g.stored_size(c)
        assert r.samples == n[0] * n[1] * n[2]
    with pytest.raises(IndexOutOfRange):
        g.position(g.total)


def test_mapped_and_super_chunks(spark):
    g = Grid.of(descriptor())
    assert all(g.mapped_chunk(g.primary_chunk(m, k)) == m for m in range(g.total // g.counts[0]) for k in range(g.counts[0]))
    a, b = Grid((64, 64), (0, 1), 32), Grid((64, 64), (0, 1), 16)
    df = spark.range(64).selectExpr("id as x", "id as y")
    rows = df.select("x", super_chunks([a, b], ["x", "y"]).alias("s")).collect()
    assert {r.s for r in rows} == {0, 3} and all((r.s == 0) == (r.x < 32) for r in rows)


@pytest.mark.parametrize("low,high,lod", [(0, 250, 1), (0, 252, 1), (1, 253, 1), (250, 253, 1), (512, 1793, 2), (1487, 1793, 2), (1488, 1491, 2)])
def test_level_rounding(spark, low, high, lod):
    from cubeflow.operators import subset

    level = spark.range(1793).selectExpr("id as d0", "0L as d1", "cast(id as double) as value")
    for _ in range(lod):
        level = subset.decimate(level)
    got = {r.d0: r.value for r in subset.subset_lod(level, (low, 0), (high, 1), lod).collect()}
    n = lod_length(low, high, lod)
    assert got == {k: float(((low >> lod) + k) << lod) for k in range(n) if ((low >> lod) + k) << lod < 1793}


def test_more_chunks_than_numbers():
    assert Grid((1 << 27,) * 3, (0, 1, 2), 64).total == (1 << 63)
    with pytest.raises(InvalidArgument):
        Grid((1 << 27,) * 3, (0, 1, 2), 64).chunk_column()


@pytest.mark.parametrize("lengths", [(100, 70, 50), (100, 1 << 52, 1 << 52), ((1 << 63) - 1,) * 3])
def test_names_of_chunks(spark, lengths):
    g = Grid(lengths, (0, 1, 2), 64, pos_margin=4)
    h = Grid(lengths, (0, 1, 2), 56)
    voxels = [tuple(min(x, n - 1) for n in lengths) for x in (0, 55, 56, 63, 64, (1 << 52) - 1, (1 << 60) - 1, (1 << 63) - 2)]
    df = spark.createDataFrame(voxels, "d0 long, d1 long, d2 long")
    for grid in (g, h):
        rows = df.select(grid.chunk_name(grid.brick_columns()).alias("c"), *grid.brick_columns()).collect()
        at = [tuple(x // grid.brick for x in v) for v in voxels]
        assert [(r.b0, r.b1, r.b2) for r in rows] == at
        assert [r.c for r in rows] == [grid.chunk_at(v) if grid.numbered else list(b) for v, b in zip(voxels, at)]
    assert g.numbered == (lengths[1] == 70)
    both = [r[0] for r in df.select(super_chunks([g, h], ["d0", "d1", "d2"])).collect()]
    assert [len({str(x) for x in both[:4]}), str(both[4]) == str(both[0])] == [1, False]


def test_halos_of_more_chunks_than_numbers(spark):
    from cubeflow.operators import bricks

    g = Grid((100, (1 << 63) - 1, 1 << 60), (0, 1, 2), 32, neg_margin=2, pos_margin=1)
    rows = bricks.with_halo(spark.createDataFrame([(31, (1 << 63) - 2, 1 << 59, 1.0)], "d0 long, d1 long, d2 long, value double"), g).collect()
    last, b2 = ((1 << 63) - 2) // 32, (1 << 59) // 32
    assert {(*r.chunk, r.inside) for r in rows} == {(b0, last, b, (b0, b) == (0, b2)) for b0 in (0, 1) for b in (b2, b2 - 1)}
