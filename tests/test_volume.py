import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeflow.descriptor import Axis, Channel, Descriptor, IndexOutOfRange, InvalidOperation, Layout, MetadataItem, ReadError
from cubeflow.operators import interp, subset
from cubeflow.sources import volume as V

SHAPE = (40, 35, 33)


@pytest.fixture(scope="module")
def array():
    rng = np.random.default_rng(9)
    a = rng.normal(size=tuple(reversed(SHAPE)))
    a[:, :, 32:] = 2.5
    a[rng.random(a.shape) < 0.05] = np.nan
    return a


@pytest.fixture(scope="module")
def descriptor():
    axes = tuple(Axis(n, name, "m", 0, n - 1) for n, name in zip(SHAPE, ("Sample", "Crossline", "Inline")))
    return Descriptor(axes, (Channel("Amplitude", "R64", use_novalue=True, range_min=-5, range_max=5), Channel("Mask", "1Bit"), Channel("Trace", "U8", mapping="PerTrace")), Layout(brick_log2=5, lods=2))


ITEMS = [MetadataItem("SurveyCoordinateSystem", "Origin", "DoubleVector2", (1234.0, 4321.0)), MetadataItem("c", "n", "Int", 5), MetadataItem("c", "s", "String", "x"), MetadataItem("c", "b", "BLOB", b"\0\1")]


@pytest.fixture(scope="module")
def stored(spark, array, descriptor, tmp_path_factory):
    v = V.Volume.create(spark, str(tmp_path_factory.mktemp("v") / "a"), descriptor, ITEMS)
    voxels = V.from_numpy(spark, array)
    v.write(voxels)
    v.write(voxels.withColumn("value", F.col("value") > 0), "Mask")
    return v


def key(df):
    names = subset.axes_of(df)
    return sorted(tuple(r) for r in df.where("value is not null").select(*names, "value").collect())


def test_subsets_and_levels(spark, stored, array):
    v = V.Volume.open(spark, stored.path)
    assert v.descriptor == stored.descriptor
    low, high = (5, 0, 7), (37, 35, 33)
    got = V.to_numpy(v.subset(low, high), (32, 35, 26))
    assert np.array_equal(got, array[7:33, 0:35, 5:37], equal_nan=True)
    whole = V.from_numpy(spark, array)
    for lod, level in enumerate(subset.pyramid(whole, 2)):
        if lod:
            assert key(v.voxels(0, lod)) == key(level)
            assert key(v.subset(low, high, lod)) == key(subset.subset_lod(level, low, high, lod))
    assert key(v.slice(2, 4)) == key(subset.slice_at(whole, 2, 4))
    filled = v.subset((0, 0, 0), (4, 4, 4), replacement=-1.0)
    assert filled.count() == 64 and filled.where("value is null").count() == 0
    with pytest.raises(IndexOutOfRange):
        v.subset((0, 0, 0), (41, 1, 1))
    with pytest.raises(InvalidOperation):
        v.subset((0, 0, 0), (1, 1, 1), lod=3)
    with pytest.raises(InvalidOperation):
        v.write(whole)


def test_brick_predicates_reach_the_scan(stored):
    plan = stored.subset((0, 0, 0), (8, 8, 8))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(b0)" in plan and "LessThanOrEqual(b0,0)" in plan


def test_requests(spark, stored, array):
    whole = V.from_numpy(spark, array)
    p = spark.createDataFrame([(0, 3.2, 4.4, 5.5), (1, 39.9, 0.1, 32.7)], "id long, p0 double, p1 double, p2 double")
    for method in ("nearest", "linear", "cubic"):
        assert sorted(map(tuple, stored.samples(p, method=method).collect())) == sorted(map(tuple, interp.samples(p, whole, SHAPE, method).collect()))
    assert sorted(map(tuple, stored.traces(p, 1, method="linear").collect())) == sorted(map(tuple, interp.traces(p, whole, SHAPE, 1, "linear").collect()))
    plane = (1.0, 0.5, -1.5, 2.0)
    assert key(stored.project(plane, 2, (0, 0, 0), SHAPE)) == key(interp.project(whole, SHAPE, plane, 2, (0, 0, 0), SHAPE))
    r = V.Request(stored.subset((0, 0, 0), (4, 4, 4)))
    assert not r.is_completed and len(r.wait()) > 0 and r.is_completed and r.completion_factor() == 1.0
    r = V.Request(stored.subset((0, 0, 0), (4, 4, 4)))
    r.cancel()
    with pytest.raises(InvalidOperation):
        r.wait()


def test_chunks_status_and_information(stored):
    assert stored.produce_status((0, 1, 2)) == "Normal" and stored.produce_status((0, 1)) == "Remapped" and stored.produce_status((0, 1, 2), 0, 2) == "Unavailable"
    assert stored.chunk(0).count() == 1 and stored.chunk_at((39, 34, 32)) == 7 and stored.chunk_grid().count() == 8 and stored.check().count() == 0
    assert stored.bricks().where("const_value = 2.5").count() == 0 and stored.chunk_hashes().select("hash").distinct().count() == 8
    info = json.loads(stored.info())
    assert len(info["layers"]) == 6 and len(info["metadata"]) == 4
    assert stored.buffer_bytes((0, 0, 0), (10, 10, 10)) == 8000


def test_metadata(spark, stored):
    assert [r.name for r in stored.metadata("c").collect()] == ["n", "s", "b"]
    assert stored.transformer().origin == (1234.0, 4321.0, 0.0)
    frame = stored.metadata()
    assert V.clear_metadata(frame, "c", "s").count() == 3 and V.clear_metadata(frame, "c").count() == 1
    other = V.metadata_frame(spark, [MetadataItem("c", "n", "Int", 9), MetadataItem("d", "n", "Int", 1)])
    assert {r.int_v[0] for r in V.copy_metadata(frame, other, "c").where("name = 'n'").collect()} == {9}


def test_updates_copies_and_memory(spark, array, descriptor, stored, tmp_path):
    copy = stored.copy_to(str(tmp_path / "copy"))
    assert key(copy.voxels()) == key(stored.voxels()) and key(copy.voxels(0, 2)) == key(stored.voxels(0, 2)) and key(copy.voxels("Mask")) == key(stored.voxels("Mask"))
    copy.set_metadata([MetadataItem("c", "n", "Int", 6)])
    assert copy.metadata("c", "n").first().int_v == [6]
    changes = spark.createDataFrame([(0, 0, 0, 99.0), (39, 34, 32, None), (1, 1, 1, -4.0)], "d0 long, d1 long, d2 long, value double")
    copy.update(changes)
    want = {(r[0], r[1], r[2]): r[3] for r in key(stored.voxels())} | {(0, 0, 0): 99.0, (1, 1, 1): -4.0}
    want.pop((39, 34, 32), None)
    assert {(r[0], r[1], r[2]): r[3] for r in key(copy.voxels())} == want
    again = stored.copy_to(str(tmp_path / "copy"), resume=True)
    assert key(again.voxels()) == key(stored.voxels())
    with pytest.raises(InvalidOperation):
        stored.copy_to(str(tmp_path / "copy"), layout={"brick_log2": 6}, resume=True)
    wide = stored.copy_to("memory://wide", layout={"brick_log2": 6, "lods": 0})
    assert wide.bricks().count() == 1 and key(wide.voxels()) == key(stored.voxels()) and V.Volume.open(spark, "memory://wide").descriptor.layout.lods == 0
    again.remove_chunks(0, 3)
    assert again.bricks().count() == 4
    with pytest.raises(ReadError):
        V.Volume.open(spark, str(tmp_path / "none"))
    with pytest.raises(ReadError):
        V.Volume.open(spark, "memory://none")


FAR = (40, 1000, 2_000_000)
FAR_ROWS = [(0, 0, 0, 1.0), (3, 999, 1_000_001, 2.0), (4, 998, 1_999_999, 3.0), (5, 999, 1_999_998, 4.0)]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A volume with an axis of over a million samples."""
    axes = tuple(Axis(n, f"A{d}") for d, n in enumerate(FAR))
    v = V.Volume.create(spark, str(tmp_path_factory.mktemp("far") / "a"), Descriptor(axes, (Channel("V", "R64"),), Layout(lods=1)))
    v.write(spark.createDataFrame(FAR_ROWS, "d0 long, d1 long, d2 long, value double"))
    return V.Volume.open(spark, v.path)


def test_levels_of_an_axis_over_a_million(far):
    assert key(far.voxels(0, 1)) == [(0, 0, 0, 1.0), (1, 499, 500_000, 2.0), (2, 499, 999_999, 4.0)]  # of two in a cell the first along d2


def test_a_region_of_an_axis_over_a_million(far):
    got = far.subset((1, 500, 1_000_000), (40, 1000, 2_000_000))
    assert key(got) == [(2, 499, 1, 2.0), (3, 498, 999_999, 3.0), (4, 499, 999_998, 4.0)]


def test_traces_beyond_a_million(spark, far):
    at = spark.createDataFrame([(0, 0.5, 999.5, 1_000_001.5), (1, 0.5, 998.5, 1_999_999.5), (2, 0.5, 1.5, 1_999_999.5)], "id long, p0 double, p1 double, p2 double")
    rows = far.traces(at, method="nearest").collect()
    assert len(rows) == 3 * FAR[0] and sorted((r.id, r.sample, r.value) for r in rows if r.value is not None) == [(0, 3, 2.0), (1, 4, 3.0)]


def test_the_last_brick_of_an_axis_of_31_bits(spark, tmp_path):
    n = (1 << 31) - 1
    v = V.Volume.create(spark, str(tmp_path / "last"), Descriptor((Axis(40, "A"), Axis(n, "B")), (Channel("V", "R64"),), Layout()))
    v.write(spark.createDataFrame([(3, n - 1, 2.0)], "d0 long, d1 long, value double"))
    assert key(v.subset((1, n - 5), (40, n))) == [(2, 4, 2.0)] and not v.check().count()


VAST = (40, (1 << 63) - 1, (1 << 63) - 1)
VAST_ROWS = [(0, 0, 0, 1.0), (3, (1 << 63) - 2, 70, 2.0), (39, (1 << 63) - 3, (1 << 63) - 2, 3.0), (5, 999, (1 << 61) + 1, 4.0), (6, 999, (1 << 50) + 1, 5.0)]


def test_a_volume_of_more_chunks_than_numbers(spark, tmp_path):
    axes = tuple(Axis(n, f"A{d}") for d, n in enumerate(VAST))
    v = V.Volume.create(spark, str(tmp_path / "vast"), Descriptor(axes, (Channel("V", "R64"),), Layout(brick_log2=5, lods=1)))
    v.write(spark.createDataFrame(VAST_ROWS, "d0 long, d1 long, d2 long, value double"))
    assert key(v.voxels()) == sorted(VAST_ROWS) and not v.check().count() and not v.check(lod=1).count()
    assert key(v.subset((1, VAST[1] - 2, 0), (40, VAST[1], VAST[2]))) == [(2, 1, 70, 2.0), (38, 0, VAST[2] - 1, 3.0)]
    assert [(r.lod, r.chunks, r.valid_chunks, r.samples) for r in v.layers().orderBy("lod").collect()] == [(0, None, 5, 5), (1, None, 5, 5)]
    at = spark.createDataFrame([(0, 0.5, 999.5, (1 << 50) + 1.5), (1, 0.5, 0.5, 0.5), (2, 0.5, 999.5, 70.5)], "id long, p0 double, p1 double, p2 double")
    assert sorted((r.id, r.sample, r.value) for r in v.traces(at, method="nearest").collect() if r.value is not None) == [(0, 6, 5.0), (1, 0, 1.0)]
    chunk = v.grid().chunk_at(VAST_ROWS[2][:3])
    assert chunk > 1 << 64 and [r.hi for r in v.chunk(chunk).collect()] == [3.0]
    v.update(spark.createDataFrame([(38, VAST[1] - 2, VAST[2] - 2, 7.0), (3, VAST[1] - 1, 70, None)], "d0 long, d1 long, d2 long, value double"))
    assert key(v.voxels()) == sorted([VAST_ROWS[0], *VAST_ROWS[2:], (38, VAST[1] - 2, VAST[2] - 2, 7.0)])
    halves = {}
    for d0, d1, d2, x in sorted(key(v.voxels()), key=lambda r: (r[2], r[1], r[0])):
        halves.setdefault((d0 >> 1, d1 >> 1, d2 >> 1), x)
    assert key(v.voxels(0, 1)) == sorted((*k, x) for k, x in halves.items())
    v.remove_chunks(1, chunk)
    assert key(v.voxels()) == [VAST_ROWS[0]]


def test_a_constant_brick_at_the_end_of_64_bits(spark, tmp_path):
    n = (1 << 63) - 1
    v = V.Volume.create(spark, str(tmp_path / "end"), Descriptor((Axis(2, "A"), Axis(n, "B")), (Channel("V", "R64"),), Layout(brick_log2=5)))
    rows = [(a, n - 1 - k, 5.0) for a in range(2) for k in range(31)]
    v.write(spark.createDataFrame(rows, "d0 long, d1 long, value double"))
    assert v.bricks().first().const_value == 5.0 and key(v.voxels()) == sorted(rows)
