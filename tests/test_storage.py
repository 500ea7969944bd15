"""What volumes store: types, levels after updates, components, PerTrace regions, pruning, switches."""

import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeflow.descriptor import Axis, Channel, Descriptor, InvalidOperation, Layout
from cubeflow.operators import interp, subset
from cubeflow.sources import volume as V

SHAPE = (70, 40, 36)
AXES = tuple(Axis(n, name, "m", 0, n - 1) for n, name in zip(SHAPE, ("Sample", "Crossline", "Inline")))


def rows(df):
    return sorted(tuple(r) for r in df.where("value is not null").select(*subset.axes_of(df), "value").collect())


@pytest.fixture(scope="module")
def cube():
    rng = np.random.default_rng(4)
    a = rng.normal(size=tuple(reversed(SHAPE)))
    a[rng.random(a.shape) < 0.1] = np.nan
    return a


def test_levels_and_groups_follow_updates(spark, cube, tmp_path):
    d = Descriptor(AXES, (Channel("A", "R64", use_novalue=True),), Layout(brick_log2=5, lods=2))
    v = V.Volume.create(spark, f"{tmp_path}/v", d)
    voxels = V.from_numpy(spark, cube)
    v.write(voxels)
    v.write(voxels, dims=(0, 2), lods=False)
    changes = spark.createDataFrame([(0, 0, 0, 99.0), (69, 39, 35, 7.0), (33, 1, 35, None), (64, 32, 1, 1.5)], "d0 long, d1 long, d2 long, value double")
    v.update(changes)
    want = interp.updated(voxels, changes)
    for lod, level in enumerate(subset.pyramid(want, 2)):
        assert rows(v.voxels(0, lod)) == rows(level)
    assert rows(v.voxels(0, 0, (0, 2))) == rows(want)
    before = rows(v.voxels(0, 1))
    assert v.vacuum() == 4 and rows(v.voxels(0, 1)) == before and v.vacuum() == 0


def test_integers_of_64_bits_are_exact(spark, tmp_path):
    d = Descriptor(AXES, (Channel("A", "U64"), Channel("B", "U8")), Layout(brick_log2=5, lods=1))
    v = V.Volume.create(spark, f"{tmp_path}/v", d)
    numbers = [2**53 + 1, 2**53 + 3, 2**64 - 1, 0]
    frame = spark.createDataFrame([(i, 0, 0, decimal.Decimal(n)) for i, n in enumerate(numbers)], "d0 long, d1 long, d2 long, value decimal(20,0)")
    v.write(frame)
    v.write(frame.withColumn("value", F.col("d0") + 250), "B")
    assert [int(x[3]) for x in rows(V.Volume.open(spark, v.path).subset((0, 0, 0), (4, 1, 1)))] == numbers
    p = spark.createDataFrame([(i, i + 0.5, 0.5, 0.5) for i in range(4)], "id long, p0 double, p1 double, p2 double")
    assert [int(r.value) for r in v.samples(p, method="nearest").orderBy("id").collect()] == numbers
    assert dict(v.bricks("B").dtypes)["values"] == "array<smallint>" and [x[3] for x in rows(v.voxels("B"))] == [250, 251, 252, 253]


def test_components(spark, cube, tmp_path):
    d = Descriptor(AXES, (Channel("A", "R64", components=2),), Layout(brick_log2=5, lods=1))
    v = V.Volume.create(spark, f"{tmp_path}/v", d)
    one = V.from_numpy(spark, cube).where("value is not null")
    v.write(one.withColumn("value", F.struct(F.col("value").alias("c0"), (F.col("value") * -2).alias("c1"))))
    got = v.subset((3, 2, 1), (50, 30, 20))
    for name, factor in (("c0", 1), ("c1", -2)):
        a = V.to_numpy(got.withColumn("value", F.col("value")[name]), (47, 28, 19))
        assert np.array_equal(a, factor * cube[1:20, 2:30, 3:50], equal_nan=True)
    p = spark.createDataFrame([(0, 3.2, 4.4, 5.5), (1, 60.9, 0.1, 32.7)], "id long, p0 double, p1 double, p2 double")
    for method in ("nearest", "linear", "cubic"):
        plain = dict(map(tuple, interp.samples(p, one, SHAPE, method).collect()))
        found = {r.id: r.value for r in v.samples(p, method=method).collect()}
        assert all(x is None and found[i].c0 is None or found[i].c0 == pytest.approx(x) and found[i].c1 == pytest.approx(-2 * x) for i, x in plain.items())
    filled = v.subset((0, 0, 0), (4, 4, 4), replacement=-1.0)
    assert filled.count() == 64 and filled.where("value is null").count() == 0


def test_per_trace_regions(spark, tmp_path):
    d = Descriptor(AXES, (Channel("A", "R32"), Channel("T", "U8", mapping="PerTrace", mapped_values=5)), Layout(brick_log2=5, lods=1))
    v = V.Volume.create(spark, f"{tmp_path}/v", d)
    traces = spark.range(40 * 36).select((F.col("id") % 40).alias("d1"), F.floor(F.col("id") / 40).alias("d2"))
    v.write_traces(traces.withColumn("values", F.array(*[(F.col("d1") + F.col("d2") + k) % 200 for k in range(5)])), "T")
    got = rows(v.subset((1, 3, 4), (4, 6, 9), channel="T"))
    assert got == sorted((a, b, c, (a + 1 + b + 3 + c + 4) % 200) for a in range(3) for b in range(3) for c in range(5))
    with pytest.raises(InvalidOperation):
        v.subset((0, 0, 0), (5, 2, 2), lod=1, channel="T")


def test_traces_read_the_bricks_along_their_lines(spark, cube, tmp_path):
    d = Descriptor(AXES, (Channel("A", "R64"),), Layout(brick_log2=5))
    v = V.Volume.create(spark, f"{tmp_path}/v", d)
    voxels = V.from_numpy(spark, cube)
    v.write(voxels)
    p = spark.createDataFrame([(0, 3.2, 4.4, 5.5)], "id long, p0 double, p1 double, p2 double")
    near, _ = v._near_positions(p, 0, 0, along=0)
    assert near.selectExpr("max(d1)", "max(d2)", "max(d0)").first() == (31, 31, 69)
    for method in ("linear", "cubic"):
        assert sorted(map(tuple, v.traces(p, 0, method=method).collect())) == sorted(map(tuple, interp.traces(p, voxels, SHAPE, 0, method).collect()))


def test_a_failed_write_leaves_the_table(spark, cube, tmp_path):
    d = Descriptor(AXES, (Channel("A", "R64"),), Layout(brick_log2=5))
    v = V.Volume.create(spark, f"{tmp_path}/v", d)
    voxels = V.from_numpy(spark, cube)
    v.write(voxels)
    with pytest.raises(Exception, match="stop"):
        v.write(voxels.withColumn("value", F.when(F.col("d0") < 60, F.col("value")).otherwise(F.raise_error(F.lit("stop")).cast("double"))))
    assert rows(v.voxels()) == rows(voxels)


def test_levels_that_are_not_stored_are_made_on_reading(spark, cube, tmp_path):
    d = Descriptor(AXES, (Channel("A", "R64", use_novalue=True),), Layout(brick_log2=5, lods=2))
    v = V.Volume.create(spark, f"{tmp_path}/v", d, mode="CreateWithoutLODGeneration")
    voxels = V.from_numpy(spark, cube)
    v.write(voxels)
    low, high = (5, 2, 3), (66, 40, 31)
    for lod, level in enumerate(subset.pyramid(voxels, 2)):
        assert v.produce_status((0, 1, 2), lod) == ("Remapped" if lod else "Normal")
        assert rows(v.subset(low, high, lod)) == rows(subset.subset_lod(level, low, high, lod))


def test_requests_run_by_themselves(spark, cube, tmp_path):
    slow = F.udf(lambda x: __import__("time").sleep(x) or x, "double")
    r = V.Request(spark.range(1).select(slow(F.lit(8.0)).alias("value"))).submit()
    with pytest.raises(TimeoutError):
        r.wait(0.5)
    assert not r.is_completed
    r.cancel()
    with pytest.raises(InvalidOperation):
        r.wait()
    failing = V.Request(spark.range(1).select(F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception, match="stop"):
        failing.wait()
    done = V.Request(spark.range(3)).submit()
    assert len(done.wait(60)) == 3 and done.is_completed
