import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeflow.descriptor import InvalidArgument, ReadError
from cubeflow.functions import codecs
from cubeflow.functions.index import Indexer
from cubeflow.operators import bricks, subset
from cubeflow.plans.grid import Grid
from cubeflow.sources import synthetic
from cubeflow.streaming.ingest import BrickIngest


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codecs(codec):
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.float32), np.repeat(rng.integers(0, 3, 50), rng.integers(1, 40, 50)).astype(np.float32), rng.normal(size=99).astype(np.float32)):
        assert codecs.decode(codecs.encode(a.tobytes(), codec), codec) == a.tobytes()
    with pytest.raises(InvalidArgument):
        codecs.encode(b"", "wavelet")
    if codec != "none":
        with pytest.raises(ReadError):
            codecs.decode(b"\x01\x02\x03", codec)


def test_bits():
    b = np.random.default_rng(1).random((3, 4, 13)) < 0.8
    packed = codecs.pack_bits(b)
    assert len(packed) == 3 * 4 * 2 and (codecs.unpack_bits(packed, b.shape) == b).all()


@pytest.mark.parametrize("lod,full", [(0, -1), (1, -1), (1, 0)])
def test_indexer(spark, lod, full):
    g = Grid((50, 40, 30), (0, 1, 2), 8, lod, 2, 1, full)
    for chunk in (0, 3, g.total - 1):
        x = Indexer(g, chunk)
        n = x.size[0] * x.size[1] * x.size[2]
        local = x.offset_to_local(F.col("id"))
        voxel = x.local_to_voxel(local)
        back = x.voxel_to_offset(voxel)
        again = x.chunk_local_to_local(x.voxel_to_chunk_local(voxel))
        rows = spark.range(n).select("id", back.alias("at"), *[c.alias(f"l{d}") for d, c in enumerate(local)], *[c.alias(f"a{d}") for d, c in enumerate(again)], x.voxel_in_volume(voxel).alias("v"), x.local_in_process_area(local).alias("l"), x.voxel_in_process_area(voxel).alias("p"), x.chunk_local_in_process_area(x.voxel_to_chunk_local(voxel)).alias("c"))
        got = rows.collect()
        assert all(r.at == r.id and (r.l0, r.l1, r.l2) == (r.a0, r.a1, r.a2) and r.v and r.l and r.p == r.c for r in got)
        assert sum(r.p for r in got) == int(np.prod(g.stored_size(chunk)))
    x = Indexer(Grid((20, 4), (0, 1), 32), 0)
    byte, bit = x.bit_offset([F.lit(17), F.lit(2)])
    assert tuple(spark.range(1).select(byte, bit).first()) == (8, 1)


def test_noise_and_bits(spark):
    a = synthetic.noise(spark, (12, 9, 7)).collect()
    b = synthetic.noise(spark, (12, 9, 7)).repartition(5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 12 * 9 * 7 and all(abs(r.value) <= 0.1234 for r in a)
    assert synthetic.noise(spark, (12, 9, 7), threshold=0.0).where("value < 0").count() == 0
    share = synthetic.bits(spark, (40, 40, 10)).agg(F.avg(F.col("value").cast("int"))).first()[0]
    assert 0.77 < share < 0.83


def test_stream_batches_replace_and_merge(spark, tmp_path):
    g = Grid((8, 8), (0, 1), 4)
    sink = BrickIngest(spark, str(tmp_path / "s"), g)
    one = spark.createDataFrame([(0, 0, 1.0), (5, 5, 2.0)], "d0 long, d1 long, value double")
    two = spark.createDataFrame([(0, 0, 3.0), (0, 0, 4.0), (7, 1, 5.0)], "d0 long, d1 long, value double")
    sink.write_batch(one, 0)
    sink.write_batch(two, 1)
    sink.write_batch(two, 1)  # run again after a failure
    want = [(0, 0, 4.0), (5, 5, 2.0), (7, 1, 5.0)]
    assert sorted(map(tuple, sink.voxels().collect())) == want
    sink.compact(str(tmp_path / "c"))
    assert sorted(map(tuple, bricks.from_bricks(spark.read.parquet(str(tmp_path / "c")), g).collect())) == want


def test_trace_view_and_per_trace(spark):
    v = spark.createDataFrame([(0, 1, 5.0), (2, 1, None), (1, 4, 7.0)], "d0 long, d1 long, value double")
    t = subset.to_traces(v, 3)
    assert {r.d1: r.values for r in t.collect()} == {1: [5.0, None, None], 4: [None, 7.0, None]}
    assert subset.from_traces(t).count() == 6
    extra = spark.createDataFrame([(1, 9)], "d1 long, flag int")
    assert [r.flag for r in subset.per_trace(v, extra).collect()] == [9, 9]
