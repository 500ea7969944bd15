"""Index compositions undo each other on every sample of a chunk."""

from pyspark.sql import functions as F

from cubeflow.descriptor import Axis
from cubeflow.functions.coords import Transformer
from cubeflow.functions.index import Indexer
from cubeflow.plans.grid import Grid

AXES = (Axis(50, "Sample", "ms", 0, 98), Axis(10, "Crossline", "unitless", 100, 118), Axis(30, "Inline", "unitless", 1000, 1145))


def test_compositions_round_trip(spark):
    x = Indexer(Grid((50, 10, 30), (0, 1, 2), 8, lod=1, neg_margin=2, pos_margin=1), 1)
    world = Transformer(AXES, (400000.0, 6500000.0, 0.0), (12.5, 3.25, 0.0), (-3.25, 12.5, 0.0), (0.0, 0.0, -4.0))
    total = x.size[0] * x.size[1] * x.size[2]
    at = F.col("id")
    local = x.offset_to_local(at)
    voxel, inner = x.offset_to_voxel(at), x.offset_to_chunk_local(at)
    byte, bit = x.bit_offset(local)
    same = lambda a, b: sum((p != q).cast("int") for p, q in zip(a, b))
    wrong = {
        "offset": (x.voxel_to_offset(voxel) != at).cast("int"),
        "chunk_local": (x.chunk_local_to_offset(inner) != at).cast("int"),
        "voxel": same(x.chunk_local_to_voxel(inner), voxel),
        "bits": same(x.bit_offset_to_local(byte, bit), local),
        "voxel_bits": same(x.voxel_to_bit_offset(voxel), (byte, bit)),
        "inner_bits": same(x.chunk_local_to_bit_offset(inner), (byte, bit)),
        "relative": same([x.relative_to_voxel(x.local_to_relative(local, d), d) for d in range(3)], voxel),
        "coordinate": same([x.coordinate_to_voxel(x.local_to_coordinate(local, d, AXES[d]), d, AXES[d]) for d in range(3)], voxel),
        "world": same(x.world_to_local(x.local_to_world(local, world), world), local),
        "inside": (~x.local_in_volume(local) | ~x.chunk_local_in_volume(inner)).cast("int"),
    }
    row = spark.range(total).agg(*[F.sum(c).alias(n) for n, c in wrong.items()]).first()
    assert row.asDict() == dict.fromkeys(wrong, 0)
