"""Self-describing volumes: axes, channels, layout and their validation; JSON in and out."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

MOST_DIMENSIONS = 6
#: Samples of an axis, whose indices are 64-bit integers.
MOST_SAMPLES = (1 << 63) - 1
#: Chunks that 64-bit integers number; those of a layer with more are named by their positions.
MOST_CHUNKS = (1 << 63) - 1
#: Sample formats and the Spark types that hold them without loss (unsigned ones widened).
FORMATS: dict[str, T.DataType] = {
    "1Bit": T.BooleanType(),
    "U8": T.ShortType(),
    "U16": T.IntegerType(),
    "U32": T.LongType(),
    "U64": T.DecimalType(20, 0),
    "R32": T.FloatType(),
    "R64": T.DoubleType(),
}
#: Quantised formats: number of levels; the highest is NoValue where that is used.
LEVELS = {"U8": 256, "U16": 65536}
COMPONENTS = (1, 2, 4)
MAPPINGS = ("Direct", "PerTrace")


class InvalidArgument(ValueError):
    """An argument that no request may have."""


class InvalidOperation(RuntimeError):
    """A request that the dataset, as it is, cannot serve."""


class IndexOutOfRange(InvalidArgument, IndexError):
    """An index or a region outside the volume."""


class ReadError(IOError):
    """Stored data that cannot be read."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidArgument(what)


@dataclass(frozen=True)
class Axis:
    """One dimension: sample count, name, unit and the coordinates of its first and last samples."""

    num_samples: int
    name: str
    unit: str = ""
    coord_min: float = 0.0
    coord_max: float = 0.0

    @property
    def step(self) -> float:
        return (self.coord_max - self.coord_min) / (self.num_samples - 1) if self.num_samples > 1 else 0.0

    def validate(self) -> None:
        _need(1 <= self.num_samples <= MOST_SAMPLES, f"axis {self.name}: 1 to {MOST_SAMPLES:,} samples")
        _need(math.isfinite(self.coord_min) and math.isfinite(self.coord_max), f"axis {self.name}: finite coordinates")


@dataclass(frozen=True)
class Channel:
    """A named set of values over the axes (Direct) or of ``mapped_values`` for each trace (PerTrace)."""

    name: str
    format: str = "R32"
    components: int = 1
    unit: str = ""
    range_min: float = 0.0
    range_max: float = 1.0
    mapping: str = "Direct"
    mapped_values: int = 1
    use_novalue: bool = False
    novalue: float = 0.0
    int_scale: float = 1.0
    int_offset: float = 0.0
    discrete: bool = False
    renderable: bool = True
    lossy: bool = True

    @property
    def forces_nearest(self) -> bool:
        """Discrete values have no values between them."""
        return self.discrete or self.format == "1Bit"

    def validate(self) -> None:
        _need(bool(self.name), "a channel needs a name")
        _need(self.format in FORMATS, f"channel {self.name}: unknown format {self.format}")
        _need(self.components in COMPONENTS, f"channel {self.name}: 1, 2 or 4 components")
        _need(self.mapping in MAPPINGS, f"channel {self.name}: unknown mapping {self.mapping}")
        _need(self.mapping == "Direct" or self.mapped_values >= 1, f"channel {self.name}: at least one mapped value")
        _need(self.range_min <= self.range_max, f"channel {self.name}: value range is reversed")
        _need(not (self.format == "1Bit" and self.use_novalue), f"channel {self.name}: one bit has no room for NoValue")

    @property
    def spark_type(self) -> T.DataType:
        kind = FORMATS[self.format]
        return kind if self.components == 1 else T.StructType([T.StructField(f"c{k}", kind) for k in range(self.components)])


@dataclass(frozen=True)
class Layout:
    """Brick size (a power of two), margins, the factor of 2-D tiles, levels of detail and the dimension kept at full resolution."""

    brick_log2: int = 6
    neg_margin: int = 0
    pos_margin: int = 0
    mult_2d: int = 1
    lods: int = 0
    full_res_dim: int = -1

    def effective_brick(self, n_dims: int = 3) -> int:
        size = (1 << self.brick_log2) - self.neg_margin - self.pos_margin
        return size * self.mult_2d if n_dims == 2 else size

    def validate(self) -> None:
        size = 1 << self.brick_log2
        _need(32 <= size <= 4096, "brick size is 32 to 4096")
        _need(0 <= self.neg_margin < size // 2 and 0 <= self.pos_margin < size // 2, "margins are below half a brick")
        _need(self.mult_2d >= 1 and size * self.mult_2d <= 4096, "2-D tiles are at most 4096 wide")
        _need(0 <= self.lods <= 12, "0 to 12 levels of detail")


@dataclass(frozen=True)
class MetadataItem:
    """A typed value under (category, name)."""

    category: str
    name: str
    type: str
    value: object


METADATA_TYPES = ("Int", "IntVector2", "IntVector3", "IntVector4", "Float", "FloatVector2", "FloatVector3", "FloatVector4", "Double", "DoubleVector2", "DoubleVector3", "DoubleVector4", "String", "BLOB")


@dataclass(frozen=True)
class Descriptor:
    """All that a dataset says about itself."""

    axes: tuple[Axis, ...]
    channels: tuple[Channel, ...]
    layout: Layout = field(default_factory=Layout)

    @property
    def dimensionality(self) -> int:
        return len(self.axes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.num_samples for a in self.axes)

    def validate(self) -> Descriptor:
        _need(2 <= len(self.axes) <= MOST_DIMENSIONS, "2 to 6 axes")
        for part in (*self.axes, *self.channels, self.layout):
            part.validate()
        _need(bool(self.channels), "at least one channel")
        names = [c.name for c in self.channels]
        _need(len(set(names)) == len(names), "channel names are unique")
        first = self.channels[0]
        _need(first.renderable and first.mapping == "Direct", "the primary channel is renderable and mapped directly")
        return self

    def channel_index(self, name: str) -> int:
        for k, c in enumerate(self.channels):
            if c.name == name:
                return k
        raise InvalidArgument(f"no channel {name}")

    def is_channel_available(self, name: str) -> bool:
        return any(c.name == name for c in self.channels)

    def channel(self, key: int | str = 0) -> Channel:
        k = self.channel_index(key) if isinstance(key, str) else key
        _need(0 <= k < len(self.channels), f"no channel {key}")
        return self.channels[k]

    def to_json(self) -> str:
        return json.dumps({"axes": [asdict(a) for a in self.axes], "channels": [asdict(c) for c in self.channels], "layout": asdict(self.layout)}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Descriptor:
        d = json.loads(text)
        return cls(tuple(Axis(**a) for a in d["axes"]), tuple(Channel(**c) for c in d["channels"]), Layout(**d["layout"])).validate()

    def layout_hash(self) -> str:
        return hashlib.sha256(json.dumps(json.loads(self.to_json()), sort_keys=True).encode()).hexdigest()

    def with_layout(self, **changes) -> Descriptor:
        return replace(self, layout=replace(self.layout, **changes)).validate()


def layer_name(dims: tuple[int, ...], lod: int, channel: str | None = None) -> str:
    """The name of a layer; the primary channel's is left out."""
    return f"{channel or ''}Dimensions_{''.join(map(str, dims))}LOD{lod}"


def dimension_groups(dimensionality: int, size: int | None = None) -> list[tuple[int, ...]]:
    """All pairs and triples of dimensions that can form chunks."""
    from itertools import combinations

    return [g for n in ((2, 3) if size is None else (size,)) for g in combinations(range(dimensionality), n)]


def can_remap(source: tuple[int, ...], target: tuple[int, ...]) -> bool:
    """Chunks of one group can be made of another's if the two share at least two dimensions."""
    return len(set(source) & set(target)) >= 2


def check_region(shape: tuple[int, ...], low: tuple[int, ...], high: tuple[int, ...], lod: int = 0, lods: int = 0) -> None:
    """A region is min-inclusive, max-exclusive, not empty, within the volume, in voxels of full resolution."""
    _need(len(low) == len(high) == len(shape), f"bounds for {len(shape)} dimensions")
    if not 0 <= lod <= lods:
        raise InvalidOperation(f"level {lod} is not produced; there are 0 to {lods}")
    for d, (a, b, n) in enumerate(zip(low, high, shape)):
        if not 0 <= a < b <= n:
            raise IndexOutOfRange(f"dimension {d}: [{a}, {b}) is not in [0, {n})")


def lod_length(low: int, high: int, lod: int) -> int:
    """Samples that [low, high) has at a level of detail."""
    return ((high - low - 1) >> lod) + 1


def subset_shape(low, high, lod: int = 0, full_res_dim: int = -1) -> tuple[int, ...]:
    """The shape of a subset request's result."""
    return tuple(b - a if d == full_res_dim else lod_length(a, b, lod) for d, (a, b) in enumerate(zip(low, high)))


def buffer_bytes(low, high, lod: int = 0, fmt: str = "R32", components: int = 1, full_res_dim: int = -1) -> int:
    """Bytes that a subset takes in its reference format; bits are packed along dimension 0."""
    n = subset_shape(low, high, lod, full_res_dim)
    if fmt == "1Bit":
        return -(-n[0] // 8) * math.prod(n[1:])
    width = {"U8": 1, "U16": 2, "U32": 4, "U64": 8, "R32": 4, "R64": 8}[fmt]
    return math.prod(n) * width * components
