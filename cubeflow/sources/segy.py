"""SEG-Y: header decoding, a partitioned source and sink, scanning, placement and export.

A file is a 3200-byte text header, a 400-byte binary header and traces of equal length, each a
240-byte header and samples.  Byte positions of fields count from 1.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cubeflow.descriptor import Axis, Channel, Descriptor, InvalidArgument, InvalidOperation, Layout, ReadError
from cubeflow.functions import convert, coords
from cubeflow.operators import stats

TEXT_BYTES, BINARY_BYTES, TRACE_HEADER_BYTES = 3200, 400, 240
FIRST_TRACE = TEXT_BYTES + BINARY_BYTES
#: (byte position, width); fixed values of the format.
BINARY_FIELDS = {"interval": (17, 2), "samples": (21, 2), "format": (25, 2), "measurement_system": (55, 2)}
TRACE_FIELDS = {
    "ensemblenumber": (21, 4), "offset": (37, 4), "azimuth": (61, 4), "coordinatescale": (71, 2), "sourcex": (73, 4), "sourcey": (77, 4),
    "groupx": (81, 4), "groupy": (85, 4), "starttime": (109, 2), "mutestart": (111, 2), "muteend": (113, 2), "samples": (115, 2), "interval": (117, 2),
    "ensemblex": (181, 4), "ensembley": (185, 4), "inlinenumber": (189, 4), "crosslinenumber": (193, 4), "receiver": (13, 4), "energysourcepointnumber": (17, 4),
}
ALIASES = {"inline": "inlinenumber", "crossline": "crosslinenumber", "cdp": "ensemblenumber", "sp": "energysourcepointnumber", "easting": "ensemblex", "northing": "ensembley"}
#: Sample formats that can be read and written: code, numpy type of big-endian storage.
SAMPLE_FORMATS = {1: ("ibm", ">u4"), 2: ("int32", ">i4"), 3: ("int16", ">i2"), 5: ("ieee", ">f4"), 6: ("ieee64", ">f8"), 8: ("int8", "i1"), 10: ("uint32", ">u4"), 11: ("uint16", ">u2"), 16: ("uint8", "u1")}
SURVEY_TYPES = ("Poststack", "Prestack", "Prestack2D", "Poststack2D", "CDPGathers", "ShotGathers", "ReceiverGathers", "OffsetSorted")
METERS_PER_FOOT = 0.3048


# --- values ---


def ibm_to_ieee(bits: np.ndarray) -> np.ndarray:
    """IBM hexadecimal single floats (as unsigned 32-bit integers) to float32."""
    bits = bits.astype(np.uint32)
    mantissa = (bits & 0x00FFFFFF).astype(np.float64)
    exponent = ((bits >> 24) & 0x7F).astype(np.int64) - 64
    return (np.where(bits >> 31, -1.0, 1.0) * np.ldexp(mantissa, 4 * exponent - 24)).astype(np.float32)


def ieee_to_ibm(values: np.ndarray) -> np.ndarray:
    """float32 to IBM hexadecimal single floats; what the 24 bits cannot hold is cut off."""
    v = values.astype(np.float64)
    m, e = np.frexp(np.abs(v))
    hexponent = -(-e // 4)
    mantissa = np.ldexp(m, 24 - (4 * hexponent - e)).astype(np.uint32)
    out = (np.signbit(v).astype(np.uint32) << 31) | ((hexponent + 64).astype(np.uint32) << 24) | mantissa
    return np.where(v == 0, np.uint32(0), out).astype(np.uint32)


def ibm_column(bits: Column) -> Column:
    """The same as ``ibm_to_ieee`` on a long column, in the JVM."""
    mantissa = bits.bitwiseAND(F.lit(0x00FFFFFF)).cast("double")
    exponent = F.shiftright(bits, 24).bitwiseAND(F.lit(0x7F)) - 64
    return F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, -1.0).otherwise(1.0) * mantissa * F.pow(F.lit(2.0), 4.0 * exponent - 24.0)


def decode_samples(data: bytes, code: int, little: bool = False) -> np.ndarray:
    """Samples of a trace as float32 (float64 where that is stored)."""
    if code not in SAMPLE_FORMATS:
        raise InvalidArgument(f"sample format {code} cannot be read")
    kind, dtype = SAMPLE_FORMATS[code]
    raw = np.frombuffer(data, dtype=dtype.replace(">", "<") if little else dtype)
    return ibm_to_ieee(raw) if kind == "ibm" else raw.astype(np.float64 if kind == "ieee64" else np.float32)


def encode_samples(values: np.ndarray, code: int, little: bool = False) -> bytes:
    if code not in SAMPLE_FORMATS:
        raise InvalidArgument(f"sample format {code} cannot be written")
    kind, dtype = SAMPLE_FORMATS[code]
    dtype = dtype.replace(">", "<") if little else dtype
    if kind == "ibm":
        return ieee_to_ibm(values).astype(dtype).tobytes()
    if kind.startswith("ieee"):
        return values.astype(dtype).tobytes()
    info = np.iinfo(np.dtype(dtype))
    return np.clip(np.floor(values.astype(np.float64) + 0.5), info.min, info.max).astype(dtype).tobytes()


def is_ebcdic(text: bytes) -> bool:
    """By which of the two codes makes more letters, digits and spaces of it."""
    plain = lambda s: sum(c.isalnum() and c.isascii() or c == " " for c in s)
    return plain(text.decode("cp037")) > plain(text.decode("latin-1"))


def read_text_header(text: bytes) -> str:
    return text.decode("cp037" if is_ebcdic(text) else "latin-1")


def write_text_header(lines: list[str], ebcdic: bool = True) -> bytes:
    """40 lines of 80 columns."""
    block = "".join(line[:80].ljust(80) for line in (lines + [""] * 40)[:40])
    return block.encode("cp037" if ebcdic else "latin-1", "replace")


def header_field(header: Column, position: int, width: int, little: bool = False) -> Column:
    """A signed 2- or 4-byte field of a binary header column; position 0 is an undefined field and gives 0."""
    if not position:
        return F.lit(0).cast("long")
    if width not in (2, 4):
        raise InvalidArgument("fields are 2 or 4 bytes wide")
    part = [F.substring(header, position + k, 1) for k in range(width)]
    number = F.conv(F.hex(F.concat(*(part[::-1] if little else part))), 16, 10).cast("long")
    return F.when(number >= 1 << 8 * width - 1, number - (1 << 8 * width)).otherwise(number)


def pack_field(header: bytearray, name: str, value: int, little: bool = False) -> None:
    position, width = TRACE_FIELDS[name]
    struct.pack_into(("<" if little else ">") + {2: "h", 4: "i"}[width], header, position - 1, value)


def header_column(fields: dict[str, Column]) -> Column:
    """A 240-byte big-endian trace header, made in the JVM, with the named fields set and the rest zero."""
    parts, at = [], 1
    for name, value in sorted(fields.items(), key=lambda f: TRACE_FIELDS[f[0]][0]):
        position, width = TRACE_FIELDS[name]
        if position < at:
            raise InvalidArgument(f"field {name} overlaps the one before it")
        parts += [F.lit("00" * (position - at)), F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 8 * width))), 2 * width, "0")]
        at = position + width
    return F.unhex(F.concat(*parts, F.lit("00" * (TRACE_HEADER_BYTES + 1 - at))))


def parse_mapping(entries: list[str] | dict[str, object]) -> dict[str, tuple[int, int]]:
    """Trace fields with changes: "name=byte:width" arguments or a JSON-like dict; aliases are understood."""
    out = dict(TRACE_FIELDS)
    if not isinstance(entries, dict):
        entries = dict(e.split("=", 1) for e in entries)
    for name, where in entries.items():
        position, _, width = str(where).partition(":") if not isinstance(where, (list, tuple)) else (where[0], "", where[1] if len(where) > 1 else "")
        key = name.lower()
        default = out.get(ALIASES.get(key, key), (0, 4))[1]
        out[ALIASES.get(key, key)] = (int(position), int(width or default))
    return out


# --- source ---


def _open(path: str):
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store, inner


@dataclass(frozen=True)
class FileInfo:
    """What the headers of a file say about its traces."""

    path: str
    samples: int
    interval: int
    format: int
    measurement_system: int
    traces: int
    text: str
    little: bool = False

    @property
    def sample_bytes(self) -> int:
        return np.dtype(SAMPLE_FORMATS[self.format][1]).itemsize

    @property
    def trace_bytes(self) -> int:
        return TRACE_HEADER_BYTES + self.samples * self.sample_bytes

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> FileInfo:
        return cls(**json.loads(text))


def file_info(path: str, little: bool = False, format_override: int | None = None) -> FileInfo:
    """Reads the file's headers; sample count and interval fall back to the first trace's."""
    store, inner = _open(path)
    size = store.get_file_info(inner).size
    if size is None or size < FIRST_TRACE:
        raise ReadError(f"{path} is too short for SEG-Y")
    with store.open_input_file(inner) as f:
        head = f.read(FIRST_TRACE + TRACE_HEADER_BYTES)
    end = "<" if little else ">"
    get = lambda at, table, name: struct.unpack_from(end + {2: "h", 4: "i"}[table[name][1]], head, at + table[name][0] - 1)[0]
    b = {name: get(TEXT_BYTES, BINARY_FIELDS, name) for name in BINARY_FIELDS}
    if len(head) == FIRST_TRACE + TRACE_HEADER_BYTES:
        for name in ("samples", "interval"):
            b[name] = b[name] or get(FIRST_TRACE, TRACE_FIELDS, name)
    code = format_override or b["format"]
    if code not in SAMPLE_FORMATS:
        raise ReadError(f"{path}: sample format {code} cannot be read")
    n = b["samples"] & 0xFFFF
    width = TRACE_HEADER_BYTES + n * np.dtype(SAMPLE_FORMATS[code][1]).itemsize
    return FileInfo(path, n, b["interval"], code, b["measurement_system"], (size - FIRST_TRACE) // width, read_text_header(head[:TEXT_BYTES]), little)


@dataclass
class TraceRange(InputPartition):
    first: int
    last: int


class SegyReader(DataSourceReader):
    """Partitions are ranges of traces.

    A range to read is given by options: a Python source keeps filters that one query has pushed
    down for the next one over the same frame, so it takes none.
    """

    def __init__(self, info: FileInfo, headers_only: bool, partition_bytes: int, low: int = 0, high: int | None = None) -> None:
        self.info, self.headers_only, self.partition_bytes = info, headers_only, partition_bytes
        self.low, self.high = max(0, low), info.traces if high is None else min(high, info.traces)

    def partitions(self):
        step = max(1, self.partition_bytes // self.info.trace_bytes)
        return [TraceRange(a, min(a + step, self.high)) for a in range(self.low, self.high, step)] or [TraceRange(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        info, at = self.info, partition.first
        store, inner = _open(info.path)
        with store.open_input_file(inner) as f:
            f.seek(FIRST_TRACE + at * info.trace_bytes)
            while at < partition.last:
                n = min(256, partition.last - at)
                data = f.read(n * info.trace_bytes)
                if len(data) < n * info.trace_bytes:
                    raise ReadError(f"{info.path} ends within trace {at + len(data) // info.trace_bytes}")
                rows = [data[k * info.trace_bytes : (k + 1) * info.trace_bytes] for k in range(n)]
                columns = {"trace": pa.array(range(at, at + n), pa.int64()), "header": pa.array([r[:TRACE_HEADER_BYTES] for r in rows], pa.binary())}
                if not self.headers_only:
                    columns["samples"] = pa.array([decode_samples(r[TRACE_HEADER_BYTES:], info.format, info.little) for r in rows], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_pydict(columns)
                at += n


@dataclass
class PartFile(WriterCommitMessage):
    path: str | None
    first: int
    traces: int


class SegyWriter(DataSourceWriter):
    """Tasks write the traces of their range to files of their own; the commit lays these end to end in trace order."""

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.format = path, int(options.get("format", 5))
        self.little = options.get("endianness", "big") == "little"
        self.interval, self.text = int(options.get("interval", 4000)), options.get("text", "").split("\n")
        self.measurement = int(options.get("measurementsystem", 1))

    def write(self, rows) -> PartFile:
        from pyspark import TaskContext

        store, inner = _open(self.path)
        first, n, part, out = None, 0, None, None
        for row in rows:
            if out is None:
                part, first = f"{inner}.part-{TaskContext.get().taskAttemptId()}", row["trace"]
                out = store.open_output_stream(part)
            out.write(bytes(row["header"]))
            out.write(encode_samples(np.asarray(row["samples"], dtype=np.float32), self.format, self.little))
            self.n_samples = len(row["samples"])
            n += 1
        if out is not None:
            out.close()
        message = PartFile(part, first or 0, n)
        message.samples = getattr(self, "n_samples", 0)
        return message

    def commit(self, messages) -> None:
        store, inner = _open(self.path)
        parts = sorted((m for m in messages if m and m.path), key=lambda m: m.first)
        binary = bytearray(BINARY_BYTES)
        values = {"interval": self.interval, "samples": parts[0].samples if parts else 0, "format": self.format, "measurement_system": self.measurement}
        for name, v in values.items():
            struct.pack_into(("<" if self.little else ">") + "H", binary, BINARY_FIELDS[name][0] - 1, v)
        with store.open_output_stream(inner) as out:
            out.write(write_text_header(self.text))
            out.write(bytes(binary))
            for m in parts:
                with store.open_input_stream(m.path) as f:
                    while data := f.read(16 << 20):
                        out.write(data)
        self.abort(messages)

    def abort(self, messages) -> None:
        store, _ = _open(self.path)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


class SegySource(DataSource):
    """spark.read.format("segy").load(path); options: headersOnly, endianness, format, partitionBytes, firstTrace, lastTrace (not read).

    Rows are (trace bigint, header binary[, samples array<float>]).
    """

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return "trace bigint, header binary" + ("" if self._headers_only else ", samples array<float>")

    @property
    def _headers_only(self) -> bool:
        return str(self.options.get("headersOnly", self.options.get("headersonly", "false"))).lower() == "true"

    def reader(self, schema) -> SegyReader:
        code = self.options.get("format")
        info = file_info(self.options["path"], self.options.get("endianness", "big") == "little", int(code) if code else None)
        get = lambda name, default: int(self.options.get(name, self.options.get(name.lower(), default)))
        return SegyReader(info, self._headers_only, get("partitionBytes", 64 << 20), get("firstTrace", 0), get("lastTrace", info.traces))

    def writer(self, schema, overwrite: bool) -> SegyWriter:
        return SegyWriter(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegySource)


def read_traces(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    reader = spark.read.format("segy")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def write_traces(traces: DataFrame, path: str, **options) -> None:
    """Writes (trace, header, samples) in trace order."""
    register(traces.sparkSession)
    ordered = traces.select("trace", "header", "samples").repartitionByRange("trace").sortWithinPartitions("trace")
    writer = ordered.write.format("segy").mode("append")
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.save(path)


# --- scan and placement ---


@dataclass(frozen=True)
class ImportOptions:
    """How trace headers become axes and values."""

    primary_key: str = "inlinenumber"
    secondary_key: str = "crosslinenumber"
    prestack: bool = False
    two_d: bool = False
    offset_sorted: bool = False
    header_fields: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(TRACE_FIELDS))
    little: bool = False
    attribute: str = "Amplitude"
    attribute_unit: str = ""
    mute: bool = False
    azimuth: bool = False
    azimuth_scale: float = 1.0
    azimuth_radians: bool = False
    respace_gathers: str = "Auto"
    percentile: float = 99.5
    brick_log2: int = 6
    margin: int = 0
    lods: int | None = None
    mult_2d: int = 4
    sample_unit: str = "ms"
    ignore_warnings: bool = False
    scale_override: float | None = None
    crs_wkt: str = ""
    distance_units: str = "original"

    def key(self, name: str) -> tuple[int, int]:
        name = ALIASES.get(name.lower(), name.lower())
        if name not in self.header_fields:
            raise InvalidArgument(f"unknown header field {name}")
        return self.header_fields[name]

    @property
    def survey_type(self) -> str:
        primary = ALIASES.get(self.primary_key.lower(), self.primary_key.lower())
        if self.offset_sorted:
            return "OffsetSorted"
        if self.two_d:
            return "Prestack2D" if self.prestack else "Poststack2D"
        if primary in ("inlinenumber", "crosslinenumber"):
            return "Prestack" if self.prestack else "Poststack"
        kinds = {"ensemblenumber": "CDPGathers", "receiver": "ReceiverGathers", "energysourcepointnumber": "ShotGathers"}
        if primary not in kinds:
            raise InvalidArgument(f"no survey type for primary key {self.primary_key}")
        return kinds[primary]

    @property
    def coordinate_fields(self) -> tuple[str, str]:
        return {"ShotGathers": ("sourcex", "sourcey"), "ReceiverGathers": ("groupx", "groupy")}.get(self.survey_type, ("ensemblex", "ensembley"))

    def layout(self) -> Layout:
        lods = self.lods if self.lods is not None else 4 if self.survey_type == "Poststack" else 0
        return Layout(self.brick_log2, self.margin, self.margin, self.mult_2d, lods)

    @property
    def write_group(self) -> tuple[int, ...]:
        if self.survey_type in ("Poststack2D", "CDPGathers", "ShotGathers", "ReceiverGathers"):
            return (0, 1)
        if self.survey_type == "OffsetSorted":
            return (0, 2, 3)
        primary = ALIASES.get(self.primary_key.lower(), self.primary_key.lower())
        return (0, 1, 3) if self.prestack and primary == "crosslinenumber" else (0, 1, 2)


def trace_headers(traces: DataFrame, options: ImportOptions) -> DataFrame:
    """(trace, primary, secondary, offset, x, y, azimuth, mute_start, mute_end, header) from binary headers."""
    get = lambda name: header_field(F.col("header"), *options.key(name), little=options.little)
    scale = stats.coordinate_scale(get("coordinatescale"))
    x, y = options.coordinate_fields
    unit = {"original": 1.0, "meters": METERS_PER_FOOT, "feet": 1 / METERS_PER_FOOT}[options.distance_units]
    columns = [get(options.primary_key).alias("primary"), get(options.secondary_key).alias("secondary"), get("offset").alias("offset"), (get(x) * scale * unit).alias("x"), (get(y) * scale * unit).alias("y")]
    columns.append(stats.azimuth_from_header(get("azimuth").cast("double"), F.lit(options.azimuth_scale), options.azimuth_radians).alias("azimuth"))
    columns += [get("mutestart").alias("mute_start"), get("muteend").alias("mute_end")]
    return traces.select("trace", *columns, "header")


def scan_segments(headers: DataFrame, run: int = 65536) -> DataFrame:
    """(segment, primary, first_trace, last_trace, n): runs of equal primary keys, found in parallel over ranges of traces."""
    return stats.segments(headers, "primary", ["trace"], bucket=F.floor(F.col("trace") / run))


def survey(headers: DataFrame, info: FileInfo, options: ImportOptions, value_range: tuple[float, float] = (0.0, 1.0)) -> Descriptor:
    """Axes and channels from the extent, fold and steps of the keys."""
    kind = options.survey_type
    ends = headers.agg(F.min("primary").alias("p0"), F.max("primary").alias("p1"), F.min("secondary").alias("s0"), F.max("secondary").alias("s1"), F.count("*").alias("n")).first()
    if not ends.n:
        raise InvalidOperation("the file has no traces")
    fold = headers.groupBy("primary", "secondary").count().agg(F.max("count")).first()[0]
    if kind == "OffsetSorted":
        fold = headers.select("offset").distinct().count()
    if not options.ignore_warnings:
        if kind == "Poststack" and fold > 1:
            raise InvalidOperation(f"poststack data with {fold} traces at a position")
        if kind == "Prestack" and fold < 2:
            raise InvalidOperation("prestack data with one trace at every position")
    step_of = lambda key: headers.select(key).distinct().select((F.col(key) - F.lag(key).over(Window.orderBy(key))).alias("g")).agg(F.min("g")).first()[0] or 1  # noqa: E731  distinct keys only
    step_p, step_s = step_of("primary"), step_of("secondary")
    names = {"inlinenumber": "Inline", "crosslinenumber": "Crossline", "ensemblenumber": "CDP", "receiver": "Receiver", "energysourcepointnumber": "Shot"}
    label = lambda key: names.get(ALIASES.get(key.lower(), key.lower()), key)
    ms = info.interval / 1000.0
    sample = Axis(info.samples, "Sample", options.sample_unit, 0.0, (info.samples - 1) * ms)
    primary = Axis((ends.p1 - ends.p0) // step_p + 1, label(options.primary_key), "unitless", float(ends.p0), float(ends.p1))
    secondary = Axis((ends.s1 - ends.s0) // step_s + 1, label(options.secondary_key), "unitless", float(ends.s0), float(ends.s1))
    trace_axis = Axis(fold, "Trace (offset)", "unitless", 1.0, float(fold))
    axes = {"Poststack": (sample, secondary, primary), "Prestack": (sample, trace_axis, secondary, primary), "OffsetSorted": (sample, trace_axis, secondary, primary), "Poststack2D": (sample, primary), "Prestack2D": (sample, trace_axis, primary)}.get(kind, (sample, secondary, primary))
    if not options.ignore_warnings and np.prod([a.num_samples for a in axes[1:]]) >= 2 * ends.n * (fold if kind in ("Prestack", "OffsetSorted") else 1):
        raise InvalidOperation("the axes hold over twice as many traces as the file; are the keys right?")
    channels = [Channel(options.attribute, "R32", unit=options.attribute_unit, range_min=value_range[0], range_max=value_range[1]), Channel("Trace", "U8", mapping="PerTrace", discrete=True), Channel("SEGYTraceHeader", "U8", mapping="PerTrace", mapped_values=TRACE_HEADER_BYTES, discrete=True)]
    if kind in ("Prestack", "Prestack2D", "OffsetSorted"):
        channels.append(Channel("Offset", "R32", mapping="PerTrace"))
    if options.azimuth:
        channels.append(Channel("Azimuth", "R32", mapping="PerTrace", unit="deg"))
    if options.mute:
        channels.append(Channel("Mute", "U16", components=2, mapping="PerTrace", unit="ms"))
    return Descriptor(tuple(axes), tuple(channels), options.layout()).validate()


def respaced(gathers: DataFrame, fold: int, offsets: DataFrame, keys: tuple[str, ...] = ("primary", "secondary"), order: str = "trace") -> DataFrame:
    """``gathers`` with ``slot``: each trace near its offset's place in the survey's offset list, leaving holes while there is room.

    With i a trace's place in its gather of n and w the first place of its offset in ``offsets``
    (place, offset), the slot is i plus the largest w - i so far, but never so far that the traces
    after it would not fit: at most fold - n.  A gather with an offset that is not in the list, met
    while there is still room, keeps its traces together from slot 0.
    """
    first = offsets.groupBy("offset").agg(F.min("place").alias("w"))
    w = Window.partitionBy(*keys).orderBy(order)
    g = gathers.join(first, "offset", "left").withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    shift = F.max(F.col("w") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("shift", F.least(F.lit(fold) - F.col("n"), F.greatest(F.lit(0), F.coalesce(shift, F.lit(0)))))
    before = F.coalesce(F.lag("shift").over(w), F.lit(0))
    g = g.withColumn("lost", F.when(F.col("w").isNull() & (before < F.lit(fold) - F.col("n")), 1).otherwise(0))
    g = g.withColumn("lost", F.max("lost").over(Window.partitionBy(*keys)))
    return g.withColumn("slot", F.when(F.col("lost") == 1, F.col("i")).otherwise(F.col("i") + F.col("shift")).cast("long")).drop("w", "i", "n", "shift", "lost")


def placed(headers: DataFrame, d: Descriptor, options: ImportOptions) -> DataFrame:
    """``headers`` with d1, d2, ...: where each trace goes.  Traces whose keys are off the axes' grid are left out; of several at a place the last stays."""
    kind = options.survey_type
    axis = {a.name: k for k, a in enumerate(d.axes)}
    names = {"inlinenumber": "Inline", "crosslinenumber": "Crossline", "ensemblenumber": "CDP", "receiver": "Receiver", "energysourcepointnumber": "Shot"}
    dim = lambda key: axis.get(names.get(ALIASES.get(key.lower(), key.lower()), key))
    out = headers
    for key, column in ((options.primary_key, "primary"), (options.secondary_key, "secondary")):
        k = dim(key)
        if k is not None:
            out = out.withColumn(f"d{k}", coords.coordinate_to_index(F.col(column).cast("double"), d.axes[k]))
            exact = F.abs(coords.index_to_coordinate(F.col(f"d{k}"), d.axes[k]) - F.col(column)) < 1e-6
            out = out.where(exact & F.col(f"d{k}").between(0, d.axes[k].num_samples - 1))
    if kind in ("Prestack", "Prestack2D", "OffsetSorted"):
        fold = d.axes[1].num_samples
        listed = headers.select("offset").distinct().withColumn("place", F.row_number().over(Window.orderBy("offset")) - 1)  # distinct offsets only
        if kind == "OffsetSorted":
            out = out.join(listed.withColumnRenamed("place", "d1"), "offset").withColumn("d1", F.col("d1").cast("long"))
        elif options.respace_gathers != "Off":
            out = respaced(out, fold, listed).withColumnRenamed("slot", "d1")
        else:
            w = Window.partitionBy("primary", "secondary").orderBy("trace")
            out = out.withColumn("d1", (F.row_number().over(w) - 1).cast("long"))
        out = out.where(F.col("d1") < fold)
    dims = [f"d{k}" for k in range(1, d.dimensionality)]
    return stats.last_of_duplicates(out, dims, "trace")


def imported(spark: SparkSession, path: str, options: ImportOptions) -> tuple[Descriptor, DataFrame, DataFrame]:
    """(descriptor, voxels, trace table) of a SEG-Y file."""
    info = file_info(path, options.little)
    endianness = "little" if options.little else "big"
    headers = trace_headers(read_traces(spark, path, headersOnly="true", endianness=endianness), options)
    traces = read_traces(spark, path, endianness=endianness)
    r = stats.value_range(traces.select(F.explode("samples").alias("value")), options.percentile).first()
    d = survey(headers, info, options, (r.range_min, r.range_max))
    where = placed(headers, d, options)
    dims = [f"d{k}" for k in range(1, d.dimensionality)]
    rows = traces.select("trace", "samples").join(where.select("trace", *dims), "trace")
    samples = F.transform("samples", lambda x: x * options.scale_override) if options.scale_override else F.col("samples")
    voxels = rows.select(*dims, F.posexplode(samples).alias("d0", "value")).select(F.col("d0").cast("long").alias("d0"), *dims, "value")
    return d, voxels, where.withColumn("flag", F.lit(1)).select(*dims, "trace", "flag", "header", "offset", "azimuth", "mute_start", "mute_end", "x", "y")


def exported(voxels: DataFrame, trace_table: DataFrame, path: str, n_samples: int, fmt: int = 5, interval: int = 4000, text: str = "", little: bool = False) -> None:
    """Writes the flagged traces, ordered by the outer dimensions, with their headers; missing samples are zero."""
    from cubeflow.operators.subset import to_traces

    dims = sorted(c for c in trace_table.columns if c[0] == "d" and c[1:].isdigit())
    lines = to_traces(voxels, n_samples).withColumnRenamed("values", "samples")
    rows = trace_table.where("flag = 1").select(*dims, "header").join(lines, dims, "left")
    samples = F.transform(F.coalesce("samples", F.array_repeat(F.lit(None).cast("float"), n_samples)), lambda x: F.coalesce(x.cast("float"), F.lit(0.0).cast("float")))
    number, factor = F.lit(0).cast("long"), 1
    ends = trace_table.agg(*[F.max(c) for c in dims]).first()
    for c, top in zip(dims, ends):
        number, factor = number + F.col(c) * factor, factor * ((top or 0) + 1)
    write_traces(rows.select(number.alias("trace"), "header", samples.alias("samples")), path, format=fmt, interval=interval, text=text, endianness="little" if little else "big")


def ensemble_index(headers: DataFrame, key: str = "primary") -> DataFrame:
    """(key, place): the ensembles of a line in ascending order, numbered from 0."""
    return stats.places(headers.select(key).distinct(), key).drop("places")  # an entry an ensemble


def line_information(headers: DataFrame) -> DataFrame:
    """One row for a 2-D line: positions array<struct<x, y>>, ensemble_numbers and traces, in ensemble order.

    An ensemble's position is that of its first trace.  The ensembles of a line lie in one row, as
    they become metadata of one dataset.
    """
    one = headers.groupBy("primary").agg(F.min_by(F.struct("x", "y"), "trace").alias("position"), F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("primary", "position", "n")))
    return one.agg(ordered.alias("o")).select(F.col("o.position").alias("positions"), F.col("o.primary").alias("ensemble_numbers"), F.col("o.n").alias("traces"))


def provenance(path: str, info: FileInfo, options: ImportOptions) -> list:
    """Metadata items that say where imported data came from."""
    from cubeflow.descriptor import MetadataItem

    items = [("InputFileName", path), ("InputFileSize", str(FIRST_TRACE + info.traces * info.trace_bytes)), ("SurveyType", options.survey_type), ("PrimaryKey", options.primary_key), ("SecondaryKey", options.secondary_key)]
    out = [MetadataItem("ImportInformation", name, "String", value) for name, value in items]
    out.append(MetadataItem("SEGY", "TextHeader", "BLOB", write_text_header([info.text[k : k + 80] for k in range(0, len(info.text), 80)])))
    if options.crs_wkt:
        out.append(MetadataItem("SurveyCoordinateSystem", "CRSWkt", "String", options.crs_wkt))
    return out


def survey_metadata(headers: DataFrame, options: ImportOptions) -> list:
    """Origin (where both keys are 0) and the steps of x and y for each unit of inline and crossline, by least squares.

    If one key does not vary, its step is taken to be as long as the other's and at right angles to it.
    """
    from cubeflow.descriptor import MetadataItem

    cov = [F.covar_pop(a, b).alias(f"{a[0]}{b[0]}") for a, b in (("primary", "primary"), ("secondary", "secondary"), ("primary", "secondary"), ("primary", "x"), ("primary", "y"), ("secondary", "x"), ("secondary", "y"))]
    m = headers.agg(*[F.avg(c).alias(c) for c in ("primary", "secondary", "x", "y")], *cov).first()
    if m.primary is None:
        return []
    det = m.pp * m.ss - m.ps * m.ps
    if det > 1e-9 * max(m.pp * m.ss, 1e-12):
        p = tuple((m.ss * m[f"p{c}"] - m.ps * m[f"s{c}"]) / det for c in "xy")
        s = tuple((m.pp * m[f"s{c}"] - m.ps * m[f"p{c}"]) / det for c in "xy")
    elif m.pp > 0:
        p = (m.px / m.pp, m.py / m.pp)
        s = (-p[1], p[0])
    else:
        s = (m.sx / m.ss, m.sy / m.ss) if m.ss else (0.0, 1.0)
        p = (s[1], -s[0])
    origin = tuple(m[c] - m.primary * a - m.secondary * b for c, a, b in zip("xy", p, s))
    if ALIASES.get(options.primary_key.lower(), options.primary_key.lower()) == "crosslinenumber":
        p, s = s, p
    return [MetadataItem("SurveyCoordinateSystem", name, "DoubleVector2", v) for name, v in (("Origin", origin), ("InlineSpacing", p), ("CrosslineSpacing", s))]


def import_volume(spark: SparkSession, path: str, target: str, options: ImportOptions):
    """Imports a file into a new volume at ``target``: samples with levels of detail, trace channels and metadata."""
    from cubeflow.sources.volume import Volume

    d, voxels, table = imported(spark, path, options)
    items = provenance(path, file_info(path, options.little), options)
    if options.survey_type in ("Poststack", "Prestack", "OffsetSorted"):
        keys = trace_headers(read_traces(spark, path, headersOnly="true", endianness="little" if options.little else "big"), options)
        items += survey_metadata(keys, options)
    out = Volume.create(spark, target, d, items)
    out.write(voxels)
    dims = [f"d{k}" for k in range(1, d.dimensionality)]
    out.write_traces(table.select(*dims, F.array("flag").alias("values")), "Trace")
    out.write_traces(table.select(*dims, F.col("header").alias("values")), "SEGYTraceHeader")
    for name, columns in (("Offset", ("offset",)), ("Azimuth", ("azimuth",)), ("Mute", ("mute_start", "mute_end"))):
        if d.is_channel_available(name):
            out.write_traces(table.select(*dims, F.array(*columns).alias("values")), name)
    return out


def export_volume(volume, path: str, fmt: int = 5, interval: int = 4000, text: str = "") -> None:
    """Exports a volume that has the trace channels of an import."""
    dims = [f"d{k}" for k in range(1, volume.descriptor.dimensionality)]
    table = volume.traces_of("SEGYTraceHeader").withColumnRenamed("values", "header").join(volume.traces_of("Trace").select(*dims, F.col("values")[0].alias("flag")), dims)
    exported(volume.voxels(), table, path, volume.descriptor.shape[0], fmt, interval, text)


def quantized_override(value: Column, fmt: str, low: float, high: float) -> Column:
    """A float trace as levels of a quantised format over a range."""
    return convert.quantize(value, fmt, low, high)


def merged(infos: list[FileInfo]) -> FileInfo:
    """What several files of one survey have in common; they must agree on samples, interval and format."""
    if len({(i.samples, i.interval, i.format, i.little) for i in infos}) != 1:
        raise InvalidOperation("the files differ in samples, interval or format")
    return replace(infos[0], traces=sum(i.traces for i in infos))


def read_files(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Traces of several files, ordered by their smallest primary key, numbered through."""
    keyed = []
    for p in paths:
        t = read_traces(spark, p, **options)
        low = read_traces(spark, p, **{**options, "headersOnly": "true", "lastTrace": 1}).select(header_field(F.col("header"), *TRACE_FIELDS["inlinenumber"])).first()
        keyed.append((low[0] if low else 0, file_info(p, options.get("endianness") == "little").traces, t))
    out, base = None, 0
    for _, n, t in sorted(keyed, key=lambda k: k[0]):
        t = t.withColumn("trace", F.col("trace") + base)
        out, base = t if out is None else out.unionByName(t), base + n
    return out
