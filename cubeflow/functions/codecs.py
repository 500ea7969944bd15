"""Chunk codecs as plain functions over bytes, for data that leaves or enters the engine outside Parquet.

Stored volumes leave compression to Parquet (run lengths, dictionaries, zstd).
"""

from __future__ import annotations

import zlib

import numpy as np

from cubeflow.descriptor import InvalidArgument, ReadError

CODECS = ("none", "rle", "zip")


def rle_encode(data: bytes, width: int = 4) -> bytes:
    """Runs of equal elements of ``width`` bytes: pairs of a 32-bit length and the element."""
    if len(data) % width:
        raise InvalidArgument("the data are not whole elements")
    x = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    if not len(x):
        return b""
    starts = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]).any(1)) + 1])
    lengths = np.diff(np.concatenate([starts, [len(x)]])).astype("<u4")
    return np.concatenate([lengths.view(np.uint8).reshape(-1, 4), x[starts]], axis=1).tobytes()


def rle_decode(data: bytes, width: int = 4) -> bytes:
    if len(data) % (4 + width):
        raise ReadError("run lengths are cut short")
    x = np.frombuffer(data, dtype=np.uint8).reshape(-1, 4 + width)
    return np.repeat(x[:, 4:], np.ascontiguousarray(x[:, :4]).view("<u4").ravel(), axis=0).tobytes()


def encode(data: bytes, codec: str, width: int = 4) -> bytes:
    if codec not in CODECS:
        raise InvalidArgument(f"unknown codec {codec}; wavelets are not supported")
    return {"none": lambda: data, "rle": lambda: rle_encode(data, width), "zip": lambda: zlib.compress(data)}[codec]()


def decode(data: bytes, codec: str, width: int = 4) -> bytes:
    if codec not in CODECS:
        raise InvalidArgument(f"unknown codec {codec}; wavelets are not supported")
    try:
        return {"none": lambda: data, "rle": lambda: rle_decode(data, width), "zip": lambda: zlib.decompress(data)}[codec]()
    except zlib.error as e:
        raise ReadError(str(e)) from e


def pack_bits(bits: np.ndarray) -> bytes:
    """Booleans to bits, lowest first, rows (the last axis) padded to whole bytes."""
    return np.packbits(bits, axis=-1, bitorder="little").tobytes()


def unpack_bits(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    row = -(-shape[-1] // 8)
    x = np.frombuffer(data, dtype=np.uint8).reshape(*shape[:-1], row)
    return np.unpackbits(x, axis=-1, count=shape[-1], bitorder="little").astype(bool)
