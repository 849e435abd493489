"""Compact binary form of integer arrays: byte planes under zstandard."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, each cut into byte planes (the high planes of small numbers vanish) and compressed."""
    squeeze = zstandard.ZstdCompressor(level=1)
    out = [struct.pack("<I", len(arrays))]
    for array in arrays:
        array = np.ascontiguousarray(array)
        planes = array.view(np.uint8).reshape(len(array), array.itemsize).T
        body = squeeze.compress(planes.tobytes())
        code = array.dtype.str.encode().ljust(4)
        out += [struct.pack("<4sQQ", code, len(array), len(body)), body]
    return b"".join(out)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    (count,) = struct.unpack_from("<I", data)
    at, arrays = 4, []
    for _ in range(count):
        code, length, size = struct.unpack_from("<4sQQ", data, at)
        at += struct.calcsize("<4sQQ")
        kind = np.dtype(code.decode().strip())
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, length * kind.itemsize))
        at += size
        planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, length)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
    return arrays


def packed_length(data: bytes) -> int:
    """Length of the first array."""
    return struct.unpack_from("<4sQQ", data, struct.calcsize("<I"))[1]
