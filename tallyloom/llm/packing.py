"""Integer arrays packed into compressed bytes, for exchanges that move blocks of numbers rather than rows."""

from __future__ import annotations

import pickle

import numpy as np
import zstandard


def small(a: np.ndarray) -> np.ndarray:
    """The array in the narrowest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def deltas(a: np.ndarray) -> np.ndarray:
    """A sorted array as differences."""
    return np.diff(a, prepend=a.dtype.type(0))


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of all arrays, compressed together."""
    head = pickle.dumps([(a.dtype.str, len(a)) for a in arrays])
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    raw, at, out = zstandard.ZstdDecompressor().decompress(data[4 + size :]), 0, []
    for kind, n in pickle.loads(data[4 : 4 + size]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out
