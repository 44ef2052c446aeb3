"""Compact binary columns for number arrays that move between tasks."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays, each by byte planes, so that small numbers and sorted steps compress well."""
    head = np.array([[len(a), a.dtype.itemsize] for a in arrays], "<u4").tobytes()
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays if len(a))
    return zstandard.compress(head + planes, 1)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    at, out = 8 * n, []
    for size, width in np.frombuffer(raw, "<u4", 2 * n).reshape(n, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += size * width
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys; np.cumsum gives the keys again."""
    return np.diff(keys, prepend=keys.dtype.type(0)) if len(keys) else keys


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, or in 64 if they are needed."""
    return x.astype(np.uint32 if x.max(initial=0) <= 0xFFFFFFFF else np.uint64)
