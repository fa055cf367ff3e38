"""Columns of numbers packed into one compressed binary value, for shuffles of few and large rows."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(**columns) -> bytes:
    """Arrays by name; whole numbers (64 bits at most) are narrowed, and stored as differences where that is narrower."""
    head, body = [], []
    for name, a in columns.items():
        a = np.atleast_1d(np.asarray(a))
        steps = ""
        if a.dtype == bool:
            a = a.astype(np.uint8)
        elif a.dtype.kind in "iu":
            a, steps = _narrow(a)
        head.append(f"{name} {a.dtype.str[1:]}{steps} {len(a)}")
        # byte by byte of all values: like bytes stand together
        body.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.dtype.kind in "iu" and len(a) else a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress("\n".join(head).encode() + b"\0" + b"".join(body))


def _narrow(a: np.ndarray) -> tuple[np.ndarray, str]:
    if not len(a):
        return a.astype(np.uint8), ""
    low, high = int(a.min()), int(a.max())
    if low < 0:
        return a.astype(np.min_scalar_type(min(low, -high))), ""
    plain = np.min_scalar_type(high)
    if len(a) > 1 and (a[1:] >= a[:-1]).all():
        gaps = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
        return gaps.astype(np.min_scalar_type(int(gaps.max()))), "^" if high >> 63 else "+"
    return a.astype(plain), ""


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    """The arrays; whole numbers come back as int64, or as uint64 if one is beyond that."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    cut = raw.index(b"\0")
    out, at = {}, cut + 1
    for line in raw[:cut].decode().split("\n"):
        name, kind, n = line.split(" ")
        n, steps, kind = int(n), kind[-1] if kind[-1] in "+^" else "", np.dtype(kind.rstrip("+^"))
        size = n * kind.itemsize
        a = np.frombuffer(raw, np.uint8, size, at)
        at += size
        if kind.kind in "iu":
            a = np.ascontiguousarray(a.reshape(kind.itemsize, n).T).view(kind).reshape(n)
            a = np.cumsum(a, dtype=np.uint64 if steps == "^" else np.int64) if steps else a.astype(np.uint64 if kind == np.uint64 and (a >> np.uint64(63)).any() else np.int64)
        else:
            a = a.view(kind)
        out[name] = a
    return out
