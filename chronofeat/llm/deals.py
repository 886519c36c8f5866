"""Columns of integers packed for a shuffle: one compressed blob per batch and deal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

from chronofeat.llm.textnum import U


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, one plane after the other, for the compressor."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(b, dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def freeze(columns: list[tuple[np.ndarray, int]], tail: bytes = b"") -> bytes:
    parts = [len(columns[0][0]).to_bytes(8, "little")] + [planes(x.view(U) if x.dtype == np.int64 else x, w) for x, w in columns] + [tail]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def thaw(blob: bytes, widths: list[int]) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for w in widths:
        out.append(unplanes(raw[at : at + n * w], n, w))
        at += n * w
    return out, raw[at:]


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]
