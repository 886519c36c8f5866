"""Words and n-grams of many texts at once as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_table(kind: str) -> np.ndarray:
    """True for bytes that belong to words. space: all but ASCII white space; alnum: ASCII letters and digits and all of non-ASCII."""
    t = np.ones(256, dtype=bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[0x00:0x30] = t[0x3A:0x41] = t[0x5B:0x61] = t[0x7B:0x80] = False
    return t


BASE = 0x5851F42D4C957F2D | 1
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in POWERS or len(POWERS["up"]) < n:
        m = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(m, U(base), dtype=U)
            p[0] = 1
            POWERS[name] = np.cumprod(p)
    return POWERS["up"][:n], POWERS["down"][:n]


def chunks(texts, limit: int = 1 << 21):
    """(first index, list of UTF-8 bytes) for runs of texts of about `limit` bytes; one longer text is a run of its own."""
    start, now, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if now and size + len(b) > limit:
            yield start, now
            start, now, size = i, [], 0
        now.append(b)
        size += len(b)
    if now:
        yield start, now


def words(texts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, text index, and byte start and end in its text, of every word, in order."""
    buf = lower_table()[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    inside = np.concatenate(([False], class_table(kind)[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    s, e = edge[::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(byte_codes()[buf] * up[: len(buf)])))
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    at = np.searchsorted(first, s, side="right") - 1
    return h, at, s - first[at], e - first[at]


def ngrams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """hash of each run of n words within one text, and the index of its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    g = np.zeros(m, dtype=U)
    for j in range(n):
        g = g * U(0xD6E8FEB86659FD93) + h[j : j + m]
    ok = np.flatnonzero(at[:m] == at[n - 1 :])
    return mix(g[ok]), ok


def shingle_sets(texts: list[bytes], n: int, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text: (hashes sorted within each text, offsets). A text of fewer words has its whole sequence as one."""
    h, at, _, _ = words(texts, kind)
    count = np.bincount(at, minlength=len(texts))
    few = (count > 0) & (count < n)
    if few.any():  # pad with a word that no text can hold
        need = np.where(few, n - count, 0)
        pad = np.repeat(np.arange(len(texts)), need)
        h, at = np.concatenate((h, np.full(len(pad), U(0x9D39247E33776D41)))), np.concatenate((at, pad))
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    g, first = ngrams(h, at, n)
    doc = at[first]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    if len(g):
        keep = np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))
        g, doc = g[keep], doc[keep]
    return g, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpack(b: bytes, dtype="<u8") -> np.ndarray:
    return np.frombuffer(b, dtype=dtype)
