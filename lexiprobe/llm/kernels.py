"""Vectorised byte kernels over Arrow string columns (NumPy on the UTF-8 buffers, no per-word Python)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_P = U64(0x9E3779B97F4A7C15)
_C = U64(0xD6E8FEB86659FD93)
_POW = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(4095, _P))])


def release() -> None:
    """Gives memory that a finished block has left back to the machine: workers live on, and their blocks are large."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int) -> np.ndarray:
    """_P**0 .. _P**(n-1) modulo 2**64."""
    global _POW
    if n > len(_POW):
        _POW = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 2 * len(_POW)) - 1, _P))])
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, so that all bits are equally usable."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; a null is empty."""
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
        kind = np.int64
    else:
        col = col.cast(pa.string())
        kind = np.int32
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) of about ``size`` bytes; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = IDENTITY) -> np.ndarray:
    """A 64-bit hash of each data[start:end] (bytes mapped by ``table`` first), in slices of bounded size."""
    lens = ends - starts
    out = np.empty(len(starts), np.uint64)
    total = np.concatenate([[0], np.cumsum(lens)])
    i = 0
    values = _BYTE[table]
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 20), "right")) - 1)
        ln = lens[i:j]
        rel = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], ln)
        at = rel + np.repeat(starts[i:j], ln)
        term = values[data[at]] * powers(int(ln.max(initial=1)) + 1)[rel]
        full = ln > 0
        h = np.zeros(j - i, np.uint64)
        if full.any():
            h[full] = np.add.reduceat(term, (total[i:j] - total[i])[full])
        out[i:j] = h
        i = j
    return mix(out ^ (lens.astype(np.uint64) * _C))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in ``data``) of the words of documents, and n+1 offsets of each document's words."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    dark = ~_WHITE[data[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[offsets - lo] = True
    before = np.concatenate([[False], dark[:-1]]) & ~edge[:-1]
    after = np.concatenate([dark[1:], [False]]) & ~edge[1:] if hi > lo else dark
    starts = np.flatnonzero(dark & ~before) + lo
    ends = np.flatnonzero(dark & ~after) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: 0 white space, 1 letters, digits, _ and all that is not ASCII, 2 other characters.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[_WHITE] = 0
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`words`: runs of letters, and every other character that is not white space alone."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    kind = _CLASS[data[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[offsets - lo] = True
    joined = (kind[1:] == 1) & (kind[:-1] == 1) & ~edge[1:-1] if hi > lo else np.zeros(0, bool)
    some = kind > 0
    starts = np.flatnonzero(some & ~np.concatenate([[False], joined])[: hi - lo]) + lo
    ends = np.flatnonzero(some & ~np.concatenate([joined, [False]])[: hi - lo]) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of h[i:i+k] for every i with k numbers from it on."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _C
        out += h[j : j + n]
    return mix(out)


def pack(array: np.ndarray) -> bytes:
    """Unsigned integers as byte planes (all low bytes, then the next...), compressed."""
    a = np.ascontiguousarray(array)
    width = 1
    top = int(a.max(initial=0))
    while top >> (8 * width):
        width += 1
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9:], max_output_size=max(1, n * width)), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_all(*parts: bytes) -> bytes:
    """Several blobs in one."""
    return len(parts).to_bytes(4, "little") + b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def unpack_all(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    sizes = np.frombuffer(blob, "<u8", n, 4)
    at, out = 4 + 8 * n, []
    for s in sizes.tolist():
        out.append(blob[at : at + s])
        at += s
    return out


def pack_ids(col: list) -> bytes:
    """Nullable 64-bit ids."""
    null = np.fromiter((x is None for x in col), bool, len(col))
    ids = np.fromiter((0 if x is None else x for x in col), np.int64, len(col))
    return pack_all(pack(null.astype(np.uint8)), zstandard.ZstdCompressor(level=1).compress(ids.tobytes()) if len(col) else b"")


def unpack_ids(blob: bytes) -> list:
    a, b = unpack_all(blob)
    null = unpack(a).astype(bool)
    ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=8 * len(null)), np.int64) if len(null) else np.zeros(0, np.int64)
    return [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)]


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent, near their entropy: numbers under 128 as themselves, others as a
    class of their first four bits (entropy-coded by the compressor) and their remaining bits, packed by class."""
    r = np.ascontiguousarray(ranks).astype(np.int64)
    big = r >= 128
    log = np.zeros(len(r), np.int64)
    log[big] = np.frexp(r[big].astype(float))[1] - 1
    symbol = np.where(big, 128 + (log - 7) * 8 + ((r >> np.maximum(log - 3, 0)) & 7), r)
    if len(r) and int(symbol.max()) > 255:
        return b"\x00" + pack(r)
    parts = []
    for e in range(7, 23):
        own = r[log == e] if big.any() else r[:0]
        bits = ((own[:, None] >> np.arange(e - 3)) & 1).astype(np.uint8)
        parts.append(np.packbits(bits).tobytes())
    return b"\x01" + pack_all(len(r).to_bytes(8, "little"), zstandard.ZstdCompressor(level=3).compress(symbol.astype(np.uint8).tobytes()), *parts)


def unpack_ranks(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\x00":
        return unpack(blob[1:]).astype(np.int64)
    n, symbols, *parts = unpack_all(blob[1:])
    n = int.from_bytes(n, "little")
    s = np.frombuffer(zstandard.ZstdDecompressor().decompress(symbols, max_output_size=max(1, n)), np.uint8).astype(np.int64)
    out = s.copy()
    for e, raw in zip(range(7, 23), parts, strict=True):
        own = np.flatnonzero((s >= 128 + (e - 7) * 8) & (s < 136 + (e - 7) * 8))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: len(own) * (e - 3)].reshape(len(own), e - 3).astype(np.int64)
        out[own] = ((8 + (s[own] & 7)) << (e - 3)) + (bits << np.arange(e - 3)).sum(1)
    return out
