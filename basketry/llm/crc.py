"""CRC-32C of many byte ranges at once, in numpy.

A CRC without its initial and final inversion is linear over GF(2): the CRC
of a range is the XOR of one table entry per byte, chosen by the byte's value
and its distance to the end.  Ranges are cut into ``CHUNK`` bytes counted from
their end, chunk values are moved by whole chunks with shift tables, and the
XOR over a range's chunks is its CRC.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLY = 0x82F63B78  # fixed value: reflected Castagnoli polynomial
CHUNK = 256
MASK_DELTA = 0xA282EAD8  # fixed value: constant of the masked form


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
    return t


def _zero_byte(v: np.ndarray) -> np.ndarray:
    return _byte_table()[v & np.uint32(255)] ^ (v >> np.uint32(8))


@lru_cache(maxsize=1)
def _position_table() -> np.ndarray:
    """[CHUNK * 256]: value of byte b that has CHUNK-1-j bytes after it, at j*256+b."""
    rows = [_byte_table()]
    for _ in range(CHUNK - 1):
        rows.append(_zero_byte(rows[-1]))
    return np.concatenate(rows[::-1])


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (tables[0][v & np.uint32(255)] ^ tables[1][(v >> np.uint32(8)) & np.uint32(255)]
            ^ tables[2][(v >> np.uint32(16)) & np.uint32(255)] ^ tables[3][v >> np.uint32(24)])


@lru_cache(maxsize=64)
def _shift_tables(power: int) -> np.ndarray:
    """Tables that move a value by 2**power zero bytes."""
    basis = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    if power == 0:
        return _zero_byte(basis)
    half = _shift_tables(power - 1)
    return _apply(half, half)


def _shift(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Move values by n zero bytes each."""
    v, n, power = v.copy(), n.astype(np.int64), 0
    while (n >> power).any():
        at = np.nonzero((n >> power) & 1)[0]
        v[at] = _apply(_shift_tables(power), v[at])
        power += 1
    return v


def crc32c_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of data[starts[i] : starts[i] + lengths[i]] for every i."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    n = len(starts)
    out = np.zeros(n, np.uint32)
    chunks = -(-lengths // CHUNK)
    full = np.nonzero(chunks)[0]
    if len(full):
        k = chunks[full]
        owner = np.repeat(np.arange(len(full)), k)
        first = np.cumsum(k) - k
        after = k[owner] - 1 - (np.arange(int(k.sum())) - first[owner])  # chunks that follow in the same range
        padded = np.zeros(len(owner) * CHUNK, np.uint8)  # each range ends at a chunk's end
        for at, size, end in zip(starts[full].tolist(), lengths[full].tolist(), ((first + k) * CHUNK).tolist()):
            padded[end - size:end] = data[at:at + size]
        table, value = _position_table().reshape(CHUNK, 256), np.zeros(len(owner), np.uint32)
        for a in range(0, len(owner), 4096):
            columns = np.ascontiguousarray(padded[a * CHUNK:(a + 4096) * CHUNK].reshape(-1, CHUNK).T)
            part = value[a:a + 4096]
            for j in range(CHUNK):
                part ^= table[j].take(columns[j])
        out[full] = np.bitwise_xor.reduceat(_shift(value, after * CHUNK), first)
    return out ^ _shift(np.full(n, 0xFFFFFFFF, np.uint32), lengths) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
