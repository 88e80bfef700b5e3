"""Hashes of words and word shingles of whole texts, vectorised over a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64, spans

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes."""
    s = strings.cast(pa.large_string())
    n = len(s)
    size = np.asarray(pc.binary_length(s), dtype=np.int64)
    if not n or not size.any():
        return mix64(np.zeros(n, dtype=np.uint64))
    offs = np.frombuffer(s.buffers()[1], dtype=np.int64)[s.offset : s.offset + n + 1]
    data = np.frombuffer(s.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]].astype(np.uint64) + np.uint64(1)
    start = spans(size)[:-1]
    place = np.arange(len(data)) - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max()), BASE, dtype=np.uint64))
    total = np.append(np.uint64(0), np.cumsum(data * power[place]))
    return mix64((total[start + size] - total[start]) + size.astype(np.uint64) * STEP)


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Flat word codes, offsets by text, and the distinct words that the codes mean (white space separates words)."""
    flat = texts.cast(pa.large_string())
    lists = pc.utf8_split_whitespace(pc.utf8_lower(flat) if lower else flat)
    coded = lists.flatten().dictionary_encode()
    code = np.asarray(coded.indices, dtype=np.int64)
    bound = np.asarray(lists.offsets, dtype=np.int64)
    bound = bound - bound[0]
    solid = (np.asarray(pc.binary_length(coded.dictionary), dtype=np.int64) > 0)[code] if len(code) else np.zeros(0, bool)
    return code[solid], spans(solid.astype(np.int64))[bound], coded.dictionary


def shingles(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Flat hashes of runs of ``n`` words (not distinct) and offsets by text; a shorter text is one run, an empty none."""
    code, bound, names = words(texts)
    h = string_hashes(names)[code] if len(code) else np.zeros(0, np.uint64)
    count = np.diff(bound)
    runs = np.where(count > n, count - n + 1, np.minimum(count, 1))
    offs = spans(runs)
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], runs) + np.repeat(bound[:-1], runs)
    end = np.repeat(bound[1:], runs)
    out = np.zeros(len(at), dtype=np.uint64)
    pad = np.append(h, np.zeros(n, dtype=np.uint64))
    mult = np.uint64(1)
    for j in range(n):
        out += np.where(at + j < end, pad[at + j] + np.uint64(1), np.uint64(0)) * mult
        mult = np.uint64((int(mult) * int(STEP)) % (1 << 64))
    return mix64(out), offs
