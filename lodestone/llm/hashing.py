"""Vectorised word and window hashes over Arrow string columns.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D``. A word of up to LONG bytes is hashed eight bytes at a
time: its length and each lane of bytes go through a mixing step that spreads every bit, so words of at most eight
bytes never collide with others of their length. Longer words are hashed by keyed BLAKE2b. A word has two hashes of
64 bits, with keys of their own; the second is made where asked for. All functions work on whole texts; long ones are taken
in segments, so scratch memory stays at a few MB.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 19
#: Bytes of the longest word that is hashed by lanes.
LONG = 64
KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, LONG // 8), dtype=np.uint64) * U(2) + U(1)
#: Bytes as they are, and with A-Z in lower case.
BYTES = np.arange(256, dtype=np.uint8)
LOWER = BYTES.copy()
LOWER[65:91] = LOWER[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_IN_WORD = (~SPACE).astype(np.uint8).tobytes()
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, second: bool) -> np.ndarray:
    """One or two rows of hashes of the words from ``s`` to ``e``."""
    keys = KEYS[: 1 + second]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    n = e - s
    with np.errstate(over="ignore"):
        lane = lanes[s] & _MASK[np.minimum(n, 8)]
        out = np.stack([mix(lane ^ (n.astype(U) * k[0])) for k in keys])
        on = np.flatnonzero((n > 8) & (n <= LONG))
        for j in range(1, LONG // 8):
            if not len(on):
                break
            left = n[on] - 8 * j
            lane = lanes[s[on] + 8 * j] & _MASK[np.minimum(left, 8)]
            for row, k in zip(out, keys, strict=True):
                row[on] = mix((row[on] + k[j]) ^ lane)
            on = on[left > 8]
    for i in np.flatnonzero(n > LONG):
        digest = hashlib.blake2b(data[s[i] : e[i]].tobytes(), digest_size=16, key=KEYS.tobytes()[:64]).digest()
        out[:, i] = np.frombuffer(digest, "<u8")[: 1 + second]
    return out


def words(column: pa.Array, table: np.ndarray = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows, in order, and each row's first word (one more than rows)."""
    both, first = two_words(column, table, False)
    return both[0], first


def two_words(column: pa.Array, table: np.ndarray = BYTES, second: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``, with both hashes of each word, a row for each; ``table`` says what a byte counts as."""
    data, off = buffers(column)
    n = len(data)
    hashes, starts = [], []
    at = 0
    bounds = off[1:-1]
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:  # a segment ends where no word goes on
            nxt = np.flatnonzero(SPACE[data[end : end + 4096]])
            if len(nxt):
                end += int(nxt[0])
                break
            end = min(n, end + 4096)
        seg = data[at:end]
        raw = seg.tobytes()
        word = np.frombuffer(raw.translate(_IN_WORD), bool)
        before, after = np.empty(len(seg), bool), np.empty(len(seg), bool)
        before[0], after[-1] = True, True
        before[1:], after[:-1] = ~word[:-1], ~word[1:]
        lo, hi = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, end, "left")
        cut = bounds[lo:hi] - at
        before[cut[cut < len(seg)]] = True
        after[cut[cut > 0] - 1] = True
        s, e = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        hashes.append(_hashes(seg if table is BYTES else np.frombuffer(raw.translate(table.tobytes()), np.uint8), s, e, second))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros((1 + second, 0), np.uint64), np.zeros(len(off), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes, axis=1), np.searchsorted(start, off, "left")


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values; a run at i holds values i to i+k-1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            out *= U(0xD6E8FEB86659FD93)
            out += h[j : len(h) - k + 1 + j]
        out += U(k)
    return mix(out)


def windows_at(h: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """Another hash of the runs of k values that start at ``at``; over the words' second hashes it is independent of ``windows``."""
    with np.errstate(over="ignore"):
        out = h[at] ^ U(0xA5A5A5A5A5A5A5A5)
        for j in range(1, k):
            out = (out ^ (out >> U(29))) * U(0xBF58476D1CE4E5B9) + h[at + j]
    return mix(out)
