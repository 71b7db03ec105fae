"""Hashes of words and of byte n-grams of many texts at once, with numpy.

Works on an Arrow text column's own buffers. Texts are taken whole, in chunks of
at most CHUNK bytes; a longer text is a chunk by itself and is hashed block by
block, so that beside the column only some 60 bytes of memory a byte of a block
are used, however long a text or a word is. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_R = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: multiply and fold, twice."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def byte_values(keep: str) -> np.ndarray:
    """A random value for each byte; 0 for those that part words.

    ``keep``: "lower" takes words of digits, letters with A-Z lower-cased and all
    non-ASCII; "space" takes all that white space does not part, as it stands.
    """
    values = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    if keep == "space":
        values[[*range(9, 14), 32]] = 0
        return values
    for b in range(128):
        if chr(b).isupper():
            values[b] = values[b + 32]
        elif not chr(b).isalnum():
            values[b] = 0
    return values


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets of the texts in them) for runs of rows."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data or b"", np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        to = min(to, len(texts))
        yield data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def _powers(n: int) -> list[np.ndarray]:
    """R^i and R^-i below 2^64, i < n."""
    if len(_POWERS[0]) < n:
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            p = np.full(n, r, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def _words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash (not yet spread) of each word, in order."""
    v = values[data]
    inside = v != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = offsets[:-1], offsets[1:] - 1
    starts, ends = starts[starts < len(data)], ends[ends >= 0]
    first[starts], last[ends] = inside[starts], inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v * power[: len(v)], out=total[1:])
    return s, e, (total[e] - total[s]) * inverse[s]


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, again: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hash and text number of each word of a chunk, in order, and how many words of the part before come first.

    A chunk is one part. A long text has a part for each block; each begins
    with the last ``again`` words (fewer at first) of the parts before, so that
    neighbours meet.
    """
    if len(data) <= CHUNK:
        s, _, raw = _words(data, offsets, values) if len(data) else (np.empty(0, np.int64), None, np.empty(0, np.uint64))
        yield mix(raw), np.searchsorted(offsets, s, "right") - 1, 0
        return
    before, open_ = np.empty(0, np.uint64), None  # open_: hash and length of a word that the block before did not end
    for at in range(0, len(data), CHUNK):
        block = data[at : at + CHUNK]
        s, e, raw = _words(block, np.array([0, len(block)]), values)
        lengths = e - s
        if open_ and len(s) and s[0] == 0:
            raw[:1] = open_[0] + raw[:1] * np.uint64(pow(_R, open_[1], 1 << 64))
            lengths[0] += open_[1]
        elif open_:
            raw, lengths, e = (np.append(x, y).astype(y.dtype) for x, y in ((open_[0], raw), (open_[1], lengths), (0, e)))
        open_ = None
        if len(e) and e[-1] == len(block) and at + CHUNK < len(data):
            open_, raw = (raw[-1], int(lengths[-1])), raw[:-1]
        h = np.append(before, mix(raw))
        yield h, np.zeros(len(h), np.int64), len(before)
        before = h[max(0, len(h) - again) :]


def ngram_hashes(data: np.ndarray, offsets: np.ndarray, n: int, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and text number of each run of n bytes inside a text of a chunk; a long text has a part for each block."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) if len(data) <= CHUNK else np.zeros(CHUNK + n - 1, np.int64)
    for at in range(0, len(data) - n + 1, CHUNK):
        block = data[at : at + CHUNK + n - 1]
        m = len(block) - n + 1
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(_R) + values[block[k : k + m]]
        whole = text[:m] == text[n - 1 : n - 1 + m]
        yield mix(h[whole]), text[:m][whole]
