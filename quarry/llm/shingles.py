"""Sets of hashed word shingles of a batch of texts, with numpy on the UTF-8 bytes as Arrow holds them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are taken at once; a longer text is taken alone.
AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
STEPS = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1]
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of BASE and of its inverse."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, INVERSE)):
            row = np.full(n + 1, b, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that lie between ``offsets`` in ``data``, and the number of words before each text."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; a null text is empty."""
    strings = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    if not len(strings):
        return
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[: len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(strings):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + AT_ONCE, "right")) - 1)
        own = offsets[first : last + 1] - offsets[first]
        hashes, before = word_hashes(data[offsets[first] : offsets[last]], own)
        n = len(hashes) - WIDTH + 1
        if n > 0:
            rolled = np.zeros(n, np.uint64)
            for k in range(WIDTH):
                rolled += hashes[k : k + n] * STEPS[k]
            rolled = mixed(rolled)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                yield np.unique(rolled[a : b - WIDTH + 1])
            elif b > a:
                yield mixed(np.array([(hashes[a:b] * STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        first = last


def set_id(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a = mixed(tokens ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)
    b = mixed(tokens * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
    return np.array([a, b], ">u8").tobytes()
