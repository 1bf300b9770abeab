"""LZ77 with an escape byte, and LZ78 with 12-bit codes.

LZ77 format (fixed): a match of length 3 to 65 at distance 1 to 1023 within the last 1024 bytes, without running into
itself, is escape, ((distance - 1) >> 8) << 6 | (length - 2), (distance - 1) & 255; the escape byte is escape, 0.

LZ78 format (fixed): the dictionary starts with the 256 single bytes and is started anew at 4096 entries. Each step writes
the 12-bit code of the longest known phrase and the next byte; a phrase that the data end on is written as its own steps,
the last byte alone as code 0 and that byte. Which of the two a final code 0 means is told by the length of the original.
"""

from __future__ import annotations

import numpy as np

WINDOW, LEAST, MOST = 1024, 3, 65
ENTRIES = 4096


def encode77(data: bytes, escape: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        start = max(0, i - WINDOW + 1)
        best, at = 0, -1
        size = LEAST
        # a longer match is looked for only where one of this size ends; rfind gives the nearest
        while size <= MOST and i + size <= n:
            found = data.rfind(data[i : i + size], start, i)
            if found < 0:
                break
            best, at = size, found
            while best < MOST and i + best < n and at + best < i and data[at + best] == data[i + best]:
                best += 1
            size = best + 1
        if best >= LEAST:
            nearest = data.rfind(data[i : i + best], start, i)
            back = i - nearest - 1
            out += bytes((escape, (back >> 8) << 6 | (best - 2), back & 0xFF))
            i += best
        else:
            out.append(data[i])
            if data[i] == escape:
                out.append(0)
            i += 1
    return bytes(out)


def decode77(data: bytes, escape: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        if data[i] != escape:
            at = data.find(escape, i)
            at = n if at < 0 else at
            out += data[i:at]
            i = at
        elif i + 1 < n and data[i + 1] == 0:
            out.append(escape)
            i += 2
        elif i + 2 >= n:
            raise ValueError("an LZ77 token is cut off")
        else:
            size, back = (data[i + 1] & 0x3F) + 2, (data[i + 1] >> 6 << 8 | data[i + 2]) + 1
            if size < LEAST or back > len(out):
                raise ValueError("an LZ77 token points outside the window")
            for _ in range(size):  # byte by byte, as a match may be longer than its distance
                out.append(out[-back])
            i += 3
    return bytes(out)


def steps78(data: bytes) -> list[tuple[int, int]]:
    """Code and next byte of each step."""
    words = words78(data)
    return [(w >> 8, w & 255) for w in words]


def words78(data: bytes) -> list[int]:
    """Each step's code and next byte in one number. A phrase is known by its parent's code and last byte, in one number too."""
    known: dict[int, int] = {}
    out, code, before, size = [], -1, 0, 256
    for byte in data:
        if code < 0:
            code = byte
            continue
        word = code << 8 | byte
        if (longer := known.get(word)) is not None:
            before, code = word, longer
            continue
        out.append(word)
        known[word] = size
        size += 1
        if size >= ENTRIES:
            known, size = {}, 256
        code = -1
    if code >= 256:  # no byte follows: all but the last byte is a phrase too
        out.append(before)
    elif code >= 0:
        out.append(code)  # code 0 and that byte
    return out


def encode78(data: bytes) -> bytes:
    words = np.array(words78(data), np.int64)
    n = len(words)
    pairs = np.append(words, np.zeros(n % 2, np.int64)).reshape(-1, 2)
    whole = (pairs[:, 0] << 20) | pairs[:, 1]  # five bytes for two steps
    return ((whole[:, None] >> np.array([32, 24, 16, 8, 0])) & 0xFF).astype(np.uint8).tobytes()[: -(-n * 20 // 8)]


def decode78(data: bytes, size: int) -> bytes:
    """``size``: bytes of the original, which tells a last single byte from a NUL and a byte."""
    n = len(data) * 8 // 20
    fives = np.frombuffer(data.ljust(-(-len(data) // 5) * 5, b"\0"), np.uint8).reshape(-1, 5).astype(np.int64)
    whole = fives @ (np.int64(1) << np.array([32, 24, 16, 8, 0]))
    steps = np.stack([whole >> 20, whole & 0xFFFFF], 1).ravel()[:n].tolist()
    singles = [bytes((b,)) for b in range(256)]
    out, phrases, have = [], singles.copy(), 0
    for step in steps:
        code = step >> 8
        if have >= size:
            break
        if not code and have + 1 == size:
            out.append(singles[step & 255])
            have += 1
            break
        if code >= len(phrases):
            raise ValueError("an LZ78 code names no phrase")
        longer = phrases[code] + singles[step & 255]
        out.append(longer)
        have += len(longer)
        phrases.append(longer)
        if len(phrases) >= ENTRIES:
            phrases = singles.copy()
    if have != size:
        raise ValueError("LZ78 data don't give the size that they are said to have")
    return b"".join(out)
