"""Pieces of texts as byte-level tokenizers cut them, found and looked up with numpy for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .shingles import mixed

#: Bytes of the longest piece that a table keeps. Longer ones are for the caller.
WIDEST = 32
LETTER, NUMBER, OTHER, SPACE = range(4)
#: What may follow an apostrophe as a piece with it (fixed values of the format).
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def kinds() -> np.ndarray:
    """Kind of every code point, by the classes of which the splitting pattern is made."""
    shown = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])  # no surrogates
    every = shown.astype("<u4").tobytes().decode("utf-32-le")
    own = np.full(len(shown), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            own[m.start() : m.end()] = kind
    table = np.full(0x110000, OTHER, np.uint8)
    table[shown] = own
    return table


class Pieces:
    """The pieces of some texts: place and bytes of each, and the number of pieces before each text.

    A piece is a run of letters, numbers, white space or other characters; a blank before one of the others goes with it,
    so that white space leaves its last character to what follows; and an apostrophe that stands alone takes one of ENDINGS.
    """

    def __init__(self, texts: list[str]) -> None:
        joined = "".join(texts)
        raw = joined.encode()
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n, at = len(code), np.cumsum([0, *map(len, texts)])
        edge, begins = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        edge[at] = True
        kind = kinds()[code]
        begins[1:n] = kind[1:] != kind[:-1]
        begins |= edge
        runs = np.flatnonzero(begins)
        first, last = runs[:-1], runs[1:]
        inside = ~edge[last]
        after = last[(kind[first] == SPACE) & inside] if n else last  # where something follows white space
        begins[after - 1] = True
        begins[after[code[after - 1] == 0x20]] = False
        quote = first[inside & (code[first] == 0x27) & (last - first == 1)] if n else first
        quote = quote[begins[quote]]
        for ending in ENDINGS:
            own = quote[quote + len(ending) < n]
            for k, c in enumerate(ending, 1):
                own = own[(code[own + k] == ord(c)) & ~edge[own + k]]
            begins[own + 1] = False
            begins[own + 1 + len(ending)] = True
        starts = np.flatnonzero(begins[:n])
        self.first = np.searchsorted(starts, at)
        if len(raw) != n:
            starts = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])[starts]
        self.data = np.frombuffer(raw + bytes(WIDEST), np.uint8)
        self.start, self.size = starts, np.diff(starts, append=len(raw))
        self._eight = np.ndarray((len(raw) + WIDEST - 7,), "<u8", self.data, strides=(1,))

    def word(self, k: int, which: np.ndarray) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of pieces, as numbers; bytes past the end are 0."""
        return self._eight[self.start[which] + 8 * k] & MASK[np.minimum(self.size[which] - 8 * k, 8)]

    def keys(self, which: np.ndarray) -> np.ndarray:
        """64 bits of hash of pieces of WIDEST bytes or less."""
        size = self.size[which]
        h = mixed(self.word(0, which) + size.astype(np.uint64) * ODD)
        for k in range(1, WIDEST // 8):
            more = np.flatnonzero(size > 8 * k)
            if not len(more):
                break
            h[more] = mixed(h[more] * ODD ^ self.word(k, which[more]))
        return h

    def flat(self, which: np.ndarray) -> np.ndarray:
        """The bytes of pieces, one after the other."""
        size = self.size[which]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()


class Table:
    """Numbers for pieces of WIDEST bytes or less, by open addressing; ``room`` of them at most."""

    def __init__(self, room: int) -> None:
        self.slots = np.full(1 << (2 * room).bit_length(), -1, np.int32)
        self.key, self.words, self.size = np.zeros(room, np.uint64), np.zeros((WIDEST // 8, room), np.uint64), np.zeros(room, np.uint8)
        self.room, self.n = room, 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)

    def find(self, pieces: Pieces, which: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Number of each piece; -1 where it has none; -2 where another piece has its key."""
        number, left, slot = np.full(len(which), -1, np.int64), np.arange(len(which)), self._slot(key)
        while len(left):
            there = self.slots[slot[left]]
            same = (there >= 0) & (self.key[there] == key[left])
            number[left[same]] = there[same]
            left = left[(there >= 0) & ~same]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
        hit = np.flatnonzero(number >= 0)
        ok = pieces.size[which[hit]] == self.size[number[hit]]
        for k in range(WIDEST // 8):
            long = np.flatnonzero(pieces.size[which[hit]] > 8 * k)
            ok[long] &= pieces.word(k, which[hit[long]]) == self.words[k, number[hit[long]]]
        number[hit[~ok]] = -2
        return number

    def add(self, pieces: Pieces, which: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Numbers for pieces with different keys, none of which the table has."""
        numbers = np.arange(self.n, self.n + len(which))
        self.n += len(which)
        self.key[numbers], self.size[numbers] = key, pieces.size[which]
        for k in range(WIDEST // 8):
            long = np.flatnonzero(pieces.size[which] > 8 * k)
            self.words[k, numbers[long]] = pieces.word(k, which[long])
        left, slot = np.arange(len(which)), self._slot(key)
        while len(left):
            own = slot[left]
            free = self.slots[own] < 0
            self.slots[own[free]] = numbers[left[free]]  # of several for one slot, the last has it
            left = left[self.slots[own] != numbers[left]]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
        return numbers

    def all_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of all pieces, and their bytes one after the other."""
        rows = np.ascontiguousarray(self.words[:, : self.n].T).view(np.uint8).reshape(-1, WIDEST)
        size = self.size[: self.n].astype(np.int64)
        return np.cumsum(size), rows[np.arange(WIDEST) < size[:, None]]
