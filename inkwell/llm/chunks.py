"""Texts as chunks that no match of the byte-level pattern crosses.

A text is cut where a new match begins whatever stands before and after: before a
space whose next character is no white space, between an ASCII letter or digit and
ASCII punctuation, and between a single line end and an ASCII letter.  Chunks are
hashed in numpy and their ids looked up in an open-addressing table, so only new
chunks reach Python.  The table keeps the bytes of its chunks and every hit is
compared with them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import LONGEST_BY_LANES, byte_lanes, lane, span_hashes, stretches

#: Chunks that a table holds by default, and eights of bytes and ids for each of
#: them on average; beyond any of them the chunks that were not met again are forgotten.
ENTRIES, LANES_EACH, IDS_EACH = 300_000, 4, 10
#: Chunks that are looked up together.
AT_ONCE = 200_000

# after a space these bytes may begin white space, so there is no cut before them
_SOLID = np.ones(256, dtype=bool)
_SOLID[:33] = False
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
# what a byte is, as bits
_SPACE, _SOLID_BIT, _LINE_END, _LETTER, _ALNUM, _MARK, _BLACK = (1 << k for k in range(7))
_KIND = np.array(
    [
        _SPACE * (b == 32) + _SOLID_BIT * bool(_SOLID[b]) + _LINE_END * (b == 10) + _LETTER * bytes([b]).isalpha() + _ALNUM * bytes([b]).isalnum() + _MARK * (32 < b < 127 and not bytes([b]).isalnum()) + _BLACK * (32 < b < 127)
        for b in range(256)
    ],
    dtype=np.uint8,
)


def chunk_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks start in texts that start at ``begins`` and follow each other."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        kind = _KIND[data]
        left, right = kind[:-1], kind[1:]
        cut[: len(data) - 1] = (left & _SPACE) & (right >> 1)
        cut[1 : len(data)] |= ((left >> 4) & (right >> 5) & 1).view(bool)
        # a line end that stands alone is a match; of several the last one is
        cut[2 : len(data)] |= ((kind[:-2] >> 6) & (kind[1:-1] >> 2) & (kind[2:] >> 3) & 1).view(bool)
    cut[begins[begins > 0] - 1] = False  # what follows is another text
    cut[begins] = True
    return np.nonzero(cut[:-1])[0]


def packed_learner(learn: Callable[[list[bytes]], list[bytes]]) -> Callable:
    """What ``ChunkTable`` asks for, from a function that packs the ids of a list of chunks."""

    def learned(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joined = data.tobytes()
        made = learn([joined[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist())])
        return np.frombuffer(b"".join(made), dtype="<u4"), np.array([len(m) // 4 for m in made], dtype=np.int64)

    return learned


class _Pool:
    """Stretches of one kind of number, kept one after the other."""

    def __init__(self, kind: type, rows: int = 1024):
        """``size`` counts what is stored of each stretch."""
        self.data = np.zeros(4 * rows, dtype=kind)
        self.start, self.size = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int32)
        self.rows = self.used = 0

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate((array, np.zeros(max(size, len(array) * 3 // 2) - len(array), dtype=array.dtype)))

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.rows + len(sizes), self.used + len(data)
        self.start, self.size, self.data = self._grown(self.start, n), self._grown(self.size, n), self._grown(self.data, m)
        self.size[self.rows : n] = sizes
        self.start[self.rows : n] = self.used + np.cumsum(sizes) - sizes
        self.data[self.used : m] = data
        self.rows, self.used = n, m

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.data[stretches(self.start[rows], self.size[rows])]

    def kept(self, rows: np.ndarray) -> _Pool:
        out = _Pool(self.data.dtype.type)
        out.add(self.take(rows), self.size[rows])
        return out


class ChunkTable:
    """Ids of chunks by hash.  ``learn`` gives the ids and how many each chunk has,
    for chunks that are stretches (starts, sizes) of a text's bytes."""

    def __init__(self, learn: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], entries: int = ENTRIES):
        self.learn, self.most = learn, entries
        self.slots = 1 << (3 * entries // 2).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.lanes, self.ids = _Pool(np.uint64), _Pool(np.uint32)  # a chunk is its bytes by eights
        self.sizes = np.zeros(0, dtype=np.int64)
        self.hashes, self.again = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.entry = np.zeros(self.slots, dtype=np.int32)

    @property
    def count(self) -> int:
        return self.lanes.rows

    def _forget(self) -> None:
        """Keep the chunks that were met again since the last time, if they are few enough."""
        kept = np.nonzero(self.again)[0]
        if 2 * len(kept) > self.most:
            kept = kept[: self.most // 2]
        lanes, ids, sizes, hashes = self.lanes.kept(kept), self.ids.kept(kept), self.sizes[kept], self.hashes[kept]
        self._clear()
        if 2 * lanes.used > self.most * LANES_EACH or 2 * ids.used > self.most * IDS_EACH:
            return
        self.lanes, self.ids, self.sizes, self.hashes, self.again = lanes, ids, sizes, hashes, np.zeros(len(kept), dtype=bool)
        self._insert(hashes, np.arange(len(kept), dtype=np.int32))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash or -1."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            here = self.keys[slot]
            hit = here == hashes[open_]
            found[open_[hit]] = self.entry[slot[hit]]
            go = ~hit & (here != 0)
            open_, slot = open_[go], (slot[go] + 1) & (self.slots - 1)
        return found

    def _insert(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(hashes):
            free = np.nonzero(self.keys[slot] == 0)[0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.entry[slot[first]] = hashes[first], entries[first]
            rest = np.ones(len(hashes), dtype=bool)
            rest[first] = False
            hashes, entries, slot = hashes[rest], entries[rest], (slot[rest] + 1) & (self.slots - 1)

    def _add(self, hashes: np.ndarray, data: np.ndarray, lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """New entries for chunks; a hash of zero is met by no look-up."""
        self.ids.add(*self.learn(data, starts, sizes))
        eights = (sizes + 7) // 8
        passed = 8 * stretches(np.zeros(len(eights), dtype=np.int64), eights)
        self.lanes.add(lane(lanes, np.repeat(starts, eights) + passed, np.repeat(sizes, eights) - passed), eights)
        self.sizes = np.concatenate((self.sizes, sizes))
        self.hashes = np.concatenate((self.hashes, hashes))
        self.again = np.concatenate((self.again, np.zeros(len(hashes), dtype=bool)))
        own = np.nonzero(hashes)[0]
        self._insert(hashes[own], (self.count - len(hashes) + own).astype(np.int32))

    def _differing(self, lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which chunks are not those of their entries."""
        other = self.sizes[entry] != sizes
        live, at, known = np.nonzero(~other)[0], 0, self.lanes.start[entry]
        while len(live) and at < LONGEST_BY_LANES:
            rest = sizes[live] - at
            differs = lane(lanes, starts[live] + at, rest) != self.lanes.data[known[live] + at // 8]
            if differs.any():
                other[live[differs]] = True
                rest[differs] = 0
            live, at = live[rest > 8], at + 8
        for i in live.tolist():  # long ones
            places = np.arange(at, int(sizes[i]), 8)
            other[i] = bool((lane(lanes, starts[i] + places, sizes[i] - places) != self.lanes.data[known[i] + places // 8]).any())
        return np.nonzero(other)[0]

    def _look_up(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each chunk) of at most ``AT_ONCE`` chunks."""
        if self.count > self.most or self.ids.used > self.most * IDS_EACH or self.lanes.used > self.most * LANES_EACH:
            self._forget()
        hashes = np.maximum(span_hashes(data, starts, stops), np.uint64(1))
        lanes, sizes = byte_lanes(data), stops - starts
        entry = self._find(hashes)
        new = np.nonzero(entry < 0)[0]
        self.again[entry[entry >= 0]] = True
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            self._add(fresh, data, lanes, starts[at], sizes[at])
            entry[new] = self._find(hashes[new])
        strangers = self._differing(lanes, starts, sizes, entry)
        if len(strangers):  # equal hashes of different chunks
            chunks = [data[a:b].tobytes() for a, b in zip(starts[strangers].tolist(), stops[strangers].tolist())]
            firsts = dict(zip(reversed(chunks), reversed(strangers.tolist())))
            place, first = {c: k for k, c in enumerate(firsts)}, list(firsts.values())
            before = self.count
            self._add(np.zeros(len(first), dtype=np.uint64), data, lanes, starts[first], sizes[first])
            entry[strangers] = [before + place[c] for c in chunks]
        return self.ids.take(entry), self.ids.size[entry]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of whole texts of a few megabytes."""
        if not texts:
            return []
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = chunk_starts(data, np.concatenate(([0], ends[:-1])))
        stops = np.append(starts[1:], len(data))
        parts = [self._look_up(data, starts[at : at + AT_ONCE], stops[at : at + AT_ONCE]) for at in range(0, len(starts), AT_ONCE)]
        if not parts:
            return [b""] * len(texts)
        packed = np.concatenate([p[0] for p in parts]).tobytes()
        total = np.concatenate(([0], np.cumsum(np.concatenate([p[1] for p in parts]))))
        cuts = (4 * total[np.searchsorted(starts, np.concatenate(([0], ends)))]).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]
