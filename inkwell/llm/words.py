"""Words of many texts as numpy arrays: places, documents and 64-bit hashes.

A stretch of bytes is hashed eight bytes at a time, each lane mixed before the
next one, so that no pattern in the text (as with a polynomial) makes two
stretches equal.  Long stretches take XXH3.  Words are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

#: Bytes of text that are hashed at once; a longer text is a batch of its own.
BATCH_BYTES = 1_500_000
#: Longer stretches are hashed one by one.
LONGEST_BY_LANES = 256
_B = 0x9E3779B97F4A7C15 | 1
_SECOND = 0xC2B2AE3D27D4EB4F
_LANE = np.uint64(_B)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

#: Lower-cases A-Z and turns all but 0-9, a-z and bytes from 0x80 into spaces.
ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_lanes(data: np.ndarray) -> np.ndarray:
    """For each byte the eight bytes from it on as one number, zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def lane(lanes: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The lane at each place, without the bytes beyond the ``rest`` of its stretch."""
    return lanes[at] & _LOW[np.minimum(rest, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, the same wherever the stretch stands."""
    size, lanes = ends - starts, byte_lanes(data)
    out = mix((size.astype(np.uint64) * _LANE) ^ lane(lanes, starts, size))
    far = np.nonzero(size > LONGEST_BY_LANES)[0]
    live, at = np.nonzero((size > 8) & (size <= LONGEST_BY_LANES))[0], 8
    while len(live):
        rest = size[live] - at
        out[live] = mix((out[live] * _LANE) ^ lane(lanes, starts[live] + at, rest))
        live, at = live[rest > 8], at + 8
    if len(far):
        whole = memoryview(data)
        out[far] = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(starts[far].tolist(), ends[far].tolist())]
    return out


class Words:
    """The words of ``texts`` in order: ``hashes``, and ``bounds`` so that those of
    text i are bounds[i] to bounds[i + 1]."""

    def __init__(self, texts: list[bytes | None], table: bytes = ALNUM):
        sizes = np.array([len(t) + 1 if t else 1 for t in texts], dtype=np.int64)
        data = np.frombuffer((b" ".join([t or b"" for t in texts]) + b" ").translate(table), dtype=np.uint8)
        inside = np.concatenate(([False], data != 32))
        edges = np.nonzero(inside[1:] != inside[:-1])[0]
        starts, ends = edges[::2], edges[1::2]
        self.hashes = span_hashes(data, starts, ends)
        self.bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum(sizes))))
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.hashes)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def rolled(hashes: np.ndarray, width: int, base: int = _B) -> np.ndarray:
    """A hash of each run of ``width`` words, by doubling; runs cross texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, size, power, done = None, 1, hashes, 0
    while True:
        if width & size:
            if out is None:
                out = power
            else:
                shift = np.uint64(pow(base, size, 1 << 64))
                m = min(len(out), len(power) - done)
                out = out[:m] * shift + power[done : done + m]
            done += size
        if done == width:
            return out[:n]
        shift = np.uint64(pow(base, size, 1 << 64))
        power = power[:-size] * shift + power[size:]
        size *= 2


def rolled_again(hashes: np.ndarray, width: int) -> np.ndarray:
    """Another hash of each run, which makes 128 bits with ``rolled``."""
    return rolled(mix(hashes ^ np.uint64(_SECOND)), width, _SECOND)


def stretches(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def batched(texts: pd.Series) -> Iterator[tuple[int, list]]:
    """(first index, texts) of about ``BATCH_BYTES`` each."""
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held and size + n > BATCH_BYTES:
            yield start, held
            start, size, held = i, 0, []
        held.append(text)
        size += n
    if held:
        yield start, held
