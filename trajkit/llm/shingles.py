"""Word shingles as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together.
SLICE_BYTES = 1 << 19
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240613)
_PLACE = _rng.integers(1, _MASK, size=16, dtype=np.uint64) | np.uint64(1)
_LANE, _LENGTH = (int(x) | 1 for x in _rng.integers(1, _MASK, size=2, dtype=np.uint64))
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The bytes that a lane of so many bytes holds.
_HELD = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the words in data, split at ASCII white space, A-Z lower-cased.

    A word is cut into lanes of 8 bytes. Each lane and its number are mixed by themselves, and only then summed: words of up
    to 8 bytes never collide, and in longer ones no pattern of letters makes sums meet, as it does in polynomials.
    """
    padded = np.frombuffer(data.translate(_LOWER) + bytes(8), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[padded[:-8]]
    edges = np.flatnonzero(np.diff(inside))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    number = lambda j: mixed(j.astype(np.uint64) * np.uint64(_LANE) + np.uint64(_LENGTH))
    total = mixed((lanes[starts] & _HELD[np.minimum(sizes, 8)]) ^ number(np.zeros(1)))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        first = np.cumsum(more) - more
        j = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at, left = np.repeat(starts[long], more) + 8 * j, np.repeat(sizes[long], more) - 8 * j
        total[long] += np.add.reduceat(mixed((lanes[at] & _HELD[np.minimum(left, 8)]) ^ number(j)), first)
    return starts, mixed(total + sizes.astype(np.uint64) * np.uint64(_LENGTH))


def _cut(data: bytes) -> Iterator[bytes]:
    """data in parts of about SLICE_BYTES that end where words end."""
    start = 0
    while len(data) - start > SLICE_BYTES:
        end = start + SLICE_BYTES
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on; fewer words than k have none."""
    n = len(words) - k + 1
    if n < 1:
        return words[:0]
    total = words[:n] * _PLACE[0]
    for i in range(1, k):
        total += words[i : n + i] * _PLACE[i]
    return mixed(total)


def _set(words: np.ndarray, shingles: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct shingles of one text; with fewer than k words, one for the whole sequence."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mixed((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], dtype=np.uint64) * _PLACE[k])
    ordered = np.sort(shingles)
    fresh = np.empty(len(ordered), dtype=bool)
    fresh[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    return ordered[fresh]


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """One sorted array of distinct shingle hashes per text, empty for null and for texts without words; k is below 16."""
    pending: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        places, hashes = word_hashes(b" ".join(pending))
        ends = np.searchsorted(places, np.cumsum([len(p) + 1 for p in pending])).tolist()
        shingles = _shingles(hashes, k)
        start = 0
        for end in ends:
            yield _set(hashes[start:end], shingles[start : max(start, end - k + 1)], k)
            start = end

    for text in texts:
        data = (text or "").encode("utf-8", "replace")
        if len(data) > SLICE_BYTES:
            yield from flush()
            pending, size = [], 0
            words = np.concatenate([word_hashes(part)[1] for part in _cut(data)])
            yield _set(words, _shingles(words, k), k)
            continue
        pending.append(data)
        size += len(data) + 1
        if size >= SLICE_BYTES:
            yield from flush()
            pending, size = [], 0
    yield from flush()


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    first = hashes.sum(dtype=np.uint64)
    second = mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))
