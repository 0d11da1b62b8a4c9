"""Words and word shingles of whole texts as 64-bit hashes, in numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed in one go; longer texts are cut at white space.
BLOCK = 1 << 19
SHINGLE = 5

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (fixed constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_places = mix(np.arange(1, 4097, dtype=_U)) | _U(1)


def places(n: int) -> np.ndarray:
    """A fixed odd multiplier for each place of a word."""
    global _places
    if n > len(_places):
        _places = mix(np.arange(1, 2 * n + 1, dtype=_U)) | _U(1)
    return _places


def words_of_block(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word between ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, _U), start, end
    if lower:
        raw = LOWER[raw]
    length = end - start
    at = np.flatnonzero(inside[1:-1])
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    terms = (raw[at].astype(_U) + _U(1)) * places(int(length.max()))[place]
    return mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(_U)), start, end


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes]]:
    """Runs of texts joined by line feeds, (first, after last, bytes); a text over ``BLOCK`` comes in pieces of its own."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if held and size + len(b) > BLOCK:
            yield first, i, b"\n".join(held)
            held, size = [], 0
        if not held:
            first = i
        if len(b) > BLOCK:
            while b:
                cut = len(b)
                if cut > BLOCK:
                    found = [x for x in (b.rfind(s, 0, BLOCK) for s in (b" ", b"\n", b"\t")) if x > 0]
                    cut = max(found, default=-1) + 1 or cut
                yield i, i + 1, b[:cut]
                b = b[cut:]
        else:
            held.append(b)
            size += len(b) + 1
    if held:
        yield first, len(texts), b"\n".join(held)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words, in order; A-Z count as a-z."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for first, last, data in blocks(texts):
        h, start, _ = words_of_block(data)
        if last - first == 1:
            out[first].append(h)
            continue
        sizes = np.array([len((t or "").encode()) + 1 for t in texts[first:last]])
        cuts = np.searchsorted(start, np.cumsum(sizes)[:-1])
        for i, part in enumerate(np.split(h, cuts)):
            out[first + i].append(part)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, _U) for p in out]


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, sorted, of runs of ``size`` words; of all words where there are fewer; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    k = min(n, size)
    total = np.full(n - k + 1, k, _U)
    for j in range(k):
        total += words[j : n - k + 1 + j] * places(64)[j + 7]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    return [shingles(w, size) for w in word_hashes(texts)]
