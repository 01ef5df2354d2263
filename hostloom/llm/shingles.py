"""Words and word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches.

Words are runs of bytes outside ASCII white space (space and 0x09 to 0x0D), with A-Z lower-cased.
A word's hash is the sum of one random value for each of its bytes and the place of that byte in the word (tabulation
hashing), so that no Python loop runs over words and no structure of a word makes it meet another one. Shingle hashes mix
the hashes of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20_240_101)
#: A value for each byte at each of 64 places; further places mix in the number of the round.
_PLACES = 64
_VALUE = _rng.integers(0, 1 << 63, (_PLACES, 256), dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, (_PLACES, 256), dtype=np.uint64)
_STEP = [np.uint64(x) for x in (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most size bytes together, or of one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, where a text begins at each of the cuts."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = cuts[(cuts > 0) & (cuts < len(data))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of data, none of them empty; about CHUNK bytes are worked on at once."""
    upto = np.cumsum(ends - starts)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        size = ends[at:to] - starts[at:to]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        value = _VALUE[place & (_PLACES - 1), data[np.repeat(starts[at:to], size) + place]]
        if size.max() > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            value[far] = mix(value[far] + mix((place[far] // _PLACES).astype(np.uint64)))
        out[at:to] = mix(np.add.reduceat(value, first) + size.astype(np.uint64))
        at = to
    return out


def text_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: first, end, word hashes, and the offsets of the words of each text."""
    data, offsets = text_buffers(texts)
    for at, to in chunks(offsets):
        part = _LOWER[data[offsets[at] : offsets[to]]]
        cuts = offsets[at : to + 1] - offsets[at]
        starts, ends = word_spans(part, cuts)
        yield at, to, hash_spans(part, starts, ends), np.searchsorted(starts, cuts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words; the whole, if there are fewer words; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out += words[k : k + len(out)] * _STEP[k]
    return mix(out ^ np.uint64(size))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    hashes = np.sort(hashes)
    if len(hashes) < 2:
        return hashes
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    return hashes[keep]
