"""Sets of five-word shingles as arrays of 64-bit hashes, computed over whole Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
CHUNK_BYTES = 2 << 20  # text bytes hashed at once
# White space that ends a word, and A-Z to a-z.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 63, dtype=np.int64)) * 2 + 1
_MIX = _rng.integers(0, 1 << 63, WIDTH, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
for _upper in range(65, 91):
    _BYTE[_upper] = _BYTE[_upper + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True


def _powers(base: int) -> np.ndarray:
    out = np.empty(CHUNK_BYTES + 1, dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < len(out):
        take = min(filled, len(out) - filled)
        out[filled : filled + take] = out[:take] * np.uint64(pow(base, filled, 1 << 64))
        filled += take
    return out


_UP = _powers(_BASE)
_DOWN = _powers(pow(_BASE, -1, 1 << 64))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def _hash_chunk(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word: its polynomial over the bytes, made independent of its place, then scrambled."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _UP[: len(data)], dtype=np.uint64)])
    return scramble((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(starts, hashes)`` of the words in UTF-8 bytes, chunk by chunk; a chunk ends at white space.

    A word longer than a chunk is hashed by its bytes as a whole.
    """
    at = 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        if at + CHUNK_BYTES <= len(data):
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
                whole = bytes(data[at:end]).lower()
                yield np.array([at]), np.array([xxhash.xxh64_intdigest(whole)], dtype=np.uint64)
                at = end
                continue
        part = data[at:end]
        starts, ends = _runs(part)
        yield starts + at, _hash_chunk(part, starts, ends)
        at = end


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of every five neighbouring words, or of all words if there are fewer."""
    if not len(words):
        return words
    if len(words) < WIDTH:
        total = np.full(1, len(words), dtype=np.uint64) * _MIX[0]
        for k in range(len(words)):
            total = scramble(total + words[k : k + 1]) * _MIX[1]
        return total
    total = np.zeros(len(words) - WIDTH + 1, dtype=np.uint64)
    for k in range(WIDTH):
        total += words[k : len(words) - WIDTH + 1 + k] * _MIX[k]
    return np.unique(scramble(total))


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and word hashes of every text of an Arrow column; null has none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        # Neighbouring short texts are hashed together, with a boundary at each text.
        upto = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES - 1, side="right")) - 1
        upto = min(max(upto, at + 1), len(texts))
        if upto == at + 1:
            own = data[offsets[at] : offsets[at + 1]]
            yield own, np.concatenate([np.zeros(0, np.uint64), *[h for _, h in word_hashes(own)]])
        else:
            block = data[offsets[at] : offsets[upto]]
            cuts = offsets[at : upto + 1] - offsets[at]
            starts, ends = _runs(block)
            inner = cuts[(cuts > 0) & (cuts < len(block))]
            word = ~_SPACE[block]
            glued = np.unique(inner[word[inner - 1] & word[inner]])
            starts, ends = np.sort(np.concatenate([starts, glued])), np.sort(np.concatenate([ends, glued]))
            hashes = _hash_chunk(block, starts, ends)
            places = np.searchsorted(starts, cuts)
            for k in range(upto - at):
                yield block[cuts[k] : cuts[k + 1]], hashes[places[k] : places[k + 1]]
        at = upto


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of every text of an Arrow column; null has none."""
    for _, words in words_of(texts):
        yield shingle_set(words)
