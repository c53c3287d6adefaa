"""Cut batches of UTF-8 texts into units that byte-level BPE encodes independently, and encode each distinct unit once.

The pre-tokenizer's pattern never joins two neighbouring characters of certain
classes into one piece. All texts of a batch are cut there at once, over their
bytes. A unit is one piece, or a few where the classes do not tell, so its ids
do not depend on what stands around it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

LETTER, DIGIT, SIGN, QUOTE, BLANK, SPACE, OTHER = range(7)
UNITS_AT_ONCE = 1 << 20
HELD_UNITS = 300_000  # distinct units whose ids a worker remembers
HELD_BYTES = 16 << 20


def _classes() -> np.ndarray:
    """Class per byte; bytes of characters beyond ASCII and control characters tell nothing."""
    table = np.full(256, OTHER, np.uint8)
    table[0x21:0x7F] = SIGN
    for first, last in ("AZ", "az"):
        table[ord(first) : ord(last) + 1] = LETTER
    table[ord("0") : ord("9") + 1] = DIGIT
    table[ord("'")], table[ord(" ")] = QUOTE, BLANK
    table[[9, 10, 11, 12, 13]] = SPACE
    return table


def _cuts() -> np.ndarray:
    """True for neighbouring classes with a certain piece boundary between them.

    A quote may open a contraction such as 's, so nothing is cut between a
    quote and a letter; a blank may belong to the piece after it.
    """
    cut = np.zeros((8, 8), bool)
    cut[LETTER, [DIGIT, SIGN, QUOTE, BLANK, SPACE]] = True
    cut[DIGIT, [LETTER, SIGN, QUOTE, BLANK, SPACE]] = True
    cut[SIGN, [LETTER, DIGIT, BLANK, SPACE]] = True
    cut[QUOTE, [DIGIT, BLANK, SPACE]] = True
    cut[SPACE, [LETTER, DIGIT, SIGN, QUOTE]] = True
    return cut.ravel()


CLASS, CUT = _classes(), _cuts()


def unit_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which units start, for the bytes of texts that start at ``doc_starts``."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF are letters, but for two signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    starts = np.zeros(len(data), bool)
    starts[1:] = CUT[(kind[:-1] << 3) | kind[1:]]
    first = doc_starts[doc_starts < len(data)]
    # Of several spaces the last one before a printable character of the same text is cut off: a blank goes with
    # that character, any other space stands alone.
    opens = (kind == BLANK) | (kind == SPACE)
    opens[:-1] &= kind[1:] <= QUOTE
    opens[-1] = False
    opens[first[first > 0] - 1] = False
    starts |= opens
    starts[first] = True
    return np.flatnonzero(starts)


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated slices of ``pool``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class UnitEncoder:
    """Ids of whole texts; ``encode_new`` gives the ids of distinct units that are not remembered."""

    def __init__(self, encode_new: Callable[[list[bytes]], list[np.ndarray]]) -> None:
        self.encode_new = encode_new
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.pool = np.zeros(0, np.uint32)
        self.starts = self.lengths = self.uses = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keep the units that were used most, half as many as may be held; uses of long ago count less and less."""
        kept = np.sort(np.argpartition(-self.uses, HELD_UNITS // 2)[: HELD_UNITS // 2])
        names = list(self.place)
        self.pool = gather(self.pool, self.starts[kept], self.lengths[kept])
        self.lengths, self.uses = self.lengths[kept], self.uses[kept] // 2
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.held = sum(map(len, self.place))

    def learn(self, units: list[bytes]) -> None:
        found = self.encode_new(units)
        lengths = np.array([len(f) for f in found], np.int64)
        self.place.update(zip(units, range(len(self.place), len(self.place) + len(units)), strict=True))
        self.held += sum(map(len, units))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])
        self.pool = np.concatenate([self.pool, *found]).astype(np.uint32, copy=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start (with the end at last).

        ``texts`` is a string or binary array without nulls.
        """
        texts = texts.cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        content = texts.buffers()[2]
        data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]] if content else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        cuts = unit_starts(data, offsets[:-1])
        edges = np.append(cuts, len(data))
        ids, counts = [], np.zeros(len(cuts), np.int64)
        for k in range(0, len(cuts), UNITS_AT_ONCE):
            edge = edges[k : k + UNITS_AT_ONCE + 1]
            buffers = [None, pa.py_buffer((edge - edge[0]).astype(np.int32)), pa.py_buffer(data[edge[0] : edge[-1]])]
            coded = pa.Array.from_buffers(pa.binary(), len(edge) - 1, buffers).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(self.place) > HELD_UNITS:
                self.forget_rare()
            if self.held > HELD_BYTES:
                self.forget()
            new = [u for u in distinct if u not in self.place]
            if new:
                self.learn(new)
            unit = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
            self.uses += np.bincount(unit, minlength=len(self.uses))
            counts[k : k + len(unit)] = self.lengths[unit]
            ids.append(gather(self.pool, self.starts[unit], self.lengths[unit]))
        before = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), before[np.searchsorted(edges, offsets)] if len(cuts) else np.zeros(len(offsets), np.int64)


def in_chunks(batches, column: int, max_bytes: int = 4 << 20):
    """Arrow batches joined until their ``column`` holds about ``max_bytes``; one batch at least."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
