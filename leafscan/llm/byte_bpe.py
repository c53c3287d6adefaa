"""Byte-level BPE from a table of ranks, merged by segment trees (operator 11)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import held_by_worker, small_batches
from leafscan.llm.units import UnitEncoder, gather, in_chunks

LEAVES_AT_ONCE = 1 << 16
NO_PAIR = np.iinfo(np.int64).max


class Ranks:
    """A vocabulary of byte strings whose ids are their ranks, and the pairs of ids that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            rows = (line.split() for line in file if line.strip())
            self.ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        size = max(self.ids.values()) + 1
        self.size = size
        pairs = []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left * size + right, rank))
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs] + [NO_PAIR], np.int64)
        self.merged = np.array([r for _, r in pairs] + [NO_PAIR], np.int64)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        by_id = sorted((rank, token) for token, rank in self.ids.items())
        self.bytes = np.frombuffer(b"".join(token for _, token in by_id), np.uint8)
        self.lengths = np.zeros(size, np.int64)
        self.lengths[[rank for rank, _ in by_id]] = [len(token) for _, token in by_id]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbouring ids; NO_PAIR where they do not merge or one is missing (-1)."""
        wanted = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, self.merged[at], NO_PAIR)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece: the pair of least rank merges first, the leftmost among equals."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.ids:
                out[i] = np.array([self.ids[piece]], np.int64)
            else:
                sizes.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for bits, members in sizes.items():
            step = max(1, LEAVES_AT_ONCE >> bits)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge_trees([pieces[i] for i in part], bits), strict=True):
                    out[i] = ids
        return out

    def _merge_trees(self, pieces: list[bytes], bits: int) -> list[np.ndarray]:
        """One segment tree of ``2**bits`` leaves per piece, all trees taking their next merge at the same time.

        Leaf p holds ``rank << bits | p`` of the token that starts at byte p
        and the live token after it, so the least value of a node is its
        leftmost pair of least rank. A merge changes three leaves (the pair's
        own, the dead right token's, the live left neighbour's) and the nodes
        above them.
        """
        leaves = 1 << bits
        lengths = np.array([len(p) for p in pieces], np.int64)
        held = np.arange(leaves) < lengths[:, None]
        token = np.full((len(pieces), leaves + 1), -1, np.int64)  # the last column is "no token"
        token[:, :-1][held] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.arange(leaves)[None, :] + 1, lengths[:, None])
        after = np.where(after < lengths[:, None], after, leaves)
        before = np.tile(np.arange(-1, leaves), (len(pieces), 1))
        before[:, 0] = leaves

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == NO_PAIR, NO_PAIR, (rank << bits) | at)

        tree = np.full((len(pieces), 2 * leaves), NO_PAIR, np.int64)
        tree[:, leaves:] = leaf(self.rank(token[:, :-1], token[:, 1:]), np.arange(leaves)[None, :])
        for level in range(bits - 1, -1, -1):
            low = 1 << level
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])

        live = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while len(live):
            best = tree[live, 1]
            at, rank = best & (leaves - 1), best >> bits
            dead = after[live, at]
            right, left = after[live, dead], before[live, at]
            token[live, at], token[live, dead] = rank, -1
            after[live, at] = right
            before[live, right] = at
            tree[live, leaves + at] = leaf(self.rank(rank, token[live, right]), at)
            tree[live, leaves + dead] = NO_PAIR
            some = left < leaves
            own, left = live[some], left[some]
            tree[own, leaves + left] = leaf(self.rank(token[own, left], rank[some]), left)
            rows, nodes = np.concatenate([live, live, own]), leaves + np.concatenate([at, dead, left])
            for _ in range(bits):
                nodes = nodes >> 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            live = live[tree[live, 1] != NO_PAIR]
        return [row[row >= 0] for row in token]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        return gather(self.bytes, self.starts[ids], self.lengths[ids])


class Encoder:
    """Whole texts to ids and back, for a rank file and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks, self.cut = Ranks(path), regex.compile(pattern).findall
        self.units = UnitEncoder(self._units)

    def _units(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of units, each cut into pieces; a piece of several units is merged once."""
        pieces = [[p.encode() for p in self.cut(u.decode())] for u in units]
        distinct = list(dict.fromkeys(p for own in pieces for p in own))
        ids = dict(zip(distinct, self.ranks.merge(distinct), strict=True))
        return [ids[own[0]] if len(own) == 1 else np.concatenate([np.zeros(0, np.int64), *[ids[p] for p in own]]) for own in pieces]


def _encoder(path: str, pattern: str) -> Encoder:
    return held_by_worker(("byte_bpe", path, pattern), lambda: Encoder(path, pattern))


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of a buffer as binary values."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as little-endian unsigned 32-bit integers.

    ``path`` names a file of base64 tokens and ranks, ``pattern`` the pieces
    that are encoded separately; special strings are ordinary text. Every row
    gives a row: a null or empty text has no ids, a null id stays null,
    repeated rows stay repeated, and no other column is read. A worker holds a
    few megabytes of texts, or one longer text, and a bounded memo of units.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, 1):
            ids, bounds = _encoder(path, pattern).units.encode(chunk.column(1).combine_chunks())
            yield pa.RecordBatch.from_arrays([chunk.column(0).combine_chunks(), _binary(ids.astype("<u4"), bounds * 4)], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids of :func:`encode` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, 1):
            ranks = _encoder(path, pattern).ranks
            column = chunk.column(1).combine_chunks()
            sizes = np.array([len(v) for v in column.to_pylist()], np.int64) // 4
            ids = np.frombuffer(b"".join(column.to_pylist()), "<u4")
            lengths = ranks.lengths[ids]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            decoded = _binary(ranks.decode(ids), ends[np.concatenate([[0], np.cumsum(sizes)])])
            yield pa.RecordBatch.from_arrays([chunk.column(0).combine_chunks(), column, decoded], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`decode`."""
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
