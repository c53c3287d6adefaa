"""Token ids in seekable files of independent zstandard frames (operator 1).

A file holds the documents of one range of ids, ascending:

* one zstandard frame per document: its ids as little-endian unsigned 32-bit
  integers, the end id included, with zstandard's own content checksum;
* a skippable frame (magic 0x184D2A5D) with each frame's document id as a
  signed 64-bit integer, followed by one byte per frame that is 1 for a null id;
* the seek table of the public zstandard seekable format at the very end: a
  skippable frame (magic 0x184D2A5E) with compressed size, decompressed size
  and the low 32 bits of XXH64 of the content per frame, the number of frames,
  a descriptor byte (0x80: checksums present) and the magic 0x8F92EAB1.

A reader takes the seek table from the end and then reads and decompresses
only the frames it wants.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import held_by_worker, keep, small_batches
from leafscan.llm.units import UnitEncoder, in_chunks
from leafscan.session import new_folder

# Fixed values of the file format.
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
SEEK_END_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

END_ID = 0
READ_BYTES = 4 << 20

ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer, as the library encodes them.

    Texts are cut into units that are encoded independently; each unit that is
    new goes through the library once. A text that holds an added token of the
    tokenizer, such as its end mark, goes through the library as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = UnitEncoder(self._whole)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of a string array without nulls, as little-endian 32-bit integers."""
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        ids, bounds = self.units.encode(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
        ids = ids.astype("<u4", copy=False)
        for i in range(len(texts)):
            if special[i]:
                yield self._whole([texts[i].as_py().encode()])[0].astype("<u4", copy=False)
            else:
                yield ids[bounds[i] : bounds[i + 1]]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    return held_by_worker(("encoder", path), lambda: Encoder(path))


def filesystem(uri: str):
    """File system and path of a folder or file in the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """One file of frames; ``close`` writes both tables at its end."""

    def __init__(self, sink) -> None:
        import zstandard

        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls = bytearray()

    def add(self, doc_id: int | None, content: bytes) -> None:
        import xxhash

        frame = self.packer.compress(content)
        self.sink.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(doc_id if doc_id is not None else 0)
        self.nulls.append(doc_id is None)

    def close(self) -> None:
        index = np.asarray(self.ids, dtype="<i8").tobytes() + bytes(self.nulls)
        table = np.asarray(self.entries, dtype=ENTRY).tobytes()
        end = np.uint32(len(self.entries)).astype("<u4").tobytes() + bytes([CHECKSUMS]) + np.array([SEEK_END_MAGIC], "<u4").tobytes()
        for magic, content in ((INDEX_MAGIC, index), (SEEK_MAGIC, table + end)):
            self.sink.write(np.array([magic, len(content)], "<u4").tobytes() + content)
        self.sink.close()


class FrameReader:
    """Random access to one file of frames."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        size = source.size()
        count, flags, magic = np.frombuffer(source.read_at(9, size - 9), dtype=[("n", "<u4"), ("flags", "u1"), ("magic", "<u4")])[0]
        if magic != SEEK_END_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - 9 - ENTRY.itemsize * int(count)
        self.entries = np.frombuffer(source.read_at(ENTRY.itemsize * int(count), table_at), dtype=ENTRY)
        index_at = table_at - 8 - 9 * int(count)
        index = source.read_at(9 * int(count), index_at)
        ids, nulls = np.frombuffer(index[: 8 * int(count)], "<i8"), index[8 * int(count) :]
        self.doc_ids: list[int | None] = [None if null else int(i) for i, null in zip(ids, nulls, strict=True)]
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])

    def content(self, frames: Iterable[int]) -> Iterator[bytes]:
        """Checked content of the wanted frames, ascending; neighbours share a read."""
        import xxhash

        held_at, held = 0, b""
        for k in frames:
            at, packed = int(self.offsets[k]), int(self.entries["packed"][k])
            if not (held_at <= at and at + packed <= held_at + len(held)):
                held_at, held = at, self.source.read_at(min(max(packed, READ_BYTES), int(self.offsets[-1]) - at), at)
            content = self.unpacker.decompress(held[at - held_at : at - held_at + packed])
            if len(content) != int(self.entries["size"][k]) or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.entries["check"][k]):
                raise ValueError(f"frame {k} fails its checksum")
            yield content


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Encode every text, append the end id and write frames in ascending id order.

    Returns one row per file: ``shard`` (ascending with the ids), ``file``,
    ``docs``, ``tokens`` and ``base``, the number of ids in all earlier files.
    Ids are range-partitioned, so a task holds one range and one document at a
    time. A retried or speculative task writes a file of its own name; only
    files listed here count. Null texts are empty, null ids come first, rows
    with the same id stay together in an arbitrary order unless their texts
    differ (then text order). An empty table gives no files.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(order).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        tokens = 0
        end = np.array([END_ID], "<u4")
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        file = f"{folder}/part-{shard:06d}-{attempt}.zst"
        for chunk in in_chunks(batches, 1):
            if out is None:
                store, path = filesystem(file)
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = FrameWriter(store.open_output_stream(path, compression=None))
            found = encoder(tokenizer_path).encode(chunk.column(1).combine_chunks())
            for doc_id, ids in zip(chunk.column(0).to_pylist(), found, strict=True):
                out.add(doc_id, np.concatenate([ids, end]).tobytes())
                tokens += len(ids) + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [file], "docs": [len(out.ids)], "tokens": [tokens]})

    shards = keep(ranged.mapInArrow(write, "shard long, file string, docs long, tokens long"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return keep(shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "token-files")


def read_tokens(files: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids``.

    With ``doc_ids`` only the frames of those documents are read and decompressed.
    """
    wanted = None if doc_ids is None else set(doc_ids)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = filesystem(file)
                with store.open_input_file(path) as source:
                    reader = FrameReader(source)
                    starts = base + np.concatenate([[0], np.cumsum(reader.entries["size"] // 4, dtype=np.int64)])
                    frames = [k for k, d in enumerate(reader.doc_ids) if wanted is None or d in wanted]
                    rows: list[tuple] = []
                    held = 0
                    for k, content in zip(frames, reader.content(frames), strict=True):
                        row = (reader.doc_ids[k], int(starts[k]), len(content) // 4, zlib.crc32(content))
                        rows.append((*row, np.frombuffer(content, "<u4").astype("i8")) if with_ids else row)
                        held += len(content) if with_ids else 32
                        if held > READ_BYTES:
                            yield as_batch(rows, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield as_batch(rows, with_ids)

    def as_batch(rows: list[tuple], arrays: bool) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4]]
        if arrays:
            columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.select("file", "base").repartition(parts).mapInArrow(read, schema)


def token_output(docs: DataFrame, tokenizer_path: str, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared store and read every frame back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer_path, folder, text, order))
