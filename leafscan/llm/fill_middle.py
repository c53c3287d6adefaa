"""Fill-in-middle transformation over texts in seekable compressed frames (operator 13).

A text is stored as independent zstandard frames of at most ``FRAME_UNITS``
units (code points) and the cumulative number of units at the end of each
frame. A cut is found in the counts, and only the frame that holds it is
decompressed and divided; frames between cuts are taken over as they are.
Digests decompress the frames in order, one at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import held_by_worker, keep, small_batches
from leafscan.llm.units import in_chunks

FRAME_UNITS = 1 << 14
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
FRAMES = "frames array<binary>, ends array<long>"
FRAMES_TYPE = [("frames", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64()))]


def _zstd():
    import zstandard

    return held_by_worker("zstd", lambda: (zstandard.ZstdCompressor(level=1, write_checksum=True), zstandard.ZstdDecompressor()))


class Frames:
    """A text as frames and the cumulative units at their ends."""

    def __init__(self, frames: list[bytes] | None = None, ends: list[int] | None = None) -> None:
        self.frames, self.ends = frames if frames is not None else [], ends if ends is not None else []

    @property
    def units(self) -> int:
        return self.ends[-1] if self.ends else 0

    def add(self, text: str) -> None:
        """Append a text of any length as frames of its own."""
        pack = _zstd()[0].compress
        for k in range(0, len(text), FRAME_UNITS):
            part = text[k : k + FRAME_UNITS]
            self.add_frame(pack(part.encode()), len(part))

    def add_frame(self, frame: bytes, units: int) -> None:
        self.frames.append(frame)
        self.ends.append(self.units + units)

    def text(self, k: int) -> str:
        return _zstd()[1].decompress(self.frames[k]).decode()

    def span(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Frames that hold units ``start`` to ``end`` (exclusive), each with the wanted part of it."""
        first = bisect_right(self.ends, start)
        for k in range(first, bisect_left(self.ends, end) + 1 if start < end else first):
            base = self.ends[k - 1] if k else 0
            yield k, max(start, base) - base, min(end, self.ends[k]) - base

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """UTF-8 of units ``start`` to ``end``, frame by frame."""
        for k, low, high in self.span(start, end):
            content = _zstd()[1].decompress(self.frames[k])
            whole = high - low == self.ends[k] - (self.ends[k - 1] if k else 0)
            yield content if whole else content.decode()[low:high].encode()

    def find(self, marker: str, start: int) -> int:
        """Unit at which the first ``marker`` at or after unit ``start`` begins; -1 if none."""
        tail, at = "", start
        for k, low, high in self.span(start, self.units):
            part = tail + self.text(k)[low:high]
            found = part.find(marker)
            if found >= 0:
                return at - len(tail) + found
            at += high - low
            tail = part[-(len(marker) - 1) :]
        return -1

    def rearranged(self, parts: list[str | tuple[int, int]]) -> Frames:
        """Frames of given texts and spans of this text, one after another."""
        out, loose = Frames(), []
        for part in parts:
            if isinstance(part, str):
                loose.append(part)
                continue
            for k, low, high in self.span(*part):
                units = self.ends[k] - (self.ends[k - 1] if k else 0)
                if high - low == units and units == FRAME_UNITS:
                    out.add("".join(loose))
                    loose = []
                    out.add_frame(self.frames[k], units)
                else:
                    loose.append(self.text(k)[low:high])
        out.add("".join(loose))
        return out


def order(form: str, n: int, cuts: tuple[int, int]) -> list[str | tuple[int, int]]:
    """What the output of a form consists of, for a text of ``n`` units."""
    prefix, middle, suffix = (0, cuts[0]), cuts, (cuts[1], n)
    if form == "psm":
        return [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]
    if form == "spm":
        return [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]
    return [(0, n)]


def restored(out: Frames, form: str) -> list[tuple[int, int]]:
    """Spans of an output that make up the original text, found by the markers in it."""
    if form == "plain":
        return [(0, out.units)]
    width = len(PREFIX)
    second = out.find(SUFFIX if form == "psm" else PREFIX, width)
    third = out.find(MIDDLE, second + width)
    one, two, middle = (width, second), (second + width, third), (third + width, out.units)
    return [one, middle, two] if form == "psm" else [two, middle, one]


def draws(key: Column) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the sha256 of ``1:`` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write every text as frames to the shared folder: ``doc_id, n, marked, frames, ends``.

    ``marked`` is true for a text that contains one of the markers. Null texts
    are empty and have no frame; null ids and repeated rows stay.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), body.alias("text"), marked.alias("marked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, 1):
            stored = []
            for body in chunk.column(1):
                own = Frames()
                own.add(body.as_py())
                stored.append(own)
            arrays = [chunk.column(0).combine_chunks(), pa.array([s.units for s in stored], pa.int64()), chunk.column(2).combine_chunks()]
            yield _with_frames(["doc_id", "n", "marked"], arrays, stored)

    return keep(rows.mapInArrow(run, f"doc_id long, n long, marked boolean, {FRAMES}"), "text-frames")


def _with_frames(names: list[str], arrays: list[pa.Array], stored: list[Frames]) -> pa.RecordBatch:
    columns = [pa.array([getattr(s, name) for s in stored], kind) for name, kind in FRAMES_TYPE]
    return pa.RecordBatch.from_arrays([*arrays, *columns], names=[*names, "frames", "ends"])


def planned(stored: DataFrame) -> DataFrame:
    """Add ``form`` and the two cuts ``low`` and ``high``, drawn from the id."""
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    cut = [h % (F.col("n") + 1) for h in (h1, h2)]
    form = F.when((F.col("n") == 0) | F.col("marked") | (h3 % 100 >= PLAIN_FROM), "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    return stored.select("doc_id", "n", form.alias("form"), F.least(*cut).alias("low"), F.greatest(*cut).alias("high"), "frames", "ends")


def transform(stored: DataFrame) -> DataFrame:
    """Outputs of :func:`store` rows: ``doc_id, n, form, prefix_chars, middle_chars, frames, ends``.

    ``frames`` and ``ends`` hold the output as a seekable text of its own. The
    counts are null for the form ``plain``, whose output is the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, 5):
            out = []
            rows = (chunk.column(i).to_pylist() for i in range(1, 7))
            for n, form, low, high, frames, ends in zip(*rows, strict=True):
                out.append(Frames(frames, ends).rearranged(order(form, n, (low, high))))
            yield _with_frames(["doc_id", "n", "form", "low", "high"], [chunk.column(i).combine_chunks() for i in range(5)], out)

    done = planned(stored).mapInArrow(run, f"doc_id long, n long, form string, low long, high long, {FRAMES}")
    cut = F.col("form") != "plain"
    return done.select("doc_id", "n", "form", F.when(cut, F.col("low")).alias("prefix_chars"), F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"), "frames", "ends")


def digests(outputs: DataFrame) -> DataFrame:
    """Replace the frames of :func:`transform` by ``output_sha256`` and ``restored_sha256``, read frame by frame."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def of(text: Frames, spans: list[tuple[int, int]]) -> str:
        digest = hashlib.sha256()
        for span in spans:
            for content in text.read(*span):
                digest.update(content)
        return digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, 5):
            output, back = [], []
            for form, frames, ends in zip(*(chunk.column(i).to_pylist() for i in (2, 5, 6)), strict=True):
                text = Frames(frames, ends)
                output.append(of(text, [(0, text.units)]))
                back.append(of(text, restored(text, form)))
            yield pa.RecordBatch.from_arrays(
                [*[chunk.column(i).combine_chunks() for i in range(5)], pa.array(output, pa.string()), pa.array(back, pa.string())],
                names=[*names, "output_sha256", "restored_sha256"],
            )

    return outputs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
