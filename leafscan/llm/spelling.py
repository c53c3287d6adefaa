"""Spelling variants of a vocabulary by a bit-sliced position index (operator 12).

Words that differ by one inserted, deleted or replaced code point, the shorter
of c code points, share their first ``c div 2`` code points or their last
``c - c div 2``. So a word of L code points is indexed under its head and its
tail for the classes c = L and c = L - 1, and only words of one class and key
meet. Within a group of such words a bitset per (position, letter) holds the
words with that letter there, and one pass over the letters of all query words
keeps, per query, the words that agree so far and those with one error so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import ascii_lower, keep
from leafscan.session import small

RUN = r"a-zÀ-ÿ"
GROUP_WORDS = 1024  # aim for the words of a group, of up to 64 code points; longer words come in smaller groups
GROUP_CHARS = GROUP_WORDS * 64
DOMINANT = 10


def noisy_counts(docs: DataFrame, every: int, least_chars: int, least_count: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``word, n`` over the maximal letter runs of whole texts; A-Z become lower case.

    Where ``every`` divides the crc32 of ``id:run``, one code point of the run
    is left out, chosen by the same number. Words of fewer than ``least_chars``
    code points or ``least_count`` occurrences are left out. A null text has no
    runs, a null id counts as empty, each repeated row counts, and other
    columns are not read.
    """
    body = ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    own = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    runs = docs.select(own.alias("id"), F.explode(F.regexp_extract_all(body, F.lit(f"[{RUN}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    drawn = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = drawn.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keyed(words: DataFrame, least: int) -> DataFrame:
    """A row per word, class and side; ``other`` is the head of a word keyed by its tail."""
    length = F.length("word")
    classed = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("cls")).filter(F.col("cls") >= least)
    half = F.floor(F.col("cls") / 2).cast("int")
    head, tail = F.substring("word", F.lit(1), half), F.substring("word", length - (F.col("cls") - half) + 1, length)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), head.alias("key"), F.lit("").alias("other")),
        F.struct(F.lit(1).alias("side"), tail.alias("key"), head.alias("other")),
    )
    return classed.select("word", "n", "cls", F.explode(sides).alias("s")).select("word", "n", "cls", "s.*")


def _cap(cls: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(GROUP_WORDS), F.floor(F.lit(GROUP_CHARS) / F.greatest(cls, F.lit(1))))).cast("long")


def _grouped(keyed: DataFrame) -> DataFrame:
    """Give every row its groups, so that any two words of a key meet in one of them and groups stay near the aim.

    Keys are dealt over buckets of their class. A key with more words than the
    aim is cut into slices, and each pair of slices is a group: a word is an
    entry of the index there (``role`` 1), a query (2) or both (3).
    """
    counts = keyed.groupBy("cls", "side", "key").agg(F.count("*").alias("members"))
    counts = keep(counts, "spelling-keys")
    classes = counts.groupBy("cls").agg(F.sum("members").alias("rows"))
    hot = keep(counts.filter(F.col("members") > _cap(F.col("cls"))), "spelling-hot-keys")
    rows = keyed.join(small(keep(classes, "spelling-classes")), "cls").join(small(hot), ["cls", "side", "key"], "left")
    named = F.xxhash64("key", "side")
    bucket = F.pmod(named, F.ceil(F.col("rows") / _cap(F.col("cls"))))
    slices = F.when(F.col("members").isNull(), F.lit(1)).otherwise(F.ceil(F.col("members") / _cap(F.col("cls")))).cast("int")
    part = F.when(F.col("members").isNull(), bucket).otherwise(-1 - F.pmod(named, F.lit(1 << 62)))
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")

    def place(entry: Column, asked: Column, role: int) -> Column:
        return F.struct(entry.alias("entry"), asked.alias("asked"), F.lit(role).alias("role"))

    def places(o: Column) -> Column:
        every = F.sequence(F.lit(0), F.col("slices") - 1)
        return F.flatten(F.transform(every, lambda k: F.when(k == o, F.array(place(o, o, 3))).otherwise(F.array(place(o, k, 1), place(k, o, 2)))))

    cut = rows.select("word", "n", "cls", "side", "key", "other", part.alias("part"), slices.alias("slices")).withColumn("own", own)
    once = F.array(place(F.lit(0), F.lit(0), 3))
    return cut.withColumn("p", F.explode(F.when(F.col("slices") == 1, once).otherwise(places(F.col("own"))))).select(
        "word", "n", "cls", "side", "key", "other", "part", "p.entry", "p.asked", "p.role"
    )


class PositionIndex:
    """Bitsets of words per (position, letter); the words are rows of letter codes, -1 after their end."""

    def __init__(self, codes: np.ndarray, letters: int) -> None:
        self.words, self.width = len(codes), (len(codes) + 63) // 64
        self.planes = [self._plane(codes[:, i], letters) for i in range(codes.shape[1])]
        self.none = np.zeros((letters, self.width), np.uint64)
        lengths = (codes >= 0).sum(axis=1)
        self.of_length = {int(length): self._bits((lengths == length)[None, :])[0] for length in np.unique(lengths)}

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        packed = np.zeros((len(flags), self.width * 8), np.uint8)
        some = np.packbits(flags, axis=1, bitorder="little")
        packed[:, : some.shape[1]] = some
        return packed.view(np.uint64)

    def _plane(self, column: np.ndarray, letters: int) -> np.ndarray:
        flags = np.zeros((letters, self.words), bool)
        held = np.flatnonzero(column >= 0)
        flags[column[held], held] = True
        return self._bits(flags)

    def plane(self, position: int) -> np.ndarray:
        return self.planes[position] if 0 <= position < len(self.planes) else self.none

    def near(self, asked: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs that differ by exactly one edit, for queries of equal length and words of ``lengths``.

        After i letters of a query, ``same`` holds the words that begin with
        them, ``replaced`` those that differ in one of them, ``longer`` those
        that match with one letter more (their next letter is at i + 1) and
        ``shorter`` those that match with one letter less (at i - 1).
        """
        m = asked.shape[1]
        want = {d: self.of_length.get(m + d) if m + d in lengths else None for d in (-1, 0, 1)}
        shape = (len(asked), self.width)
        same = np.full(shape, np.iinfo(np.uint64).max, np.uint64)
        replaced, longer, shorter = (np.zeros(shape, np.uint64) for _ in range(3))
        for i in range(m):
            letter = asked[:, i]
            here = self.plane(i)[letter]
            if want[0] is not None:
                replaced = (replaced & here) | (same & ~here)
            if want[1] is not None:
                longer = (longer | same) & self.plane(i + 1)[letter]
            if want[-1] is not None:
                shorter = (shorter & self.plane(i - 1)[letter]) | same
            same = same & here
        hits = np.zeros(shape, np.uint64)
        for d, found in ((0, replaced), (1, longer | same), (-1, shorter)):
            if want[d] is not None:
                hits |= found & want[d]
        rows, cells = np.nonzero(hits)
        bits = np.unpackbits(hits[rows, cells].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        return rows[which], cells[which] * 64 + bit


QUERIES_AT_ONCE = 1024


def _group(table: pa.Table) -> pa.Table:
    """Near words of a group's queries: their number and the best of them, per query word with any."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    cls, side, role = table.column("cls")[0].as_py(), table.column("side")[0].as_py(), table.column("role").to_numpy()
    key, other = (table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("key", "other"))
    lengths = np.array([len(w) for w in words])
    letters, flat = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), return_inverse=True)
    codes = np.full((len(words), int(lengths.max())), -1, np.int64)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    entries = np.flatnonzero(role & 1)
    index = PositionIndex(codes[entries], len(letters))
    found_a, found_b = [], []
    for m, wanted in ((cls, (cls, cls + 1)), (cls + 1, (cls,))):
        asked = np.flatnonzero((lengths == m) & (role & 2 > 0))
        for k in range(0, len(asked), QUERIES_AT_ONCE):
            own = asked[k : k + QUERIES_AT_ONCE]
            a, b = index.near(codes[own, :m], wanted)
            found_a.append(own[a])
            found_b.append(entries[b])
    a, b = np.concatenate([np.zeros(0, np.int64), *found_a]), np.concatenate([np.zeros(0, np.int64), *found_b])
    # Words with the same head meet under it, others under their tail; a bucket also holds words of other keys.
    met = (key[a] == key[b]) & ((other[a] != other[b]) if side else True)
    a, b = a[met], b[met]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    ranked = np.lexsort((place[b], -n[b], a))
    a, b = a[ranked], b[ranked]
    asked, first, near = np.unique(a, return_index=True, return_counts=True)
    return pa.table(
        {
            "word": pa.array([words[i] for i in asked], pa.string()),
            "near": pa.array(near, pa.int64()),
            "form": pa.array([words[i] for i in b[first]], pa.string()),
            "form_n": pa.array(n[b[first]], pa.int64()),
        }
    )


def near_words(words: DataFrame, least: int = 1) -> DataFrame:
    """``word, n_near, form, form_n`` for every word of ``words`` (distinct ``word, n``) with a near word.

    ``form`` is the near word of largest ``n``, of equals the smallest in code
    point order. ``least`` is the length of the shortest word.
    """
    groups = _grouped(_keyed(words, least)).groupBy("cls", "side", "part", "entry", "asked")
    found = groups.applyInArrow(_group, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def variants(words: DataFrame, least: int = 1, dominant: int = DOMINANT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary of distinct ``word, n``.

    A word's form is its best near word if that is ``dominant`` times as
    frequent; its root is the end of the chain of forms, itself if it has none.
    A chain is at most as long as a count has digits to that base, so its ends
    are found by doubling in a few rounds. An empty vocabulary gives no rows.
    """
    words = keep(words.select("word", "n"), "spelling-words")
    near = near_words(words, least)
    strong = F.col("form_n") >= dominant * F.col("n")
    rows = keep(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")
        ),
        "spelling-forms",
    )
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    largest = words.agg(F.max("n")).first()[0] or 1
    steps = 1
    while dominant**steps <= largest:  # a chain of this many forms may exist
        following = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = keep(links.join(following, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-links")
        steps *= 2
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
