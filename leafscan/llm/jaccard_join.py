"""n-gram Jaccard join by grouped prefixes (operator 10).

Texts are sets of five-word shingles; two sets link when
100 * |A & B| >= 75 * |A | B|. The join goes through these steps, all exact:

1. Every text gives a number of its smallest shingle hashes, 40 in a hundred. Sets that link
   share so many of these that a set with few of them in any other text drops
   out (``survivors``).
2. The full sets of the remaining texts are counted; shingles are ordered from
   the rarest, and shingles of one text only cannot be shared, so they take up
   the front of the prefix without ever being joined (``candidates``).
3. Sets with the same prefix and size form a group; groups meet on the
   shingles of their prefixes. Groups first meet one pivot per shingle. What
   those links connect need not meet again, so of a large group of near copies
   only what is still apart is paired, its members expanded and verified
   (``near_links``).
4. Components of the links (``components``).

Counting moves packed arrays of hashes: a row per text chunk and bucket of
shingles, dealt by Spark by bucket and back by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import held_by_worker, keep, packed, small_batches, unpacked
from leafscan.llm.components import components
from leafscan.llm.shingles import sets_of
from leafscan.session import small

SHARE = 75  # a link needs SHARE hundredths of the union in common
EXTRA = 15  # hundredths of a set by which the first step's prefix is longer than needed
CHUNK_TOKENS = 1_000_000
PIVOTS = 6  # drawn per shingle for the groups that are apart after the first pivot
CHUNK_DOCS = 60_000  # document numbers in a chunk take two bytes
TOKENS, TEXTS = 0, 1  # kinds of packed rows
LOW = np.uint64((1 << 48) - 1)
PACKED = "bucket long, chunk long, kind long, blob binary"
DOC = np.dtype([("key", "V32"), ("sig", "V16"), ("n", "<u4"), ("copy", "u1")])


def overlap_needed(n: int | np.ndarray):
    """Least overlap of a set of size n with any set that links to it."""
    return -(-SHARE * n // 100)


def first_prefix(n: int) -> int:
    return n - overlap_needed(n) + 1 + EXTRA * n // 100


def first_shared(n: np.ndarray) -> np.ndarray:
    """Hashes that the first prefixes of a set of size n and of any set linking to it share at least.

    With prefixes longer by l - 1 than needed, the l smallest common hashes lie
    in both; the other set has SHARE hundredths of n elements or more.
    """
    return 1 + EXTRA * overlap_needed(n) // 100


# --- packed rows ---------------------------------------------------------------


def pack(places: np.ndarray, tokens: np.ndarray, docs: int, counts: np.ndarray | None = None) -> bytes:
    """Tokens (48 bits) of a chunk, sorted by document number, with their counts if given."""
    dense = len(tokens) >= docs
    where = np.bincount(places, minlength=docs).astype("<u4") if dense else places.astype("<u2")
    head = np.array([dense, docs, len(tokens), counts is not None], "<u4").tobytes()
    low = np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return head + where.tobytes() + low + (b"" if counts is None else counts.astype("<u4").tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    dense, docs, n, counted = np.frombuffer(blob, "<u4", 4).tolist()
    at = 16
    if dense:
        places = np.repeat(np.arange(docs, dtype=np.int64), np.frombuffer(blob, "<u4", docs, at))
        at += 4 * docs
    else:
        places = np.frombuffer(blob, "<u2", n, at).astype(np.int64)
        at += 2 * n
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(-1, 6)
    return places, wide.view("<u8").ravel(), np.frombuffer(blob, "<u4", n, at + 6 * n) if counted else None


def batch(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def packed_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["bucket", "chunk", "kind", "blob"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > 4 << 20:
            yield batch(names, held, kinds)
            held, size = [], 0
    if held:
        yield batch(names, held, kinds)


def chunk_rows(chunk: int, texts: list[tuple], sets: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Packed rows of one chunk: its tokens by bucket, and its texts in one of the buckets."""
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    places = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = ((tokens >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    tokens, places, bucket = tokens[order], places[order], bucket[order]
    for b, start, end in runs(bucket):
        yield b, chunk, TOKENS, pack(places[start:end], tokens[start:end] & LOW, len(sets))
    yield chunk % buckets, chunk, TEXTS, np.array(texts, DOC).tobytes()


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(value, start, end)`` of the runs of equal values."""
    if len(values):
        edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]).tolist()
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            yield int(values[start]), start, end


def shingled(texts: DataFrame, buckets: int, prefix: Callable[[int], int] | None) -> DataFrame:
    """Packed rows of ``key, body``: all tokens of each set, or the ``prefix(n)`` smallest.

    Rows are sorted in their partition first, so a task that runs again makes
    the same chunks. A set that its task has met before is listed without tokens.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed_batches(rows(batches))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held_by_worker("jaccard", dict)
        chunk = TaskContext.get().partitionId() << 24
        texts: list[tuple] = []
        sets: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = 0
        for rows in batches:
            for key, own in zip(rows.column(0).to_pylist(), sets_of(rows.column(1)), strict=True):
                sig = xxhash.xxh3_128_digest(own.tobytes())
                copy = sig in seen
                seen.add(sig)
                texts.append((key, sig, len(own), copy))
                sets.append(own[:0] if copy else own[: prefix(len(own))] if prefix else own)
                held += len(sets[-1])
                if held >= CHUNK_TOKENS or len(texts) >= CHUNK_DOCS:
                    yield from chunk_rows(chunk, texts, sets, buckets)
                    chunk, texts, sets, held = chunk + 1, [], [], 0
                    seen.clear()
        if texts:
            yield from chunk_rows(chunk, texts, sets, buckets)

    return texts.select("key", "body").sortWithinPartitions("key").mapInArrow(make, PACKED)


def by_value(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a sorted partition, one value of a column after the other."""
    value, held = None, []
    for rows in batches:
        for row in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if row[column] != value and held:
                yield value, held
                held = []
            value = row[column]
            held.append(row)
    if held:
        yield value, held


def repeated(shingles: DataFrame) -> DataFrame:
    """Of packed rows, the tokens that occur in two texts or more, with the number of texts; rows of texts pass through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed_batches(row for bucket, rows in by_value(batches, 0) for row in count_bucket(bucket, rows))

    return shingles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, PACKED)


def count_bucket(bucket: int, rows: list[tuple]) -> Iterator[tuple]:
    parts = []
    docs = []
    for number, (_, _, kind, blob) in enumerate(rows):
        if kind == TEXTS:
            yield rows[number]
            continue
        places, tokens, _ = unpack(blob)
        parts.append((np.full(len(tokens), number, np.int32), places.astype(np.int32), tokens))
        docs.append((number, int(np.frombuffer(blob, "<u4", 4)[1])))
    if not parts:
        return
    number, places, tokens = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    order = np.argsort(tokens)
    same = tokens[order]
    first = np.concatenate([[True], same[1:] != same[:-1]])
    counts = np.diff(np.append(np.flatnonzero(first), len(same)))
    counts = np.repeat(counts, counts)
    order, counts = order[counts > 1], counts[counts > 1]
    back = np.lexsort((places[order], number[order]))
    order, counts = order[back], counts[back]
    size = dict(docs)
    for row, start, end in runs(number[order]):
        at = order[start:end]
        yield bucket, rows[row][1], TOKENS, pack(places[at], tokens[at], size[row], np.minimum(counts[start:end], 0xFFFFFFFF))


def per_chunk(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a chunk, and document numbers, tokens and counts of its repeated tokens, rarest first per document."""
    texts = np.zeros(0, DOC)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
    for bucket, _, kind, blob in rows:
        if kind == TEXTS:
            texts = np.frombuffer(blob, DOC)
        else:
            places, tokens, counts = unpack(blob)
            parts.append((places, tokens | np.uint64(bucket << 48), counts))
    places, tokens, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((tokens, counts, places))
    return texts, places[order], tokens[order], counts[order]


def by_chunk(rows: DataFrame, make: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in by_value(batches, 1):
            yield make(own)

    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)


# --- steps ---------------------------------------------------------------------


def keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.unhex(F.sha2(body, 256)).alias("key"), body.alias("body"))


def survivors(texts: DataFrame, buckets: int) -> DataFrame:
    """``key, sig, n, near``: set and size of every text, and whether its first prefix allows a link to another set."""

    def make(rows: list[tuple]) -> pa.RecordBatch:
        texts, places, _, _ = per_chunk(rows)
        shared = np.bincount(places, minlength=len(texts))
        n = texts["n"].astype(np.int64)
        near = (n > 0) & (texts["copy"] == 0) & (shared >= first_shared(n))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k.tobytes() for k in texts["key"]], pa.binary()),
                pa.array([s.tobytes() for s in texts["sig"]], pa.binary()),
                pa.array(n, pa.int64()),
                pa.array(near, pa.bool_()),
            ],
            names=["key", "sig", "n", "near"],
        )

    rows = repeated(shingled(texts, buckets, first_prefix))
    sets = by_chunk(rows, make, "key binary, sig binary, n long, near boolean")
    return keep(sets.groupBy("key").agg(F.max("sig").alias("sig"), F.max("n").alias("n"), F.max("near").alias("near")), "shingle-sets")


def candidates(texts: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """``sig, n, need, tokens``: sets whose prefix has shared tokens; ``tokens`` are all shared ones, the rarest first.

    ``need`` tokens are in the prefix: the tokens of no other text come before
    them in the order, but cannot be met elsewhere.
    """
    chosen = keep(sets.filter("near").groupBy("sig").agg(F.min("key").alias("key")), "near-keys")
    bodies = texts.join(small(chosen.select("key")), "key", "left_semi").dropDuplicates(["key"])

    def make(rows: list[tuple]) -> pa.RecordBatch:
        texts, places, tokens, _ = per_chunk(rows)
        found = []
        ends = np.searchsorted(places, np.arange(len(texts) + 1))
        for k, text in enumerate(texts):
            n, own = int(text["n"]), tokens[ends[k] : ends[k + 1]]
            need = n - overlap_needed(n) + 1 - (n - len(own))
            if n and need > 0:
                found.append((text["sig"].tobytes(), n, need, own.view(np.int64)))
        return batch(["sig", "n", "need", "tokens"], found, [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())])

    rows = repeated(shingled(bodies, buckets, None))
    return keep(by_chunk(rows, make, "sig binary, n long, need long, tokens array<long>"), "near-sets")


def fits(a: Column, b: Column) -> Column:
    """Sizes that allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * SHARE


def short_prefix(side: str) -> Column:
    """Shared tokens in the prefix of a set that meets larger ones only.

    The overlap with a set of n or more elements is at least
    2 * SHARE / (100 + SHARE) of n, which leaves fewer tokens before the first
    common one than the prefix against sets of any size.
    """
    n, shared = F.col(f"{side}_n"), F.col(f"{side}_shared")
    least = F.ceil(n * (2 * SHARE) / (100 + SHARE) - 1e-9).cast("long")
    return n - least + 1 - (n - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link, by their whole sets."""
    own = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    other = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(own, "a").join(other, "b")
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    return both.select("a", "b", "na", "nb", common.alias("common")).filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * SHARE).select("a", "b")


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``label``, the component of ``sig`` under the links so far."""
    roots = components(links).select(F.col("node").alias("sig"), "root")
    return members.join(small(roots), "sig", "left").select(*members.columns, F.coalesce("root", "sig").alias("label"))


def pointed(nodes: DataFrame, links: DataFrame, hops: int = 4) -> DataFrame:
    """``sig, label``: where up to ``hops`` links ``a -> b`` lead, if each set points to one other at most."""
    step = small(links.select(F.col("a").alias("label"), F.col("b").alias("next")))
    out = nodes.select("sig", F.col("sig").alias("label"))
    for _ in range(hops):
        out = out.join(step, "label", "left").select("sig", F.coalesce("next", "label").alias("label"))
    return out


def meetings(entries: DataFrame, pivots: DataFrame, most: int) -> DataFrame:
    """``a, b``: each group with the ``most`` pivots of other labels with which it shares most tokens."""
    met = entries.join(pivots, "h").filter((F.col("label") != F.col("p.label")) & fits(F.col("n"), F.col("p.n")))
    counted = met.groupBy("lead", F.col("p.lead").alias("pivot")).agg(F.count("*").alias("hits"))
    if most == 1:
        best = counted.groupBy("lead").agg(F.max(F.struct("hits", "pivot")).alias("best"))
    else:
        ranked = F.sort_array(F.collect_list(F.struct("hits", "pivot")), asc=False)  # a few per token of the prefix
        best = counted.groupBy("lead").agg(F.slice(ranked, 1, most).alias("best")).select("lead", F.explode("best").alias("best"))
    return best.select(F.col("lead").alias("a"), F.col("best.pivot").alias("b"))


def near_links(sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between sets; not all, but enough that components are those of all links."""
    sets = sets.withColumn("prefix", F.slice("tokens", F.lit(1), F.col("need").cast("int")))
    groups = sets.groupBy("n", "prefix").agg(F.min("sig").alias("lead"), F.min(1 - F.size("tokens") / F.col("n")).alias("alone"))
    members = keep(
        sets.join(groups, ["n", "prefix"]).select("sig", "n", "lead", F.size("tokens").cast("long").alias("shared")), "near-members"
    )
    entries = groups.select("lead", "n", "alone", F.posexplode("prefix").alias("pos", "h"))
    entries = keep(entries.select("lead", "n", "alone", F.col("pos").cast("long").alias("pos"), "h"), "near-entries")

    # Members meet the lead of their group. A group meets one pivot: of each token's list the set with the smallest
    # part of its own comes first, which of near copies is the one nearest to their origin.
    inside = members.filter("sig <> lead").select(F.col("sig").alias("a"), F.col("lead").alias("b"))
    own = entries.withColumn("label", F.col("lead"))
    pivots = own.groupBy("h").agg(F.min(F.struct("alone", "lead", "n", "label")).alias("p"), F.count("*").alias("size")).filter("size > 1")
    links = keep(verified(inside.unionByName(meetings(own, pivots.select("h", "p"), 1)), sets), "near-links")

    # Members still apart from others of a list meet some pivots drawn from it.
    labels = keep(pointed(members, links), "near-leads")
    expanded = entries.join(small(members.drop("n")), "lead")
    own = expanded.join(small(labels), "sig").select("h", F.col("sig").alias("lead"), "n", "label")
    drawn = [F.min(F.struct(F.xxhash64("lead", F.lit(k)), "lead", "n", "label")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = own.groupBy("h").agg(*drawn, F.min("label").alias("first"), F.max("label").alias("last")).filter("first <> last")
    listed = F.array_distinct(F.array(*[F.struct(f"p{k}.lead", f"p{k}.n", f"p{k}.label") for k in range(PIVOTS)]))
    more = meetings(own, pivots.select("h", F.explode(listed).alias("p")), PIVOTS)
    links = keep(links.unionByName(verified(more, sets)), "near-links")

    # What is still apart: in a token's list, all members outside its most common component meet all others.
    rows = expanded.join(small(keep(labelled(members.select("sig"), links), "near-labels")), "sig").select("h", "sig", "n", "pos", "shared", "label")
    rows = keep(rows, "near-rows")
    share = rows.groupBy("h", "label").agg(F.count("*").alias("c"))
    mixed = share.groupBy("h").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    mixed = keep(mixed.select("h", F.col("top.label").alias("top")), "near-mixed")
    apart = rows.join(small(mixed), "h")
    x = apart.filter("label <> top").select("h", *[F.col(c).alias(f"x_{c}") for c in ("sig", "n", "pos", "shared", "label")])
    y = apart.select("h", *[F.col(c).alias(f"y_{c}") for c in ("sig", "n", "pos", "shared", "label")])
    most = F.least(F.col("x_shared") - F.col("x_pos"), F.col("y_shared") - F.col("y_pos"))
    enough = most * (100 + SHARE) >= (F.col("x_n") + F.col("y_n")) * SHARE  # from the first common token on
    # A shorter prefix of the smaller set is enough: it has common tokens for more than half of both sets.
    x_smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_sig") < F.col("y_sig")))
    early = F.when(x_smaller, F.col("x_pos") < short_prefix("x")).otherwise(F.col("y_pos") < short_prefix("y"))
    pairs = x.join(y, "h").filter((F.col("x_label") != F.col("y_label")) & fits(F.col("x_n"), F.col("y_n")) & enough & early)
    pairs = pairs.select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct()
    return links.unionByName(verified(keep(pairs, "near-pairs"), sets))


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """``key, sig, n, label`` per distinct text: its shingle set, the size and the component (of links between sets)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    texts = keyed(docs, text)
    sets = survivors(texts, buckets)
    near = candidates(texts, sets, buckets)
    return labelled(sets.select("key", "sig", "n"), near_links(near))


def jaccard_join(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    ``n_shingles`` is the size of the set of five-word shingles after
    lower-casing A-Z (all words as one shingle if there are fewer than five);
    ``component_id`` the smallest doc_id reachable by links, itself included.
    A text that is null or without words has no shingles and links with
    nothing; equal texts with words link. A null id is never the smallest
    unless it is alone. Repeated rows each get a row, an empty table none;
    extra columns are ignored.
    """
    found = near_groups(docs, text)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(order).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("key"))
    rows = keep(rows.join(found, "key").select("doc_id", "n", "label"), "near-documents")
    least = rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest id (then text digest); columns as given.

    Texts without words all stay. Of rows with the same id and text one stays.
    """
    found = near_groups(docs)
    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    rows = docs.select(F.col("doc_id").alias("id"), key.alias("key"))
    rows = keep(rows.join(found.filter("n > 0"), "key").select("id", "key", "label").groupBy("id", "key", "label").count(), "near-documents")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
    ranked = rows.join(first, "label").select(
        "id", "key", "count", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("stays")
    )
    ranked = keep(ranked, "near-ranked")
    lost = ranked.filter(~F.col("stays")).select(F.col("id").alias("lost_id"), F.col("key").alias("lost_key"))
    whole = packed(docs, id=F.col("doc_id"), key=key)
    match = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("key") == F.col("lost_key"))
    kept = whole.join(small(lost), match, "left_anti")
    again = keep(ranked.filter("stays and count > 1").select(F.col("id").alias("lost_id"), F.col("key").alias("lost_key")), "near-repeated")
    if again.isEmpty():
        return unpacked(kept, docs.columns)
    single = kept.join(small(again), match, "left_anti")
    return unpacked(single.unionByName(kept.join(small(again), match, "left_semi").dropDuplicates(["id", "key"])), docs.columns)
