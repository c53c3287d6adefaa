"""Benchmark decontamination by winnowing (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import ascii_lower, keep, let, packed, unpacked
from leafscan.session import small

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed: what separates words once A-Z are lower case
SPAN = 10  # words of a window
GRAM = 5  # words of a fingerprint
GUARD = SPAN - GRAM + 1  # k-grams of a winnowing window: every shared span of SPAN words shares its minimum


def clean(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def exact_words(c: Column) -> Column:
    """Words as compared and as hashed: only A-Z lower-cased. The first and last may be empty.

    No letter depends on its neighbours, as a capital sigma would in full lower
    case; so a word is the same in a text and in a window joined by blanks, and
    fingerprints never miss a match.
    """
    return F.split(ascii_lower(clean(c)), BREAK, -1)


def word_count(words: Column) -> Column:
    def inner(ws: Column) -> Column:
        edges = (F.get(ws, F.lit(0)) == "").cast("long") + (F.get(ws, F.size(ws) - 1) == "").cast("long")
        return F.greatest(F.size(ws).cast("long") - edges, F.lit(0).cast("long"))

    return let(words, inner)


def upto(last: Column) -> Column:
    """0 .. last, or nothing if ``last`` is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def grams(words: Column, k: int) -> Column:
    """Hash of every run of ``k`` words."""
    return let(words, lambda ws: F.transform(upto(F.size(ws) - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)])))


def winnowed(hashes: Column, w: int) -> Column:
    """Distinct minima of every ``w`` neighbouring hashes."""
    if w == 1:
        return F.array_distinct(hashes)
    return F.array_distinct(
        let(hashes, lambda hs: F.transform(upto(F.size(hs) - w), lambda i: F.least(*[F.get(hs, i + j) for j in range(w)])))
    )


def marked(hashes: Column, span: int) -> Column:
    return F.transform(hashes, lambda m: F.struct(F.lit(span).alias("span"), m.alias("mark")))


def marks_of(marks: Column, span: int) -> Column:
    return F.transform(F.filter(marks, lambda m: m["span"] == span), lambda m: m["mark"])


def windows_near(marks: Column, hashes: Column, last: Column, w: int) -> Column:
    """Starts, up to ``last``, of the windows around every k-gram whose hash is in ``marks``."""

    def around(place: Column, end: Column) -> Column:
        near = F.sequence(F.least(F.greatest(place - (w - 1), F.lit(0)), end), F.least(place, end))
        return F.when(end < 0, F.array().cast("array<int>")).otherwise(near)

    def starts(own: Column, hs: Column, end: Column) -> Column:
        places = F.filter(upto(F.size(hs) - 1), lambda i: F.array_contains(own, F.get(hs, i)))
        return F.flatten(F.transform(places, lambda p: around(p, end)))

    return let(marks, lambda own: let(hashes, lambda hs: let(last, lambda end: starts(own, hs, end))))


def windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Every window of every item: ``item_id`` (text), ``span`` (words), ``window`` (words joined by a blank)."""
    words = items.select(
        clean(F.col(item_id).cast("string")).alias("item_id"), F.filter(exact_words(F.col(text)), lambda x: x != "").alias("words")
    ).filter(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(SPAN))
    return words.select(
        "item_id",
        span.alias("span"),
        F.explode(
            let(F.col("words"), lambda ws: F.transform(upto(F.size(ws) - span), lambda i: F.array_join(F.slice(ws, i + 1, span), " ")))
        ).alias("window"),
    ).distinct()


def fingerprints(windowed: DataFrame, span: int, k: int, w: int) -> DataFrame:
    """Distinct fingerprints ``mark`` of the windows of ``span`` words."""
    words = exact_words(F.col("window"))
    return windowed.filter(F.col("span") == span).select(F.explode(winnowed(grams(words, k), w)).alias("mark")).distinct()


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per distinct text: ``key`` (sha256), ``n_words, n_hit, n_items, item_ids``.

    Fingerprints of all texts are joined with those of the items; texts that
    share one are read again and only the windows around shared fingerprints
    are compared in full. An item of fewer than ten words is one window; its
    fingerprint is the hash of the whole window, so its texts are tested at
    every position.
    """
    bench = keep(windows(items, item_id, item_text), "bench-windows")
    spans = sorted(r[0] for r in bench.select("span").distinct().collect())  # at most ten values
    plans = [(s, *((GRAM, GUARD) if s == SPAN else (s, 1))) for s in spans]
    keyed = docs.select(F.sha2(clean(F.col(text)), 256).alias("key"), clean(F.col(text)).alias("body"))

    marks = None
    for span, k, w in plans:
        own = fingerprints(bench, span, k, w).select(F.lit(span).alias("span"), "mark")
        marks = own if marks is None else marks.unionByName(own)
    words = keyed.select("key", exact_words(F.col("body")).alias("words"))
    no_mark = F.array(F.struct(F.lit(0).alias("span"), F.xxhash64("key").alias("mark")))  # carries n_words on
    listed = [marked(winnowed(grams(F.col("words"), k), w), span) for span, k, w in plans]
    rows = words.select("key", word_count(F.col("words")).alias("n_words"), F.explode(F.concat(no_mark, *listed)).alias("m")).select(
        "key", "n_words", "m.span", "m.mark"
    )
    if marks is None:
        shared = rows.withColumn("found", F.lit(None).cast("boolean"))
    else:
        known = small(keep(marks, "bench-marks")).withColumn("found", F.lit(True))
        shared = rows.join(known, ["span", "mark"], "left").filter(F.col("found") | (F.col("span") == 0))
    shared = shared.groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("found"), F.struct("span", "mark"))).alias("marks")
    )
    texts = keep(shared, "text-marks")
    if marks is None:
        none = texts.select("key", "n_words")
        return none.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("item_ids"))

    matched = texts.filter(F.size("marks") > 0).select("key", "marks")
    bodies = keyed.join(small(matched.select("key")), "key", "left_semi").dropDuplicates(["key"])
    read = bodies.join(matched, "key").select("key", "marks", exact_words(F.col("body")).alias("words"))
    tried = None
    for span, k, w in plans:
        at = read.select("key", "words", marks_of(F.col("marks"), span).alias("own"), grams(F.col("words"), k).alias("hashes"))
        around = F.array_distinct(windows_near(F.col("own"), F.col("hashes"), F.size("words") - span, w))
        starts = at.filter(F.size("own") > 0).select("key", "words", F.explode(around).alias("at"))
        part = starts.select("key", "at", F.lit(span).alias("span"), F.array_join(F.slice("words", F.col("at") + 1, span), " ").alias("window"))
        tried = part if tried is None else tried.unionByName(part)
    known = small(bench.select("span", "window").distinct())
    exact = keep(tried.join(known, ["span", "window"]), "window-hits")

    order = Window.partitionBy("key").orderBy("at", "span").rowsBetween(Window.unboundedPreceding, -1)
    covered = exact.select("key", "at", "span", F.max(F.col("at") + F.col("span")).over(order).alias("done"))
    end = F.col("at") + F.col("span")
    covered = covered.groupBy("key").agg(
        F.sum(F.greatest(end - F.greatest("at", F.coalesce("done", F.lit(0))), F.lit(0))).cast("long").alias("n_hit")
    )
    found = exact.select("key", "span", "window").distinct().join(bench, ["span", "window"]).select("key", "item_id").distinct()
    found = found.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("item_ids"))
    return (
        texts.select("key", "n_words")
        .join(covered.join(found, "key"), "key", "left")
        .select(
            "key",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in an occurrence of ten consecutive words of an
    item, or of a whole shorter item. Texts without words, null among them,
    have no hits; items without words are never found, an item without id is
    listed as an empty id, and items that share an id count once. Repeated
    rows each get a row, an empty table of documents gives none, an empty
    benchmark gives no hits. Extra columns are ignored.
    """
    found = hits(docs, items, text)
    rows = docs.select(F.col(order).alias("doc_id"), F.sha2(clean(F.col(text)), 256).alias("key"))
    return rows.join(found, "key").select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any word in common windows with an item; columns as given.

    Null and empty texts have no words and stay, as do all documents if the
    benchmark is empty. Every row is judged by its own text, so repeated rows
    stay or go together; ids and other columns, whatever their names, are not
    read. An empty table gives no rows.
    """
    found = hits(docs, items).filter("n_hit > 0").select("key")
    rows = packed(docs, key=F.sha2(clean(F.col("text")), 256))
    return unpacked(rows.join(small(keep(found, "hit-texts")), "key", "left_anti"), docs.columns)
