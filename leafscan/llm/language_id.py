"""Language identification by word-first backoff (operator 3)."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import held_by_worker, held_out, keep, packed, small_batches, unpacked
from leafscan.session import small

UNKNOWN = "und"
# Bounds of the fitted model; documented parameters of ``fit``.
SAMPLE_PER_LANG = 4_000  # labelled rows per language, about
MAX_WORDS = 15_000  # per language
MAX_GRAMS = 15_000  # per language
MAX_GRAM = 5
WORD = r"\p{L}+"
MEMO_ENTRIES = 100_000
PIECE = 1 << 20  # characters of a text whose words are held at once


@dataclass
class Model:
    """Log frequencies per language of known words and of character n-grams."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray  # (words, langs)
    grams: list[dict[str, int]]  # by length less one
    gram_logs: np.ndarray  # (n-grams, langs)

    def unseen(self, word: str) -> np.ndarray | None:
        """Scores of a word that is not known: the longest n-grams of which any is known, their mean."""
        framed = f" {word} "
        for n in range(MAX_GRAM, 0, -1):
            known = self.grams[n - 1]
            hits = [known[g] for i in range(len(framed) - n + 1) if (g := framed[i : i + n]) in known]
            if hits:
                return self.gram_logs[hits].mean(axis=0)
        return None


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", per_lang: int = SAMPLE_PER_LANG,
        max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from rows with a language whose id is not held out.

    The fit reads whole texts of a bounded sample: per language about
    ``per_lang`` rows, chosen by a hash of id and text; of the words and
    n-grams counted there the ``max_words`` and ``max_grams`` most frequent of
    each language stay, so no language loses its words to a larger one. Only
    those and the list of languages reach the driver.
    """
    named = docs.select(
        F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(order).alias("id")
    ).filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = keep(named.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    scale = 1 << 30
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("rows")) * scale
    sample = named.join(small(sizes).withColumn("limit", share.cast("long")), "lang").filter(
        F.pmod(F.xxhash64(F.col("id"), F.crc32(F.col("text").cast("binary"))), F.lit(scale)) < F.col("limit")
    )
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    counts = words.groupBy("word", "lang").agg(F.count("*").alias("n")).persist()
    try:
        langs = [r[0] for r in sizes.select("lang").orderBy("lang").collect()]
        word_rows = top_terms(counts, "word", max_words)
        framed = counts.select("lang", "n", F.concat(F.lit(" "), F.col("word"), F.lit(" ")).alias("framed"))
        lengths = F.sequence(F.lit(1), F.lit(MAX_GRAM))
        grams = framed.select("lang", "n", "framed", F.explode(lengths).alias("k")).filter(F.length("framed") >= F.col("k"))
        starts = F.sequence(F.lit(1), F.length("framed") - F.col("k") + 1)
        grams = grams.select("lang", "n", F.explode(F.transform(starts, lambda i: F.col("framed").substr(i, F.col("k")))).alias("gram"))
        gram_rows = top_terms(grams.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "gram", max_grams)
    finally:
        counts.unpersist()
    at = {name: i for i, name in enumerate(langs)}
    words_index, word_logs = logs(word_rows, at, [None] * len(word_rows))
    gram_index, gram_logs = logs(gram_rows, at, [len(r[0]) for r in gram_rows])
    by_length: list[dict[str, int]] = [{} for _ in range(MAX_GRAM)]
    for gram, i in gram_index.items():
        by_length[len(gram) - 1][gram] = i
    return Model(langs, words_index, word_logs, by_length, gram_logs)


def top_terms(counts: DataFrame, term: str, most: int) -> list:
    """``(term, {lang: n})`` of the terms that are among the ``most`` frequent of any language, ties by term; in order of term."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), term))
    kept = counts.withColumn("_rank", rank).filter(F.col("_rank") <= most).select(term).distinct()
    by_lang = counts.join(kept, term, "left_semi").groupBy(term).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    return by_lang.orderBy(term).collect()


def logs(rows: list, at: dict[str, int], classes: list) -> tuple[dict[str, int], np.ndarray]:
    """Log frequency per language with add-half smoothing, normalised per class (a class is an n-gram length)."""
    table = np.full((len(rows), len(at)), 0.5)
    for i, (_, by_lang) in enumerate(rows):
        for name, n in by_lang.items():
            table[i, at[name]] += n
    kinds = np.array([c or 0 for c in classes])
    for kind in set(kinds.tolist()):
        own = kinds == kind
        table[own] = np.log(table[own] / table[own].sum(axis=0))
    return {r[0]: i for i, r in enumerate(rows)}, table


def pieces(text: str) -> Iterator[str]:
    """A text in parts that end between words, so a very long text never becomes one list of words."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and text[cut].isalpha():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class Scorer:
    """Scores texts with a model; remembers unseen words up to a bound."""

    def __init__(self, model: Model) -> None:
        import regex

        self.model, self.find, self.memo = model, regex.compile(WORD).findall, {}

    def totals(self, text: str) -> np.ndarray | None:
        """Summed log scores per language; None without any letter."""
        counts: Counter[str] = Counter()
        for piece in pieces(text.lower()):
            counts.update(self.find(piece))
        if not counts:
            return None
        model, memo = self.model, self.memo
        total = np.zeros(len(model.langs))
        known: list[int] = []
        times: list[int] = []
        for word, n in counts.items():
            i = model.words.get(word)
            if i is not None:
                known.append(i)
                times.append(n)
                continue
            if word not in memo:
                if len(memo) > MEMO_ENTRIES:
                    memo.clear()
                memo[word] = model.unseen(word)
            if memo[word] is not None:
                total += n * memo[word]
        if known:
            total += np.asarray(times, dtype=float) @ model.word_logs[known]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.totals(text) if text else None
        if total is None or not len(total):
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.model.langs[best], 1.0 / sum(math.exp(max(x - total[best], -700.0)) for x in total)


def scorer(shared: Broadcast, key: str) -> Scorer:
    """The worker's scorer of a model, built once."""
    return held_by_worker(("language", key), lambda: Scorer(shared.value))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with ``lang_pred`` and ``score`` (posterior of the best language, 0 to 1)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    rows, at = packed(docs), docs.columns.index(text)
    kind = rows.schema["row"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared, key)
        for batch in batches:
            found = [own.predict(t) for t in batch.column(0).field(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    return rows.mapInArrow(score, f"row {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Known words score by their log frequency per language. An unseen word
    scores by its longest character n-grams of which any is known. Prediction
    reads the text only. Texts that are null or without a letter give ``und``
    with score 0, as does everything if no row has a language to learn from;
    equal scores go to the first language in order of name. Repeated rows are
    scored each; an empty table gives no rows; extra columns are ignored.
    """
    model = fit(docs, text, lang, order)
    scored = predict(docs.select(F.col(order).alias("doc_id"), F.col(text).alias("text")), model)
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised with a score of ``least`` or more; columns as given.

    Null texts and texts without a letter go, as does everything if no row has
    a language to learn from. Every row is judged by its own text, so repeated
    rows stay or go together. An empty table gives no rows; other columns,
    whatever their names, come along.
    """
    scored = predict(docs, fit(docs))
    return unpacked(scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs.columns)
