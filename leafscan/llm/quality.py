"""Quality scores by Bradley-Terry ranking of preference pairs (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import held_out, keep, small_batches
from leafscan.llm.shingles import shingle_set, words_of
from leafscan.session import small

# Bounds of the fit; documented parameters of ``fit``.
SAMPLE_ROWS = 16_000  # labelled rows, about
PAIRS = 60_000  # preference pairs, about
LEAST = 1_000  # rows of each label in the sample, about, if there are as many
PASS = 0.7  # score of the threshold
BINS = 4_096  # of a round of the quantile
NEAR = 4_096  # values that are sorted by the driver

# Classes of bytes whose shares are features.
CLASSES = ["A-Z", "a-z", "0-9", ".,", "|", "!?", "other ASCII signs", "space", "newline", "above ASCII"]
_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[:128] = 6
for _k, _chars in enumerate(
    [range(65, 91), range(97, 123), range(48, 58), b".,", b"|", b"!?", b"", b" \t", b"\n\r"]
):
    _CLASS[list(_chars)] = _k
NAMES = [f"share of {c}" for c in CLASSES] + [f"log share of {c}" for c in CLASSES] + [
    "log words", "word length", "same word again", "distinct words", "log distinct words", "repeated shingles", "log words per line",
]


def features(data: np.ndarray, words: np.ndarray) -> list[float]:
    """Numbers that describe the form of a text, in the order of ``NAMES``; an empty text is all typical zeros."""
    counts = np.bincount(_CLASS[data], minlength=len(CLASSES)).astype(float)
    size, n = len(data), len(words)
    shares = counts / max(size, 1)
    logs = np.log((counts + 1.0) / (size + 20.0))
    distinct = len(np.unique(words))
    runs = max(n - 4, 1)
    return [
        *shares,
        *logs,
        math.log1p(n),
        min(size / n, 50.0) if n else 0.0,
        float(np.count_nonzero(words[1:] == words[:-1])) / n if n else 0.0,
        distinct / n if n else 1.0,
        math.log((distinct + 1.0) / (n + 1.0) ** 0.9),
        1.0 - len(shingle_set(words)) / runs if n > 4 else 0.0,
        math.log1p(n / (counts[8] + 1.0)),
    ]


def utility(x: Column, weights: np.ndarray) -> Column:
    products = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


@dataclass
class Model:
    weights: np.ndarray
    threshold: float  # utility at the score quantile
    base: float | None  # share of label 1; None if there was nothing to compare

    def score(self, x: Column) -> Column:
        """Features to 0..1; the threshold maps to ``PASS``."""
        if self.base is None:
            return F.lit(0.5)
        over = utility(x, self.weights) - self.threshold + math.log(PASS / (1 - PASS))
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(over, F.lit(500.0)), F.lit(-500.0))))


def described(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` and the array ``x`` of features of every text."""
    small_batches(rows.sparkSession)
    chosen = rows.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(data, words) for data, words in words_of(batch.column(len(columns)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*columns, "x"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kinds}, x array<double>")


def nth(values: DataFrame, rank: int, size: int, low: float, high: float) -> float:
    """The value ``u`` at a rank from 0. Each round counts the values by bin and goes on within the bin of the rank."""
    while low < high and size > NEAR:
        place = F.floor((F.col("u") - low) / (high - low) * BINS)
        within = values.filter(F.col("u").between(low, high)).groupBy(F.least(place, F.lit(BINS - 1)).alias("bin"))
        for row in sorted(within.agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high")).collect()):
            size, low, high = row["n"], row["low"], row["high"]
            if rank < size:
                break
            rank -= size
    return low if low == high else sorted(r[0] for r in values.filter(F.col("u").between(low, high)).collect())[rank]


def quantile(values: DataFrame, share: float) -> float:
    """Exact quantile of the column ``u``, between two values in proportion; no task or driver holds all values."""
    size, low, high = values.agg(F.count("u"), F.min("u"), F.max("u")).first()
    at = share * (size - 1)
    below, above = (nth(values, k, size, low, high) for k in (math.floor(at), math.ceil(at)))
    return below + (above - below) * (at - math.floor(at))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE_ROWS, pairs: int = PAIRS) -> Model:
    """:func:`learned` from texts."""
    return learned(keep(described(docs, ["doc_id"], text), "quality-features"), labels, sample, pairs)


def learned(known: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, pairs: int = PAIRS) -> Model:
    """Learn from labelled rows ``doc_id, x`` whose id is not held out.

    About ``sample`` labelled documents, chosen by a hash of the id (and at
    least ``LEAST`` of each label, as far as there are), form about ``pairs``
    pairs of a good and a bad one: both sides are dealt into as many buckets as
    give that number. The Bradley-Terry model says that the good one wins with
    the logistic function of the difference of utilities, so its weights are a
    logistic regression without intercept on feature differences. The sample
    serves the weights only: the share of good documents, and the threshold,
    which is the quantile of utilities that lets pass that share, are those of
    all labelled documents that are not held out.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("quality").alias("quality"))
    labelled = keep(known.join(small(keep(usable, "quality-labels")), "doc_id").select("doc_id", "quality", "x"), "quality-labelled")

    def sizes(rows: DataFrame) -> tuple[int, int]:
        found = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
        return found.get(1, 0), found.get(0, 0)

    good, bad = sizes(labelled)
    width = len(NAMES)
    if not good or not bad:
        return Model(np.zeros(width), 0.0, None)
    base = good / (good + bad)
    scale = 1 << 30
    limits = [int(min(1.0, max(sample / (good + bad), LEAST / n)) * scale) for n in (good, bad)]
    limit = F.when(F.col("quality") == 1, limits[0]).otherwise(limits[1])
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < limit)
    good, bad = sizes(chosen)
    buckets = max(1, round(good * bad / pairs))
    sides = chosen.select("quality", "x", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(buckets)).alias("bucket"), F.xxhash64("doc_id").alias("coin"))
    left = sides.filter("quality = 1").select("bucket", F.col("x").alias("good"), F.col("coin").alias("c1"))
    right = sides.filter("quality = 0").select("bucket", F.col("x").alias("bad"), F.col("coin").alias("c0"))
    met = left.join(right, "bucket")
    won = F.pmod(F.xxhash64("c1", "c0"), F.lit(2))  # half of the pairs are told from the other side
    sign = F.when(won == 1, 1.0).otherwise(-1.0)
    differences = met.select(won.cast("double").alias("label"), array_to_vector(F.zip_with("good", "bad", lambda a, b: (a - b) * sign)).alias("features"))
    differences = keep(differences, "quality-pairs")
    model = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=60).fit(differences)
    weights = np.array(model.coefficients.toArray())
    return Model(weights, quantile(labelled.select(utility(F.col("x"), weights).alias("u")), 1 - base), base)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    The score reads the text only. Null counts as empty; an empty text has a
    score like any other. If several labels name a document the better one
    counts; labels that are null or name no document are not used; without
    both labels every score is 0.5. Equal texts score equally, repeated rows
    are scored each, an empty table gives no rows; extra columns are ignored.
    """
    known = keep(described(docs, ["doc_id"], text), "quality-features")  # read by the fit and by the scores
    score = learned(known, labels).score(F.col("x"))
    scored = known.select("doc_id", score.alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
