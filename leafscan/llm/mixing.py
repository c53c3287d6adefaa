"""Mixing sources to target weights by temperature (operator 9)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import keep, packed
from leafscan.session import small

STEPS = 30  # of the bisection
SLICES = 4096  # equal slices of a permutation; only the slice where the budget ends is ordered row by row


# Blocks of the scripts that are written without blanks: Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = r"[\u0E01-\u0EDF\u1000-\u109F\u1780-\u17DD\u3041-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}]"


def word_tokens(text: Column) -> Column:
    """Words separated by white space, and each letter of a script without blanks; 0 for null.

    A word that holds such letters counts by its letters, and once more for each part between them.
    """
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    unspaced = (F.octet_length(text) != F.length(text)) & text.rlike(UNSPACED)
    n = F.when(unspaced, F.regexp_count(text, F.lit(UNSPACED)) + words(F.regexp_replace(text, UNSPACED, " "))).otherwise(words(text))
    return F.coalesce(n.cast("long"), F.lit(0).cast("long"))


@dataclass(frozen=True)
class Moments:
    """Of shares p to the power alpha: their sum, the sum with log p, and the range of p to the power alpha - 1."""

    total: float
    logs: float
    least: float
    most: float

    def entropy(self, alpha: float) -> float:
        return math.log(self.total) - alpha * self.logs / self.total

    def repeats(self, budget_share: float | None) -> float:
        """How often the most repeated source is read. Without a budget, the least repeated one is read once."""
        return self.most / self.least if budget_share is None else self.most / self.total * budget_share


def moments(shares: DataFrame, alpha: float) -> Moments:
    """One aggregate over the table of sources; four numbers reach the driver."""
    p = F.col("share")
    row = shares.agg(F.sum(F.pow(p, F.lit(alpha))), F.sum(F.pow(p, F.lit(alpha)) * F.log(p)), F.min(F.pow(p, F.lit(alpha - 1))), F.max(F.pow(p, F.lit(alpha - 1)))).first()
    return Moments(*map(float, row))


def exponent(shares: DataFrame, max_repeats: float | None, target_entropy: float | None, budget_share: float | None) -> float:
    """Exponent in [0, 1] by bisection.

    With a repetition limit the smallest one that keeps it, so the flattest
    mix; with a target entropy (nats) the largest one that reaches it. If no
    exponent does, 1 (the sources as they are) or 0 (equal weights) is used.
    """

    def flat_enough(alpha: float) -> bool:  # true up to some exponent, false after it
        now = moments(shares, alpha)
        return now.repeats(budget_share) > max_repeats if max_repeats is not None else now.entropy(alpha) >= target_entropy

    low, high = 0.0, 1.0
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(middle) else (low, middle)
    return high if max_repeats is not None else low


def plan(sizes: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> tuple[DataFrame, float]:
    """Per source ``src``: ``weight``, ``quota`` of tokens, ``blocks`` read whole and ``rest`` tokens of one more; and the exponent."""
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    filled = sizes.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    if not total:
        return filled.select("src", "tokens", F.lit(0.0).alias("weight"), *[F.lit(0).cast("long").alias(c) for c in ("quota", "blocks", "rest")]), 1.0
    budget_share = None if budget is None else budget / total
    alpha = exponent(filled, max_repeats, target_entropy, budget_share)
    now = moments(filled, alpha)
    all_tokens = budget if budget is not None else total * now.total / now.least
    weight = F.pow(F.col("share"), F.lit(alpha)) / now.total
    # A quota within rounding of whole blocks is whole blocks.
    quota = F.floor(weight * float(all_tokens) * (1 + 1e-12) + 1e-6)
    out = filled.select("src", "tokens", weight.alias("weight"), quota.cast("long").alias("quota"))
    return out.select("*", F.expr("quota div tokens").alias("blocks"), (F.col("quota") % F.col("tokens")).alias("rest")), alpha


def mixed(docs: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None, budget: int | None = None,
          seed: int = 1, text: str = "text", source: str = "source", order: str = "doc_id") -> DataFrame:
    """Rows drawn: struct ``row`` of the input, ``block``, ``sort_key`` and ``tokens``.

    Token shares of the sources are raised to the exponent that meets the
    repetition limit or the target entropy, and normalised. Each source then
    fills its part of the token budget with blocks; a block is a permutation of
    the source's rows, ordered by ``sort_key``, a keyed hash. Whole blocks hold
    every row; the last one holds the rows that come first until the budget
    ends. Without a budget it is the least that draws every row once. Null
    sources are a source of their own; rows without tokens are in every whole
    block; equal rows are drawn together.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")
    src = F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    identity = F.xxhash64(F.lit(seed), F.col(order), F.col(text))
    rows = packed(docs, src=src, tokens=word_tokens(F.col(text)), identity=identity)
    facts = keep(rows.select("src", "tokens", "identity"), "mix-rows")
    sizes = keep(facts.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    quotas, _ = plan(sizes, max_repeats, target_entropy, budget)
    quotas = small(keep(quotas, "mix-quotas"))

    last = F.xxhash64("identity", "blocks")  # order of the last block
    place = F.pmod(F.shiftrightunsigned(last, 40), F.lit(SLICES))
    units = facts.groupBy("src", "identity").agg(F.sum("tokens").alias("tokens")).join(quotas.select("src", "blocks", "rest"), "src")
    units = units.filter("rest > 0").select("src", "identity", "tokens", "rest", last.alias("last"), place.alias("slice"))
    slices = units.groupBy("src", "slice").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows
    before = slices.select("src", "slice", "tokens", "rest", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("before"))
    ends = before.filter("before <= rest and before + tokens > rest").groupBy("src").agg(F.min(F.struct("slice", "before")).alias("end"))
    ends = keep(ends.select("src", F.col("end.slice").alias("end_slice"), F.col("end.before").alias("before")), "mix-ends")
    border = units.join(small(ends), "src").filter("slice = end_slice")
    inside = Window.partitionBy("src").orderBy("last", "identity").rowsBetween(Window.unboundedPreceding, 0)  # one slice of a source
    picks = border.withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).filter("upto <= rest")
    picks = keep(picks.select("src", "identity", F.lit(True).alias("picked")), "mix-picks")

    drawn = rows.join(quotas.select("src", "blocks", "rest"), "src", "left").join(small(ends.select("src", "end_slice")), "src", "left")
    drawn = drawn.join(small(picks), ["src", "identity"], "left")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))  # a source without any token is kept as it is
    # Without a border slice the rest holds the whole permutation, or nothing of it.
    more = (F.col("rest") > 0) & ((place < F.col("end_slice")) | F.coalesce("picked", F.lit(False)) | F.col("end_slice").isNull())
    times = blocks + F.when(more, 1).otherwise(0)
    listed = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))
    return drawn.select("row", "tokens", "identity", F.explode(listed).alias("block")).select(
        "row", "block", F.xxhash64("identity", "block").alias("sort_key"), "tokens"
    )


def mix(docs: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None, budget: int | None = None,
        seed: int = 1) -> DataFrame:
    """One row per drawn copy: ``doc_id, source, block, sort_key, n_tokens``.

    See :func:`mixed`. An empty table gives no rows; extra columns are ignored.
    """
    drawn = mixed(docs.select("doc_id", "source", "text"), max_repeats, target_entropy, budget, seed)
    return drawn.select("row.doc_id", "row.source", "block", "sort_key", F.col("tokens").alias("n_tokens"))


def remixed(docs: DataFrame, max_repeats: float, seed: int = 1) -> DataFrame:
    """``docs`` mixed, every document at least once, columns as given.

    Null texts have no tokens and are read as often as their source's whole
    blocks; null sources are a source of their own; equal rows are drawn
    together. An empty table gives no rows; other columns, whatever their
    names, come along.
    """
    drawn = mixed(docs, max_repeats=max_repeats, seed=seed)
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
