"""Exact duplicates by skew-safe combining (operator 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import ascii_lower, keep

HOT_SHARE = 2000  # a text is hot if more than 1/HOT_SHARE of all rows hold it; so at most HOT_SHARE texts are
SALTS = 64


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def text_classes(docs: DataFrame, text: str = "text", order: str = "doc_id", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Classes of equal texts: ``digest``, ``keep_id``, ``group_size``.

    Three combining steps, each grouping by the full text beside its digest:
    rows of one map task (Spark's partial aggregate), then salted groups, then
    the salt winners of hot texts. Only hot texts are salted, so the full text
    of any other is shuffled once. ``digest`` may be weak; texts that share one
    stay apart.
    """
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    # A coarser key than the text is enough to find hot texts, and is cheap.
    coarse = F.xxhash64(F.lower(F.coalesce(F.col(text), F.lit(""))))
    counts = docs.select(coarse.alias("coarse")).groupBy("coarse").count()
    hot = counts.filter(F.col("count") * HOT_SHARE > docs.count()).select("coarse", F.lit(True).alias("hot"))
    rows = docs.select(F.col(order).cast("long").alias("id"), body.alias("body"), coarse.alias("coarse"))
    rows = rows.join(F.broadcast(hot), "coarse", "left").select(
        "id",
        "body",
        digest(F.col("body")).alias("digest"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(-1).alias("salt"),
    )
    salted = rows.groupBy("digest", "body", "salt").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # A text without salt is complete here: it keeps a number of its own instead of its body.
    winners = salted.select(
        "digest",
        F.when(F.col("salt") >= 0, F.col("body")).alias("hot_body"),
        F.when(F.col("salt") < 0, F.monotonically_increasing_id()).alias("own"),
        "keep_id",
        "group_size",
    )
    merged = winners.groupBy("digest", "hot_body", "own").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return merged.select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as the
    empty text. Of equal texts the row with the largest id stays. A null id is
    smaller than any other; of repeated rows with the same id all are marked
    ``kept`` (they are the same document), and all of them count in
    ``group_size``. An empty table gives no rows. Extra columns are ignored.
    """
    classes = keep(text_classes(docs, text, order, digest), "text-classes")
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(order).cast("long").alias("doc_id"), body.alias("body"))
    rows = rows.select("doc_id", "body", digest(F.col("body")).alias("digest"))
    shared = classes.groupBy("digest").count().filter("count > 1").select(F.col("digest").alias("shared_digest"))
    if shared.isEmpty():
        named = rows.drop("body").withColumn("text_sha256", F.col("digest")) if digest is sha256 else rows.select("doc_id", "digest", sha256(F.col("body")).alias("text_sha256"))
        joined = named.join(classes, "digest")
    else:
        # Several texts under one digest: those classes are joined by the full text.
        alone = classes.join(shared, F.col("digest") == F.col("shared_digest"), "left_anti")
        mixed = rows.join(shared, F.col("digest") == F.col("shared_digest"), "left_semi")
        sizes = mixed.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        several = mixed.join(sizes, "body")
        joined = rows.join(alone, "digest").select("doc_id", "keep_id", "group_size", sha256(F.col("body")).alias("text_sha256")).unionByName(
            several.select("doc_id", "keep_id", "group_size", sha256(F.col("body")).alias("text_sha256"))
        )
    return joined.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
