"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.session import new_folder

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. A text without other letters than ASCII takes the quick built-in path."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh path in the shared folder and read it back: computed once, lineage cut."""
    path = f"{new_folder(df.sparkSession, name)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **cols: Column) -> DataFrame:
    """The whole input row as the struct ``row`` beside computed columns: no name of the input can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in cols.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The input columns of a :func:`packed` frame, nothing else."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows per Arrow batch of Python stages, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_HELD: dict[object, object] = {}


def held_by_worker(key: object, make: Callable[[], object]):
    """What a Python worker keeps from task to task; it keeps one thing at a time, so memory does not add up over operators."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            _give_back()
        _HELD[key] = make()
    return _HELD[key]


def _give_back() -> None:
    """Return freed memory to the system, so what one operator held does not add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library only
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside the function of ``transform`` or ``filter`` may be put
    there as an expression by the optimizer, and would then run per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_offsets(lengths: Column, block: int = 128) -> Column:
    """Sum of all earlier elements, per element of an array of longs.

    Sums run within blocks and over block totals, so the work stays near
    ``n * block`` for an array of n elements instead of n squared.
    """
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    def by_block(own: Column) -> Column:
        parts = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.floor((F.size(own) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(parts, lambda b: F.slice(own, b * block + 1, block)), lambda cut: let(F.transform(cut, total), lambda sums: inner(cut, sums)))

    def inner(cut: Column, sums: Column) -> Column:
        def of(part: Column, b: Column) -> Column:
            return let(total(F.slice(sums, F.lit(1), b)), lambda base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i))))

        return F.flatten(F.transform(cut, of))

    return let(lengths, by_block)


def spans_of(text: Column, pattern: str) -> Column:
    """Matches of a Java pattern as array<struct<start, end, value>>: leftmost, non-overlapping, code points, end exclusive.

    The gaps between matches come from ``split``; the pattern must not match the empty string.
    """

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)).cast("long") + F.length(m))
        return let(
            running_offsets(steps),
            lambda before: F.transform(
                found,
                lambda m, i: let(
                    F.get(before, i) + F.length(F.get(gaps, i)),
                    lambda start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value")),
                ),
            ),
        )

    spans = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))
