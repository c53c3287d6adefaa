"""Session settings the library relies on, size-checked broadcasts and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count proves it is at most this many rows;
# beyond it the plain join is used and AQE picks (and splits) the shuffle join.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = "spark.sql.autoBroadcastJoinThreshold"
BROADCAST_CHARS = 2_000_000  # of query text; each character opens at most three terms


def configure(spark: SparkSession, measured: bool = False) -> SparkSession:
    """Set the runtime options the operators need; all are session-level.

    ``measured`` leaves unhinted joins to sizes that were measured by their
    shuffle. Estimates from file sizes know nothing of rows that explode, and
    have the driver collect sides that are many times larger.
    """
    limit = spark.sparkContext.getConf().get(BROADCAST_BYTES, "10MB")
    spark.conf.set(BROADCAST_BYTES, "-1" if measured else limit)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # GB18030 is needed to undo mojibake; Spark 4 only allows it behind this flag.
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    # State of streams on disk, as arbitrary stateful operators need it.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def build_session(name: str = "leafscan", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return configure(builder.getOrCreate())


class Batch(NamedTuple):
    """Measured size of a query batch; decides what may be broadcast."""

    rows: int
    chars: int

    def hint(self, df: DataFrame, rows_per_query: int = 1) -> DataFrame:
        """Broadcast ``df`` if it holds at most ``rows_per_query`` rows per query and that is proven small."""
        return F.broadcast(df) if self.rows * rows_per_query <= BROADCAST_ROWS else df

    def hint_terms(self, df: DataFrame) -> DataFrame:
        """The same for tables with a row per query term."""
        return F.broadcast(df) if self.chars <= BROADCAST_CHARS else df


def measure(queries: DataFrame, text: str = "query") -> Batch:
    """Size of a query batch, by one aggregate over the query side alone."""
    row = queries.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return Batch(int(row[0]), int(row[1]))


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for an input ``df`` if it is proven to hold at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows. A larger side is returned
    unhinted, so the join falls back to a shuffle join with AQE skew handling.
    Meant for inputs, not for results: the check runs the plan of ``df``.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="leafscan-"))
    return shared


_LOCAL: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
