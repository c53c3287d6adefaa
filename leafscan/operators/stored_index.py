"""BM25 index in stored tables: built once, asked by any number of batches (E10 for F2, F3, F4, F7, F12).

``postings`` are partitioned by domain and term bucket, and bucketed by page
with terms in order inside each file. A batch reads only the partitions of its
own domains and term buckets, and the scores of a page are summed where its
bucket is read: neither page texts nor postings are exchanged. ``terms`` hold
document frequencies and the highest share of a term in any page's score in the
same partitions, ``corpus`` a row per domain, and ``pages`` the page rows for
quotes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.operators import index as I
from leafscan.session import shared_folder

BUCKET_CHARS = 16 << 20  # page text per bucket: its postings are counted and sorted in a task's memory
PART_CHARS = 4 << 20  # page text per bucket and term bucket
MIN_TERM_BUCKETS, MAX_TERM_BUCKETS = 4, 64
FORMAT = 2  # of the tables and of the tokens in them: an index of another format is built anew
TABLES = ("postings", "terms", "corpus", "pages")
KEYS = ["domain", "doc_id", "page_id", "page_no"]


@dataclass(frozen=True)
class StoredIndex:
    """Tables of one build and the number of term buckets they were written with."""

    name: str
    folder: str
    buckets: int
    term_buckets: int
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    pages: DataFrame

    def term_bucket(self, term: Column | str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.term_buckets)).cast("int")

    def asked(self, terms: DataFrame) -> tuple[DataFrame, list[Column]]:
        """Query terms with their bucket, and the filters that leave only partitions with any of them.

        The partitions are collected: at most term buckets times the domains of the batch.
        """
        placed = terms.withColumn("term_bucket", self.term_bucket())
        used = placed.select("domain", "term_bucket").distinct().collect()
        domains, buckets = sorted({r[0] for r in used if r[0] is not None}), sorted({r[1] for r in used})
        return placed, [F.col("domain").isin(domains), F.col("term_bucket").isin(buckets)]


def build_index(pages: DataFrame, folder: str, text: str = "index_text") -> StoredIndex:
    """Write the index of ``pages(domain, doc_id, page_id, page_no, ...)`` below ``folder``.

    Pages are dealt by page once; tokens, counts and files follow from that.
    The number of buckets grows with the text, so a bucket stays small.
    """
    spark = pages.sparkSession
    chars = pages.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long")).first()[0]
    buckets = max(spark.sparkContext.defaultParallelism, ceil(chars / BUCKET_CHARS))
    term_buckets = min(MAX_TERM_BUCKETS, max(MIN_TERM_BUCKETS, ceil(chars / buckets / PART_CHARS)))
    name = f"leafscan_{uuid.uuid4().hex[:12]}"
    folder = folder.rstrip("/")

    def write(df: DataFrame, table: str, parts: list[str], order: list[str]) -> None:
        out = df.write.format("parquet").mode("errorifexists").option("path", f"{folder}/{table}")
        out = out.partitionBy(*parts) if parts else out
        out = out.bucketBy(buckets, "page_id").sortBy(*order) if order else out
        out.saveAsTable(f"{name}_{table}")

    dealt = pages.repartition(buckets, "page_id")
    write(dealt, "pages", ["domain"], ["page_id"])
    stored = spark.table(f"{name}_pages")
    size, token = F.size("tokens").alias("dl"), F.explode("tokens").alias("term")
    tokens = I.page_tokens(stored, text, buckets=buckets)
    counted = tokens.select(*KEYS, size, token).groupBy(*KEYS, "dl", "term").agg(F.count("*").alias("tf"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(term_buckets)).cast("int").alias("term_bucket")
    write(counted.select("doc_id", "page_id", "page_no", "dl", "term", "tf", "domain", bucket), "postings", ["domain", "term_bucket"], ["term", "page_id"])
    # Lengths follow from the postings, so no text is cut into tokens again; pages without any count as well.
    postings = spark.table(f"{name}_postings")
    held = postings.groupBy("domain").agg(F.sum("tf").alias("_tokens"))
    sizes = stored.groupBy("domain").agg(F.count("*").alias("n")).join(F.broadcast(held), stored["domain"].eqNullSafe(held["domain"]), "left")
    corpus = sizes.select(stored["domain"], "n", (F.coalesce("_tokens", F.lit(0)) / F.col("n")).alias("avgdl"))
    write(corpus, "corpus", [], [])
    means = spark.table(f"{name}_corpus").select(F.col("domain").alias("_domain"), "avgdl")
    rated = postings.join(F.broadcast(means), F.col("domain").eqNullSafe(F.col("_domain")))
    df = rated.groupBy("domain", "term_bucket", "term").agg(F.count("*").alias("df"), F.max(I.saturation()).alias("top"))
    # Terms by range: a range of a partition's terms to a task, in order.
    write(df.select("term", "df", "top", "domain", "term_bucket").repartitionByRange("domain", "term_bucket", "term"), "terms", ["domain", "term_bucket"], [])
    schemas = {t: ", ".join(f"`{n}` {kind}" for n, kind in spark.table(f"{name}_{t}").dtypes) for t in TABLES}
    sizes = F.lit(name).alias("name"), F.lit(buckets).alias("buckets"), F.lit(term_buckets).alias("term_buckets")
    facts = spark.range(1).select(*sizes, *[F.lit(ddl).alias(t) for t, ddl in schemas.items()])
    facts.write.parquet(f"{folder}/build")  # last: a folder with it is complete
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> StoredIndex:
    """The index stored below ``folder``, in any session of the cluster."""
    folder = folder.rstrip("/")
    facts = spark.read.parquet(f"{folder}/build").first()
    name, buckets, term_buckets = facts["name"], facts["buckets"], facts["term_buckets"]
    layout = {"pages": ("domain", "page_id"), "postings": ("domain, term_bucket", "term, page_id")}
    tables = {}
    for table in TABLES:
        if table in layout:
            if not spark.catalog.tableExists(f"{name}_{table}"):
                parts, order = layout[table]
                spark.sql(
                    f"CREATE TABLE {name}_{table} ({facts[table]}) USING parquet PARTITIONED BY ({parts}) "
                    f"CLUSTERED BY (page_id) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{folder}/{table}'"
                )
                spark.catalog.recoverPartitions(f"{name}_{table}")
            tables[table] = spark.table(f"{name}_{table}")
        else:
            tables[table] = spark.read.schema(facts[table]).parquet(f"{folder}/{table}")
    return StoredIndex(name, folder, buckets, term_buckets, **tables)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Digest of names, sizes and times of input files; reads no column."""
    facts = spark.read.parquet(*paths).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = facts.agg(F.count("*"), F.expr("bit_xor(xxhash64(file_path, file_size, file_modification_time))")).first()
    return f"{row[0]}-{(row[1] or 0) & (2**64 - 1):016x}"


def index_for(spark: SparkSession, key: str, pages) -> StoredIndex:
    """The live index registered under ``key`` in the shared folder; built from ``pages()`` if there is none.

    A build registers itself by one appended row once all its tables are
    written, so a failed one leaves nothing behind that is read.
    """
    base = f"{shared_folder(spark).rstrip('/')}/search-index-{FORMAT}"
    try:
        live = spark.read.schema("key string, folder string").parquet(f"{base}/registry").filter(F.col("key") == key).agg(F.max("folder")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        live = None
    if live is not None:
        return open_index(spark, live)
    folder = f"{base}/{uuid.uuid4().hex[:12]}"
    built = build_index(pages(), folder)
    spark.createDataFrame([(key, folder)], "key string, folder string").coalesce(1).write.mode("append").parquet(f"{base}/registry")
    return built
