"""Registry of runnable queries and the inputs they derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import segment as S
from leafscan.operators.stored_index import StoredIndex, fingerprint, index_for
from leafscan.session import configure, cut_lineage

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir)`` under ``name`` with its equivalent SQL, if SQL can say it."""

    def add(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(configure(spark, measured=True), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Widen integers and floats and print arrays, so both engines compare alike."""
    cols = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        c = F.col(f"`{field.name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind == "float":
            c = c.cast("double")
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of an input with fewer splits than cores; large inputs stay as they are scanned.

    Text rules are heavy per row, and a small file is one split however many cores wait.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def r3(col):
    """Three decimals with the half-way point moved off the values sums land on; R3 is its SQL twin."""
    return F.floor(F.col(col) * 1000 + 0.50001) / F.lit(1000.0) if isinstance(col, str) else F.floor(col * 1000 + 0.50001) / F.lit(1000.0)


R3 = "floor({0} * 1000 + 0.50001) / 1000.0"


# --- derived inputs ---------------------------------------------------------
# SQL twins of these inputs are the *_SQL strings below them.


def line_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every non-blank line of a document is a page; the language is the domain."""
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"),
        F.col("lang").alias("domain"),
        F.col("source").alias("title"),
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    ).filter(F.trim("text") != "")
    return rows.select(
        "doc_id",
        "domain",
        F.format_string("%s_lp_%04d", "doc_id", F.col("pos") + 1).alias("page_id"),
        (F.col("pos") + 1).alias("page_no"),
        "title",
        F.array("title").alias("heading_path"),
        "text",
        F.col("text").alias("index_text"),
    )


PAGES_SQL = """
doc_lines AS (
  SELECT 'd' || doc_id AS doc_id, lang AS domain, source AS title,
         unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS page_no
  FROM documents),
pg AS (
  SELECT doc_id, domain, title, text, page_no,
         doc_id || '_lp_' || printf('%04d', page_no) AS page_id
  FROM doc_lines WHERE trim(text) <> '')"""


def line_index(spark: SparkSession, d: str) -> StoredIndex:
    """Stored search index of the line pages, reused as long as the documents' files are the same."""
    return index_for(spark, f"lines-{fingerprint(spark, f'{d}/documents.parquet')}", lambda: line_pages(spark, d))


def bench_queries(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    return items.select(
        F.concat(F.lit("q"), "item_id").alias("qid"),
        F.when(F.col("item_id") % 4 == 3, "fr").otherwise("en").alias("domain"),
        F.col("text").alias("query"),
    )


QUERIES_SQL = """
qs AS (
  SELECT 'q' || item_id AS qid, CASE WHEN item_id % 4 = 3 THEN 'fr' ELSE 'en' END AS domain, text AS query
  FROM benchmark)"""

def falls_on(spark: SparkSession, d: str, number):
    """The benchmark query on which a document's number falls: all documents are dealt to the queries in turn."""
    items = table(spark, d, "benchmark").agg(F.max("item_id") + 1).first()[0] or 1
    return F.concat(F.lit("q"), number % items)


# Terms of queries and pages, and BM25 scores of every matching pair.
BM25_SQL = (
    PAGES_SQL
    + ","
    + QUERIES_SQL
    + """,
qt AS (
  SELECT qid, domain, term, least(count(*), 3) AS qtf, min(pos) AS pos FROM (
    SELECT qid, domain, unnest(regexp_extract_all(lower(query), '[A-Za-z0-9_.%-]+')) AS term,
           generate_subscripts(regexp_extract_all(lower(query), '[A-Za-z0-9_.%-]+'), 1) AS pos FROM qs)
  GROUP BY qid, domain, term),
ptok AS (SELECT domain, doc_id, page_id, page_no, regexp_extract_all(lower(text), '[A-Za-z0-9_.%-]+') AS toks FROM pg),
corpus AS (SELECT domain, count(*) AS n, avg(len(toks)) AS avgdl FROM ptok GROUP BY domain),
post AS (
  SELECT domain, doc_id, page_id, page_no, dl, term, count(*) AS tf FROM (
    SELECT domain, doc_id, page_id, page_no, len(toks) AS dl, unnest(toks) AS term FROM ptok)
  GROUP BY ALL),
dfs AS (SELECT domain, term, count(*) AS df FROM post GROUP BY domain, term),
bm AS (
  SELECT qt.qid, post.domain, post.doc_id, post.page_id, post.page_no,
         sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * qtf) AS score
  FROM qt JOIN post ON qt.domain = post.domain AND qt.term = post.term
  JOIN dfs ON dfs.domain = post.domain AND dfs.term = post.term
  JOIN corpus ON corpus.domain = post.domain
  GROUP BY ALL HAVING score > 0)"""
)


def own_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every document is asked by the benchmark text on which its number falls, in its own language: ``qid, domain, query, doc_id``."""
    docs = line_pages(spark, d).select("doc_id", "domain").distinct()
    item = falls_on(spark, d, F.substring("doc_id", 2, 20).cast("bigint"))
    texts = table(spark, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("item"), F.col("text").alias("query"))
    return docs.withColumn("item", item).join(texts, "item").select(F.concat_ws("_", "item", "domain").alias("qid"), "domain", "query", "doc_id")


OWN_REQUESTS_SQL = """
SELECT 'q' || item_id || '_' || domain AS qid, domain, doc_id FROM (SELECT DISTINCT doc_id, domain FROM pg) p
JOIN benchmark b ON CAST(substr(p.doc_id, 2) AS BIGINT) % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id"""
# The same scores for every text in every language.
OWN_BM25_SQL = BM25_SQL.replace(
    QUERIES_SQL, """
qs AS (SELECT 'q' || item_id || '_' || domain AS qid, domain, text AS query FROM benchmark, (SELECT DISTINCT domain FROM pg) l)"""
)


def markdown_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as markdown: every non-blank line gets a heading from its first words; an empty heading precedes each fifth."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "num")
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    level = lambda i: 1 + F.pmod(i * 7 + F.col("num"), F.lit(4)).cast("int")
    heading = lambda x, i, chars: F.concat(F.rpad(F.lit("#"), level(i), "#"), F.lit(" "), F.trim(F.substring(F.trim(x), 1, chars)), F.lit("\n"))
    parts = F.transform(
        kept, lambda x, i: F.concat(F.when(i % 5 == 4, heading(x, i + 3, 12)).otherwise(""), heading(x, i, 24), x)
    )
    return docs.select(
        F.concat(F.lit("d"), "num").alias("doc_id"),
        F.col("lang").alias("domain"),
        F.concat(F.lit("corpus/raw_md/"), "lang", F.lit("/d"), "num", F.lit(".md")).alias("source_path"),
        F.array_join(parts, "\n").alias("raw"),
    )


def markdown_outline(spark: SparkSession, d: str) -> DataFrame:
    docs = markdown_docs(spark, d).withColumn("text", X.normalize_text("raw")).drop("raw")
    return S.outline(docs, "heading")


# Heading tree of the markdown documents; ``path`` is joined with ' > '.
TREE_SQL = """
md_lines AS (
  SELECT doc_id AS num, lang, trim(x) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE trim(x) <> ''),
heads AS (
  SELECT 'd' || num AS doc_id, lang AS domain, i + 1 + (i + 1) // 5 AS toc_no, CAST(1 + (i * 7 + num) % 4 AS BIGINT) AS level,
         trim(substr(x, 1, 24)) AS title, x AS text FROM md_lines
  UNION ALL
  SELECT 'd' || num, lang, i + 1 + i // 5, CAST(1 + ((i + 3) * 7 + num) % 4 AS BIGINT), trim(substr(x, 1, 12)), '' FROM md_lines WHERE i % 5 = 4),
marks AS (
  SELECT *, max(CASE WHEN level = 1 THEN toc_no END) OVER w AS p1, max(CASE WHEN level = 2 THEN toc_no END) OVER w AS p2,
         max(CASE WHEN level = 3 THEN toc_no END) OVER w AS p3 FROM heads
  WINDOW w AS (PARTITION BY doc_id ORDER BY toc_no)),
paths AS (
  SELECT m.doc_id, m.domain, m.toc_no, m.level, m.title, m.text,
         list_filter([CASE WHEN m.level > 1 THEN h1.title END,
           CASE WHEN m.level > 2 AND m.p2 > coalesce(m.p1, 0) THEN h2.title END,
           CASE WHEN m.level > 3 AND m.p3 > greatest(coalesce(m.p1, 0), coalesce(m.p2, 0)) THEN h3.title END,
           m.title], lambda t: t IS NOT NULL) AS path
  FROM marks m
  LEFT JOIN heads h1 ON h1.doc_id = m.doc_id AND h1.toc_no = m.p1
  LEFT JOIN heads h2 ON h2.doc_id = m.doc_id AND h2.toc_no = m.p2
  LEFT JOIN heads h3 ON h3.doc_id = m.doc_id AND h3.toc_no = m.p3),
pgs AS (
  SELECT *, doc_id || '_lp_' || printf('%04d', page_no) AS page_id FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY toc_no) AS page_no FROM paths WHERE text <> '')),
secs AS (
  SELECT doc_id || '_sec_' || printf('%04d', toc_no) AS section_id, * FROM (
    SELECT doc_id, path, min(toc_no) AS toc_no, arg_min(level, toc_no) AS level, arg_min(title, toc_no) AS title
    FROM paths GROUP BY doc_id, path))"""


_BUILT: dict[tuple[str, str], dict[str, DataFrame]] = {}


def markdown_index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Index of the markdown documents, built once per application and kept in the checkpoint folder.

    ``toc``, ``pages``, ``documents``, ``sections`` (one row per heading path)
    and ``bridge`` (pages at or below a section).
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = build_markdown_index(spark, d)
    return _BUILT[key]


def markdown_search(spark: SparkSession, d: str) -> StoredIndex:
    """Stored search index of the markdown pages."""
    pages = lambda: markdown_index(spark, d)["pages"].withColumn("index_text", F.col("text"))
    return index_for(spark, f"markdown-{fingerprint(spark, f'{d}/documents.parquet')}", pages)


def build_markdown_index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    from leafscan.operators import index as I

    docs = cut_lineage(markdown_docs(spark, d).withColumn("text", X.normalize_text("raw")).drop("raw"))  # cleaned once, read twice
    rows = cut_lineage(S.outline(docs, "heading"))
    toc = cut_lineage(S.toc_of(rows))
    named = I.doc_identity(docs, toc)
    blocks = S.blocks_of(rows).drop("domain", "source_path").join(
        named.select("doc_id", "domain", "title", "source_path", F.lit("heading").alias("mode")), "doc_id"
    )
    pages = cut_lineage(S.make_pages(blocks))
    documents = cut_lineage(I.documents_idx(named, pages))
    sections = cut_lineage(I.section_rows(toc))
    bridge = cut_lineage(I.section_pages(sections, pages))
    return {"toc": toc, "pages": pages, "documents": documents, "sections": sections, "bridge": bridge}
