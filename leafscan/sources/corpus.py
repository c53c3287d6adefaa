"""Corpus files, JSON lines and JSON records as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafscan.functions import text as X
from leafscan.operators import index as I


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def _text() -> Column:
    """UTF-8 text; invalid bytes are left out."""
    return X.without_invalid(F.col("content").cast("string"))


def read_corpus(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """A1: ``path, text, kind_ord`` of a folder: markdown files, then text files.

    Corpus order is ``(kind_ord, path)``; no task numbers all files. A folder
    named ``regulatory`` takes its attachments and the raw text next to it.
    """
    root = path.rstrip("/")
    if root.rsplit("/", 1)[-1].lower() == "regulatory":
        base = root.rsplit("/", 2)[0]
        places = [(f"{root}/attachments", "*.md"), (f"{base}/raw/regulatory/txt", "*.txt")]
    else:
        places = [(root, "*.md"), (root, "*.txt")]
    out = None
    for order, (folder, glob) in enumerate(places):
        if not _exists(spark, folder):
            continue
        part = _files(spark, folder, glob).select("path", _text().alias("text"), F.lit(order).alias("kind_ord"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(path)
    return out.orderBy("kind_ord", "path").limit(limit) if limit else out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def corpus_documents(files: DataFrame, default_domain: str = "") -> DataFrame:
    """Normalised documents of corpus files: id and domain from the path (D3), text by B2."""
    path = F.regexp_replace("path", "^file:/*", "/")
    domain = I.domain_of(path)
    return files.select(
        I.doc_id_of(path).alias("doc_id"), F.coalesce(X.falsy_null(F.lit(default_domain)), domain).alias("domain"), path.alias("source_path"),
        X.normalize_text("text").alias("text"),
    )


def domain_files(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """Files of a domain with document id, size and change time; contents are not read."""
    md, txt = (_files(spark, path, g).select("path", "length", "modificationTime") for g in ("*.md", "*.txt"))
    rows = md.unionByName(txt)
    return rows.select(
        F.lit(domain).alias("domain"), F.substring_index("path", "/", -1).alias("filename"), I.doc_id_of(F.col("path")).alias("doc_id"),
        F.col("length").alias("size"), F.col("modificationTime").alias("updated_at"),
    )


def duplicate_doc_ids(files: DataFrame) -> DataFrame:
    """Document ids more than one file of a domain claims."""
    return files.groupBy("domain", "doc_id").agg(F.count("*").alias("n")).filter("n > 1")


def quota_use(files: DataFrame, max_files: int = 50, max_bytes: int = 64 << 20) -> DataFrame:
    """Files and bytes per domain against the upload limits."""
    used = files.groupBy("domain").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    return used.withColumn("within", (F.col("n_files") <= max_files) & (F.col("n_bytes") <= max_bytes))


MODES = ("fail", "skip", "repair")
BAD = "_bad_line"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, mode: str = "fail") -> DataFrame:
    """A2: JSON lines, byte-order mark and blank lines tolerated.

    ``fail`` stops at a malformed line, ``skip`` leaves it out, ``repair`` undoes
    mojibake line by line before parsing and then fails like ``fail``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    line = X.strip(F.regexp_replace("value", "^﻿", ""))
    rows = spark.read.text(path).select(line.alias("line")).filter("line <> ''")
    if mode == "repair":
        rows = rows.select(X.repair("line").alias("line"))
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if mode == "skip":
        wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
        parsed = rows.select(F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
        return parsed.filter(F.col(BAD).isNull()).drop(BAD)
    return rows.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A3: a JSON array, an object wrapping one (``questions``, ``data``, ``items``), or a single record."""
    reader = spark.read.option("multiLine", "true")
    df = (reader.schema(schema) if schema else reader).json(path)
    for key in ("questions", "data", "items"):
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            return df.select(F.explode(key).alias("r")).select("r.*")
    return df
