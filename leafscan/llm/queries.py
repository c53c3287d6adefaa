"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafscan.llm import byte_bpe, fill_middle, spelling
from leafscan.llm.decontaminate import decontaminate
from leafscan.llm.exact_dedup import exact_dedup
from leafscan.llm.jaccard_join import jaccard_join
from leafscan.llm.language_id import language_id
from leafscan.llm.licenses import license_scan
from leafscan.llm.mixing import mix
from leafscan.llm.pii import replace_pii
from leafscan.llm.quality import quality_scores
from leafscan.llm.secrets import BASE, MORE, secrets
from leafscan.llm.token_store import token_output
from leafscan.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir)`` with the session options the library needs."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op4_exact_dedup",
    """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
groups AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY body)
SELECT r.doc_id, g.keep_id, g.group_size, r.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(r.body) AS text_sha256
FROM rows r JOIN groups g ON r.body = g.body""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op1_token_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op8_decontaminate",
    f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m,
         unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1:i + 10], ' '))) AS win
  FROM items WHERE len(w) > 0),
places AS (
  SELECT rid, m, w, unnest(range(0, len(w) - m + 1)) AS s FROM docs CROSS JOIN (SELECT DISTINCT m FROM wins)),
tried AS (SELECT rid, m, s, array_to_string(w[s + 1:s + m], ' ') AS win FROM places),
found AS (SELECT rid, t.m, s, win, item_id FROM tried t JOIN wins USING (win)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM found) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def _secret_sql() -> str:
    """Every rule by its matches and the gaps between them."""
    parts = []
    for rank, rule in enumerate(BASE + MORE):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(body, '{pattern}') AS found, "
            f"regexp_extract_all(body, '{pattern}', {rule.group}) AS decisive, string_split_regex(body, '{pattern}') AS gaps FROM docs"
        )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
matched AS ({" UNION ALL ".join(parts)}),
places AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matched),
spans AS (
  SELECT rid, rank, kind, start, start + length(found[i]) AS stop FROM (
    SELECT *, coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
              + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS start FROM places)
  WHERE length(decisive[i]) >= least),
lists AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (rid)"""


@query("op5_secret_scan", _secret_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


PII_KEY = "leafscan surrogates"  # of the registered query; a production run passes its own


@query("op6_pii_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), max_repeats=4.0)


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern))


NOISE_EVERY, LEAST_CHARS, LEAST_COUNT = 31, 7, 2


@query(
    "op12_spelling_variants",
    f"""
WITH RECURSIVE
crcs AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(0, 8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, b) AS v FROM range(0, 256) r(b))),
runs AS (
  SELECT id, run, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents)
  WHERE length(run) >= {LEAST_CHARS} GROUP BY id, run),
coded AS (SELECT id, run, c, hex(encode(id || ':' || run)) AS bytes FROM runs),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
           list_transform(range(1, length(bytes), 2), lambda i: (instr('0123456789ABCDEF', bytes[i]) - 1) * 16 + instr('0123456789ABCDEF', bytes[i + 1]) - 1),
           lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]), 4294967295)) AS h
  FROM coded CROSS JOIN crcs),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {NOISE_EVERY} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c
    FROM hashed)
  WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
gaps AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT g.word AS a, g.n AS a_n, w.word AS b, w.n AS b_n FROM gaps g JOIN words w ON g.rest = w.word),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT a, b, b_n FROM shorter
  UNION ALL SELECT b, a, a_n FROM shorter),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM pairs),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON w.word = r.word),
chains AS (
  SELECT word, word AS at, form AS following FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON c.following = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON f.word = c.word AND c.following IS NULL""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.noisy_counts(table(spark, sf_dir, "documents"), NOISE_EVERY, LEAST_CHARS, LEAST_COUNT)
    return spelling.variants(words, LEAST_CHARS)


@query(
    "op13_fill_middle",
    """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
drawn AS (
  SELECT *, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2, CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4
  FROM docs),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, substr(body, 1, low) AS prefix, substr(body, low + 1, high - low) AS middle, substr(body, high + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(fill_middle.store(table(spark, sf_dir, "documents"))))
