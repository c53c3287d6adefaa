"""Queries: section retrieval, evidence scoring, expansion, packing and retrieval rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.functions import focus as C
from leafscan.functions import text as X
from leafscan.operators import evidence as V
from leafscan.operators import rounds as U
from leafscan.operators import search as Q
from leafscan.operators import sections as S
from leafscan.plans.base import BM25_SQL, PAGES_SQL, R3, TREE_SQL
from leafscan.plans.base import bench_queries, falls_on, line_pages, markdown_index, markdown_search, query, r3, table
from leafscan.plans.evaluate import ORDERS_SQL, order_pages
from leafscan.plans.search import TOP_SQL


def tokens_sql(source: str, out: str) -> str:
    """Distinct tokens (id, tok) of ``source(id, text)``."""
    return f"""
{out}_r AS (SELECT id, unnest(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')) AS run FROM {source}),
{out} AS (SELECT DISTINCT id, tok FROM (
  SELECT id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_.%-]+')) AS tok FROM {source} UNION ALL SELECT id, run FROM {out}_r UNION ALL
  SELECT id, substr(run, i, n) FROM (SELECT id, run, unnest(range(1, length(run) + 1)) AS i FROM {out}_r WHERE length(run) >= 4), (VALUES (2), (3)) g(n)
  WHERE i + n - 1 <= length(run)))"""


def num(c):
    return F.substring(c, 2, 20).cast("bigint")


def section_requests(spark, d, ix):
    """Every document is asked by the benchmark text on which its number falls."""
    docs = ix["documents"].select("doc_id", falls_on(spark, d, num("doc_id")).alias("qid"))
    return bench_queries(spark, d).join(docs, "qid")


REQ_SQL = """
req AS (SELECT 'q' || item_id AS qid, b.text AS query, 'd' || d.doc_id AS doc_id FROM benchmark b JOIN documents d ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id),
qtk AS (SELECT DISTINCT 'q' || item_id AS qid, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_.%-]+')) AS tok FROM benchmark),
stk AS (SELECT DISTINCT doc_id, section_id, toc_no, unnest(regexp_extract_all(lower(array_to_string(path, ' ')), '[A-Za-z0-9_.%-]+')) AS tok FROM secs),
ss AS (SELECT req.qid, req.doc_id, section_id, toc_no, 4.0 * count(*) AS score FROM req JOIN stk ON stk.doc_id = req.doc_id
  JOIN qtk ON qtk.qid = req.qid AND qtk.tok = stk.tok GROUP BY ALL),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, toc_no) AS section_rank FROM ss) WHERE section_rank <= 3),
lnk AS (SELECT s.section_id, s.doc_id, p.page_id, p.page_no, p.text FROM secs s JOIN pgs p ON p.doc_id = s.doc_id AND p.path[1:len(s.path)] = s.path)"""


def tree(spark, d):
    ix = markdown_index(spark, d)
    return ix, ix["sections"], ix["bridge"]


@query("f9_section_score", f"WITH {TREE_SQL}, {REQ_SQL} SELECT qid, doc_id, section_id, CAST(score AS DOUBLE) AS score FROM ss")
def f9(spark, d):
    ix, rows, _ = tree(spark, d)
    return S.section_score(section_requests(spark, d, ix), rows).select("qid", "doc_id", "section_id", "score")


@query("f10_select_sections", f"WITH {TREE_SQL}, {REQ_SQL} SELECT qid, doc_id, section_id, section_rank FROM sel")
def f10(spark, d):
    ix, rows, _ = tree(spark, d)
    return S.select_sections(S.section_score(section_requests(spark, d, ix), rows)).select("qid", "doc_id", "section_id", "section_rank")


@query(
    "f11_resolve_sections",
    f"""WITH {TREE_SQL}, {REQ_SQL}, ch AS (SELECT qid, req.doc_id, section_id, min(toc_no) AS pos FROM req JOIN secs ON secs.doc_id = req.doc_id
      WHERE CAST(substr(qid, 2) AS BIGINT) % 2 = 0 GROUP BY ALL),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY pos) AS section_rank FROM ch) WHERE section_rank <= 3)
    SELECT qid, doc_id, section_id, section_rank FROM kept
    UNION ALL SELECT qid, doc_id, section_id, section_rank FROM sel WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.qid = sel.qid AND k.doc_id = sel.doc_id)""",
)
def f11(spark, d):
    """Even queries choose all sections and one that does not exist; odd ones fall back."""
    ix, rows, _ = tree(spark, d)
    requests = section_requests(spark, d, ix)
    real = requests.filter(num("qid") % 2 == 0).join(rows, "doc_id").select("qid", "doc_id", F.col("toc_no").alias("pos"), "section_id")
    fake = requests.select("qid", "doc_id", F.lit(0).alias("pos"), F.lit("nowhere").alias("section_id"))
    fallback = S.select_sections(S.section_score(requests, rows))
    return S.resolve_sections(real.unionByName(fake), rows, fallback).select("qid", "doc_id", "section_id", "section_rank")


CONTEXT_SQL = """
ub AS (SELECT page_id FROM (SELECT page_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(array_to_string(path, ' > '), '\\s+', ' ', 'g')) AS h FROM pgs)
  WHERE length(s) >= 20 AND NOT (h <> '' AND ends_with(h, s))),
sp AS (SELECT sel.qid, sel.doc_id, section_rank, lnk.page_id, page_no FROM sel JOIN lnk ON lnk.section_id = sel.section_id JOIN ub ON ub.page_id = lnk.page_id),
t1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY page_no) AS n FROM sp WHERE section_rank = 1) WHERE n <= 3),
t2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY page_no) AS n FROM sp WHERE section_rank = 2 AND (qid, page_id) NOT IN (SELECT (qid, page_id) FROM t1)) WHERE n <= 3),
t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY page_no) AS n FROM sp WHERE section_rank = 3
  AND (qid, page_id) NOT IN (SELECT (qid, page_id) FROM t1) AND (qid, page_id) NOT IN (SELECT (qid, page_id) FROM t2)) WHERE n <= 3),
ctx AS (SELECT * FROM (SELECT qid, doc_id, page_id, page_no, section_rank, row_number() OVER (PARTITION BY qid, doc_id ORDER BY section_rank, page_no) AS context_no
  FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)) WHERE context_no <= 6)"""
WORDS = "regexp_extract_all(lower({0}), '[A-Za-z0-9_.%-]+')"


@query(
    "f12_section_search",
    f"""WITH {TREE_SQL}, {REQ_SQL}, {CONTEXT_SQL}, qt AS (SELECT 'q' || item_id AS qid, CASE WHEN item_id % 4 = 3 THEN 'fr' ELSE 'en' END AS domain, tok, least(count(*), 3) AS qtf FROM (
      SELECT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_.%-]+')) AS tok FROM benchmark) GROUP BY ALL),
    ptok AS (SELECT domain, doc_id, page_id, page_no, regexp_extract_all(lower(text), '[A-Za-z0-9_.%-]+') AS toks FROM pgs),
    corpus AS (SELECT domain, count(*) AS n, avg(len(toks)) AS avgdl FROM ptok GROUP BY domain),
    post AS (SELECT domain, doc_id, page_id, page_no, dl, tok, count(*) AS tf FROM (SELECT domain, doc_id, page_id, page_no, len(toks) AS dl, unnest(toks) AS tok FROM ptok) GROUP BY ALL),
    dfs AS (SELECT domain, tok, count(*) AS df FROM post GROUP BY ALL),
    bm AS (SELECT qt.qid, post.doc_id, post.page_id, post.page_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * qtf) AS score
      FROM qt JOIN post ON qt.domain = post.domain AND qt.tok = post.tok JOIN dfs ON dfs.domain = post.domain AND dfs.tok = post.tok JOIN corpus ON corpus.domain = post.domain
      JOIN req ON req.qid = qt.qid AND req.doc_id = post.doc_id GROUP BY ALL),
    hp AS (SELECT doc_id, array_to_string(path, ' > ') AS section_id, page_id, page_no, text, row_number() OVER (PARTITION BY doc_id, path ORDER BY page_no) AS n FROM pgs),
    hs AS (SELECT doc_id, section_id, min(page_no) AS toc_no, string_agg(substr(text, 1, 300), chr(10) ORDER BY n) FILTER (n <= 3) AS sample FROM hp GROUP BY ALL),
    ht AS (SELECT DISTINCT doc_id, section_id, toc_no, unnest({WORDS.format('section_id')}) AS tok, 3.0 AS w FROM hs UNION ALL SELECT DISTINCT doc_id, section_id, toc_no, unnest({WORDS.format('sample')}), 1.0 FROM hs),
    s3 AS (SELECT req.qid, req.doc_id, section_id, toc_no, sum(w) AS score FROM req JOIN ht ON ht.doc_id = req.doc_id JOIN qtk ON qtk.qid = req.qid AND qtk.tok = ht.tok GROUP BY ALL),
    c3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, toc_no) AS r FROM s3) WHERE r <= 3),
    ins AS (SELECT DISTINCT 1 AS tier, qid, lnk.page_id FROM sel JOIN lnk ON lnk.section_id = sel.section_id
      UNION ALL SELECT DISTINCT 3, qid, page_id FROM c3 JOIN hp ON hp.doc_id = c3.doc_id AND hp.section_id = c3.section_id UNION ALL SELECT 4, qid, page_id FROM bm),
    hits AS (SELECT * FROM (SELECT bm.qid, bm.doc_id, bm.page_id, tier, score, row_number() OVER (PARTITION BY bm.qid, bm.doc_id, tier ORDER BY round(score, 6) DESC, page_no) AS rank
      FROM bm JOIN ins ON ins.qid = bm.qid AND ins.page_id = bm.page_id) WHERE rank <= 4),
    o AS (SELECT * FROM hits UNION ALL SELECT qid, doc_id, page_id, 1, 0.0, context_no + 4 FROM ctx),
    w AS (SELECT *, min(tier) OVER (PARTITION BY qid, doc_id) AS best FROM o),
    u AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id, page_id ORDER BY rank) AS dup FROM w WHERE tier = best)
    SELECT qid, doc_id, page_id, CAST(tier AS BIGINT) AS tier, {R3.format('round(score, 6)')} AS score, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) AS rank FROM u WHERE dup = 1""",
)
def f12(spark, d):
    """Hits and context pages of the tier that answers each (query, document)."""
    ix, rows, bridge = tree(spark, d)
    found = S.section_search(section_requests(spark, d, ix), markdown_search(spark, d), rows.withColumn("preview", F.lit("")), bridge)
    return found.select("qid", "doc_id", "page_id", "tier", r3(F.round("score", 6)).alias("score"), "rank")


@query("f13_section_context", f"WITH {TREE_SQL}, {REQ_SQL}, {CONTEXT_SQL} SELECT qid, doc_id, context_no, page_id, page_no, section_rank FROM ctx")
def f13(spark, d):
    ix, rows, bridge = tree(spark, d)
    chosen = S.select_sections(S.section_score(section_requests(spark, d, ix), rows))
    return S.section_context(chosen, bridge, ix["pages"])


@query(
    "f14_section_pages_ranked",
    f"""WITH {TREE_SQL}, {REQ_SQL}, f1 AS (SELECT * FROM sel WHERE section_rank = 1),
    pk AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(array_to_string(path, ' > ') || ' ' || text || ' ' || text), '[A-Za-z0-9_.%-]+')) AS tok FROM pgs),
    body AS (SELECT page_id FROM (SELECT page_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(array_to_string(path, ' > '), '\\s+', ' ', 'g')) AS h FROM pgs)
      WHERE length(s) >= 20 AND NOT ends_with(h, s)),
    sc AS (SELECT f1.qid, f1.section_id, lnk.page_id, lnk.page_no, count(qtk.tok) AS score FROM f1 JOIN lnk ON lnk.section_id = f1.section_id JOIN body ON body.page_id = lnk.page_id
      LEFT JOIN pk ON pk.page_id = lnk.page_id LEFT JOIN qtk ON qtk.qid = f1.qid AND qtk.tok = pk.tok GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid, section_id ORDER BY score DESC, page_no) AS rank FROM sc)
    SELECT qid, section_id, page_id AS evidence_id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 2
    UNION ALL SELECT qid, section_id, section_id || '_toc_title', 0.0, 1 FROM f1 WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.qid = f1.qid AND sc.section_id = f1.section_id)""",
)
def f14(spark, d):
    ix, rows, bridge = tree(spark, d)
    pages = ix["pages"].withColumn("index_text", F.col("text"))
    best = S.select_sections(S.section_score(section_requests(spark, d, ix), rows), 1)
    chosen = best.join(bench_queries(spark, d).select("qid", "query"), "qid").select("qid", "section_id", "query")
    found = S.section_pages_ranked(chosen, rows.withColumn("preview", F.lit("")), bridge, pages)
    return found.select("qid", "section_id", "evidence_id", "score", "rank")


@query("f15_expand_pointers")
def f15(spark, d):
    """Every heading of a document as a short text that names its section."""
    ix, rows, bridge = tree(spark, d)
    evidence = rows.select(
        F.col("doc_id").alias("qid"), F.col("section_id").alias("evidence_id"), "doc_id", F.col("title").alias("text"),
        F.array(F.col("section_id")).alias("selected_section_ids"),
    )
    return S.expand_pointers(evidence, rows, bridge, ix["pages"]).drop("heading_path", "text")


@query("f16_hint_search")
def f16(spark, d):
    """Every section gives a hint: its title, words of a body, or nothing the document holds."""
    ix, rows, bridge = tree(spark, d)
    titles = rows.select("doc_id", "section_id", "title")
    hints = titles.join(ix["documents"].select("doc_id", "domain"), "doc_id").select(
        F.col("section_id").alias("qid"), "domain", "doc_id",
        F.when(num("doc_id") % 3 == 0, F.col("title")).when(num("doc_id") % 3 == 1, F.lit("1. the")).otherwise(F.lit("zzqq")).alias("hint"),
        F.col("title").alias("query"),
    )
    return S.hint_search(hints, rows.withColumn("preview", F.lit("")), bridge, ix["pages"]).select("qid", "evidence_id", "tier", "rank", "source")


# --- evidence of the contract notes -------------------------------------------------


def contract_evidence(spark, d):
    """All notes of a customer as evidence of one question about that customer."""
    p = order_pages(spark, d)
    return p.select(
        F.col("doc_id").alias("qid"), F.col("page_id").alias("evidence_id"), "doc_id", "page_id", "page_no", "domain", "heading_path", "text", "title",
        (F.col("page_no") % 7 / 2.0).alias("score"), F.lit("initial").alias("source"),
    ).withColumn("ord", Q.rank_by(["qid"], F.col("page_no")))


def contract_queries(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("c"), F.lpad(k.cast("string"), 7, "0")).alias("qid"),
        F.concat(F.lit("是否约定"), k % 7 + 1995, F.lit("年违约金比例为"), k % 5 + 1, F.lit("%的营业收入 "), "c_mktsegment").alias("query"),
        F.lit("违约金比例").alias("slot"),
        F.array(F.lit("违约金"), F.concat(k % 5 + 1, F.lit("%")), F.lit("研发 投入"), F.lit("净资产")).alias("key_terms"),
    )


CONTRACT_SQL = f"""{ORDERS_SQL},
ce AS (SELECT doc_id AS qid, page_id AS id, page_no, domain, status, '合同 > ' || status || chr(10) || text AS text, text AS body, title, (page_no % 7) / 2.0 AS score,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS ord FROM op),
cq AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS id, (c_custkey % 7 + 1995) || '' AS yr, (c_custkey % 5 + 1) || '%' AS pc,
  '是否约定' || (c_custkey % 7 + 1995) || '年违约金比例为' || (c_custkey % 5 + 1) || '%的营业收入 ' || c_mktsegment AS text FROM customer),
{tokens_sql('ce', 'etk')}, {tokens_sql('cq', 'ctk')},
ov AS (SELECT ce.id, count(*) AS n FROM ce JOIN etk ON etk.id = ce.id JOIN ctk ON ctk.id = ce.qid AND ctk.tok = etk.tok GROUP BY ce.id),
qsc AS (SELECT ce.*, score + 1.5 * coalesce(n, 0) + CASE WHEN contains(ce.text, yr) THEN 2 ELSE 0 END
  + CASE WHEN contains(ce.text, yr) THEN 1 ELSE 0 END + CASE WHEN contains(ce.text, pc) THEN 1 ELSE 0 END AS query_score
  FROM ce JOIN cq ON cq.id = ce.qid LEFT JOIN ov ON ov.id = ce.id)"""


@query(
    "f17_rerank",
    f"""WITH {CONTRACT_SQL} SELECT qid, id AS evidence_id, CAST(query_score AS DOUBLE) AS query_score,
      row_number() OVER (PARTITION BY qid ORDER BY query_score DESC, ord) AS rank FROM qsc""",
)
def f17(spark, d):
    """Every note twice; the repeats drop out."""
    e = contract_evidence(spark, d)
    twice = e.unionByName(e.withColumn("ord", F.col("ord") + 100000))
    return V.rerank(twice, contract_queries(spark, d)).select("qid", "evidence_id", "query_score", "rank")


@query(
    "f18_rerank_slot",
    f"""WITH {CONTRACT_SQL}, kt AS (SELECT id AS qid, unnest(['违约金', pc, '研发投入', '净资产']) AS term FROM cq),
    kd AS (SELECT DISTINCT term AS id, term AS text FROM kt), {tokens_sql('kd', 'ktk')},
    sh AS (SELECT ce.id, ktk.id AS term, count(*) AS n FROM ce JOIN kt ON kt.qid = ce.qid JOIN ktk ON ktk.id = kt.term JOIN etk ON etk.id = ce.id AND etk.tok = ktk.tok GROUP BY ce.id, ktk.id),
    tm AS (SELECT ce.id, sum(CASE WHEN contains(ce.text, kt.term) THEN 4 ELSE least(2.5, 0.8 * coalesce(n, 0)) END) AS gain,
      sum(CASE WHEN contains(ce.text, kt.term) THEN 1 WHEN coalesce(n, 0) > 0 THEN 0.5 ELSE 0 END) AS cov
      FROM ce JOIN kt ON kt.qid = ce.qid LEFT JOIN sh ON sh.id = ce.id AND sh.term = kt.term GROUP BY ce.id),
    s AS (SELECT qid, qsc.id, ord, query_score + gain + least(6, cov * 1.2) + CASE WHEN cov = 0 THEN -6 ELSE 0 END AS slot_score FROM qsc JOIN tm ON tm.id = qsc.id)
    SELECT qid, id AS evidence_id, round(CAST(slot_score AS DOUBLE), 4) AS slot_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(slot_score, 6) DESC, ord) AS rank FROM s) WHERE rank <= 3""",
)
def f18(spark, d):
    return V.rerank_slot(contract_evidence(spark, d), contract_queries(spark, d), 3).select("qid", "evidence_id", F.round("slot_score", 4).alias("slot_score"), "rank")


@query(
    "f19_summary_candidates",
    f"""WITH {CONTRACT_SQL}, e AS (SELECT *, query_score - score AS s FROM qsc WHERE ord <= 8 AND page_no <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, page_no) AS rank FROM e WHERE s > 0)
    SELECT qid, id AS evidence_id, CAST(s AS DOUBLE) AS query_score, rank FROM r WHERE rank <= 2""",
)
def f19(spark, d):
    requests = contract_queries(spark, d).withColumn("doc_id", F.col("qid"))
    return V.summary_candidates(order_pages(spark, d), requests).select("qid", "evidence_id", "query_score", "rank")


@query(
    "f20_term_coverage",
    f"""WITH {CONTRACT_SQL}, b AS (SELECT ce.*, title || ' 合同 ' || status || ' ' || body AS s, pc FROM ce JOIN cq ON cq.id = ce.qid),
    c AS (SELECT *, 1 + CASE WHEN contains(s, pc) THEN 1 ELSE 0 END + CASE WHEN contains(s, '研发投入') THEN 1 ELSE 0 END + CASE WHEN contains(s, '净资产') THEN 1 ELSE 0 END AS covered FROM b),
    r AS (SELECT *, covered * 20.0 + least(length(s), 2000) / 2000.0 AS sc FROM c WHERE covered >= 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, page_no) AS rank FROM r)
    SELECT qid, id AS evidence_id, CAST(covered AS BIGINT) AS covered, round(CAST(sc AS DOUBLE), 4) AS score, rank FROM k WHERE rank <= 3""",
)
def f20(spark, d):
    requests = contract_queries(spark, d).withColumn("doc_id", F.col("qid"))
    found = V.term_coverage(order_pages(spark, d), requests)
    return found.select("qid", "evidence_id", F.col("covered").cast("bigint").alias("covered"), F.round("score", 4).alias("score"), "rank")


@query(
    "f21_expand_forward",
    f"""WITH {CONTRACT_SQL}, ev AS (SELECT * FROM ce WHERE ord % 3 = 1), an AS (SELECT * FROM ev WHERE page_no % 2 = 0),
    st AS (SELECT an.qid, an.id AS src, an.ord, s.i AS step FROM an, (SELECT unnest(range(1, 5)) AS i) s),
    nx AS (SELECT st.qid, st.src, st.ord, st.step, p.id FROM st JOIN ce p ON p.qid = st.qid AND p.ord = st.ord + st.step WHERE p.ord % 3 <> 1)
    SELECT qid, src AS expanded_from, step, id AS evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY ord, step) AS n FROM nx) WHERE n = 1""",
)
def f21(spark, d):
    """Every third note is evidence; the even ones break off before a formula."""
    pages = order_pages(spark, d)
    e = contract_evidence(spark, d).filter("ord % 3 = 1")
    e = e.withColumn("text", F.when(F.col("page_no") % 2 == 0, F.lit("赔付金额按照以下公式计算如下：")).otherwise(F.col("text")))
    return V.expand_forward(e, pages).select("qid", "expanded_from", F.col("step").cast("bigint").alias("step"), "evidence_id")


@query(
    "f22_merge_evidence",
    f"""WITH {CONTRACT_SQL}, m AS (SELECT qid, id, ord, 0 AS side FROM ce WHERE ord % 2 = 0 UNION ALL SELECT qid, id, ord, 1 FROM ce WHERE ord % 3 = 0 AND ord % 2 <> 0 AND page_no % 5 <> 0)
    SELECT qid, id AS evidence_id, row_number() OVER (PARTITION BY qid ORDER BY side, ord) AS ord FROM m""",
)
def f22(spark, d):
    """Even rows first, then every third; rows of every fifth order are excluded from the second side."""
    e = contract_evidence(spark, d)
    merged = V.merge_evidence(e.filter("ord % 2 = 0"), e.filter("ord % 3 = 0"), e.filter("page_no % 5 = 0"))
    return merged.select("qid", "evidence_id", "ord")


@query(
    "f22_merge_facts",
    f"""WITH {CONTRACT_SQL}, f AS (SELECT DISTINCT qid, ord, 0 AS side, 's' || (page_no % 3) AS slot, 'v' || (page_no % 4) AS value, 'e' || (page_no % 2) AS ids FROM ce WHERE ord % 2 = 0
      UNION ALL SELECT qid, ord, 1, 's' || (page_no % 3), 'v' || (page_no % 4), 'e' || (page_no % 2) FROM ce WHERE ord % 2 = 1),
    u AS (SELECT *, row_number() OVER (PARTITION BY qid, slot, value, ids ORDER BY side, ord) AS n FROM f),
    l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY side DESC, ord DESC) AS b FROM u WHERE side = 0 OR n = 1)
    SELECT qid, ord, slot, value, ids AS evidence_ids FROM l WHERE b <= 24""",
)
def f22_facts(spark, d):
    n = F.col("page_no")
    facts = contract_evidence(spark, d).select(
        "qid", "ord", F.concat(F.lit("s"), n % 3).alias("slot"), F.concat(F.lit("v"), n % 4).alias("value"), F.lit("full").alias("coverage"),
        F.array(F.concat(F.lit("e"), n % 2)).alias("evidence_ids"),
    )
    return V.merge_facts(facts.filter("ord % 2 = 0"), facts.filter("ord % 2 = 1")).select("qid", "ord", "slot", "value", "evidence_ids")


def long_evidence(spark, d):
    """Whole documents as long evidence of the first benchmark words."""
    docs = table(spark, d, "documents")
    q = F.concat(F.lit("the and "), F.substring("text", 1, 80))
    return docs.select(
        F.concat(F.lit("d"), "doc_id").alias("qid"), F.lit(1).alias("ord"), F.concat(F.lit("d"), "doc_id").alias("evidence_id"),
        F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.concat(F.lit("d"), "doc_id").alias("page_id"), F.array("source").alias("heading_path"),
        F.regexp_replace("text", "\n", "\n\n").alias("text"), F.lit(1.0).alias("score"), F.lit("initial").alias("source"), q.alias("query"),
    )


@query("c8_subsplit")
def c8(spark, d):
    return long_evidence(spark, d).select("evidence_id", F.posexplode(C.subsplit("text", 1500, 760)).alias("idx", "snippet"))


@query("c9_inner_split")
def c9(spark, d):
    rows = long_evidence(spark, d).select("evidence_id", F.posexplode(C.inner_split("text", F.col("query"))).alias("idx", "s"))
    return rows.select("evidence_id", "idx", "s.start", "s.end", "s.snippet")


@query(
    "c10_note_sentences",
    f"""WITH {ORDERS_SQL}, s AS (SELECT page_id, unnest(regexp_extract_all(text, '[^。；;！？!?]*[。；;！？!?]|[^。；;！？!?]+$')) AS p,
      generate_subscripts(regexp_extract_all(text, '[^。；;！？!?]*[。；;！？!?]|[^。；;！？!?]+$'), 1) AS n FROM op)
    SELECT page_id, n, trim(p) AS sentence FROM s""",
)
def c10(spark, d):
    rows = order_pages(spark, d).select("page_id", F.posexplode(C.note_sentences("text")).alias("n", "sentence"))
    return rows.select("page_id", (F.col("n") + 1).alias("n"), "sentence")


@query("f23_local_subsearch")
def f23(spark, d):
    e = long_evidence(spark, d)
    return V.local_subsearch(e.drop("query"), e.select("qid", "query")).drop("heading_path")


@query("f24_inner_focus")
def f24(spark, d):
    e = long_evidence(spark, d)
    return V.inner_focus(e.drop("query"), e.select("qid", "query")).drop("heading_path")


@query("f25_focus")
def f25(spark, d):
    """A table of a customer's orders, focused on one year."""
    o = table(spark, d, "orders")
    row = F.concat(F.lit("| "), F.year("o_orderdate"), F.lit(" | "), "o_orderkey", F.lit(" | "), "o_orderstatus", F.lit(" |"))
    tables = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    text = F.concat(F.lit("客户订单\n| 年份 | 编号 | 状态 |\n|---|---|---|\n"), "rows")
    return tables.select("o_custkey", C.focus(text, F.concat(F.col("o_custkey") % 7 + 1995, F.lit("年")), 400).alias("focused"))


@query("f26_evidence_notes")
def f26(spark, d):
    return V.evidence_notes(contract_evidence(spark, d), contract_queries(spark, d)).drop("heading")


@query(
    "f28_review_sources",
    f"""WITH {CONTRACT_SQL}, c2 AS (SELECT id, tok FROM ctk WHERE length(tok) >= 2),
    o2 AS (SELECT ce.id, count(*) AS n FROM ce JOIN etk ON etk.id = ce.id JOIN c2 ON c2.id = ce.qid AND c2.tok = etk.tok GROUP BY ce.id),
    s AS (SELECT ce.qid, ce.id, ord, 4.0 + CASE WHEN contains(ce.text, pc) THEN 4 ELSE 0 END + coalesce(n, 0)
      + CASE WHEN page_no % 4 = 0 THEN 2 ELSE 0 END AS sc FROM ce JOIN cq ON cq.id = ce.qid LEFT JOIN o2 ON o2.id = ce.id),
    r AS (SELECT *, count(*) OVER (PARTITION BY qid) AS c, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, ord) AS sr, row_number() OVER (PARTITION BY qid ORDER BY ord) AS orr FROM s)
    SELECT qid, id AS evidence_id, CAST(sc AS DOUBLE) AS review_score, CASE WHEN c <= 3 THEN orr ELSE sr END AS rank FROM r WHERE c <= 3 OR sr <= 3""",
)
def f28(spark, d):
    e = contract_evidence(spark, d).withColumn("remembered", F.col("page_no") % 4 == 0)
    return V.review_sources(e, contract_queries(spark, d))


@query(
    "d11_reference_targets",
    f"""WITH {CONTRACT_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord DESC) AS b FROM ce),
    t AS (SELECT qid, ord, '附表' || (page_no % 4 + 1) AS target FROM l WHERE b <= 12),
    u AS (SELECT qid, target, min(ord) AS ord FROM t GROUP BY ALL),
    r AS (SELECT qid, target, row_number() OVER (PARTITION BY qid ORDER BY ord) AS target_no FROM u)
    SELECT qid, target, target_no FROM r WHERE target_no <= 4""",
)
def d11(spark, d):
    e = contract_evidence(spark, d).withColumn("text", F.regexp_extract("text", "详见.*?。", 0))
    return V.reference_targets(e).select("qid", "target", "target_no")


@query(
    "d12_referenced_slots",
    f"""WITH {CONTRACT_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord DESC) AS b FROM ce),
    t AS (SELECT qid, '附表' || (page_no % 4 + 1) AS target, min(ord) AS ord, arg_min(id, ord) AS evidence_id FROM l WHERE b <= 12 GROUP BY ALL)
    SELECT qid, '给付比例' AS slot, target, evidence_id, qid AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY ord) AS slot_no FROM t""",
)
def d12(spark, d):
    e = contract_evidence(spark, d).withColumn("text", F.concat(F.lit("给付比例"), F.regexp_extract("text", "详见.*?。", 0)))
    return V.referenced_slots(e)


def amounts(spark, d):
    """Yearly notes per customer with two metrics in different units."""
    e = contract_evidence(spark, d)
    text = F.concat(F.lit("报告期营业收入为"), F.col("page_no") % 90 + 10, F.lit("亿元，其中研发投入"), F.col("page_no") % 800 + 1, F.lit("百万元。增长5%。"))
    return e.withColumn("text", text)


@query(
    "d14_computed_ratio",
    f"""WITH {CONTRACT_SQL}, f AS (SELECT qid, page_no, id FROM ce WHERE ord = 1)
    SELECT qid, round((page_no % 800 + 1) * 1e6 / ((page_no % 90 + 10) * 1e8) * 100, 6) AS ratio, id AS supporting_evidence_ids FROM f""",
)
def d14(spark, d):
    queries = contract_queries(spark, d).select("qid", F.lit("研发投入占营业收入的比例是多少").alias("query"))
    return V.computed_ratio(queries, amounts(spark, d)).select("qid", F.round("ratio", 6).alias("ratio"), "supporting_evidence_ids")


@query("f29_reference_followup")
def f29(spark, d):
    missing = contract_queries(spark, d).select("qid", F.lit("给付比例").alias("slot"), F.lit("赔付").alias("query"), F.lit("核对").alias("task"), F.lit("计划一如何").alias("question"))
    e = contract_evidence(spark, d)
    docs = order_pages(spark, d).select(F.col("doc_id").alias("qid"), "domain", "doc_id", F.lit(1).alias("doc_ord")).distinct()
    return V.reference_followup(missing, e, docs, order_pages(spark, d)).select("qid", "evidence_id", "rank")


@query(
    "f34_pack_context",
    f"""WITH {CONTRACT_SQL}, u AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY qid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ce)
    SELECT qid, string_agg('[' || id || '] doc=' || qid || ' heading=合同 > ' || status || chr(10) || substr(body, 1, CAST(500 - used AS BIGINT)), chr(10) || chr(10) ORDER BY ord) AS context,
      count(*) AS n_evidence FROM u WHERE used < 500 GROUP BY qid""",
)
def f34(spark, d):
    return V.pack_context(contract_evidence(spark, d), 500)


@query(
    "f35_next_candidates",
    f"""WITH {TREE_SQL}, q AS (SELECT doc_id AS qid, section_id, title, toc_no AS ord FROM secs),
    av AS (SELECT DISTINCT doc_id AS qid, lower(regexp_replace(title, '[\\s，,。；;：:、.．（）()《》<>【】\\[\\]"''“”‘’]', '', 'g')) AS a FROM secs WHERE toc_no = 3),
    l AS (SELECT q.*, lower(regexp_replace(title, '[\\s，,。；;：:、.．（）()《》<>【】\\[\\]"''“”‘’]', '', 'g')) AS key FROM q WHERE ord > 2)
    SELECT qid, arg_min(section_id, ord) AS section_id, min(ord) AS ord FROM l WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.qid = l.qid AND a <> '' AND contains(l.key, a)) GROUP BY qid""",
)
def f35(spark, d):
    _, rows, _ = tree(spark, d)
    queue = rows.select(F.col("doc_id").alias("qid"), F.col("toc_no").alias("ord"), "section_id", "title")
    return V.next_candidates(queue, queue.filter("ord <= 2"), queue.filter("ord = 3")).select("qid", "section_id", "ord")


@query(
    "f36_verify_quotes",
    f"""WITH {CONTRACT_SQL} SELECT qid, id || '_extract_0' AS evidence_id, substr(body, 5, 20) AS text FROM ce WHERE page_no % 3 <> 0""",
)
def f36(spark, d):
    """Two of three quotes are verbatim, the third is not in its source."""
    e = contract_evidence(spark, d)
    quotes = e.select(
        "qid", F.lit(0).alias("idx"), F.col("evidence_id").alias("source_evidence_id"),
        F.when(F.col("page_no") % 3 == 0, F.concat(F.lit("并非"), F.substring("text", 5, 20))).otherwise(F.substring("text", 5, 20)).alias("text"),
    )
    return V.verify_quotes(quotes, e).select("qid", "evidence_id", "text")


@query(
    "f41_export_candidates",
    f"""WITH {CONTRACT_SQL} SELECT qid, id AS evidence_id FROM ce WHERE ord % 2 = 0 AND regexp_matches(body, '不得|禁止|不应|不能|应当|必须|批准|审批|许可|限制|例外|除外')""",
)
def f41(spark, d):
    e = contract_evidence(spark, d)
    tasks = contract_queries(spark, d).select("qid", F.col("query").alias("question"), F.lit(1).alias("n_slots"))
    return V.export_candidates(e, tasks, e.filter("ord % 2 = 1")).select("qid", "evidence_id")


def round_inputs(spark, d):
    pages = order_pages(spark, d)
    docs = pages.select(F.col("doc_id").alias("qid"), "domain", "doc_id").distinct()
    queries = contract_queries(spark, d)
    options = docs.drop("doc_id").join(queries, "qid").select(
        "qid", "domain", F.col("query").alias("question"), F.lit("A").alias("option"), F.concat(F.lit("违约金比例为"), F.substring("qid", -1, 1), F.lit("%")).alias("claim")
    )
    return pages, docs, queries, options


@query("f38_initial_round")
def f38(spark, d):
    """A third of the customers has planned searches, a third slot queries, a third only the question."""
    pages, docs, queries, options = round_inputs(spark, d)
    third = F.substring("qid", 2, 20).cast("int") % 3
    plans = queries.filter(third == 0).select("qid", F.lit(1).alias("ord"), F.lit("违约金 支付").alias("query"), F.col("qid").alias("doc_id"))
    slots = queries.filter(third <= 1).select("qid", F.lit(1).alias("ord"), "slot", F.lit("").alias("expected"), F.array(F.lit("违约金比例"), F.lit("账期 天")).alias("queries"))
    return U.initial(options, plans, slots, docs, pages).select("qid", "ord", "evidence_id", "source")


@query("f39_followup_round")
def f39(spark, d):
    """Missing slots of every customer name the next one, whose notes are searched too; a quarter of the query texts was tried before."""
    pages, docs, queries, options = round_inputs(spark, d)
    file_marks = lambda k: F.format_string("K%07d L%07d M%07d", k, k, k)
    number = F.substring("qid", 2, 20).cast("int")
    asked = F.concat_ws(" ", "query", file_marks(number + 1))
    missing = queries.join(options.select("qid", "domain"), "qid").select("qid", "domain", "slot", asked.alias("query"), "key_terms")
    tried = missing.filter(number % 4 == 0).select("qid", X.stable_id(F.col("query"), 12).alias("query_key"))
    own = queries.select(F.col("qid").alias("doc_id"), file_marks(number).alias("profile"))
    found = U.followup(missing, docs, pages, own, tried)
    return found.select("qid", "slot", "ord", "evidence_id", "source", F.round("slot_score", 3).alias("slot_score"))


@query("f40_repair_round")
def f40(spark, d):
    ix, rows, bridge = tree(spark, d)
    hints = rows.join(ix["documents"].select("doc_id", "domain"), "doc_id").select(
        F.col("doc_id").alias("qid"), F.col("toc_no").alias("ord"), "domain", "doc_id", F.col("title").alias("hint"), F.lit("").alias("query"), F.array(F.col("title")).alias("key_terms")
    )
    return V.repair_round(hints, rows.withColumn("preview", F.lit("")), bridge, ix["pages"]).select("qid", "ord", "evidence_id", "source")


@query(
    "d26_page_flags",
    f"""WITH {TREE_SQL}, f AS (SELECT page_id, page_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(array_to_string(path, ' > '), '\\s+', ' ', 'g')) AS h FROM pgs)
    SELECT page_id, length(s) < 20 OR ends_with(h, s) AS heading_only, regexp_matches(substr(s, 1, 180), '\\.{{16}}.*\\.{{16}}') AS low_value,
      page_no <= 2 AND NOT (length(s) < 20 OR ends_with(h, s)) AS summary_like, false AS open_anchor FROM f""",
)
def d26(spark, d):
    return markdown_index(spark, d)["pages"].select(
        "page_id",
        S.is_heading_only(F.col("text"), F.col("heading_path")).alias("heading_only"),
        S.is_low_value(F.col("text"), F.col("heading_path")).alias("low_value"),
        S.is_summary_like(F.col("page_no"), F.col("text"), F.col("heading_path"), F.lit(""), F.lit("")).alias("summary_like"),
        S.is_open_anchor(F.col("text")).alias("open_anchor"),
    )
