"""Queries: cleaning, segmentation, index and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import index as I
from leafscan.operators import search as Q
from leafscan.operators import segment as S
from leafscan.plans.base import BM25_SQL, PAGES_SQL, QUERIES_SQL, R3, TREE_SQL
from leafscan.plans.base import OWN_BM25_SQL, OWN_REQUESTS_SQL, own_requests
from leafscan.plans.base import bench_queries, line_index, line_pages, markdown_docs, markdown_index, markdown_outline, query, r3, table

SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(
    "b3_compact_text",
    f"SELECT doc_id, {SQUEEZE.format('text')} AS text FROM documents",
)
def b3(spark, d):
    return table(spark, d, "documents").select("doc_id", X.compact_text("text").alias("text"))


@query(
    "b5_clip",
    f"""WITH t AS (SELECT doc_id, {SQUEEZE.format('text')} AS s FROM documents)
    SELECT doc_id,
      CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substr(s, 1, 237)) || '...' END AS ellipsis,
      CASE WHEN length(s) <= 220 THEN s ELSE substr(s, 1, 220) || '...' END AS suffix,
      substr(s, 1, 100) AS prefix FROM t""",
)
def b5(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        X.clip("text", 240).alias("ellipsis"),
        X.clip("text", 220, "suffix").alias("suffix"),
        X.clip("text", 100, "prefix").alias("prefix"),
    )


@query(
    "b6_match_key",
    r"""SELECT doc_id,
      lower(regexp_replace(text, '[\s，,。；;：:、.．（）()《》<>【】\[\]"''“”‘’]', '', 'g')) AS heading,
      lower(regexp_replace(text, '[\s、，,。；;：:（）()\[\]【】《》"''“”‘’/\\_-]+', '', 'g')) AS catalog,
      regexp_replace(text, '[\s:：,，。；;()（）]+', '', 'g') AS reference,
      lower(regexp_replace(text, '[\s,.;:!?、，。；：！？]+', '', 'g')) AS intent,
      regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS slot FROM documents""",
)
def b6(spark, d):
    kinds = ("heading", "catalog", "reference", "intent", "slot")
    return table(spark, d, "documents").select("doc_id", *[X.match_key("text", k).alias(k) for k in kinds])


@query(
    "b8_stable_id",
    r"""SELECT doc_id, substr(md5(text), 1, 16) AS content_hash,
      'chat_' || CASE WHEN s = '' THEN '' ELSE s || '_' END || substr(md5(text), 1, 8) AS query_id
    FROM (SELECT *, substr(trim(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', '_', 'g'), '_'), 1, 24) AS s FROM documents)""",
)
def b8(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.stable_id("text", 16).alias("content_hash"), X.query_id("text").alias("query_id")
    )


@query(
    "b9_unique_compact",
    r"""WITH t AS (SELECT doc_id, unnest(string_split(text, '.')) AS x, generate_subscripts(string_split(text, '.'), 1) AS pos FROM documents),
    c AS (SELECT doc_id, pos, trim(regexp_replace(x, '\s+', ' ', 'g'), ' ,;:') AS v FROM t),
    u AS (SELECT doc_id, v, min(pos) AS pos FROM c WHERE v <> '' GROUP BY doc_id, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM u)
    SELECT d.doc_id, coalesce(string_agg(v, '|' ORDER BY rn) FILTER (rn <= 12), '') AS items
    FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def b9(spark, d):
    return table(spark, d, "documents").select("doc_id", X.unique_compact(F.split("text", r"\."), 12).alias("items"))


@query(
    "f1_tokenize",
    """SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_.%-]+') AS t FROM documents)""",
)
def f1(spark, d):
    toks = table(spark, d, "documents").select("doc_id", X.tokenize("text").alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(
    "e10_bm25_postings",
    f"WITH {BM25_SQL} SELECT domain, page_id, term, tf, dl FROM post",
)
def e10_postings(spark, d):
    return line_index(spark, d).postings.select("domain", "page_id", "term", "tf", "dl")


@query(
    "e10_term_stats",
    f"""WITH {BM25_SQL} SELECT dfs.domain, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf
    FROM dfs JOIN corpus ON corpus.domain = dfs.domain""",
)
def e10_terms(spark, d):
    index = line_index(spark, d)
    return index.terms.join(index.corpus, "domain").select("domain", "term", "df", F.round(I.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("e10_corpus_stats", f"WITH {BM25_SQL} SELECT domain, n, round(avgdl, 6) AS avgdl FROM corpus")
def e10_corpus(spark, d):
    return line_index(spark, d).corpus.select("domain", "n", F.round("avgdl", 6).alias("avgdl"))


@query(
    "f2_bm25_scores",
    f"""WITH {OWN_BM25_SQL}, allowed AS ({OWN_REQUESTS_SQL})
    SELECT bm.qid, bm.page_id, round(score, 3) AS score FROM bm JOIN allowed a ON a.qid = bm.qid AND a.doc_id = bm.doc_id""",
)
def f2(spark, d):
    """Scores under a document filter: statistics still cover the whole domain."""
    requests = own_requests(spark, d)
    return Q.bm25(requests.select("qid", "domain", "query").distinct(), line_index(spark, d), requests).select("qid", "page_id", F.round("score", 3).alias("score"))


TOP_SQL = """top AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id, page_no) AS rank FROM bm)"""


@query(
    "f3_search_pages",
    f"""WITH {BM25_SQL}, {TOP_SQL}
    SELECT qid, top.domain, top.doc_id, top.page_id, round(score, 3) AS score, rank, pg.title AS heading_path,
      CASE WHEN length(s) <= 200 THEN s ELSE rtrim(substr(s, 1, 197)) || '...' END AS quote
    FROM top JOIN (SELECT *, {SQUEEZE.format('text')} AS s FROM pg) pg ON pg.page_id = top.page_id WHERE rank <= 5""",
)
def f3(spark, d):
    return Q.search_pages(bench_queries(spark, d), line_index(spark, d), k=5, quote=200)


LINE_CATALOG_SQL = f"""
firsts AS (SELECT doc_id, domain, title, count(*) AS page_count, arg_min(page_id, page_no) AS first_page_id,
    arg_min(text, page_no) AS first_text FROM pg GROUP BY doc_id, domain, title),
cat AS (SELECT *, CASE WHEN length(s) <= 500 THEN s ELSE substr(s, 1, 500) || '...' END AS first_page_preview
  FROM (SELECT *, {SQUEEZE.format('first_text')} AS s FROM firsts)),
prof AS (SELECT *, title || ' ' || title || '|' || doc_id || ' ' || title || ' ' || first_page_preview AS profile FROM cat)"""


def line_catalog(spark, d):
    """Catalog of the line pages: the source is title and only heading, the id a second alias."""
    first = line_pages(spark, d).groupBy("doc_id", "domain", "title").agg(
        F.count("*").alias("page_count"), F.min_by(F.struct("page_id", "text"), "page_no").alias("p")
    )
    return first.select(
        "doc_id",
        "domain",
        "title",
        F.col("title").alias("title_fixed"),
        "page_count",
        F.array(F.concat_ws("|", "title", "doc_id")).alias("aliases"),
        F.array("title").alias("top_headings"),
        F.col("p.page_id").alias("first_page_id"),
        X.clip("p.text", 500, "suffix").alias("first_page_preview"),
    )


OCC = "CAST((length({0}) - length(replace({0}, {1}, ''))) / length({1}) AS BIGINT)"
CATSCORE_SQL = f"""
chits AS (SELECT qt.qid, p.domain, p.doc_id, qt.term, qt.pos, least({OCC.format('lower(p.profile)', 'qt.term')}, 3) AS h
  FROM qt JOIN prof p ON p.domain = qt.domain WHERE contains(lower(p.profile), qt.term)),
cnt AS (SELECT qid, domain, doc_id, sum(h) AS s, list(term ORDER BY pos)[1:12] AS m FROM chits GROUP BY qid, domain, doc_id),
phr AS (SELECT qs.qid, p.domain, p.doc_id FROM qs JOIN prof p ON p.domain = qs.domain AND contains(p.profile, trim(qs.query))),
cats AS (SELECT coalesce(cnt.qid, phr.qid) AS qid, coalesce(cnt.domain, phr.domain) AS domain, coalesce(cnt.doc_id, phr.doc_id) AS doc_id,
    CAST(coalesce(s, 0) + CASE WHEN phr.qid IS NULL THEN 0 ELSE 4 END AS DOUBLE) AS catalog_score, coalesce(m, []) AS m
  FROM cnt FULL JOIN phr ON cnt.qid = phr.qid AND cnt.doc_id = phr.doc_id)"""


@query(
    "f6_catalog_score",
    f"""WITH {BM25_SQL}, {LINE_CATALOG_SQL}, {CATSCORE_SQL}
    SELECT qid, domain, doc_id, catalog_score, array_to_string(m, '|') AS matched FROM cats""",
)
def f6(spark, d):
    return Q.catalog_score(bench_queries(spark, d), line_catalog(spark, d))


@query(
    "f4_search_docs",
    f"""WITH {BM25_SQL}, {TOP_SQL}, {LINE_CATALOG_SQL}, {CATSCORE_SQL},
    perdoc AS (SELECT qid, domain, doc_id, sum(score) AS page_score, arg_min(page_id, rank) AS page_id FROM top WHERE rank <= 50 GROUP BY ALL),
    ph AS (SELECT pd.qid, pd.doc_id, list(qt.term ORDER BY pos)[1:12] AS pm FROM perdoc pd JOIN pg ON pg.page_id = pd.page_id
      JOIN qt ON qt.qid = pd.qid AND contains(lower(pg.text), qt.term) GROUP BY ALL),
    merged AS (SELECT coalesce(c.qid, p.qid) AS qid, coalesce(c.domain, p.domain) AS domain, coalesce(c.doc_id, p.doc_id) AS doc_id,
      coalesce(catalog_score, 0.0) AS cs, coalesce(page_score, 0.0) AS ps, coalesce(m, []) AS m
      FROM cats c FULL JOIN perdoc p ON c.qid = p.qid AND c.doc_id = p.doc_id),
    terms AS (SELECT mg.*, round(cs + ps, 3) AS score,
      list_concat(m, list_filter(coalesce(pm, []), lambda x: NOT list_contains(m, x)))[1:12] AS mt
      FROM merged mg LEFT JOIN ph ON ph.qid = mg.qid AND ph.doc_id = mg.doc_id WHERE cs + ps > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM terms)
    SELECT qid, r.domain, r.doc_id, title, score, round(cs, 3) AS catalog_score, round(ps, 3) AS page_score,
      array_to_string(mt, '|') AS matched_terms, page_count, first_page_id,
      CASE WHEN length(first_page_preview) <= 240 THEN first_page_preview ELSE rtrim(substr(first_page_preview, 1, 237)) || '...' END AS first_page_preview,
      rank FROM ranked r JOIN cat ON cat.doc_id = r.doc_id WHERE rank <= 5""",
)
def f4(spark, d):
    return Q.search_docs(bench_queries(spark, d), line_index(spark, d), line_catalog(spark, d), k=5)


@query(
    "f5_get_page",
    f"""WITH {PAGES_SQL}, firsts AS (SELECT doc_id, min(page_no) AS page_no FROM pg GROUP BY doc_id)
    SELECT pg.doc_id AS key_id, pg.domain, pg.doc_id, page_id, title AS heading_path,
      CASE WHEN length(s) <= 300 THEN s ELSE rtrim(substr(s, 1, 297)) || '...' END AS text
    FROM (SELECT *, {SQUEEZE.format('text')} AS s FROM pg) pg JOIN firsts f ON f.doc_id = pg.doc_id AND f.page_no = pg.page_no""",
)
def f5(spark, d):
    """Look up every labelled or unlabelled document's first page, half by page id, half by document id."""
    pages = line_pages(spark, d)
    firsts = pages.groupBy("doc_id", "domain").agg(F.min_by("page_id", "page_no").alias("page_id"))
    even = F.ascii(F.substring("doc_id", -1, 1)) % 2 == 0
    keys = firsts.select(
        F.col("doc_id").alias("key_id"), "domain", F.when(even, F.col("page_id")).alias("page_id"), "doc_id"
    )
    return Q.get_page(pages, keys, 300)


@query(
    "f7_retrieve_multi",
    f"""WITH {OWN_BM25_SQL}, req AS ({OWN_REQUESTS_SQL}),
    r AS (SELECT bm.*, row_number() OVER (PARTITION BY bm.qid, bm.doc_id ORDER BY round(score, 6) DESC, page_no) AS rank
      FROM bm JOIN req ON req.qid = bm.qid AND req.doc_id = bm.doc_id)
    SELECT qid, page_id AS evidence_id, doc_id, {R3.format('round(score, 6)')} AS score, rank FROM r WHERE rank <= 2""",
)
def f7(spark, d):
    return Q.retrieve_multi(own_requests(spark, d), line_index(spark, d), 2, "initial").select(
        "qid", "evidence_id", "doc_id", r3("score").alias("score"), "rank"
    )


# --- segmentation and index tables -----------------------------------------


@query(
    "c1_split_headings_toc",
    f"WITH {TREE_SQL} SELECT doc_id, toc_no, level, title, array_to_string(path, '|') AS heading_path FROM paths",
)
def c1_toc(spark, d):
    return S.toc_of(markdown_outline(spark, d))


@query(
    "c1_split_headings_blocks",
    f"""WITH {TREE_SQL}, off AS (SELECT *, coalesce(sum(level + 2 + length(title) + CASE WHEN text = '' THEN 0 ELSE length(text) + 1 END)
        OVER (PARTITION BY doc_id ORDER BY toc_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM paths)
    SELECT doc_id, 'section' AS kind, text, CAST(start + level + 2 + length(title) AS BIGINT) AS char_start,
      CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY toc_no),
        start + level + 2 + length(title) + CASE WHEN text = '' THEN 0 ELSE length(text) END) AS BIGINT) AS char_end,
      array_to_string(path, '|') AS heading_path, level FROM off QUALIFY text <> ''""",
)
def c1_blocks(spark, d):
    cols = ("doc_id", "kind", "text", "char_start", "char_end", "heading_path", "level")
    return S.blocks_of(markdown_outline(spark, d)).select(*cols)


@query(
    "c7_make_pages",
    f"""WITH {TREE_SQL}, t1 AS (SELECT doc_id, title AS doc_title FROM paths WHERE toc_no = 1),
    tt AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%') AS nums FROM pgs)
    SELECT pgs.doc_id, domain, 'corpus/raw_md/' || domain || '/' || pgs.doc_id || '.md' AS source_path, page_id, page_no,
      doc_title AS title, array_to_string(path, '|') AS heading_path, level, text,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%'))), '|') AS numbers,
      doc_title || chr(10) || array_to_string(path, ' ') || chr(10) ||
        CASE WHEN regexp_matches(text, '[0-9]%') THEN array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%'))), ' ') || chr(10) ELSE '' END
        || text AS index_text
    FROM pgs JOIN t1 ON t1.doc_id = pgs.doc_id""",
)
def c7(spark, d):
    return markdown_index(spark, d)["pages"].select(
        "doc_id", "domain", "source_path", "page_id", "page_no", "title", "heading_path", "level", "text", "numbers", "index_text"
    )


@query(
    "e1_documents_idx",
    f"""WITH {TREE_SQL}, md AS (SELECT doc_id, domain, count(*) FILTER (text <> '') AS page_count, arg_min(title, toc_no) AS title,
      string_agg(repeat('#', level) || ' ' || title || CASE WHEN text = '' THEN '' ELSE chr(10) || text END, chr(10) ORDER BY toc_no) AS body
      FROM paths GROUP BY doc_id, domain)
    SELECT doc_id, domain, title, 'corpus/raw_md/' || domain || '/' || doc_id || '.md' AS source_path, page_count,
      substr(md5(body), 1, 16) AS content_hash FROM md""",
)
def e1(spark, d):
    return markdown_index(spark, d)["documents"]


@query(
    "e3_sections",
    f"""WITH {TREE_SQL}, link AS (SELECT s.section_id, p.page_id, p.page_no, p.text, p.path = s.path AS exact
      FROM secs s JOIN pgs p ON p.doc_id = s.doc_id AND len(p.path) >= len(s.path) AND p.path[1:len(s.path)] = s.path),
    ids AS (SELECT section_id, string_agg(page_id, '|' ORDER BY page_no) FILTER (exact) AS page_ids,
      string_agg(page_id, '|' ORDER BY page_no) AS descendant_page_ids FROM link GROUP BY section_id),
    shown AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY page_no) AS rn FROM (
      SELECT *, bool_or(exact) OVER (PARTITION BY section_id) AS any_exact FROM link) WHERE exact OR NOT any_exact),
    pv AS (SELECT section_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY rn), '\\s+', ' ', 'g')) AS s FROM shown WHERE rn <= 2 GROUP BY section_id)
    SELECT s.section_id, doc_id, level, title, array_to_string(path, '|') AS heading_path,
      coalesce(page_ids, '') AS page_ids, coalesce(descendant_page_ids, '') AS descendant_page_ids,
      CASE WHEN s IS NULL THEN '' WHEN length(pv.s) <= 260 THEN pv.s ELSE substr(pv.s, 1, 260) || '...' END AS preview
    FROM secs s LEFT JOIN ids ON ids.section_id = s.section_id LEFT JOIN pv ON pv.section_id = s.section_id""",
)
def e3(spark, d):
    ix = markdown_index(spark, d)
    return I.sections(ix["toc"], ix["pages"]).select(
        "section_id", "doc_id", "level", "title", "heading_path", "page_ids", "descendant_page_ids", "preview"
    )


LINKS_SQL = f"""{TREE_SQL},
up AS (SELECT c.section_id, c.doc_id, c.toc_no, a.section_id AS above, len(a.path) AS depth
  FROM secs c JOIN secs a ON a.doc_id = c.doc_id AND len(a.path) < len(c.path) AND c.path[1:len(a.path)] = a.path),
links AS (SELECT s.section_id, s.doc_id, s.toc_no, coalesce(u.parent, '') AS parent_id FROM secs s
  LEFT JOIN (SELECT section_id, arg_max(above, depth) AS parent FROM up GROUP BY section_id) u ON u.section_id = s.section_id)"""


@query(
    "e4_section_links",
    f"""WITH {LINKS_SQL} SELECT l.section_id, l.parent_id, coalesce(string_agg(c.section_id, '|' ORDER BY c.toc_no), '') AS children_ids
    FROM links l LEFT JOIN links c ON c.parent_id = l.section_id GROUP BY l.section_id, l.parent_id""",
)
def e4(spark, d):
    ix = markdown_index(spark, d)
    return I.sections(ix["toc"], ix["pages"]).select("section_id", "parent_id", "children_ids")


@query(
    "e5_section_walk",
    f"""WITH {LINKS_SQL}, seeds AS (SELECT section_id FROM secs WHERE toc_no = 3)
    SELECT doc_id, 'root' AS relation, CAST(NULL AS VARCHAR) AS seed_id, section_id FROM links WHERE parent_id = ''
    UNION ALL SELECT doc_id, 'child', parent_id, section_id FROM links WHERE parent_id IN (SELECT section_id FROM seeds)
    UNION ALL SELECT doc_id, 'ancestor', section_id, above FROM up WHERE section_id IN (SELECT section_id FROM seeds)""",
)
def e5(spark, d):
    rows = markdown_index(spark, d)["sections"]
    return I.section_walk(rows, rows.filter("toc_no = 3"))


@query(
    "e6_pages_by_heading",
    f"""WITH {TREE_SQL} SELECT doc_id, array_to_string(path, ' > ') AS heading, string_agg(page_id, '|' ORDER BY page_no) AS page_ids
    FROM pgs GROUP BY ALL HAVING heading <> ''""",
)
def e6(spark, d):
    return I.pages_by_heading(markdown_index(spark, d)["pages"])


@query(
    "e9_doc_outline",
    f"""WITH {TREE_SQL}, t1 AS (SELECT p.doc_id, max(CASE WHEN toc_no = 1 THEN title END) AS title, max(domain) AS domain,
      count(*) FILTER (text <> '') AS page_count FROM paths p GROUP BY p.doc_id),
    f AS (SELECT doc_id, path, min(page_no) AS page_no, arg_min(page_id, page_no) AS page_id FROM pgs GROUP BY doc_id, path),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS heading_no FROM f),
    c AS (SELECT doc_id, count(*) >= 10 AS headings_truncated FROM r WHERE heading_no <= 10 GROUP BY doc_id)
    SELECT domain, r.doc_id, title, page_count, heading_no, page_id, array_to_string(path, '|') AS heading_path, headings_truncated
    FROM r JOIN t1 ON t1.doc_id = r.doc_id JOIN c ON c.doc_id = r.doc_id WHERE heading_no <= 10""",
)
def e9(spark, d):
    ix = markdown_index(spark, d)
    catalog = ix["documents"].withColumn("title_fixed", F.col("title"))
    return I.doc_outline(catalog, ix["pages"], 10)


@query(
    "a10_toc_text",
    f"""WITH {TREE_SQL} SELECT doc_id, string_agg(repeat('  ', CAST(level AS INT) - 1) || '- ' || title, chr(10) ORDER BY toc_no) AS outline
    FROM paths GROUP BY doc_id""",
)
def a10(spark, d):
    return I.toc_text(markdown_index(spark, d)["toc"])


@query(
    "a11_page_preview",
    f"""WITH {TREE_SQL} SELECT doc_id, page_id, page_no, array_to_string(path, ' > ') AS heading,
      CASE WHEN length(s) <= 220 THEN s ELSE substr(s, 1, 220) || '...' END AS preview
    FROM (SELECT *, {SQUEEZE.format('text')} AS s FROM pgs)""",
)
def a11(spark, d):
    return I.page_preview(markdown_index(spark, d)["pages"]).select("doc_id", "page_id", "page_no", "heading", "preview")


@query(
    "e13_toc_for_docs",
    f"""WITH {TREE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY toc_no) AS rn FROM secs)
    SELECT doc_id, '## ' || doc_id || chr(10) || string_agg(section_id || ' | L' || level || ' | ' || array_to_string(path, ' > '), chr(10) ORDER BY toc_no) AS toc
    FROM n WHERE rn <= 20 GROUP BY doc_id""",
)
def e13(spark, d):
    ix = markdown_index(spark, d)
    return I.toc_for_docs(ix["sections"], ix["pages"], 20)


@query(
    "e2_doc_catalog",
    f"""WITH {TREE_SQL}, t1 AS (SELECT doc_id, title FROM paths WHERE toc_no = 1),
    fp AS (SELECT doc_id, count(*) AS page_count, arg_min(page_id, page_no) AS first_page_id, {SQUEEZE.format('arg_min(text, page_no)')} AS s FROM pgs GROUP BY doc_id),
    cl AS (SELECT doc_id, toc_no, level, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ,;:') AS v FROM paths),
    hd AS (SELECT doc_id, list(v ORDER BY pos) AS top FROM (
      SELECT doc_id, v, min(toc_no) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY min(toc_no)) AS rn FROM cl WHERE level <= 2 AND v <> '' GROUP BY doc_id, v)
      WHERE rn <= 60 GROUP BY doc_id),
    al AS (SELECT doc_id, list(v ORDER BY pos) AS a FROM (
      SELECT doc_id, v, min(pos) AS pos FROM (
        SELECT doc_id, v, toc_no + 10 AS pos FROM cl WHERE toc_no <= 12 UNION ALL SELECT doc_id, v, 0 FROM cl WHERE toc_no = 1
        UNION ALL SELECT DISTINCT doc_id, doc_id, 1 FROM cl) WHERE v <> '' GROUP BY doc_id, v) GROUP BY doc_id)
    SELECT t1.doc_id, t1.title, coalesce(page_count, 0) AS page_count, array_to_string(a, '|') AS aliases, coalesce(array_to_string(top, '|'), '') AS top_headings,
      coalesce(first_page_id, '') AS first_page_id, CASE WHEN s IS NULL THEN '' WHEN length(s) <= 500 THEN s ELSE substr(s, 1, 500) || '...' END AS first_page_preview
    FROM t1 LEFT JOIN fp ON fp.doc_id = t1.doc_id LEFT JOIN hd ON hd.doc_id = t1.doc_id LEFT JOIN al ON al.doc_id = t1.doc_id""",
)
def e2(spark, d):
    ix = markdown_index(spark, d)
    return I.doc_catalog(ix["documents"], ix["toc"], ix["pages"]).select(
        "doc_id", "title", "page_count", "aliases", "top_headings", "first_page_id", "first_page_preview"
    )


@query(
    "e12_doc_profile",
    f"""WITH {TREE_SQL}, t1 AS (SELECT doc_id, title AS t FROM paths WHERE toc_no = 1),
    tr AS (SELECT doc_id, string_agg(section_id || ' | L' || level || ' | ' || array_to_string(path, ' > '), chr(10) ORDER BY toc_no) AS tree FROM secs GROUP BY doc_id),
    bd AS (SELECT p.doc_id, string_agg(t || ' ' || array_to_string(path, ' > ') || ' ' || substr(text, 1, 180), ' ' ORDER BY page_no) AS b
      FROM pgs p JOIN t1 ON t1.doc_id = p.doc_id WHERE page_no <= 3 GROUP BY p.doc_id)
    SELECT t1.doc_id, substr({SQUEEZE.format("t || ' ' || t1.doc_id || ' ' || substr(tree, 1, 1200) || coalesce(' ' || b, '')")}, 1, 1400) AS profile
    FROM t1 JOIN tr ON tr.doc_id = t1.doc_id LEFT JOIN bd ON bd.doc_id = t1.doc_id""",
)
def e12(spark, d):
    ix = markdown_index(spark, d)
    trees = I.tree_text(ix["sections"])
    return I.doc_profile(ix["documents"], trees, ix["pages"], 1400).select("doc_id", "profile")


@query(
    "f8_ordinal_targets",
    f"""WITH {QUERIES_SQL}, k AS (SELECT qid, CAST(substr(qid, 2) AS BIGINT) AS n FROM qs),
    docs AS (SELECT qid, n, 'd' || (n * 3 + i) AS doc_id, i + 1 AS ord FROM k, range(3) r(i))
    SELECT qid, doc_id, ord FROM docs WHERE (n % 4 = 0 AND ord = 1) OR (n % 4 = 1 AND ord = 2) OR n % 4 IN (2, 3)""",
)
def f8(spark, d):
    """Target documents of questions that name the first, the second, both or no document."""
    marks = F.array(F.lit("第一份文档"), F.lit("第二个"), F.lit("两份"), F.lit(""))
    n = F.substring("qid", 2, 20).cast("int")
    questions = bench_queries(spark, d).select(
        "qid",
        F.concat(F.col("query"), F.element_at(marks, n % 4 + 1)).alias("query"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("d"), n * 3 + i)).alias("doc_ids"),
    )
    return Q.target_docs(questions)
