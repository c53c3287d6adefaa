"""Queries: sinks and sources, cleaning variants and the remaining segmentation modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import memory as M
from leafscan.operators import segment as S
from leafscan.plans.base import TREE_SQL, line_pages, markdown_index, query, table
from leafscan.plans.memory import sessions
from leafscan.session import new_folder
from leafscan.sources import corpus as R
from leafscan.sources import publish as P


@query("a2_read_jsonl", "SELECT doc_id, lang, length(text) AS n FROM documents")
def a2(spark, d):
    """Documents written as JSON lines with a broken line between, read back without it."""
    folder = new_folder(spark, "jsonl")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    lines = docs.select(F.explode(F.array(F.to_json(F.struct("doc_id", "lang", "text")), F.lit("{broken"), F.lit(" "))).alias("value"))
    lines.write.text(folder)
    rows = R.read_jsonl(spark, folder, "doc_id bigint, lang string, text string", "skip")
    return rows.select("doc_id", "lang", F.length("text").alias("n"))


@query("a4_write_index", f"WITH {TREE_SQL} SELECT doc_id, page_id, array_to_string(path, '|') AS heading_path FROM pgs")
def a4(spark, d):
    """Pages written as JSON and read back with their schema."""
    folder = new_folder(spark, "index")
    pages = markdown_index(spark, d)["pages"]
    P.write_index({"page_index": pages}, folder)
    return spark.read.schema(pages.schema).json(f"{folder}/page_index").select("doc_id", "page_id", "heading_path")


@query("a6_publish_index", f"WITH {TREE_SQL} SELECT domain, count(*) AS n_pages FROM pgs GROUP BY domain")
def a6(spark, d):
    """Two builds of which the second fails its check: the first stays live."""
    folder, registry = new_folder(spark, "builds"), new_folder(spark, "registry")
    ix = markdown_index(spark, d)
    tables = {"documents": ix["documents"], "pages": ix["pages"]}
    P.publish_index(spark, "all", tables, folder, "b1", "2024-01-01T00:00:00", registry)
    try:
        P.publish_index(spark, "all", {**tables, "pages": ix["pages"].filter("false")}, folder, "b2", "2024-01-02T00:00:00", registry)
    except P.PublishError:
        pass
    live = P.read_live(spark, registry, "all", "pages")
    return live.groupBy("domain").agg(F.count("*").alias("n_pages"))


@query(
    "a9_append_results",
    "SELECT item_id, length(text) AS n FROM benchmark",
)
def a9(spark, d):
    folder = new_folder(spark, "results")
    rows = table(spark, d, "benchmark").select("item_id", F.length("text").cast("bigint").alias("n"))
    P.append_results(rows.filter("item_id % 2 = 0"), folder)
    P.append_results(rows.filter("item_id % 2 = 1"), folder)
    return spark.read.schema("item_id bigint, n bigint").json(folder)


@query(
    "e7_domain_health",
    """WITH l AS (SELECT lang AS domain, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), p AS (SELECT domain, count(DISTINCT doc_id) AS d, count(*) AS n FROM l WHERE trim(x) <> '' GROUP BY domain)
    SELECT domain, d AS doc_count, n AS page_count, 'ready' AS status FROM p UNION ALL SELECT 's' || (conv_id % 7) || '_notes', 0, 0, 'needs_build' FROM conversations WHERE conv_id % 7 > 2 GROUP BY conv_id % 7""",
)
def e7(spark, d):
    """Languages are built domains; a few session classes are registered but not built."""
    pages = line_pages(spark, d)
    n = F.substring("session_id", 2, 9).cast("int") % 7
    events = sessions(spark, d).select(
        F.concat(F.lit("s"), n, F.lit("_notes")).alias("domain"), F.lit(1).alias("ts"), F.when(n > 2, "create").otherwise("file").alias("kind"),
        F.lit("Notes").alias("name"), F.lit("heading").alias("mode"), F.lit("u1").alias("owner_id"),
    )
    registry = P.registry_state(events)
    files = events.select("domain")
    return P.domain_health(registry, pages.select("domain", "doc_id").distinct(), pages, files, "u1").select("domain", "doc_count", "page_count", "status")


@query(
    "e15_registry_state",
    """WITH e AS (SELECT 'dom_' || lower(CASE WHEN user_id % 10 = 0 THEN 'X!' ELSE CAST(user_id AS VARCHAR) END) AS domain, event_id AS ts,
      CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'build' ELSE 'file' END AS kind FROM events)
    SELECT domain, CASE arg_max(kind, ts) WHEN 'build' THEN 'ready' ELSE 'needs_build' END AS status, CAST(max(CASE WHEN kind = 'build' THEN ts END) AS DOUBLE) AS last_built_at
    FROM e WHERE domain <> 'dom_x!' GROUP BY domain HAVING bool_or(kind = 'create')""",
)
def e15(spark, d):
    name = F.lower(F.when(F.col("user_id") % 10 == 0, "X!").otherwise(F.col("user_id").cast("string")))
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "build").otherwise("file")
    events = table(spark, d, "events").select(
        F.concat(F.lit("dom_"), name).alias("domain"), F.col("event_id").alias("ts"), kind.alias("kind"), F.lit("N").alias("name"), F.lit("block").alias("mode"), F.lit("u").alias("owner_id")
    )
    return P.registry_state(events).select("domain", "status", F.col("last_built_at").cast("double").alias("last_built_at"))


# --- cleaning ---------------------------------------------------------------------

# letters become frequent characters, so that every document has a wide twin
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WIDE = "的第公司发行规券信息报告中国有人大不为在了是我他定这"
BROKEN = f"translate(lower(text), '{LETTERS}', '{WIDE}') || '的第'"


def wide_text():
    # two frequent characters at the end, so that every repair pays off
    return F.concat(F.translate(F.lower("text"), LETTERS, WIDE), F.lit("的第"))


def broken(c):
    """UTF-8 bytes read as GB18030."""
    return F.decode(F.encode(c, "UTF-8"), "GB18030")


@query("b1_repair", f"SELECT doc_id, regexp_replace({BROKEN}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g') AS text FROM documents")
def b1(spark, d):
    """Wide documents broken in pairs of characters (six bytes, which always decode) and repaired."""
    only = F.regexp_replace(wide_text(), f"[^{X.CJK}]", "")
    docs = table(spark, d, "documents").select("doc_id", only.alias("text"))
    pairs = F.transform(F.regexp_extract_all("text", F.lit("(?s)..?"), F.lit(0)), lambda p: broken(F.when(F.length(p) == 2, p).otherwise(F.concat(p, F.lit("的")))))
    odd = F.length("text") % 2 == 1
    rows = docs.select("doc_id", odd.alias("odd"), F.array_join(pairs, "").alias("bad"))
    fixed = X.repair("bad")
    return rows.select("doc_id", F.when(F.col("odd"), F.substring(fixed, F.lit(1), F.length(fixed) - 1)).otherwise(fixed).alias("text"))


@query(
    "b2_normalize_text",
    r"""SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[ \t]+', ' ', 'g')), '\s*\n\s*', chr(10) || chr(10), 'g') || chr(10) || chr(10) || '[details: note]' || chr(10) || 'body' AS text FROM documents""",
)
def b2(spark, d):
    """Documents with comments, images, blank runs and a folded note put in, normalised again."""
    clean = F.regexp_replace(F.trim(F.regexp_replace("text", "[ \t]+", " ")), r"\s*\n\s*", "\n")
    dirty = F.concat(
        F.lit("<!-- head\n -->\n"), F.regexp_replace(clean, "\n", " ![i](u) \n\n<!-- x -->\n \n"), F.lit("<details><summary> note </summary> body\n</details>\n")
    )
    return table(spark, d, "documents").select("doc_id", X.normalize_text(dirty).alias("text"))


@query("b4_html_text")
def b4(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_text("html").alias("text"))


@query("b7_repair_nested", "SELECT doc_id, source, lang FROM documents")
def b7(spark, d):
    docs = table(spark, d, "documents")
    nested = docs.select("doc_id", F.struct(F.array("source").alias("a"), F.create_map(F.lit("k"), "lang").alias("m")).alias("s"))
    return X.repair_nested(nested).select("doc_id", F.col("s.a")[0].alias("source"), F.col("s.m")["k"].alias("lang"))


# --- segmentation ------------------------------------------------------------------


def numbered_docs(spark, d):
    """Documents as one heading and their sentences as a numbered outline of three forms."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "num")
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", r"\s+", " "), r"\. "), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(
        parts,
        lambda x, i: F.when(i % 5 == 0, F.concat((i + 1).cast("string"), F.lit("、"), x, F.lit("：")))
        .when(i % 5 == 3, F.concat(F.lit("1."), (i + 1).cast("string"), F.lit(" "), x))
        .when(i % 5 == 4, x)
        .otherwise(F.concat(F.lit("（"), (i % 5).cast("string"), F.lit("）"), x)),
    )
    return docs.select(F.concat(F.lit("d"), "num").alias("doc_id"), F.concat(F.lit("# H\n"), F.array_join(marked, "\n")).alias("text"), marked.alias("marked"))


NUMBERED_SQL = """
ns AS (SELECT 'd' || doc_id AS doc_id, trim(x) AS x, pos FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), '. ')) AS x,
  generate_subscripts(string_split(regexp_replace(text, '\\s+', ' ', 'g'), '. '), 1) AS pos FROM documents) WHERE trim(x) <> ''),
ni AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM ns),
nm AS (SELECT *, CASE i % 5 WHEN 0 THEN (i + 1) || '、' || x || '：' WHEN 3 THEN '1.' || (i + 1) || ' ' || x WHEN 4 THEN x ELSE '（' || (i % 5) || '）' || x END AS line FROM ni)"""


@query(
    "c2_split_numbered",
    f"""WITH {NUMBERED_SQL}, lv AS (SELECT doc_id, i, line, CASE i % 5 WHEN 0 THEN 2 WHEN 3 THEN 3 WHEN 1 THEN 3 ELSE 2 END AS level FROM nm WHERE i % 5 < 4)
    SELECT doc_id, i - i // 5 + 2 AS toc_no, CAST(level AS BIGINT) AS level, line AS title,
      'H' || CASE WHEN i % 5 = 1 THEN '|' || lag(line) OVER (PARTITION BY doc_id ORDER BY i) WHEN i % 5 = 3 THEN '|' || lag(line) OVER (PARTITION BY doc_id ORDER BY i) ELSE '' END || '|' || line AS heading_path FROM lv
    UNION ALL SELECT DISTINCT doc_id, 1, 1, 'H', 'H' FROM nm""",
)
def c2(spark, d):
    toc, _ = S.split_numbered(numbered_docs(spark, d).drop("marked"))
    return toc


@query("c3_split_legal")
def c3(spark, d):
    """The same sentences as chapters, sections, articles and list items."""
    docs = numbered_docs(spark, d)
    legal = F.transform(
        "marked",
        lambda x, i: F.when(i % 20 == 0, F.concat(F.lit("第"), (F.floor(i / 20) + 1).cast("string"), F.lit("章 总则")))
        .when(i % 10 == 0, F.lit("第一节 范围")).when(i % 10 == 5, F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("条 "), F.substring(x, 1, 20))).otherwise(x),
    )
    toc, _ = S.split_legal(docs.select("doc_id", F.array_join(legal, "\n").alias("text")))
    return toc


@query(
    "c4_split_blocks",
    f"""WITH {NUMBERED_SQL}, b AS (SELECT doc_id, i // 3 AS g, CASE WHEN (i // 3) % 2 = 1 THEN 'table' ELSE 'text' END AS kind, string_agg(CASE WHEN (i // 3) % 2 = 1 THEN '| ' || i || ' | x |' ELSE 't ' || line END, chr(10) ORDER BY i) AS text
      FROM nm GROUP BY ALL) SELECT doc_id, kind, text, 'H' AS heading_path FROM b""",
)
def c4(spark, d):
    """Three lines of text, three of a table, and so on."""
    docs = numbered_docs(spark, d)
    mixed = F.transform("marked", lambda x, i: F.when(F.floor(i / 3) % 2 == 1, F.concat(F.lit("| "), i.cast("string"), F.lit(" | x |"))).otherwise(F.concat(F.lit("t "), x)))
    _, blocks = S.split_blocks(docs.select("doc_id", F.concat(F.lit("# H\n"), F.array_join(mixed, "\n")).alias("text")))
    return blocks.select("doc_id", "kind", "text", "heading_path")


@query("c5_split_corpus")
def c5(spark, d):
    """All split modes in one corpus, by document number; text files are legal text whatever their mode."""
    docs = numbered_docs(spark, d)
    n = F.substring("doc_id", 2, 20).cast("int") % 4
    mode = F.element_at(F.array(*[F.lit(m) for m in ("heading", "heading_plus_numbered", "block", "heading")]), n + 1)
    rows = docs.select("doc_id", "text", mode.alias("mode"), F.concat("doc_id", F.when(n == 3, ".txt").otherwise(".md")).alias("source_path"))
    return S.blocks_of(S.split_corpus(rows)).select("doc_id", "mode", "kind", "text", "heading_path")


@query(
    "c6_pack",
    """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents),
    w AS (SELECT doc_id, s, unnest(range(0, greatest(length(s) - 160, 1), 1640)) AS st FROM t WHERE length(s) > 1800)
    SELECT doc_id, CAST(st // 1640 AS BIGINT) AS part_index, substr(s, CAST(st + 1 AS BIGINT), 1800) AS part FROM w UNION ALL SELECT doc_id, 0, s FROM t WHERE length(s) <= 1800""",
)
def c6(spark, d):
    """Documents without paragraphs: long ones become overlapping windows."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.pack(X.squeeze("text"))).alias("part_index", "part"))


BLANK_LINE, EDGE = r"\n\s*\n", r"^\s+|\s+$"


@query(
    "c6_pack_paragraphs",
    f"""WITH RECURSIVE src AS (SELECT doc_id, regexp_replace(text, '\\. ', '.' || chr(10) || chr(10), 'g') AS t FROM documents),
    raw AS (SELECT doc_id, unnest(string_split_regex(t, '{BLANK_LINE}')) AS x, generate_subscripts(string_split_regex(t, '{BLANK_LINE}'), 1) AS pos FROM src WHERE length(t) > 1800),
    par AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, regexp_replace(x, '{EDGE}', '', 'g') AS p FROM raw WHERE regexp_replace(x, '{EDGE}', '', 'g') <> ''),
    off AS (SELECT *, length(p) AS len, sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2 AS st, count(*) OVER (PARTITION BY doc_id) AS n FROM par),
    nxt AS (SELECT a.doc_id, a.i, coalesce(min(b.i), any_value(a.n)) AS nx FROM off a LEFT JOIN off b ON b.doc_id = a.doc_id AND b.i > a.i AND b.st + b.len > a.st + 1800 GROUP BY a.doc_id, a.i),
    orbit AS (SELECT doc_id, i, nx FROM nxt WHERE i = 0 UNION ALL SELECT x.doc_id, x.i, x.nx FROM orbit o JOIN nxt x ON x.doc_id = o.doc_id AND x.i = o.nx),
    parts AS (SELECT o.doc_id, o.i, 0 AS st, string_agg(f.p, chr(10) || chr(10) ORDER BY f.i) AS part FROM orbit o JOIN off f ON f.doc_id = o.doc_id AND f.i >= o.i AND f.i < o.nx
      GROUP BY o.doc_id, o.i HAVING max(f.len) <= 1800
      UNION ALL SELECT doc_id, i, st, substr(p, CAST(st + 1 AS BIGINT), 1800) FROM (
        SELECT o.doc_id, o.i, f.p, unnest(range(0, greatest(f.len - 160, 1), 1640)) AS st FROM orbit o JOIN off f ON f.doc_id = o.doc_id AND f.i = o.i WHERE f.len > 1800))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, st) - 1 AS part_index, part FROM parts
    UNION ALL SELECT doc_id, 0, t FROM src WHERE length(t) <= 1800""",
)
def c6_paragraphs(spark, d):
    """Every sentence a paragraph: parts are packed greedily."""
    text = F.regexp_replace("text", r"\. ", ".\n\n")
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.pack(text)).alias("part_index", "part"))


@query(
    "d19_memory_terms",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(CASE WHEN length(s) <= 1200 THEN s ELSE rtrim(substr(s, 1, 1197)) || '...' END), '[a-z0-9]{2,}'),
      lambda w: w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'what', 'which', 'how', 'why') AND NOT regexp_matches(w, '^(pack|text)')))), '|') AS terms
    FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)""",
)
def d19(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(M.memory_terms("text")).alias("terms"))
