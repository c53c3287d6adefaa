"""Queries: typed terms, payloads, names and entities, supplementary pages, missing slots, audit reading and period tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import payload as P
from leafscan.functions import text as X
from leafscan.operators import audit as A
from leafscan.operators import entities as N
from leafscan.operators import evidence as V
from leafscan.operators import review as W
from leafscan.operators import rewrite as R
from leafscan.operators import routing as G
from leafscan.operators import search as Q
from leafscan.operators import supplement as S
from leafscan.plans.base import query, table
from leafscan.plans.evaluate import ORDERS_SQL, order_pages
from leafscan.plans.evidence import tokens_sql
from leafscan.plans.evidence import CONTRACT_SQL, amounts, contract_evidence, contract_queries
from leafscan.plans.review import NOTES_SQL, id_lists, notes
from leafscan.plans.routing import PROFILE_SQL, RUNS, SIGN, sign, supplier_questions

CJK = r"\x{4e00}-\x{9fff}"


def values(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def hits_sql(text: str, words) -> str:
    return f"len(list_filter({values(words)}, lambda w: contains({text}, w)))"


def any_sql(text: str, words) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


# --- D22, D23 ----------------------------------------------------------------------


def terms_sql(source: str, out: str, n: int) -> str:
    """Typed terms ``out(id, terms)`` of ``source(id, pos, text)``."""
    blank = "\\s"
    spans = [
        r"(?:19|20)[0-9]{2}\s*[-至]\s*(?:19|20)?[0-9]{2}\s*年?", r"(?:19|20)[0-9]{2}\s*年(?:\s*1\s*[-至]\s*6\s*月)?", r"(?:19|20)[0-9]{2}", r"[0-9]+\s*[-至]\s*[0-9]+\s*月",
    ]
    bare = "regexp_replace(trim(x), '^(?:查找|查询|获取|确定)', '')"
    for span in spans:
        bare = f"regexp_replace({bare}, '{span}', '', 'g')"
    period = r"^(?:20[0-9]{2}|19[0-9]{2}|第\s*[0-9]+\s*个?\s*[年月日]|[0-9]+\s*[-至]\s*[0-9]+\s*月)$"
    return f"""
{out}_s AS (SELECT id, pos, text, regexp_replace(text, '[，。；;：:（）()《》“”"''?？{blank}]+', ' ', 'g') AS t FROM {source}),
{out}_x AS (SELECT id, pos, list_concat(list_concat(regexp_extract_all(t, '[^{blank}的]{{1,18}}(?:{E.ENTITY_ENDINGS})'),
    flatten(list_transform(string_split_regex(t, '[的{blank}]+'), lambda p: regexp_extract_all(p, '[{CJK}A-Za-z0-9]{{2,16}}(?:{E.METRIC_ENDINGS})')))),
    string_split_regex(text, '[{blank},，、；;：:（）()《》“”"''?？]+')) AS xs FROM {out}_s),
{out}_u AS (SELECT id, pos, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM {out}_x),
{out}_b AS (SELECT id, trim({bare}) AS term, pos, i FROM {out}_u),
{out}_f AS (SELECT id, term, min(struct_pack(p := pos, i := i)) AS place FROM {out}_b WHERE length(term) BETWEEN 2 AND 24 AND NOT regexp_matches(term, '{period}')
  AND NOT regexp_matches(term, '{E.NO_TERM}') GROUP BY id, term),
{out} AS (SELECT id, list(term ORDER BY place) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS rn FROM {out}_f) WHERE rn <= {n} GROUP BY id)"""


@query(
    "d22_typed_terms",
    f"""WITH {ORDERS_SQL}, src AS (SELECT page_id AS id, 1 AS pos, replace(text, '账期', '业务 账期') AS text FROM op), {terms_sql('src', 'tt', 12)}
    SELECT op.page_id, coalesce(array_to_string(terms, '|'), '') AS terms FROM op LEFT JOIN tt ON tt.id = op.page_id""",
)
def d22(spark, d):
    text = F.replace("text", F.lit("账期"), F.lit("业务 账期"))
    return order_pages(spark, d).select("page_id", E.typed_terms(F.array(text)).alias("terms"))


@query("d23_payloads", "SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations")
def d23(spark, d):
    """Every turn as a reply of one of four forms, read back: fenced, loose with braces around, below a heading, and values after labels."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    body = F.to_json(F.struct("text", F.struct("role", F.lit('a "{" in a string').alias("note")).alias("who")))
    form = F.col("turn") % 4
    reply = (
        F.when(form == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 1, F.concat(F.lit("The reply follows.\n"), body, F.lit("\nSee {below} or }.")))
        .when(form == 2, F.concat(F.lit("# Log\n## Unit Results\n```json\n"), body, F.lit("\n```\n## End")))
        .otherwise(F.concat(F.lit("note: "), body, F.lit("\nrole: `"), "role", F.lit("`")))
    )
    rows = rows.select("conv_id", "turn", form.alias("form"), reply.alias("reply"))
    found = F.when(F.col("form") == 2, P.json_block(F.col("reply"), "## Unit Results")).otherwise(P.json_object(F.col("reply")))
    read = F.from_json(found, "text string, who struct<role:string,note:string>")
    role = F.when(F.col("form") == 3, P.backtick_value(F.col("reply"), r"\nrole")).otherwise(F.col("r.who.role"))
    return rows.withColumn("r", read).select("conv_id", "turn", role.alias("role"), F.col("r.text").alias("text"))


# --- G9, G10 -------------------------------------------------------------------------

SUPPLIERS_SQL = f"sup AS (SELECT s_suppkey AS k, 's' || s_suppkey AS doc_id, {SIGN.format('s_suppkey')} AS sign, s_nationkey AS nation, (SELECT count(*) FROM supplier) AS n FROM supplier)"
CITIES = ("北京", "上海", "深圳")


def suppliers(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("k"), F.concat(F.lit("s"), k).alias("doc_id"), sign(k).alias("sign"), F.col("s_nationkey").alias("nation"))


def supplier_names(spark, d):
    """A title with the legal form, an alias with a city, and aliases that name nothing."""
    s = suppliers(spark, d)
    city = F.element_at(F.array(*[F.lit(c) for c in CITIES]), (F.col("k") % 3 + 1).cast("int"))
    listed = F.array(
        F.concat("sign", F.lit("股份有限公司")), F.concat(city, "sign", F.lit("集团")), F.lit("募集说明书 有限公司"), F.concat(F.lit("一、"), "sign", F.lit("公司"))
    )
    return s.select("doc_id", F.posexplode(listed).alias("pos", "name"))


@query(
    "g9_identity_match",
    f"""WITH {SUPPLIERS_SQL},
    cl AS (SELECT 'c' || c_custkey AS qid, c_custkey AS c, '关于' || {SIGN.format('c_custkey % (SELECT count(*) FROM supplier) + 1')} ||
        CASE c_custkey % 4 WHEN 0 THEN '股份有限公司' WHEN 1 THEN '集团' WHEN 2 THEN '' ELSE '年报' END || '的账期' AS claim FROM customer),
    ca AS (SELECT qid, claim, s.doc_id, s.k, s.sign, o + 1 AS ord FROM cl, range(4) r(o) JOIN sup s ON s.k = (cl.c + o) % s.n + 1),
    hit AS (SELECT *, sign || '股份有限公司' AS n1, ['北京', '上海', '深圳'][k % 3 + 1] || sign || '集团' AS n2 FROM ca),
    sc AS (SELECT qid, doc_id, ord, CASE WHEN contains(claim, n1) OR contains(claim, sign) THEN least(18.0, greatest(8.0, length(n1) / 1.2)) ELSE 0 END
      + CASE WHEN contains(claim, n2) OR contains(claim, ['北京', '上海', '深圳'][k % 3 + 1] || sign) THEN least(18.0, greatest(8.0, length(n2) / 1.2)) ELSE 0 END AS score FROM hit),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank, max(score) OVER (PARTITION BY qid) AS best FROM sc WHERE score > 0)
    SELECT qid, doc_id, round(score, 3) AS score, rank FROM r WHERE rank <= 3 AND score >= 8 AND score >= best * 0.6""",
)
def g9(spark, d):
    """Every customer's claim names a supplier in one of four forms; it and the next three are candidates."""
    s = suppliers(spark, d)
    n = table(spark, d, "supplier").count()
    c = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    form = F.element_at(F.array(F.lit("股份有限公司"), F.lit("集团"), F.lit(""), F.lit("年报")), (k % 4 + 1).cast("int"))
    claims = c.select(F.concat(F.lit("c"), k).alias("qid"), F.concat(F.lit("关于"), sign(k % n + 1), form, F.lit("的账期")).alias("claim"))
    offsets = F.explode(F.sequence(F.lit(0), F.lit(3)))
    near = c.select(F.concat(F.lit("c"), k).alias("qid"), k, offsets.alias("o")).select("qid", (F.col("o") + 1).alias("ord"), F.pmod(k + F.col("o"), F.lit(n)) + 1)
    candidates = near.toDF("qid", "ord", "k").join(s.select("k", "doc_id"), "k").select("qid", "doc_id", "ord")
    found = N.identity_match(claims, candidates, supplier_names(spark, d))
    return found.select("qid", "doc_id", F.round("score", 3).alias("score"), "rank")


PROFILE_TAILS = ("核心技术 功耗 降低", "性能 稳定 龙头", "行业 一般", "费用 效率 自主")


def entity_questions(spark, d):
    """Each nation compares its first six suppliers; every fifth nation asks nothing that they have in common."""
    s = suppliers(spark, d).withColumn("ord", Q.rank_by(["nation"], F.col("k")))
    first = s.filter("ord <= 6").groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("ord", "sign"))).alias("m"))
    names = F.transform("m", lambda x: x["sign"])
    listed = F.concat(F.array_join(F.slice(names, 1, 2), "、"), F.when(F.size(names) > 2, F.concat(F.lit("和"), F.array_join(F.slice(names, 3, 6), "，"))).otherwise(""))
    ask = F.when(F.col("nation") % 5 == 0, "怎样？").otherwise("性能与成本的共同规律是什么？")
    questions = first.select(
        F.concat(F.lit("n"), "nation").alias("qid"), F.concat(F.lit("在"), listed, F.lit("领域中，"), ask).alias("question"), F.lit("").alias("claim"), F.size("m").alias("members")
    )
    candidates = s.select(F.concat(F.lit("n"), "nation").alias("qid"), "doc_id", "ord")
    tail = F.element_at(F.array(*[F.lit(t) for t in PROFILE_TAILS]), (F.col("k") % 4 + 1).cast("int"))
    profiles = s.select("doc_id", F.concat_ws(" ", "sign", tail).alias("profile"))
    return questions, candidates, profiles


GRAMS = "list_distinct(list_concat([s], list_concat(list_transform(range(1, 8), lambda i: s[i:i + 1]), list_transform(range(1, 7), lambda i: s[i:i + 2]))))"


@query(
    "g10_entity_docs",
    f"""WITH {SUPPLIERS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY k) AS ord, {values(PROFILE_TAILS)}[k % 4 + 1] AS tail FROM sup),
    e AS (SELECT nation, ord AS entity_no, sign FROM o WHERE ord <= 6 AND nation % 5 <> 0 AND (SELECT count(*) FROM o p WHERE p.nation = o.nation) >= 2),
    g AS (SELECT k, sign AS s, {GRAMS.replace('s[', 'sign[').replace('[s]', '[sign]')} AS toks FROM o),
    ge AS (SELECT e.*, g.toks FROM e JOIN g ON g.s = e.sign),
    sc AS (SELECT ge.nation, entity_no, ge.sign, o.doc_id, o.ord,
      CASE WHEN o.sign = ge.sign THEN 12 ELSE 0 END + 2 * len(list_intersect(ge.toks, g.toks))
      + CASE WHEN regexp_matches(o.tail, '费用|降低|功耗|成本|节约') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(o.tail, '性能|效率|稳定') THEN 2 ELSE 0 END
      + least(6.0, coalesce(list_max(list_filter(range(4, 9), lambda z: len(list_filter(range(1, 10 - z), lambda i: contains(o.sign, ge.sign[i:i + z - 1]))) > 0)), 0) / 2) AS score
      FROM ge JOIN o ON o.nation = ge.nation JOIN g ON g.k = o.k),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation, entity_no ORDER BY score DESC, ord) AS rank FROM sc) WHERE rank = 1 AND score >= 8),
    w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY nation, doc_id ORDER BY entity_no) = 1 THEN 1 ELSE 0 END AS fresh FROM b),
    c AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY nation ORDER BY entity_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
    SELECT 'n' || nation AS qid, entity_no, sign AS entity, doc_id, round(CAST(score AS DOUBLE), 3) AS score FROM c WHERE before < 4""",
)
def g10(spark, d):
    questions, candidates, profiles = entity_questions(spark, d)
    return N.entity_docs(questions, candidates, profiles)


# --- F31 -------------------------------------------------------------------------------

EXTRAS = ("", "降本 费用", "提质 性能 同步 成本", "单位成本 技术 工艺", "目录 成本 性能")
AXIS_QUERY = "如何 降低 成本 提升 性能 核心 技术"


def axis_notes(spark, d):
    """Contract notes with wording of cost, quality or mechanism by number; every eleventh is a key-figure table."""
    p = order_pages(spark, d)
    extra = F.element_at(F.array(*[F.lit(e) for e in EXTRAS]), (F.col("page_no") % 5 + 1).cast("int"))
    heading = F.when(F.col("page_no") % 11 == 0, F.array(F.lit("主要会计数据"))).otherwise(F.col("heading_path"))
    text = F.concat_ws(" ", extra, "text")
    return p.withColumn("heading_path", heading).withColumn("text", text).withColumn("index_text", text)


AXIS_SQL = f"""{ORDERS_SQL},
ap AS (SELECT doc_id, page_id, page_no, title, CASE WHEN page_no % 11 = 0 THEN '主要会计数据' ELSE '合同 > ' || status END AS heading,
  {values(EXTRAS)}[page_no % 5 + 1] || ' ' || text AS text FROM op)"""


@query(
    "f31_key_figures",
    f"""WITH {AXIS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS n FROM ap),
    t AS (SELECT doc_id, arg_min(page_id, n) AS page_id FROM f WHERE n <= 80 AND page_no % 11 = 0 GROUP BY doc_id)
    SELECT 'q' || doc_id AS qid, page_id AS evidence_id, 'initial_metric' AS source FROM t WHERE CAST(substr(doc_id, 2) AS BIGINT) % 3 <> 0""",
)
def f31_figures(spark, d):
    """Two thirds of the customers are asked for a metric."""
    pages = axis_notes(spark, d)
    docs = pages.select("doc_id").distinct()
    ask = F.when(F.substring("doc_id", 2, 9).cast("int") % 3 == 0, "账期是多少").otherwise("研发投入是多少")
    requests = docs.select(F.concat(F.lit("q"), "doc_id").alias("qid"), "doc_id", ask.alias("query"))
    return S.key_figure_pages(requests, pages).select("qid", "evidence_id", "source")


def axis_sql(kind: str, other, most: int, each: float, summary: float, low: float, query_text: str) -> str:
    together = "+ CASE WHEN contains(text, '同步') THEN 3 ELSE 0 END" if kind == "quality" else ""
    return f"""WITH {AXIS_SQL}, qx AS (SELECT 'q' AS id, '{query_text}' AS text), sx AS (SELECT page_id AS id, heading || ' ' || title || ' ' || text || ' ' || text AS text FROM ap),
    {tokens_sql('qx', 'qk')}, {tokens_sql('sx', 'sk')},
    ov AS (SELECT sk.id, count(*) AS n FROM sk JOIN qk ON qk.tok = sk.tok GROUP BY sk.id),
    sc AS (SELECT doc_id, page_id, page_no, 8.0 * least({hits_sql('text', S.COST_TERMS)}, 3) + {each} * least({hits_sql("heading || text", other)}, {most})
      + CASE WHEN {any_sql('text', S.UNIT_COSTS)} THEN 6 ELSE 0 END {together} - CASE WHEN contains(text, '目录') THEN {low} ELSE 0 END + 1.2 * coalesce(ov.n, 0) AS score
      FROM ap LEFT JOIN ov ON ov.id = ap.page_id WHERE {hits_sql('text', S.COST_TERMS)} > 0 AND {hits_sql("heading || text", other)} > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, page_no) AS rank FROM sc WHERE score > 0)
    SELECT 'q' || doc_id AS qid, page_id AS evidence_id, round(CAST(score AS DOUBLE), 3) AS score, rank FROM r WHERE rank <= 2"""


def axis_requests(pages):
    return pages.select("doc_id").distinct().select(F.concat(F.lit("q"), "doc_id").alias("qid"), "doc_id", F.lit(AXIS_QUERY).alias("query"))


@query("f31_cost_quality", axis_sql("quality", S.QUALITY_TERMS, 3, 8.0, 6.0, 10.0, f"{AXIS_QUERY} {S.BOTH_AXES}"))
def f31_quality(spark, d):
    pages = axis_notes(spark, d)
    found = S.axis_pages(axis_requests(pages), pages, "quality", "dual_axis", 2)
    return found.select("qid", "evidence_id", F.round("score", 3).alias("score"), "rank")


@query("f31_cost_mechanism", axis_sql("mechanism", S.MECHANISM_TERMS, 4, 6.0, 4.0, 12.0, AXIS_QUERY))
def f31_mechanism(spark, d):
    pages = axis_notes(spark, d)
    found = S.axis_pages(axis_requests(pages), pages, "mechanism", "cost_mechanism", 2)
    return found.select("qid", "evidence_id", F.round("score", 3).alias("score"), "rank")


# --- F32, H17 ----------------------------------------------------------------------------


def missing_slots(spark, d):
    """Three slots per customer: a share, a term of days and a metric; the last wants another document for every fourth."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("qid"))
    k = F.col("c_custkey")
    rows = F.array(
        F.struct(F.lit(1).alias("slot_no"), F.lit("违约金比例").alias("slot"), F.concat(k % 5 + 1, F.lit("% 附表")).alias("query"), F.lit("").alias("target")),
        F.struct(F.lit(2).alias("slot_no"), F.lit("账期").alias("slot"), F.concat(k % 90 + 1, F.lit("天 支付")).alias("query"), F.lit("").alias("target")),
        F.struct(F.lit(3).alias("slot_no"), F.lit("营业收入").alias("slot"), F.lit("研发投入 计收").alias("query"), F.when(k % 4 == 0, "nowhere").otherwise("").alias("target")),
    )
    return c.select("qid", F.explode(rows).alias("r")).select(
        "qid", "r.slot_no", "r.slot", F.lit("").alias("followup_query"), "r.query", F.array("r.target").alias("target_doc_ids")
    )


MISSING_SQL = f"""{NOTES_SQL},
ms AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS qid, n AS slot_no, c_custkey % 4 = 0 AND n = 3 AS elsewhere,
  CASE n WHEN 1 THEN '违约金比例  ' || (c_custkey % 5 + 1) || '% 附表' WHEN 2 THEN '账期  ' || (c_custkey % 90 + 1) || '天 支付' ELSE '营业收入  研发投入 计收' END AS text
  FROM customer, (VALUES (1), (2), (3)) v(n)),
mq AS (SELECT qid || '/' || slot_no AS id, text FROM ms), me AS (SELECT evidence_id AS id, qid || ' 合同 ' || status || ' ' || text AS text FROM ev),
{tokens_sql('mq', 'mqt')}, {tokens_sql('me', 'met')},
mp AS (SELECT string_split(id, '/')[1] AS qid, string_split(id, '/')[2] AS slot_no, part, worth FROM (
  SELECT id, tok AS part, 2 AS worth FROM mqt WHERE length(tok) >= 2 UNION ALL SELECT DISTINCT id, chr(1) || unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?')), 1 FROM mq)),
mr AS (SELECT string_split(id, '_lp_')[1] AS qid, id, part FROM (
  SELECT id, tok AS part FROM met UNION ALL SELECT DISTINCT id, chr(1) || unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?')) FROM me)),
sh AS (SELECT mp.qid, slot_no, mr.id, sum(worth) AS shared FROM mp JOIN mr ON mr.qid = mp.qid AND mr.part = mp.part GROUP BY ALL),
mh AS (SELECT ms.qid, ms.slot_no, ev.evidence_id, ev.ord, ev.source, ms.text AS asked, ev.text AS body, shared
  FROM sh JOIN ms ON ms.qid = sh.qid AND CAST(ms.slot_no AS VARCHAR) = sh.slot_no JOIN ev ON ev.evidence_id = sh.id WHERE NOT elsewhere),
mc AS (SELECT *, shared + 4.0 * len(list_filter(METRICS, lambda m: contains(asked, m) AND contains(body, m))) AS score FROM mh),
mb AS (SELECT qid, evidence_id, min(struct_pack(l := -score, s := slot_no, o := ord)) AS b FROM mc GROUP BY ALL),
mm AS (SELECT qid, evidence_id, -b.l AS score, row_number() OVER (PARTITION BY qid ORDER BY b.l, b.s, b.o) AS rank FROM mb)""".replace("METRICS", values(S.V.METRICS))


@query("f32_match_missing", f"WITH {MISSING_SQL} SELECT qid, evidence_id, CAST(score AS DOUBLE) AS score, rank FROM mm WHERE rank <= 4")
def f32(spark, d):
    return S.match_missing(missing_slots(spark, d), notes(spark, d))


@query(
    "f32_metric_candidates",
    f"""WITH {NOTES_SQL}, h AS (SELECT *, source = 'initial' AS early FROM ev WHERE regexp_matches(text, '签订日期为199[5-9]|20[0-9]{{2}}年12月31日')),
    s AS (SELECT qid, evidence_id, ord, CAST(10 + CASE WHEN early THEN 2 ELSE 0 END AS DOUBLE) AS score FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM s)
    SELECT qid, evidence_id, score, rank FROM r WHERE rank <= 6 AND CAST(substr(qid, 2) AS BIGINT) % 2 = 0""",
)
def f32_metrics(spark, d):
    """Even customers ask for the share of two metrics that every note names; later notes count as tables, odd ones ask for none."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("qid"))
    ask = F.when(F.col("c_custkey") % 2 == 0, "研发投入占营业收入的比例").otherwise("账期")
    e = notes(spark, d).withColumn("text", F.regexp_replace("text", "签订日期为199([5-9])", "签订日期为202$1"))
    return S.metric_candidates(c.select("qid", ask.alias("query"), F.lit(None).cast("array<string>").alias("target_doc_ids")), e)


@query(
    "h17_audit_reading",
    f"""WITH {MISSING_SQL}, nm AS (SELECT qid, evidence_id, min(struct_pack(t := t, p := p)) AS place FROM (
      SELECT qid, evidence_id, 1 AS t, min(pos) AS p FROM ls WHERE kind = 'new' GROUP BY ALL UNION ALL SELECT qid, evidence_id, 2, rank FROM mm WHERE rank <= 4) GROUP BY ALL),
    kp AS (SELECT DISTINCT qid, evidence_id FROM ls WHERE kind = 'slot'),
    fr AS (SELECT nm.*, kp.qid IS NULL AS fresh, bool_or(kp.qid IS NULL) OVER (PARTITION BY nm.qid) AS any_fresh FROM nm LEFT JOIN kp ON kp.qid = nm.qid AND kp.evidence_id = nm.evidence_id),
    ch AS (SELECT * FROM fr WHERE (fresh OR NOT any_fresh) AND qid IN (SELECT qid FROM kp)),
    rd AS (SELECT ch.qid, ch.evidence_id, row_number() OVER (PARTITION BY ch.qid ORDER BY place, ev.ord) AS reading_no FROM ch JOIN ev ON ev.qid = ch.qid AND ev.evidence_id = ch.evidence_id
      UNION ALL SELECT qid, evidence_id, review_no FROM ro WHERE qid NOT IN (SELECT qid FROM ch))
    SELECT qid, evidence_id, reading_no FROM rd WHERE reading_no <= 6""",
)
def h17(spark, d):
    e = notes(spark, d)
    return S.audit_reading(e, id_lists(e), missing_slots(spark, d)).select("qid", "evidence_id", "reading_no")


@query(
    "h17_decisive",
    f"""WITH {ORDERS_SQL}, sn AS (SELECT doc_id AS qid, string_agg(text, chr(10)) AS t FROM op WHERE page_no % 2 = 0 GROUP BY doc_id),
    q AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS qid, CASE c_custkey % 3 WHEN 0 THEN ['客户', '支付', '仲裁', '诉讼'] WHEN 1 THEN ['客户', '仲裁', '诉讼'] ELSE [] END AS w FROM customer)
    SELECT q.qid, coalesce(contains(t, '应当'), false) AND len(w) > 0 AND len(list_filter(w, lambda x: coalesce(contains(t, x), false))) / greatest(1, least(len(w), 18)) >= 0.45 AS decisive
    FROM q LEFT JOIN sn ON sn.qid = q.qid""",
)
def h17_decisive(spark, d):
    """Notes of even orders against queries of which half, a third or none of the words occur."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("qid"))
    third = F.col("c_custkey") % 3
    ask = F.when(third == 0, "客户 支付 仲裁 诉讼").when(third == 1, "客户 仲裁 诉讼").otherwise("")
    snippets = order_pages(spark, d).filter("page_no % 2 = 0").select(F.col("doc_id").alias("qid"), "text")
    return S.decisive(c.select("qid", ask.alias("query")), snippets)


# --- H12 -------------------------------------------------------------------------------

PERIOD_SQL = f"""
od AS (SELECT o_custkey AS c, o_orderkey AS k, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
tk AS (SELECT 'c' || c AS qid, c, k, pos, '查询' || y || '年产品' || (k % 3 + 1) || '的营业收入' AS task, '产品' || (k % 3 + 1) || '余额' AS slot, y || '年 合同金额' AS q FROM od)"""


@query(
    "h12_period_tasks",
    f"""WITH {PERIOD_SQL}, mg AS (SELECT qid, any_value(c) AS c, min(pos) AS pos, count(*) AS n FROM tk GROUP BY qid HAVING count(*) >= 2 AND any_value(c) % 4 <> 0 AND any_value(c) % 5 <> 0),
    src AS (SELECT tk.qid AS id, pos + 0 * 1000000 AS pos, task AS text FROM tk UNION ALL SELECT qid, pos + 1000000, slot FROM tk UNION ALL SELECT qid, pos + 2000000, q FROM tk),
    {terms_sql('src', 'tt', 10)},
    w AS (SELECT mg.qid, mg.pos, list_concat(terms, list_filter(['明细', '构成', '分类', '表', '报告期'], lambda t: NOT list_contains(terms, t)))[1:12] AS ts FROM mg JOIN tt ON tt.id = mg.qid)
    SELECT qid, pos, '{A.PERIOD_TASK}' AS task, substr(array_to_string(ts, ' '), 1, 120) AS query, CAST(1 AS BIGINT) AS n_facts FROM w
    UNION ALL SELECT qid, pos, task, q, 1 FROM tk WHERE qid NOT IN (SELECT qid FROM mg)""",
)
def h12_periods(spark, d):
    """A customer's orders as tasks of one question; every fourth is no free question, every fifth names two documents."""
    o = table(spark, d, "orders").withColumn("pos", Q.rank_by(["o_custkey"], F.col("o_orderkey")))
    c, k, y = F.col("o_custkey"), F.col("o_orderkey"), F.year("o_orderdate")
    product = F.concat(F.lit("产品"), k % 3 + 1)
    docs = F.when((c % 5 == 0) & (F.col("pos") == 1), F.array(F.lit("d1"), F.lit("d2"))).otherwise(F.array(F.lit("d1")))
    tasks = o.select(
        F.concat(F.lit("c"), c).alias("qid"), "pos", F.concat(F.lit("查询"), y, F.lit("年"), product, F.lit("的营业收入")).alias("task"), F.lit("retrieve").alias("task_type"),
        docs.alias("target_doc_ids"), F.array(F.struct(F.lit("币种").alias("slot"), F.lit("人民币").alias("value"))).alias("known_facts"),
        F.array(F.struct(F.concat(product, F.lit("余额")).alias("slot"), F.concat(y, F.lit("年 合同金额")).alias("query"))).alias("search_slots"),
    )
    custs = o.select(c).distinct()
    questions = custs.select(F.concat(F.lit("c"), c).alias("qid"), F.lit("分别列出各年").alias("question"), F.when(c % 4 == 0, "mcq").otherwise("free").alias("answer_format"))
    merged = A.merge_period_tasks(tasks, questions)
    return merged.select("qid", "pos", "task", F.col("search_slots")[0]["query"].alias("query"), F.size("known_facts").alias("n_facts"))


# --- D13, D21, D25, F30, F37 --------------------------------------------------------------


@query(
    "d13_metric_amounts",
    f"""WITH {CONTRACT_SQL} SELECT id AS evidence_id, (page_no % 90 + 10) * 1e8 AS revenue, (page_no % 90 + 10) || '亿元' AS revenue_raw, (page_no % 800 + 1) * 1e6 AS research,
      (page_no % 800 + 1) || '百万元' AS research_raw, CAST(NULL AS DOUBLE) AS profit FROM ce""",
)
def d13(spark, d):
    """Amounts of two metrics next to their words, and of one that is not there."""
    rows = amounts(spark, d)
    found = {m: V.metric_amount(V.metric_snippet(F.col("text"), F.lit(m)), F.lit(m)) for m in ("营业收入", "研发投入", "净利润")}
    return rows.select(
        "evidence_id", found["营业收入"]["amount"].alias("revenue"), found["营业收入"]["raw"].alias("revenue_raw"), found["研发投入"]["amount"].alias("research"),
        found["研发投入"]["raw"].alias("research_raw"), found["净利润"]["amount"].alias("profit"),
    )


@query(
    "d21_query_terms",
    f"""WITH {PROFILE_SQL}, r AS (SELECT qid, list_concat([regexp_extract(query, '《([^》]{{2,120}})》', 1)], {RUNS}) AS ts FROM rq),
    u AS (SELECT qid, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM r), f AS (SELECT qid, t, min(i) AS i FROM u WHERE t <> '' GROUP BY ALL)
    SELECT qid, string_agg(t, '|' ORDER BY i) AS terms FROM f GROUP BY qid""",
)
def d21(spark, d):
    return supplier_questions(spark, d).select("qid", G.query_doc_terms(F.col("query")).alias("terms"))


@query(
    "d25_subject_terms",
    """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '甲' || c_custkey || '|光通信领域' WHEN 1 THEN '电池制造|消费行业' ELSE '' END AS terms, c_custkey % 3 = 2 AS is_document FROM customer""",
)
def d25(spark, d):
    """Subjects by a fact, by typed nouns of the task, or none: then the task is about a document."""
    k = F.col("c_custkey")
    third = k % 3
    task = F.when(third == 0, "核对 光通信领域").when(third == 1, "比较 电池制造，消费行业").otherwise("核对 报告 题名")
    facts = F.when(third == 0, F.array(F.struct(F.lit("比较对象").alias("slot"), F.concat(F.lit(" 甲"), k).alias("value")))).otherwise(
        F.array(F.struct(F.lit("标题").alias("slot"), F.when(third == 2, "某报告").otherwise("").alias("value")))
    )
    return table(spark, d, "customer").select(k.alias("k"), A.subject_terms(task, facts).alias("terms"), A.is_document_task(task, facts).alias("is_document"))


@query(
    "f30_rewrite_queries",
    f"""WITH c AS (SELECT 'c' || c_custkey AS qid, c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '第' || (c_custkey % 9 + 1) || '个保单年度退保所得金额' WHEN 1 THEN (c_custkey % 60 + 20) || '岁 给付'
        WHEN 2 THEN '研发投入占营业收入的比例' ELSE '降低成本 提升 性能' END AS q FROM customer),
    g AS (SELECT qid, 2 AS tier, p.i - 1 AS pos, 'general' AS kind, p.q AS query, k FROM c, (SELECT unnest({values(R.GENERAL[0][1] + R.GENERAL[2][1])}) AS q, unnest(range(1, 7)) AS i) p WHERE k % 4 = 0
      UNION ALL SELECT qid, 2, p.i - 1, 'general', p.q, k FROM c, (SELECT unnest({values(R.GENERAL[1][1])}) AS q, unnest(range(1, 4)) AS i) p WHERE k % 4 = 1
      UNION ALL SELECT qid, 3, 0, 'ratio', '营业收入 合计', k FROM c WHERE k % 4 = 2 UNION ALL SELECT qid, 3, 1, 'ratio', '研发投入 金额', k FROM c WHERE k % 4 = 2
      UNION ALL SELECT qid, 3, 2, 'ratio', '投入 金额', k FROM c WHERE k % 4 = 2
      UNION ALL SELECT qid, 4, 0, 'axes', '降低成本 提升 性能 {S.BOTH_AXES}', k FROM c WHERE k % 4 = 3
      UNION ALL SELECT qid, 5, 0, 'slot', '降低成本 提升 性能 效率 材料 节省 功耗 单位成本 速率 精度 强度 可靠 轻薄 良率', k FROM c WHERE k % 4 = 3
      UNION ALL SELECT qid, 1, 0, 'given', q, k FROM c)
    SELECT qid, kind, CAST(pos AS BIGINT) AS pos, query FROM g""",
)
def f30(spark, d):
    """Queries on contract years and surrender, ages, shares, and cost against performance."""
    k = F.col("c_custkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("第"), k % 9 + 1, F.lit("个保单年度退保所得金额")))
        .when(k % 4 == 1, F.concat(k % 60 + 20, F.lit("岁 给付")))
        .when(k % 4 == 2, "研发投入占营业收入的比例")
        .otherwise("降低成本 提升 性能")
    )
    return R.rewrite_queries(table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("qid"), F.lit("").alias("slot"), text.alias("query")))


@query(
    "f37_assemble_queries",
    """SELECT 'c' || c_custkey AS qid, trim('断言' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' 比例 数字 违约金 罚息 账期 天' ELSE '' END
      || CASE WHEN c_custkey % 3 = 0 THEN ' 缺口 补查' || c_custkey ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' 首查 再查' ELSE '' END || ' 题目' || c_mktsegment) AS query FROM customer""",
)
def f37(spark, d):
    """Half of the options has slots, a third misses something, a fifth was searched before."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k, F.concat(F.lit("c"), k).alias("qid"), "c_mktsegment")
    options = c.select("qid", F.concat(F.lit("断言"), k).alias("claim"), F.concat(F.lit("题目"), "c_mktsegment").alias("question"))
    rows = F.array(
        F.struct(F.lit(2).alias("ord"), F.lit("账期").alias("slot"), F.lit("").alias("expected"), F.array(F.lit("天")).alias("queries")),
        F.struct(F.lit(1).alias("ord"), F.lit("比例").alias("slot"), F.lit("数字").alias("expected"), F.array(F.lit("违约金"), F.lit("罚息")).alias("queries")),
    )
    slots = c.filter(k % 2 == 0).select("qid", F.explode(rows).alias("r")).select("qid", "r.*")
    missing = c.filter(k % 3 == 0).select("qid", F.lit(1).alias("ord"), F.lit("缺口").alias("slot"), F.concat(F.lit("补查"), k).alias("followup_query"))
    searches = c.filter(k % 5 == 0).select("qid", F.posexplode(F.array(F.lit("首查"), F.lit("再查"))).alias("ord", "query"))
    return V.assemble_queries(options, slots, missing, searches)


# --- G11, H15 -------------------------------------------------------------------------------


@query(
    "g11_foundational_docs",
    """WITH t AS (SELECT o_custkey AS c, 'o' || o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderkey % 3 = 0 AS rules FROM orders),
    r AS (SELECT c, doc_id, row_number() OVER (PARTITION BY c ORDER BY ord) AS added_no FROM t WHERE rules AND ord > 1 AND c % 2 = 0)
    SELECT 'c' || c AS qid, doc_id, added_no FROM r WHERE added_no <= 2""",
)
def g11_foundational(spark, d):
    """Every third order is a text of rules; half of the customers asks about disclosure; first orders are routed already."""
    o = table(spark, d, "orders").withColumn("ord", Q.rank_by(["o_custkey"], F.col("o_orderkey")))
    docs = o.select(F.concat(F.lit("c"), "o_custkey").alias("qid"), F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), "ord", "o_orderkey", "o_custkey")
    title = F.when(F.col("o_orderkey") % 6 == 0, "上市公司信息披露管理办法").when(F.col("o_orderkey") % 3 == 0, "关于上市公司").otherwise("合同")
    alias = F.when(F.col("o_orderkey") % 3 == 0, "信息披露事务管理办法").otherwise("附件")
    names = docs.select("doc_id", F.posexplode(F.array(title, alias)).alias("pos", "name"))
    asks = F.when(F.col("o_custkey") % 2 == 0, "上市公司的重大事项应当及时公告吗").otherwise("账期是多少")
    contexts = docs.select("qid", asks.alias("context")).distinct()
    return W.foundational_docs(contexts, docs.select("qid", "doc_id", "ord"), names, docs.filter("ord = 1").select("qid", "doc_id"))


def judged(spark, d):
    """Judgments of a customer's orders as options; every fourth gives no reason, every third no confidence."""
    o = table(spark, d, "orders").withColumn("option_ord", Q.rank_by(["o_custkey"], F.col("o_orderkey")))
    k = F.col("o_orderkey")
    judgments = o.select(
        F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("qid"), "option_ord", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("因为"), k)).alias("reason"),
        F.when(k % 3 != 0, F.when(k % 7 == 0, "高").otherwise((k % 10 / 10.0).cast("string"))).alias("confidence"),
    )
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("qid"))
    overall = c.select("qid", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("综合"), "c_custkey")).alias("reason"), F.when(F.col("c_custkey") % 5 == 0, "0.75").alias("confidence"))
    return c, judgments, overall


JUDGED_SQL = """
jd AS (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS qid, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o FROM orders),
jr AS (SELECT qid, string_agg('因为' || k, chr(10) ORDER BY o) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS n FROM jd WHERE k % 4 <> 0) WHERE n <= 2 GROUP BY qid),
jc AS (SELECT qid, arg_min(CASE WHEN k % 7 = 0 THEN '高' ELSE CAST(k % 10 / 10.0 AS VARCHAR) END, o) AS raw FROM jd WHERE k % 3 <> 0 GROUP BY qid),
cu AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS qid, c_custkey AS c FROM customer)"""


@query(
    "h15_reasons",
    f"""WITH {JUDGED_SQL} SELECT cu.qid, coalesce(lines, CASE WHEN c % 2 = 0 THEN '综合' || c ELSE '' END) AS reason,
      CASE WHEN c % 5 = 0 THEN 0.75 ELSE try_cast(raw AS DOUBLE) END AS confidence FROM cu LEFT JOIN jr ON jr.qid = cu.qid LEFT JOIN jc ON jc.qid = cu.qid""",
)
def h15_reasons(spark, d):
    _, judgments, overall = judged(spark, d)
    return W.summary_reasons(judgments, overall).join(W.first_confidence(judgments, overall), "qid")


@query(
    "h15_answer_summary",
    f"""WITH {JUDGED_SQL}, n AS (SELECT qid, least(count(*), 8) AS n FROM jd GROUP BY qid),
    f AS (SELECT qid, count(DISTINCT v) FILTER (doc) AS facts, count(DISTINCT v) FILTER (NOT doc) AS said FROM (SELECT qid, k % 3 AS v, k % 4 <> 0 AS doc FROM jd) GROUP BY qid)
    SELECT cu.qid, CASE WHEN c % 10 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN c % 10 = 0 THEN '模型超时' END AS error,
      CASE WHEN c % 10 <> 0 THEN CASE c % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_applicable_or_insufficient' WHEN 2 THEN '42' ELSE 'contradicted_or_insufficient' END END AS answer,
      CASE WHEN c % 10 <> 0 THEN coalesce(n.n, 0) ELSE 0 END AS n_evidence, CASE WHEN c % 10 <> 0 THEN coalesce(facts, 0) ELSE 0 END AS n_facts, CASE WHEN c % 10 <> 0 THEN coalesce(said, 0) ELSE 0 END AS n_said,
      CASE WHEN c % 10 <> 0 THEN coalesce(lines, CASE WHEN c % 2 = 0 THEN '综合' || c ELSE '' END) END AS reason
    FROM cu LEFT JOIN n ON n.qid = cu.qid LEFT JOIN f ON f.qid = cu.qid LEFT JOIN jr ON jr.qid = cu.qid""",
)
def h15_summary(spark, d):
    """Answers of four kinds; every tenth run failed."""
    c, judgments, overall = judged(spark, d)
    k = F.col("c_custkey")
    task = F.when(k % 4 == 1, "rule_applicability").when(k % 4 == 2, "calculation").otherwise("claim_verification")
    raw = F.when(k % 4 == 0, " T ").when(k % 4 == 1, "B").when(k % 4 == 2, "42").otherwise("FALSE")
    states = c.select("qid", task.alias("task_type"), F.lit("done").alias("status"), raw.alias("final_answer"))
    e = notes(spark, d).withColumn("option_ord", F.lit(1))
    slots = e.select("qid", "ord", F.lit("账期").alias("slot"), F.concat(F.lit("约"), F.col("page_no") % 3).alias("value"), F.when(F.col("page_no") % 4 == 0, F.array(F.lit("题干"))).otherwise(F.array(F.lit("e1"))).alias("evidence_ids"))
    errors = c.filter(k % 10 == 0).select("qid", F.lit("模型超时").alias("error"))
    rows = W.answer_summary(states, e, slots, judgments, overall, errors)
    size = lambda col: F.coalesce(F.when(F.col("error").isNull(), F.size(col)), F.lit(0))
    count = lambda col: F.when(F.col(col).isNull(), 0).otherwise(size(col))
    return rows.select("qid", "status", "error", F.trim("answer").alias("answer"), count("evidence").alias("n_evidence"), count("facts").alias("n_facts"), count("question_info").alias("n_said"), "reason")
