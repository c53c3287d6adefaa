"""Queries: evidence to read, judge, reject and report, over the contract notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.operators import review as V
from leafscan.plans.base import query, table
from leafscan.plans.evaluate import ORDERS_SQL, order_pages
from leafscan.operators import search as Q


def notes(spark, d):
    """All notes of a customer as evidence of one question."""
    p = order_pages(spark, d).select(
        F.col("doc_id").alias("qid"), F.col("page_id").alias("evidence_id"), "page_id", "doc_id", "heading_path", "text", "page_no",
        (F.col("page_no") % 7 / 2.0).alias("score"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("page_no") % 4 + 1).cast("int")).alias("source"),
    )
    return p.withColumn("ord", Q.rank_by(["qid"], F.col("page_no")))


SOURCES = ("initial", "evidence_extract", "evidence_inner_focus", "toc_repair_hint")
KINDS = ("new", "remembered", "slot", "audit", "none")


def id_lists(evidence):
    """Each third note is named, in a kind by its number; every seventh is named twice."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    once = evidence.filter("page_no % 3 = 0").select(
        "qid", F.element_at(kinds, (F.col("page_no") % 5 + 1).cast("int")).alias("kind"), (-F.col("page_no")).alias("pos"), "evidence_id"
    )
    return once.unionByName(evidence.filter("page_no % 7 = 0").select("qid", F.lit("audit").alias("kind"), F.col("page_no").alias("pos"), "evidence_id"))


NOTES_SQL = f"""{ORDERS_SQL},
ev AS (SELECT doc_id AS qid, page_id AS evidence_id, page_no, status, text, (page_no % 7) / 2.0 AS score,
  ['initial', 'evidence_extract', 'evidence_inner_focus', 'toc_repair_hint'][page_no % 4 + 1] AS source,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS ord FROM op),
ls AS (SELECT qid, ['new', 'remembered', 'slot', 'audit', 'none'][page_no % 5 + 1] AS kind, -page_no AS pos, evidence_id FROM ev WHERE page_no % 3 = 0
  UNION ALL SELECT qid, 'audit', page_no, evidence_id FROM ev WHERE page_no % 7 = 0),
pl AS (SELECT qid, evidence_id, min(struct_pack(t := CASE kind WHEN 'new' THEN 1 WHEN 'remembered' THEN 2 WHEN 'slot' THEN 3 ELSE 4 END, p := pos)) AS place
  FROM ls WHERE kind <> 'none' GROUP BY ALL),
ro AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.qid ORDER BY coalesce(place.t, 9), coalesce(place.p, ord), ord) AS review_no
  FROM ev LEFT JOIN pl ON pl.qid = ev.qid AND pl.evidence_id = ev.evidence_id)"""


@query("f27_review_order", f"WITH {NOTES_SQL} SELECT qid, evidence_id, review_no FROM ro")
def f27_order(spark, d):
    e = notes(spark, d)
    return V.review_order(e, id_lists(e)).select("qid", "evidence_id", "review_no")


@query(
    "f27_read_set",
    f"""WITH {NOTES_SQL}, nw AS (SELECT DISTINCT qid, evidence_id FROM ls WHERE kind = 'new'),
    ch AS (SELECT ev.* FROM ev JOIN nw ON nw.qid = ev.qid AND nw.evidence_id = ev.evidence_id
      UNION ALL SELECT * EXCLUDE (review_no) FROM ro WHERE review_no <= 6 AND qid NOT IN (SELECT qid FROM nw))
    SELECT qid, evidence_id, read_no FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY
      CASE source WHEN 'evidence_extract' THEN 0 WHEN 'evidence_inner_focus' THEN 1 ELSE 5 END, score DESC, ord) AS read_no FROM ch) WHERE read_no <= 6""",
)
def f27_read(spark, d):
    e = notes(spark, d)
    return V.read_set(e, id_lists(e)).select("qid", "evidence_id", "read_no")


def open_audits(spark, d):
    """A third of the customers is judged, a third lacks something, a third has facts already."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("qid"))
    third = F.col("c_custkey") % 3
    return c.select(
        "qid", (third == 0).alias("can_judge"), F.when(third == 0, 0).otherwise(2).alias("n_missing"), F.when(third == 2, 1).otherwise(0).alias("n_filled"),
        F.lit(None).cast("array<string>").alias("target_doc_ids"),
    )


@query(
    "f27_judge_set",
    f"""WITH {NOTES_SQL}, jp AS (SELECT qid, evidence_id, min(struct_pack(t := CASE kind WHEN 'remembered' THEN 1 WHEN 'new' THEN 2 WHEN 'slot' THEN 3 ELSE 4 END, p := pos)) AS place
      FROM ls WHERE kind <> 'none' GROUP BY ALL),
    j AS (SELECT ro.*, place, bool_or(place IS NOT NULL) OVER (PARTITION BY ro.qid) AS named, CAST(substr(ro.qid, 2) AS BIGINT) % 3 <> 0 AS open
      FROM ro LEFT JOIN jp ON jp.qid = ro.qid AND jp.evidence_id = ro.evidence_id)
    SELECT qid, evidence_id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(place.t, 9), coalesce(place.p, review_no), review_no) AS judge_no
    FROM j WHERE place IS NOT NULL OR NOT named OR (open AND review_no <= 8)""",
)
def f27_judge(spark, d):
    e = notes(spark, d)
    return V.judge_set(e, id_lists(e), open_audits(spark, d)).select("qid", "evidence_id", "judge_no")


@query(
    "f33_reject",
    f"""WITH {NOTES_SQL}, r AS (SELECT qid, evidence_id, row_number() OVER (PARTITION BY qid ORDER BY page_no) AS n FROM ev
      WHERE source = 'toc_repair_hint' AND page_no % 5 <> 0 AND CAST(substr(qid, 2) AS BIGINT) % 3 = 1)
    SELECT qid, evidence_id FROM ev WHERE (qid, evidence_id) NOT IN (SELECT (qid, evidence_id) FROM r WHERE n <= 3)""",
)
def f33(spark, d):
    """Evidence left after rejection; every fifth note was used."""
    e = notes(spark, d).withColumn("subsearch_source", F.lit("")).withColumn("focused_from", F.lit(""))
    reviewed = e.select("qid", F.col("page_no").alias("pos"), "evidence_id")
    used = e.filter("page_no % 5 = 0").select("qid", "evidence_id")
    return V.without_rejected(e, V.reject(e, reviewed, used, open_audits(spark, d))).select("qid", "evidence_id")


@query(
    "h15_evidence_summary",
    f"""WITH {NOTES_SQL}, o AS (SELECT *, page_no % 2 AS opt FROM ev UNION ALL SELECT *, 2 FROM ev WHERE page_no % 3 = 0),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, evidence_id ORDER BY opt, ord) AS s FROM o) WHERE s = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY opt, ord) AS item_no FROM f)
    SELECT qid, item_no, qid AS doc_id, evidence_id AS page_id, evidence_id, '合同 > ' || status AS heading,
      substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 600) AS quote, source FROM n WHERE item_no <= 8""",
)
def h15_evidence(spark, d):
    """Notes of two options by parity, every third also of a third one; ids give the document."""
    e = notes(spark, d).withColumn("doc_id", F.lit("")).withColumn("option_ord", F.col("page_no") % 2)
    return V.evidence_summary(e.unionByName(e.filter("page_no % 3 = 0").withColumn("option_ord", F.lit(2).cast("bigint"))))


@query(
    "h15_summary_facts",
    f"""WITH {NOTES_SQL}, s AS (SELECT qid, ord, page_no, CASE WHEN page_no % 5 = 0 THEN '' ELSE '账期' || (page_no % 2) END AS slot, '约' || (page_no % 3) AS value,
      CASE WHEN page_no % 4 = 0 THEN ['题干'] ELSE ['e' || (page_no % 2)] END AS ids FROM ev)
    SELECT qid, min(ord) AS ord, slot, value, array_to_string(ids, '|') AS evidence_ids, CASE WHEN ids[1] = '题干' THEN 'user_query' ELSE 'document' END AS source
    FROM s WHERE slot <> '' GROUP BY qid, slot, value, ids""",
)
def h15_facts(spark, d):
    n = F.col("page_no")
    slots = notes(spark, d).select(
        "qid", "ord", F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit(" 账期"), n % 2)).alias("slot"), F.concat(F.lit("约"), n % 3, F.lit(" ")).alias("value"),
        F.when(n % 4 == 0, F.array(F.lit("题干"), F.lit(""))).otherwise(F.array(F.concat(F.lit("e"), n % 2))).alias("evidence_ids"),
    )
    return V.summary_facts(slots)


@query(
    "d20_obligations",
    f"""WITH {ORDERS_SQL}, p AS (SELECT doc_id, page_id, page_no, '订单' || page_no || '的合同应当在' || (page_no % 9) || '个工作日内办理；逾期不得提交申请' AS a FROM op)
    SELECT doc_id, page_id, CAST(1 AS BIGINT) AS obligation_no, '订单' || page_no || '的合同应当在' || (page_no % 9) || '个工作日内办理' AS sentence FROM p
    UNION ALL SELECT doc_id, page_id, 2, '第' || (page_no % 30 + 1) || '条规定客户必须及时报告并提交材料' FROM p""",
)
def d20(spark, d):
    """A duty, a short sentence, one without a time word, an article and its repetition per order."""
    n = F.col("page_no")
    article = F.concat(F.lit("第"), n % 30 + 1, F.lit("条规定客户必须及时报告并提交材料"))
    text = F.concat(
        F.lit("订单"), n, F.lit("的合同应当在"), n % 9, F.lit("个工作日内办理；应当及时。客户应当按照约定支付全部价款"), article, F.lit("。 "), article, F.lit("；")
    )
    return V.obligations(order_pages(spark, d).select("doc_id", "page_id", "page_no", text.alias("text")))


@query(
    "d27_axis_flags",
    f"WITH {ORDERS_SQL} SELECT page_id, regexp_matches(text, '降本|成本|费用|费率|节约|降低|下降|功耗|耗能|效率') AS cost, "
    "regexp_matches(text, '提质|性能|提升|提高|优化|速率|速度|精度|可靠|稳定|良率|带宽|低时延') AS quality FROM op",
)
def d27(spark, d):
    cost, quality = V.axis_flags(F.col("text"))
    return order_pages(spark, d).select("page_id", cost.alias("cost"), quality.alias("quality"))


@query(
    "d29_hint_flags",
    f"""WITH {NOTES_SQL} SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS qid, c_custkey % 2 = 0 AS figures,
      coalesce((SELECT bool_or(page_no % 11 = 0) FROM ev WHERE ev.qid = 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')), false) AS contents FROM customer""",
)
def d29(spark, d):
    """Half of the customers misses a figure; every eleventh note is a contents page."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("qid"), "c_custkey")
    missing = c.select("qid", F.when(F.col("c_custkey") % 2 == 0, "占比").otherwise("主体").alias("slot"), F.lit("合同双方").alias("query"))
    e = notes(spark, d).select("qid", F.lit(None).cast("array<string>").alias("none"), F.when(F.col("page_no") % 11 == 0, "图表目录").otherwise("正文").alias("text"))
    return V.hint_flags(missing, e.select("qid", F.array(F.lit("合同")).alias("heading_path"), "text"))


def route_scores(spark, d):
    """A customer's orders as documents scored by their price."""
    o = table(spark, d, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("qid"), F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("score"), "o_orderkey"
    )
    return o.withColumn("rank", Q.rank_by(["qid"], F.desc("score"), F.col("o_orderkey")))


SCORES_SQL = """rs AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS rank, max(score) OVER (PARTITION BY qid) AS best FROM (
  SELECT 'c' || o_custkey AS qid, 'o' || o_orderkey AS doc_id, CAST(floor(o_totalprice / 10000) AS DOUBLE) AS score, o_orderkey AS k, o_custkey AS c FROM orders)),
sc AS (SELECT qid, max(score) FILTER (rank = 2) AS second FROM rs GROUP BY qid)"""


@query(
    "g11_confident_routes",
    f"""WITH {SCORES_SQL} SELECT rs.qid, doc_id FROM rs JOIN sc ON sc.qid = rs.qid
    WHERE best >= 16 AND coalesce(second, 0) * 1.2 <= best AND score >= 10 AND score >= best * 0.55 AND rank <= CASE WHEN c % 2 = 0 THEN 3 ELSE 2 END""",
)
def g11_confident(spark, d):
    s = route_scores(spark, d)
    many = s.filter(F.substring("qid", 2, 20).cast("bigint") % 2 == 0).select("qid")
    return V.confident_routes(s, many).select("qid", "doc_id")


@query("g11_high_score_routes", f"WITH {SCORES_SQL} SELECT qid, doc_id FROM rs WHERE best >= 16 AND rank <= 2 AND score >= best * 0.9")
def g11_high(spark, d):
    return V.high_score_routes(route_scores(spark, d)).select("qid", "doc_id")


@query(
    "g11_demoted",
    f"""WITH {SCORES_SQL}, st AS (SELECT qid, doc_id, rank FROM rs WHERE k % 4 = 1), hi AS (SELECT qid, doc_id FROM rs WHERE best >= 16 AND rank <= 2 AND score >= best * 0.9),
    own AS (SELECT rs.qid, max(best) AS best, max(rs.score) FILTER (k % 4 = 1) AS own FROM rs WHERE rank <= 4 GROUP BY rs.qid)
    SELECT qid FROM own WHERE best >= 16 AND coalesce(own, 0) < best * 0.7 AND qid IN (SELECT qid FROM st) AND qid IN (SELECT qid FROM hi)
      AND qid NOT IN (SELECT st.qid FROM st JOIN hi ON hi.qid = st.qid AND hi.doc_id = st.doc_id)""",
)
def g11_demoted(spark, d):
    """Every fourth order number is a strong document."""
    s = route_scores(spark, d)
    return V.demoted(s.filter("o_orderkey % 4 = 1").select("qid", "doc_id"), V.high_score_routes(s).select("qid", "doc_id"), s)


@query(
    "g11_relevant_targets",
    """WITH t AS (SELECT 'c' || o_custkey AS qid, 'o' || o_orderkey AS doc_id, o_orderkey % 3 = 0 AS bad FROM orders),
    g AS (SELECT qid, bool_or(NOT bad) AS good FROM t GROUP BY qid) SELECT t.qid, doc_id FROM t JOIN g ON g.qid = t.qid WHERE NOT bad OR NOT good""",
)
def g11_targets(spark, d):
    o = table(spark, d, "orders")
    reason = F.when(F.col("o_orderkey") % 3 == 0, "与问题关联度低").otherwise("直接相关")
    return V.relevant_targets(o.select(F.concat(F.lit("c"), "o_custkey").alias("qid"), F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), reason.alias("reason"))).select("qid", "doc_id")
