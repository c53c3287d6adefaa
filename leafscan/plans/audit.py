"""Queries: audit, judgment and answer rules over replies written from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.operators import audit as A
from leafscan.operators import evidence as V
from leafscan.operators import search as Q
from leafscan.plans.base import query, table
from leafscan.plans.evidence import CONTRACT_SQL, contract_evidence

def K():
    return F.col("o_orderkey")


def pick(col, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (col % len(values) + 1).cast("int"))


def orders(spark, d):
    return table(spark, d, "orders")


def qid():
    return F.concat(F.lit("q"), K()).alias("qid")


def audit_inputs(spark, d):
    """An option per order with one filled slot of eight kinds and, for a third, a declared gap."""
    o = orders(spark, d)
    claim = F.concat(F.lit("金额为"), K() % 90 + 10, F.lit("万元"))
    options = o.select(qid(), claim.alias("claim"), F.array(F.lit("d1"), F.lit("d2")).alias("target_doc_ids"), F.lit(True).alias("can_judge"))
    value = F.when(K() % 8 == 0, "").when(K() % 8 == 1, "待确认").when(K() % 8 == 2, "证据不足").when(K() % 8 == 3, claim).when(K() % 8 == 4, claim).otherwise(F.concat(F.lit("约定"), K() % 7, F.lit("%")))
    ids = F.when(K() % 8 == 2, V.none()).otherwise(F.array(F.concat(F.lit("e"), K())))
    filled = o.select(qid(), F.lit(1).alias("ord"), F.lit("合同金额").alias("slot"), value.alias("value"), ids.alias("evidence_ids"), F.lit("").alias("query"), V.none().alias("key_terms"))
    missing = o.filter(K() % 3 == 0).select(
        qid(), F.lit(1).alias("ord"), F.lit("账期").alias("slot"), F.lit("账期 天数").alias("query"), F.array(F.lit("d2"), F.lit("d9")).alias("target_doc_ids"), F.array(F.lit("账 期"), F.lit("x")).alias("key_terms")
    )
    text = F.when(K() % 8 == 3, F.concat(F.lit("记载"), claim)).otherwise("无数字")
    evidence = o.select(qid(), F.concat(F.lit("e"), K()).alias("evidence_id"), F.array(F.lit("h")).alias("heading_path"), text.alias("text"))
    return filled, missing, options, evidence


AUDIT_SQL = """
k AS (SELECT o_orderkey AS k, 'q' || o_orderkey AS qid, '金额为' || (o_orderkey % 90 + 10) || '万元' AS claim FROM orders),
f AS (SELECT *, CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN '待确认' WHEN 2 THEN '证据不足' WHEN 3 THEN claim WHEN 4 THEN claim ELSE '约定' || (k % 7) || '%' END AS value FROM k)"""


@query("h1_filled_slots", f"WITH {AUDIT_SQL} SELECT qid, '合同金额' AS slot, value FROM f WHERE k % 8 IN (3, 5, 6, 7)")
def h1_filled(spark, d):
    return A.normalize_audit(*audit_inputs(spark, d))[0].select("qid", "slot", "value")


@query(
    "h1_missing_slots",
    f"""WITH {AUDIT_SQL}, m AS (SELECT qid, k, 0 AS side, '账期' AS slot, 'd2' AS target_doc_ids, '账期 天数' AS followup_query, '账期' AS key_terms FROM k WHERE k % 3 = 0
      UNION ALL SELECT qid, k, 1, '合同金额', 'd1|d2', '合同金额', '合同金额|合同|同金|金额|合同金|同金额' FROM f WHERE k % 8 IN (0, 1, 2, 4))
    SELECT qid, slot, target_doc_ids, followup_query, key_terms, row_number() OVER (PARTITION BY qid ORDER BY side) AS ord FROM m""",
)
def h1_missing(spark, d):
    return A.normalize_audit(*audit_inputs(spark, d))[1]


@query("h1_can_judge", f"WITH {AUDIT_SQL} SELECT qid, NOT (k % 3 = 0 OR k % 8 IN (0, 1, 2, 4)) AS can_judge FROM k")
def h1_verdict(spark, d):
    return A.normalize_audit(*audit_inputs(spark, d))[2]


@query(
    "h2_filter_facts",
    """SELECT 'q' || o_orderkey AS qid FROM orders WHERE o_orderkey % 7 IN (0, 5, 6)""",
)
def h2(spark, d):
    slot = pick(K(), "现金价值", "最终结果", "计算规则", "给付比例", "收入较上年", "保险期间", "收入较上年")
    value = pick(K(), "12%", "5万元", "未知", "已比较", "增长", "十年", "增长3.5%")
    rows = orders(spark, d).select(qid(), slot.alias("slot"), value.alias("value"), F.array(F.lit("e")).alias("evidence_ids"))
    return A.filter_facts(rows).select("qid")


@query(
    "h3_reference_missing",
    f"""WITH {CONTRACT_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord DESC) AS b, bool_or(page_no % 4 = 0) OVER (PARTITION BY qid) AS known FROM ce)
    SELECT qid, '给付比例' AS slot, '附表2 给付比例' AS followup_query, '附表2' AS reference_target, arg_min(id, ord) AS source_evidence_id FROM l WHERE b <= 12 AND NOT known GROUP BY qid""",
)
def h3(spark, d):
    """Notes that refer to a schedule; a quarter of the customers has the value in another note."""
    e = contract_evidence(spark, d)
    text = F.when(F.col("page_no") % 4 == 0, F.concat(F.lit("给付比例："), F.col("page_no") % 50, F.lit("%"))).otherwise("给付比例详见附表2。")
    filled = e.filter("false").select("qid", F.lit("").alias("slot"), F.lit("").alias("value"), V.none().alias("evidence_ids"))
    return A.reference_missing(e.withColumn("text", text), filled, filled.select("qid", "slot"))


@query(
    "h4_doc_coverage",
    """WITH k AS (SELECT o_orderkey AS k, 'q' || o_orderkey AS qid FROM orders), x AS (SELECT k, qid, n FROM k, (VALUES (0), (1), (2)) v(n))
    SELECT qid, 'd' || n AS doc_id, '核对合同' AS slot, '金额 日期' AS followup_query FROM x WHERE k % 2 = 0 AND k % 3 <> n""",
)
def h4(spark, d):
    o = orders(spark, d)
    tasks = o.select(
        qid(), F.lit("核对合同").alias("task"), F.when(K() % 2 == 0, "retrieve").otherwise("summarize").alias("task_type"),
        F.array(F.lit("d0"), F.lit("d1"), F.lit("d2"), F.lit("d1")).alias("target_doc_ids"), F.array(F.lit("金额"), F.lit("日期"), F.lit("人")).alias("search_queries"), F.lit(True).alias("can_solve"),
    )
    return A.doc_coverage(tasks, o.select(qid(), F.concat(F.lit("d"), K() % 3).alias("doc_id"))).select("qid", "doc_id", "slot", "followup_query")


@query(
    "h5_merge_slots",
    """WITH r AS (SELECT 'c' || o_custkey AS qid, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS side, 's' || (o_orderkey % 4) AS slot,
      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus || o_orderkey END AS value FROM orders),
    m AS (SELECT qid, slot, arg_max(value, side * 1000000000 + ord) AS value, min(side * 1000000000 + ord) AS at1 FROM r WHERE value <> '' GROUP BY qid, slot)
    SELECT qid, slot, value, row_number() OVER (PARTITION BY qid ORDER BY at1) AS ord FROM m""",
)
def h5(spark, d):
    rows = orders(spark, d).select(
        F.concat(F.lit("c"), "o_custkey").alias("qid"), K().alias("ord"), F.concat(F.lit("s"), K() % 4).alias("slot"),
        F.when(K() % 5 == 0, "").otherwise(F.concat("o_orderstatus", K())).alias("value"), V.none().alias("evidence_ids"),
    )
    return A.merge_slots(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1")).select("qid", "slot", "value", "ord")


WHOLE = "是否支持当前选项中的全称陈述"
CAUSE = "当前选项原因是否有证据支持："


def tokens_of(run: str, n: int) -> list[str]:
    """A run of signs, its pairs and its triples, the first ``n``."""
    return list(dict.fromkeys([run, *[run[i : i + k] for k in (2, 3) for i in range(len(run) - k + 1)]]))[:n]


def cause_sql(pos: int, cause: str) -> str:
    terms = tokens_of(cause, 8)
    return f"SELECT qid, 2 AS side, {pos} AS pos, '{CAUSE}{cause}' AS slot, '是' AS expected, '{' '.join(terms)}' AS queries, '{'|'.join(terms)}' AS key_terms FROM k WHERE k % 3 = 1"


@query(
    "h6_complete_slots",
    f"""WITH k AS (SELECT 'q' || o_orderkey AS qid, o_orderkey AS k FROM orders),
    e AS (SELECT qid, '公司' || (k % 5) AS e, 0 AS n FROM k WHERE k % 3 = 0 AND k % 5 <> k % 7 UNION ALL SELECT qid, '乙公司', 1 FROM k WHERE k % 3 = 0)
    SELECT qid, CAST(1 AS BIGINT) AS side, row_number() OVER (PARTITION BY qid ORDER BY n) - 1 AS pos, e || '{WHOLE}' AS slot, '' AS expected, e || ' 收入' AS queries, e || '|收入' AS key_terms FROM e
    UNION ALL {cause_sql(0, '华东需求旺盛')} UNION ALL {cause_sql(1, '华东成本下降')}""",
)
def h6(spark, d):
    claim = pick(K(), "两家公司都实现增长", "市场位于华东，因为当地需求旺盛且成本下降", "收入增长")
    o = orders(spark, d)
    options = o.select(qid(), claim.alias("claim"), F.lit("是否成立").alias("question"), F.array(F.concat(F.lit("公司"), K() % 5), F.lit("乙公司")).alias("entities"), V.none().alias("constraints"))
    slots = o.select(qid(), F.concat(F.lit("公司"), K() % 7, F.lit("收入")).alias("slot"), F.lit("").alias("expected"), V.none().alias("queries"), F.array(F.lit("收入")).alias("key_terms"))
    return A.complete_slots(options, slots).select("qid", "side", "pos", "slot", "expected", "queries", "key_terms")


@query(
    "h7_required_slots",
    """WITH r AS (SELECT 'q' || o_orderkey AS qid, o_orderkey % 4 AS m FROM orders)
    SELECT qid, CASE m WHEN 0 THEN '合同金额' WHEN 1 THEN '账期' ELSE '折扣率 账期' END AS slot, m <> 1 AS filled FROM r WHERE m <> 3""",
)
def h7(spark, d):
    o = orders(spark, d)
    required = o.select(qid(), F.lit(1).alias("ord"), pick(K(), "合同金额", "账期", "折扣率 账期", "是否有其他费用").alias("slot"))
    memory = o.select(qid(), pick(K(), "金额", "折扣", "账期 折扣率", "其他费用").alias("slot"))
    return A.required_slots(required, memory).select("qid", "slot", "filled")


def branch_state(spark, d):
    o = orders(spark, d)
    n = (K() % 3).alias("n_missing")
    filled = o.select(qid(), F.lit("主要收入").alias("slot"), pick(K(), "并非如此", "两大来源之一", "未提及", "占比三成", "否").alias("value"))
    missing = o.filter(K() % 3 > 0).select(qid(), F.lit("主要收入来源").alias("slot"))
    found = A.contradictions(filled, missing, missing).withColumn("contradicted", F.lit(True))
    rows = o.select(
        qid(), n, F.when(K() % 3 == 0, "ready_to_judge").otherwise("audited").alias("status"), (K() % 4).cast("int").alias("round"), (K() % 11 == 0).alias("reroutable"),
        (K() % 7 == 0).alias("review_pending"), (K() % 2 == 0).alias("long_evidence"), (K() % 5 == 1).alias("focus_used"), (K() % 5 == 2).alias("repair_used"), (K() % 3).alias("repairs"),
    )
    return rows.join(found, "qid", "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))


@query(
    "h8_audit_branch",
    """WITH k AS (SELECT o_orderkey AS k, 'q' || o_orderkey AS qid FROM orders)
    SELECT qid, CASE WHEN k % 3 = 0 THEN 'judge' WHEN k % 5 IN (0, 1, 4) THEN 'judge' WHEN k % 11 = 0 THEN 'reroute' WHEN k % 7 = 0 THEN 'review'
      WHEN k % 2 = 0 AND k % 5 <> 1 THEN 'focus' WHEN k % 5 <> 2 AND k % 4 >= 2 THEN 'repair' WHEN k % 4 >= 3 THEN 'judge' ELSE 'more' END AS branch FROM k""",
)
def h8(spark, d):
    return A.audit_branch(branch_state(spark, d)).select("qid", "branch")


def replies(spark, d):
    o = orders(spark, d)
    rows = o.select(qid(), K().alias("k"), F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("option"))
    i = F.ascii("option") - 65
    m = F.col("k") + i
    return rows.select(
        "qid", "option", i.alias("option_ord"), pick(F.col("k"), "multi", "mcq", "free").alias("answer_format"),
        F.when(m % 5 == 0, F.lit(None).cast("boolean")).otherwise(m % 2 == 0).alias("verdict"), pick(m, "A", "TRUE", "no", "不清楚").alias("answer"),
        ((F.col("k") * 7 + i * 3) % 10 / 10.0).alias("confidence"), pick(m, "", "证据显示选项成立", "与选项不一致", "综合判断", "无法支持").alias("reason"), F.lit("done").alias("status"),
    ), rows.filter("k % 7 = 0 AND option = 'A'").select("qid", "option")


JUDGE_SQL = """
r AS (SELECT 'q' || o_orderkey AS qid, o_orderkey AS k, i, ['A', 'B', 'C'][i + 1] AS option, ['multi', 'mcq', 'free'][o_orderkey % 3 + 1] AS form, o_orderkey + i AS m,
  ((o_orderkey * 7 + i * 3) % 10) / 10.0 AS conf FROM orders, (VALUES (0), (1), (2)) v(i)),
v0 AS (SELECT *, CASE m % 4 WHEN 0 THEN option = 'A' WHEN 1 THEN true WHEN 2 THEN false ELSE CASE WHEN m % 5 = 0 THEN NULL ELSE m % 2 = 0 END END AS a,
  CASE m % 5 WHEN 1 THEN true WHEN 2 THEN false WHEN 4 THEN false END AS said FROM r),
v1 AS (SELECT *, said IS NOT NULL AND a IS DISTINCT FROM said AS over, CASE WHEN said IS NOT NULL THEN said ELSE a END AS b FROM v0),
jd AS (SELECT *, k % 7 = 0 AND i = 0 AND coalesce(b, false) AS guarded, CASE WHEN k % 7 = 0 AND i = 0 AND b THEN false ELSE b END AS verdict,
  CASE WHEN k % 7 = 0 AND i = 0 AND b THEN least(CASE WHEN over THEN least(conf, 0.85) ELSE conf END, 0.5) WHEN over THEN least(conf, 0.85) ELSE conf END AS confidence FROM v1)"""


@query(
    "h9_judgments",
    f"""WITH {JUDGE_SQL} SELECT qid, option, CASE WHEN verdict THEN 'true' WHEN NOT verdict THEN 'false' END AS verdict, CAST(confidence AS DOUBLE) AS confidence,
      CASE WHEN verdict THEN option WHEN NOT verdict THEN '' ELSE ['A', 'TRUE', 'no', '不清楚'][m % 4 + 1] END AS answer FROM jd""",
)
def h9(spark, d):
    return A.judgments(*replies(spark, d)).select("qid", "option", F.col("verdict").cast("string").alias("verdict"), "confidence", "answer")


@query(
    "h10_final_answers",
    f"""WITH {JUDGE_SQL} SELECT qid, CASE WHEN k % 3 = 1 THEN coalesce(arg_max(option, CAST(confidence AS DOUBLE) * 10 - i * 0.001) FILTER (verdict), '')
      ELSE coalesce(string_agg(option, '' ORDER BY i) FILTER (verdict), '') END AS final_answer FROM jd GROUP BY qid, k""",
)
def h10(spark, d):
    return A.final_answers(A.judgments(*replies(spark, d))).select("qid", "final_answer")


@query(
    "h11_block_results",
    """SELECT 'q' || o_orderkey AS task_id, CASE WHEN o_orderkey % 4 = 3 THEN 'partial' WHEN o_orderkey % 4 IN (1, 2) THEN 'blocked' ELSE 'complete' END AS status FROM orders""",
)
def h11(spark, d):
    """Notes on the right subject, on none, on another one, and results that are not complete."""
    o = orders(spark, d)
    note = pick(K(), "主体=光伏行业；成本下降", "证据不足", "主体=养殖行业；产量上升", "无关")
    results = o.select(
        qid().alias("task_id"), F.when(K() % 4 == 3, "partial").otherwise("complete").alias("status"), F.lit("成本下降").alias("result"), F.lit("").alias("basis"), V.none().alias("warnings"),
        F.array(F.struct(F.lit("d1").alias("doc_id"), note.alias("note"))).alias("notes"), F.array(F.lit("d1_lp_0001")).alias("evidence_ids"),
    )
    facts = F.array(F.struct(F.lit("行业").alias("slot"), F.lit("光伏行业").alias("value")))
    tasks = o.select(qid().alias("task_id"), F.lit("核验降本").alias("task"), facts.alias("known_facts"), F.array(F.lit("d1")).alias("target_doc_ids"))
    return A.block_results(results, tasks).select("task_id", "status")


@query(
    "h12_normalize_plan",
    """WITH k AS (SELECT o_orderkey AS k, 'q' || o_orderkey AS qid FROM orders)
    SELECT qid, CASE k % 4 WHEN 0 THEN '提取金额' WHEN 1 THEN '比较两份合同' ELSE '核对账期' END AS task, CASE k % 4 WHEN 1 THEN 'summarize' ELSE 'retrieve' END AS task_type,
      CASE k % 4 WHEN 1 THEN '' WHEN 0 THEN 'd2' ELSE 'd1|d2' END AS target_doc_ids,
      CASE k % 4 WHEN 0 THEN '金额=合同金额' WHEN 1 THEN '比较两份合同=比较两份合同' ELSE '核对账期=核对账期' END AS slots FROM k WHERE k % 4 < 3""",
)
def h12(spark, d):
    o = orders(spark, d)
    slot = lambda s, q: F.struct(F.lit(s).alias("slot"), F.lit(q).alias("query"))
    slots = F.when(K() % 4 == 0, F.array(slot("金额 ", "合同金额"), slot("是否还有其他费用", ""))).when(K() % 4 == 2, F.array(slot("有无其他收费", "x")))
    plans = o.select(
        qid(), F.lit(1).alias("pos"), pick(K(), "提取金额", "比较两份合同", "核对账期", " ").alias("task"), F.lit("").alias("task_type"),
        F.when(K() % 4 == 0, F.array(F.lit("d2"))).otherwise(V.none()).alias("doc_ids"), slots.alias("slots"),
    )
    docs = o.select(qid(), F.posexplode(F.array(F.lit("d1"), F.lit("d2"))).alias("doc_ord", "doc_id"))
    out = A.normalize_plan(plans, docs)
    return out.select("qid", "task", "task_type", "target_doc_ids", F.transform("search_slots", lambda s: F.concat_ws("=", s["slot"], s["query"])).alias("slots"))


@query(
    "h12_merge_relation_tasks",
    """WITH r AS (SELECT 'c' || o_custkey AS qid, o_custkey AS c, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN 'summarize' ELSE 'retrieve' END AS kind, 'e' || (o_orderkey % 2) AS entity FROM orders),
    p AS (SELECT DISTINCT qid FROM (SELECT qid, entity, count(*) AS n FROM r WHERE kind = 'retrieve' GROUP BY ALL) WHERE n >= 2),
    g AS (SELECT r.*, CASE WHEN c % 2 = 0 AND p.qid IS NOT NULL AND kind = 'retrieve' THEN entity ELSE 'task ' || pos END AS grp FROM r LEFT JOIN p ON p.qid = r.qid)
    SELECT qid, min(pos) AS pos, min(kind) AS task_type, count(*) AS n_slots FROM g GROUP BY qid, grp""",
)
def h12_merge(spark, d):
    rows = orders(spark, d).select(
        F.concat(F.lit("c"), "o_custkey").alias("qid"), F.col("o_custkey").alias("c"), K().alias("pos"), F.concat(F.lit("任务"), K()).alias("task"),
        F.when(K() % 4 == 0, "summarize").otherwise("retrieve").alias("task_type"), F.array(F.lit("d1")).alias("target_doc_ids"), F.concat(F.lit("e"), K() % 2).alias("entity"),
        F.array(F.concat(F.lit("槽位"), K())).alias("search_slots"),
    )
    asked = rows.select("qid", F.when(F.col("c") % 2 == 0, "是否同时满足").otherwise("是否满足").alias("question")).distinct()
    return A.merge_relation_tasks(rows.drop("c"), asked).select("qid", "pos", "task_type", F.size("search_slots").cast("bigint").alias("n_slots"))


@query(
    "h13_compare_dates",
    """WITH p AS (SELECT a.o_orderkey AS k, a.o_orderdate AS x, b.o_orderdate AS y FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0)
    SELECT 'q' || k AS qid, CASE WHEN k % 6 = 0 AND date_trunc('month', x) = date_trunc('month', y) THEN ''
      WHEN CASE WHEN k % 4 = 0 THEN y > x ELSE y <= x END THEN '是' ELSE '否' END AS answer FROM p""",
)
def h13(spark, d):
    """Dates of neighbouring orders; every third first date has no day."""
    o = orders(spark, d)
    date = F.concat(F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月"))
    full = F.concat(date, F.dayofmonth("o_orderdate"), F.lit("日"))
    even = K() - K() % 2
    rows = o.select(
        F.concat(F.lit("q"), even).alias("qid"), K().alias("pos"), F.when(K() % 2 == 0, "第一份文档的日期").otherwise("第二份文档的日期").alias("task"),
        F.when(K() % 6 == 0, date).otherwise(full).alias("result"), *[F.lit("").alias(c) for c in ("amount", "basis", "calculation", "substitution")],
    )
    asks = o.filter(K() % 2 == 0).select(qid(), F.when(K() % 4 == 0, "第二份是否晚于第一份").otherwise("第二份是否不晚于第一份").alias("question"))
    return A.compare_dates(asks, rows)


@query(
    "d16_parse_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(day(o_orderdate) AS BIGINT) END AS day FROM orders""",
)
def d16(spark, d):
    """Order dates in Arabic or Chinese numerals; every third without a day."""
    tens = lambda c: F.concat(
        F.when(c >= 20, F.translate(F.floor(c / 10).cast("string"), "23", "二三")).otherwise(""), F.when(c >= 10, "十").otherwise(""),
        F.when(c % 10 > 0, F.translate((c % 10).cast("string"), "123456789", "一二三四五六七八九")).otherwise(""),
    )
    y, m, day = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    arabic = F.concat(y, F.lit("年"), m, F.lit("月"), F.when(K() % 3 == 0, "").otherwise(F.concat(day, F.lit("日"))))
    chinese = F.concat(F.translate(y.cast("string"), "0123456789", "〇一二三四五六七八九"), F.lit("年"), tens(m), F.lit("月"), F.when(K() % 3 == 0, "").otherwise(F.concat(tens(day), F.lit("日"))))
    return orders(spark, d).select("o_orderkey", A.parse_date(F.concat(F.lit("于 "), F.when(K() % 2 == 0, arabic).otherwise(chinese))).alias("p")).select("o_orderkey", "p.*")


@query(
    "h14_next_workday",
    """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CASE dayofweek(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END, '%Y-%m-%d') AS next_workday FROM orders""",
)
def h14(spark, d):
    return A.next_workday(orders(spark, d).select("o_orderkey", F.to_date("o_orderdate").alias("date"))).select("o_orderkey", F.col("next_workday").cast("string").alias("next_workday"))


@query(
    "d15_claim_parts",
    """WITH r AS (SELECT o_orderkey AS k, floor(o_totalprice) AS p FROM orders)
    SELECT k, CAST(1 AS BIGINT) AS claim_index, '赔付' || CAST(p AS BIGINT) || '元' AS raw_claim, CAST(p AS BIGINT) || '元' AS amounts, 'positive/pay_or_amount' AS polarity FROM r
    UNION ALL SELECT k, 2, '高于' || (k % 9 + 1) || '%', (k % 9 + 1) || '%', 'comparison/ranking' FROM r
    UNION ALL SELECT k, 3, '客户不属于名单', '', 'negative/no_pay' FROM r""",
)
def d15(spark, d):
    claim = F.concat(F.lit("赔付"), F.floor("o_totalprice"), F.lit("元；高于"), K() % 9 + 1, F.lit("%。\n 客户不属于名单，"))
    return A.claim_parts(orders(spark, d).select(K().alias("qid"), F.lit("A").alias("option"), claim.alias("claim"))).select(
        F.col("qid").alias("k"), F.col("claim_index").cast("int").alias("claim_index"), "raw_claim", "amounts", "polarity"
    )


@query(
    "d17_reason_parts",
    """SELECT o_orderkey, '华东需求旺盛|华东成本下降' || (o_orderkey % 9) || '%' AS reasons FROM orders""",
)
def d17(spark, d):
    claim = F.concat(F.lit("产能集中在华东，因为该地区需求旺盛且成本下降"), K() % 9, F.lit("%。"))
    return orders(spark, d).select("o_orderkey", A.reason_parts(claim).alias("reasons"))


@query(
    "d18_key_terms",
    f"""WITH {CONTRACT_SQL} SELECT id AS qid, '违约金|' || pc || '|研发投入|净资产' AS given FROM cq""",
)
def d18(spark, d):
    from leafscan.plans.evidence import contract_queries

    return contract_queries(spark, d).select("qid", V.key_terms(F.col("key_terms"), F.col("query")).alias("given"))
