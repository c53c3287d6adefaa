"""Queries: extraction rules, evaluation, case and sample building over pages written from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import text as X
from leafscan.operators import evaluate as V
from leafscan.operators import search as Q
from leafscan.plans.base import BM25_SQL, bench_queries, line_index, line_pages, query, table
from leafscan.plans.memory import turns
from leafscan.plans.memory import TURNS_SQL
from leafscan.plans.search import TOP_SQL
from leafscan.session import cut_lineage


def order_pages(spark, d):
    """One page per order, written as a short contract note; customers are documents, market segments domains.

    The text is generated, so filters on it stay behind the join: rules over
    texts run once, on dealt rows, and not at the few splits of the orders' file.
    """
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit("订单"), k, F.lit("的合同金额为"), F.floor("o_totalprice"), F.lit("万元，折扣率为"), c % 17 + 1, F.lit("."), k % 9 + 1,
        F.lit("%，账期"), k % 90 + 1, F.lit("天。签订日期为"), F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月"),
        F.dayofmonth("o_orderdate"), F.lit("日，第"), k % 30 + 1, F.lit("条规定客户应当在"), k % 28 + 1, F.lit("日内支付，违约金比例为"), c % 5 + 1,
        F.lit("%。逾期"), k % 12 + 1, F.lit("个月的按营业收入计收，详见附表"), k % 4 + 1,
        F.lit("。本公司 研发投入 保持稳定 交付节奏 与 客户结构 均 未发生 重大变化 供应商集中度 有所下降 现金流 较为充裕 "), F.col("o_orderpriority"), F.lit("。"),
    )
    rows = o.select(
        F.concat(F.lit("c"), F.lpad(c.cast("string"), 7, "0")).alias("doc_id"), F.lower("c_mktsegment").alias("domain"), F.col("c_name").alias("title"),
        k.alias("page_no"), F.array(F.lit("合同"), F.col("o_orderstatus")).alias("heading_path"), F.explode(F.array(text)).alias("text"), "o_orderdate",
    )
    return rows.withColumn("page_id", F.format_string("%s_lp_%04d", "doc_id", "page_no")).withColumn("index_text", F.col("text"))


ORDERS_SQL = """
op AS (SELECT *, doc_id || '_lp_' || printf('%04d', page_no) AS page_id FROM (
  SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS doc_id, lower(c_mktsegment) AS domain, c_name AS title, o_orderkey AS page_no, o_orderstatus AS status,
    '订单' || o_orderkey || '的合同金额为' || CAST(floor(o_totalprice) AS BIGINT) || '万元，折扣率为' || (o_custkey % 17 + 1) || '.' || (o_orderkey % 9 + 1)
    || '%，账期' || (o_orderkey % 90 + 1) || '天。签订日期为' || year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate)
    || '日，第' || (o_orderkey % 30 + 1) || '条规定客户应当在' || (o_orderkey % 28 + 1) || '日内支付，违约金比例为' || (o_custkey % 5 + 1)
    || '%。逾期' || (o_orderkey % 12 + 1) || '个月的按营业收入计收，详见附表' || (o_orderkey % 4 + 1)
    || '。本公司 研发投入 保持稳定 交付节奏 与 客户结构 均 未发生 重大变化 供应商集中度 有所下降 现金流 较为充裕 ' || o_orderpriority || '。' AS text
  FROM orders JOIN customer ON c_custkey = o_custkey))"""


@query(
    "d1_extract_terms",
    f"""WITH {ORDERS_SQL} SELECT page_id,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text, '第[一二三四五六七八九十百千万零〇0-9]+[章节条款项]'))), '|') AS clause_ids,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{{4}}年(?:[0-9]{{1,2}}月(?:[0-9]{{1,2}}日)?)?'))), '|') AS dates,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%|[0-9]+(?:\\.[0-9]+)?(?:万|亿)?(?:元|股|吨|家|个|项|倍|年|个月|日)'))), '|') AS numbers
    FROM op""",
)
def d1(spark, d):
    terms = E.page_terms("text")
    return order_pages(spark, d).select("page_id", *[terms[c].alias(c) for c in ("clause_ids", "dates", "numbers")])


@query(
    "d2_table_headers",
    """SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus AS table_headers FROM orders""",
)
def d2(spark, d):
    cells = F.concat(F.lit("前言\n| "), "o_orderpriority", F.lit(" |"), "o_orderstatus", F.lit("|--|\n|-|-|-|\n|1|2|3|"))
    return table(spark, d, "orders").select("o_orderkey", E.table_headers(cells).alias("table_headers"))


VALUES_SQL = f"""{ORDERS_SQL},
vx AS (SELECT page_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?(?:%|亿元|万元|元|天|日|年|月|倍|个百分点|个基点|万股|股)')) AS s,
  generate_subscripts(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?(?:%|亿元|万元|元|天|日|年|月|倍|个百分点|个基点|万股|股)'), 1) AS pos FROM op),
vd AS (SELECT page_id, s, min(pos) AS pos FROM vx GROUP BY page_id, s),
vr AS (SELECT page_id, s, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n,
  CAST(regexp_extract(s, '^[0-9.]+') AS DOUBLE) AS value, replace(regexp_replace(s, '^[0-9.]+', ''), '日', '天') AS unit FROM vd)"""


@query("d5_measured_values", f"WITH {VALUES_SQL} SELECT page_id, n, s AS surface, value, unit FROM vr WHERE n <= 8")
def d5(spark, d):
    rows = order_pages(spark, d).select("page_id", F.posexplode(E.measured_values(F.col("text"))).alias("n", "v"))
    return rows.select("page_id", (F.col("n") + 1).alias("n"), "v.*")


@query(
    "d5_number_tokens",
    f"""WITH {ORDERS_SQL} SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?'),
      lambda x: ends_with(x, '%') OR length(replace(x, '.', '')) >= 2))), '|') AS tokens FROM op""",
)
def d5_tokens(spark, d):
    return order_pages(spark, d).select("page_id", F.array_sort(E.number_tokens(F.col("text"))).alias("tokens"))


@query(
    "d6_keywords",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}A-Za-z0-9]{2,12}')) AS word,
      generate_subscripts(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}A-Za-z0-9]{2,12}'), 1) AS pos FROM documents),
    s AS (SELECT doc_id, word, sum(1 + least(length(word), 6)) AS weight, min(pos) AS pos FROM w WHERE NOT regexp_matches(word, '^[0-9]+$') GROUP BY doc_id, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, length(word) DESC, pos) AS rank FROM s)
    SELECT doc_id, string_agg(word, '|' ORDER BY rank) AS keywords FROM r WHERE rank <= 8 GROUP BY doc_id""",
)
def d6(spark, d):
    return V.top_keywords(table(spark, d, "documents"), "doc_id", "text")


def questions(spark, d):
    """A question per order: several wordings, types and option sets, chosen by the order key."""
    o = table(spark, d, "orders")
    k = o["o_orderkey"]
    asks = F.array(*[F.lit(x) for x in ("请计算合计金额", "下列哪项规定适用", "比较两份合同的金额高低，哪份高于另一份", "该陈述是否正确", "请按金额从高到低排序", "发布日期是哪一天")])
    kinds = F.array(*[F.lit(x) for x in ("计算题", "单选题", "多选题", "判断题", "", "抽取题")])
    plain = F.create_map(F.lit("A"), F.lit("正确"), F.lit("B"), F.lit("错误"))
    two = F.create_map(
        F.lit("B"), F.concat(F.lit("合同金额不超过"), F.floor("o_totalprice"), F.lit("元且应当在5日内支付")),
        F.lit("A"), F.concat(F.lit("客户"), "o_custkey", F.lit("的净利润同时增长")),
    )
    pick = (k % 6 + 1).cast("int")
    return o.select(
        F.concat(F.lit("q"), k).alias("qid"), F.concat(F.element_at(asks, pick), F.lit("："), "o_orderpriority").alias("question"),
        F.element_at(kinds, pick).alias("type"), F.lit("").alias("answer_format"), F.when(k % 2 == 0, "A").otherwise("B").alias("split"),
        F.lower("o_orderstatus").alias("domain"),
        F.when(k % 6 == 3, plain).when((k % 6).isin(1, 2), two).alias("options"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("doc_ids"),
    )


ASK_SQL = """
ask AS (SELECT o_orderkey AS k, 'q' || o_orderkey AS qid,
  ['请计算合计金额', '下列哪项规定适用', '比较两份合同的金额高低，哪份高于另一份', '该陈述是否正确', '请按金额从高到低排序', '发布日期是哪一天'][o_orderkey % 6 + 1] || '：' || o_orderpriority AS question,
  ['计算题', '单选题', '多选题', '判断题', '', '抽取题'][o_orderkey % 6 + 1] AS type, lower(o_orderstatus) AS domain,
  CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS split, '客户' || o_custkey || '的净利润同时增长' AS oa, '合同金额不超过' || CAST(floor(o_totalprice) AS BIGINT) || '元且应当在5日内支付' AS ob
  FROM orders),
opt AS (SELECT qid || '_A' AS atomic_id, ask.*, 'A' AS label, oa AS option_text FROM ask WHERE k % 6 IN (1, 2) UNION ALL
  SELECT qid || '_B', ask.*, 'B', ob FROM ask WHERE k % 6 IN (1, 2) UNION ALL SELECT qid, ask.*, NULL, NULL FROM ask WHERE k % 6 NOT IN (1, 2)),
cb AS (SELECT *, CASE WHEN label IS NULL THEN question ELSE question || ' ' || option_text END AS t FROM opt),
ty AS (SELECT *, CASE WHEN type = '计算题' OR regexp_matches(t, '计算|多少|合计|比例|占比|增速|收益率') THEN 'calculation'
  WHEN type = '抽取题' OR regexp_matches(t, '抽取|填写|日期|名称|文号|施行|发布') THEN 'fact_extraction'
  WHEN regexp_matches(t, '排序|排名|从高到低|从低到高|大于号') THEN 'ranking'
  WHEN regexp_matches(t, '比较|高于|低于|大于|小于|多于|少于|最准确|哪两项') THEN 'comparison'
  WHEN regexp_matches(t, '适用|责任免除|责任范围|规定|规则|监管|处罚|违法|应当|不得') THEN 'rule_applicability' ELSE 'claim_verification' END AS task_type FROM cb)"""


@query(
    "k9_atomic_questions",
    f"""WITH {ASK_SQL} SELECT atomic_id, qid AS source_qid, split AS source_split, domain, type AS source_type,
      CASE type WHEN '多选题' THEN 'multi' WHEN '单选题' THEN 'mcq' WHEN '判断题' THEN 'tf' WHEN '计算题' THEN 'free' WHEN '抽取题' THEN 'free' ELSE 'unknown' END AS source_answer_format,
      task_type, CASE WHEN label IS NOT NULL THEN CASE WHEN task_type IN ('comparison', 'rule_applicability') THEN '请核验并说明依据'
          WHEN task_type = 'calculation' THEN '请根据文档核验或计算' ELSE '请核验' END || '：在“' || question || '”这个问题背景下，选项' || label || '的陈述是否成立：' || option_text
        ELSE CASE task_type WHEN 'calculation' THEN '请根据企业文档计算并回答：' WHEN 'ranking' THEN '请根据企业文档完成排序并回答：' ELSE '请根据企业文档抽取或回答：' END || question END AS question,
      CASE task_type WHEN 'claim_verification' THEN 'supported|contradicted|insufficient' WHEN 'rule_applicability' THEN 'applicable|not_applicable|insufficient'
        WHEN 'calculation' THEN 'calculated_value' WHEN 'ranking' THEN 'ordered_result' ELSE 'extracted_value' END AS expected_answer FROM ty""",
)
def k9(spark, d):
    cols = ("atomic_id", "source_qid", "source_split", "domain", "source_type", "source_answer_format", "task_type", "question", "expected_answer")
    return V.atomic_questions(questions(spark, d)).select(*cols)


@query(
    "d8_metrics",
    f"""WITH {ASK_SQL} SELECT atomic_id, CASE WHEN contains(t, '净利润') THEN '净利润' ELSE '' END AS metrics FROM ty""",
)
def d8(spark, d):
    return V.atomic_questions(questions(spark, d)).select("atomic_id", "metrics")


@query(
    "d9_constraints",
    f"""WITH {ASK_SQL} SELECT atomic_id, array_to_string(list_filter([
      CASE WHEN regexp_matches(t, '都|均|全部|各自|分别|四款|三类|两类|两者') THEN '需要覆盖题干涉及的所有对象，不能只验证其中一部分。' END,
      CASE WHEN regexp_matches(t, '同时|并且|既|又|双重') THEN '需要同时满足复合条件，不能只满足其中一个条件。' END,
      CASE WHEN regexp_matches(t, '高于|低于|大于|小于|超过|不超过') THEN '需要核对比较方向、单位和统计口径。' END,
      CASE WHEN regexp_matches(t, '第|年度|周岁|日期|施行|发布') THEN '需要核对时间、年度、年龄或生效日期条件。' END,
      CASE WHEN regexp_matches(t, '只填写|保留两位|%|大于号|排序') THEN '需要按问题要求输出格式化答案。' END], lambda x: x IS NOT NULL), '|') AS constraints FROM ty""",
)
def d9(spark, d):
    return V.atomic_questions(questions(spark, d)).select("atomic_id", "constraints")


@query("d10_task_type", f"WITH {ASK_SQL} SELECT task_type, domain, count(*) AS n FROM ty GROUP BY ALL")
def d10(spark, d):
    rows = V.atomic_questions(questions(spark, d))
    return rows.groupBy("task_type", "domain").agg(F.count("*").alias("n"))


@query("d7_entities")
def d7(spark, d):
    """Named things in every contract note and its question."""
    return order_pages(spark, d).select("page_id", E.entities(F.concat("text", F.lit("《"), "title", F.lit("》"))).alias("entities"))


@query(
    "e11_counts",
    f"""WITH {ASK_SQL} SELECT 'task_type' AS key, task_type AS value, count(*) AS n, count(DISTINCT qid) AS n_distinct FROM ty GROUP BY task_type
    UNION ALL SELECT 'domain', domain, count(*), count(DISTINCT qid) FROM ty GROUP BY domain
    UNION ALL SELECT 'source_split', split, count(*), count(DISTINCT qid) FROM ty GROUP BY split""",
)
def e11(spark, d):
    return V.counts(V.atomic_questions(questions(spark, d)), "task_type", "domain", "source_split", distinct="source_qid")


@query(
    "h16_option_rows",
    f"""WITH {ASK_SQL} SELECT qid, CAST(0 AS BIGINT) AS option_ord, 'T' AS option, question AS claim FROM ask WHERE k % 6 = 3
    UNION ALL SELECT qid, CASE label WHEN 'B' THEN 0 ELSE 1 END, label, option_text FROM opt WHERE label IS NOT NULL""",
)
def h16(spark, d):
    rows = questions(spark, d).withColumn("answer_format", E.answer_format(F.col("answer_format"), F.col("type")))
    return V.option_rows(rows).select("qid", "option_ord", "option", "claim")


@query(
    "d28_question_form",
    f"""WITH {ASK_SQL} SELECT atomic_id, CASE WHEN task_type IN ('claim_verification', 'rule_applicability') OR label IS NOT NULL OR contains(question, '是否正确') THEN 'tf' ELSE 'free' END AS answer_format FROM ty""",
)
def d28(spark, d):
    return V.question_form(V.atomic_questions(questions(spark, d)).drop("answer_format")).select("atomic_id", "answer_format")


@query(
    "d24_normalize_answers",
    """WITH t AS (SELECT doc_id, ['multi', 'mcq', 'tf', 'free'][doc_id % 4 + 1] AS form, list_filter(regexp_extract_all(upper(text), '[A-D]'), lambda x: true) AS l FROM documents)
    SELECT doc_id, CASE WHEN form IN ('mcq', 'tf') THEN coalesce(l[1], '') ELSE array_to_string(list_sort(list_distinct(l)), '') END AS answer FROM t""",
)
def d24(spark, d):
    forms = F.array(*[F.lit(x) for x in ("multi", "mcq", "tf", "free")])
    form = F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", E.normalize_answer(F.col("text"), form).alias("answer"))


# --- K -----------------------------------------------------------------------


def cases_and_responses(spark, d):
    """Benchmark texts as cases with labels as expectations; responses are the pages searched for them."""
    hits = cut_lineage(Q.search_pages(bench_queries(spark, d), line_index(spark, d), k=3, quote=120))  # cases and responses read it
    responses = hits.groupBy(F.col("qid").alias("id")).agg(
        F.array_agg(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("doc_ids"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.struct("doc_id", F.lit("h").alias("heading"), "quote").alias("e")))), lambda x: x["e"]
        ).alias("evidence"),
        F.min_by("quote", "rank").alias("answer"),
        F.round(F.max("score") / 7, 3).alias("elapsed_seconds"),
    )
    responses = responses.select("id", "doc_ids", "evidence", "answer", F.lit("").alias("reason"), "elapsed_seconds")
    n = F.substring("qid", 2, 20).cast("int")
    kinds = F.array(*[F.lit(x) for x in ("fact", "insufficient_evidence", "multi")])
    expected = hits.filter("rank = 2").select(F.col("qid").alias("id"), F.col("doc_id").alias("second"))
    cases = bench_queries(spark, d).select(
        F.col("qid").alias("id"), n.alias("ord"), "domain", F.element_at(kinds, n % 3 + 1).alias("task_type"),
        F.array(F.substring_index("query", " ", 2)).alias("expected_answer_keywords"),
        F.array(F.substring_index("query", " ", 1)).alias("expected_evidence_keywords"),
    ).join(expected, "id")
    docs = F.when(F.col("task_type") == "multi", F.array("second", F.concat(F.lit("d"), "ord"))).otherwise(F.array("second"))
    return cases.withColumn("expected_doc_ids", docs).drop("second"), responses


SCORED_SQL = f"""{BM25_SQL}, {TOP_SQL},
hit AS (SELECT qid, rank, top.doc_id, score, CASE WHEN length(s) <= 120 THEN s ELSE rtrim(substr(s, 1, 117)) || '...' END AS quote
  FROM top JOIN (SELECT page_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM pg) pg ON pg.page_id = top.page_id WHERE rank <= 3),
rsp AS (SELECT qid, list(doc_id) AS docs, arg_min(quote, rank) AS answer, string_agg(quote || ' h', chr(10) ORDER BY rank) AS ev, round(round(max(score), 3) / 7, 3) AS secs FROM hit GROUP BY qid),
cse AS (SELECT qs.qid, domain, CAST(substr(qs.qid, 2) AS BIGINT) AS n, string_split(query, ' ')[1] AS w1, array_to_string(string_split(query, ' ')[1:2], ' ') AS w2, h.doc_id AS second
  FROM qs JOIN hit h ON h.qid = qs.qid AND h.rank = 2),
sc AS (SELECT c.qid AS id, n, domain, ['fact', 'insufficient_evidence', 'multi'][n % 3 + 1] AS task_type,
  list_contains(docs, second) OR (n % 3 = 2 AND list_contains(docs, 'd' || n)) AS doc_hit,
  list_contains(docs, second) AND (n % 3 <> 2 OR list_contains(docs, 'd' || n)) AS multi_doc_coverage, n % 3 = 2 AND second <> 'd' || n AS two,
  contains(answer, w2) AS answer_keyword_hit, contains(ev || chr(10) || answer, w1) AS evidence_keyword_hit, secs AS elapsed_seconds
  FROM cse c JOIN rsp r ON r.qid = c.qid),
scored AS (SELECT * EXCLUDE (two), CASE WHEN task_type = 'insufficient_evidence' THEN answer_keyword_hit WHEN two THEN multi_doc_coverage AND (answer_keyword_hit OR evidence_keyword_hit)
  ELSE doc_hit AND (answer_keyword_hit OR evidence_keyword_hit) END AS passed FROM sc)"""


@query("k1_score_cases", f"WITH {SCORED_SQL} SELECT * EXCLUDE (n) FROM scored")
def k1(spark, d):
    return V.score_cases(*cases_and_responses(spark, d))


RATE_SQL = ", ".join(f"round(avg(CAST({c} AS INT)), 4) AS {c}_rate" for c in V.RATES)


@query(
    "k2_eval_summary",
    f"""WITH {SCORED_SQL} SELECT task_type, CAST(0 AS BIGINT) AS overall, count(*) AS total, {RATE_SQL}, round(avg(elapsed_seconds), 3) AS avg_latency_seconds FROM scored GROUP BY task_type
    UNION ALL SELECT NULL, 1, count(*), {RATE_SQL}, round(avg(elapsed_seconds), 3) FROM scored""",
)
def k2(spark, d):
    return V.eval_summary(V.score_cases(*cases_and_responses(spark, d)))


@query("k3_select_cases", "SELECT item_id FROM benchmark ORDER BY item_id LIMIT 7")
def k3(spark, d):
    return V.select_cases(table(spark, d, "benchmark"), "item_id", limit=7).select("item_id")


@query(
    "a7_upsert_results",
    f"""WITH {SCORED_SQL} SELECT id, CASE WHEN n % 2 = 0 THEN NOT passed ELSE passed END AS passed, CASE WHEN n % 5 <> 0 THEN n END AS case_ord FROM scored WHERE n % 3 > 0 OR n % 2 = 0""",
)
def a7(spark, d):
    """Even cases are run again with the opposite verdict; every fifth case is no longer in the set."""
    cases, responses = cases_and_responses(spark, d)
    rows = V.score_cases(cases, responses).join(cases.select("id", "ord"), "id").select("id", "passed", "ord")
    old, new = rows.filter("ord % 3 > 0").drop("ord"), rows.filter("ord % 2 = 0").select("id", (~F.col("passed")).alias("passed"))
    return V.upsert_results(old, new, cases.filter("ord % 5 <> 0"))


@query(
    "a8_answer_table",
    f"""WITH {TURNS_SQL}, r AS (SELECT session_id || '-' || turn_index AS qid, CASE WHEN turn_index % 2 = 0 THEN 'B' ELSE 'A' END AS answer, length(user_query) AS p, length(assistant_answer) AS c FROM t)
    SELECT qid, answer, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, CAST(1 AS BIGINT) AS ord FROM r
    UNION ALL SELECT 'summary', '', CAST(sum(p) AS BIGINT), CAST(sum(c) AS BIGINT), CAST(sum(p + c) AS BIGINT), 0 FROM r""",
)
def a8(spark, d):
    t = turns(spark, d).select(
        F.concat_ws("-", "session_id", "turn_index").alias("qid"), F.lit("A").alias("answer"), "turn_index",
        F.length("user_query").cast("bigint").alias("prompt_tokens"), F.length("assistant_answer").cast("bigint").alias("completion_tokens"),
    )
    return V.answer_table(t.drop("turn_index"), t.filter("turn_index % 2 = 0").withColumn("answer", F.lit("B")).drop("turn_index"))


@query(
    "e14_token_usage",
    f"""WITH {TURNS_SQL} SELECT session_id, CAST(sum(length(user_query)) AS BIGINT) AS prompt_tokens, CAST(sum(length(assistant_answer)) AS BIGINT) AS completion_tokens,
      CAST(sum(length(user_query) + length(assistant_answer)) AS BIGINT) AS total_tokens FROM t GROUP BY session_id""",
)
def e14(spark, d):
    calls = turns(spark, d).select("session_id", F.length("user_query").alias("prompt_tokens"), F.length("assistant_answer").alias("completion_tokens"))
    return V.token_usage(calls.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")), "session_id")


@query(
    "k4_draft_cases",
    f"""WITH {ORDERS_SQL}, sf AS (SELECT *, coalesce(nullif(regexp_extract(text, '[0-9.]+%'), ''), '') AS answer,
        list_filter(regexp_extract_all(text, '[^。；;.!?？]*[。；;.!?？]|[^。；;.!?？]+$'), lambda p: contains(p, regexp_extract(text, '[0-9.]+%')))[1] AS part, strpos(text, regexp_extract(text, '[0-9.]+%')) AS loc FROM op),
    fd AS (SELECT domain, doc_id, min(page_no) AS page_no FROM op GROUP BY domain, doc_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS no FROM fd)
    SELECT rk.domain || CASE WHEN no <= 5 THEN '_num_' || printf('%03d', no) ELSE '_summary_' || printf('%03d', no - 5) END AS id, rk.domain AS domain, rk.doc_id AS doc_id, page_id,
      CASE WHEN no <= 5 THEN 'numeric_fact' ELSE 'summary_keyword' END AS answer_type,
      '根据《' || title || '》中“合同 > ' || status || '”部分，' || CASE WHEN no <= 5 THEN '文中提到的关键数值是多少？请给出原文中的数值并简要说明对应事项。' ELSE '概括该部分主要讨论的内容。' END AS question,
      CASE WHEN no <= 5 THEN CASE WHEN part IS NOT NULL THEN part ELSE substr(text, greatest(1, loc - 120), loc - greatest(1, loc - 120) + 180) END ELSE substr(text, 1, 320) END AS quote
    FROM rk JOIN sf ON sf.domain = rk.domain AND sf.doc_id = rk.doc_id AND sf.page_no = rk.page_no WHERE no <= 10""",
)
def k4(spark, d):
    return V.draft_cases(order_pages(spark, d), 10).select("id", "domain", "doc_id", "page_id", "answer_type", "question", "quote")


@query("k5_task_cases")
def k5(spark, d):
    return V.task_cases(order_pages(spark, d))


@query(
    "k8_split_groups",
    """WITH k AS (SELECT DISTINCT 'c' || o_custkey AS qid FROM orders), r AS (SELECT qid, row_number() OVER (ORDER BY md5('42:' || qid), qid) AS rn, count(*) OVER () AS n FROM k)
    SELECT 'c' || o_custkey AS qid, o_orderkey, CASE WHEN rn <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM orders JOIN r ON r.qid = 'c' || o_custkey""",
)
def k8(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("qid"), "o_orderkey")
    return V.split_groups(rows, "qid")


def run_logs(spark, d):
    """Markdown run logs written from the contract notes: one unit per order, one log per customer."""
    pages = order_pages(spark, d)
    evidence = F.struct(
        F.col("page_id").alias("evidence_id"), "doc_id", "heading_path", F.lit("initial").alias("source"), "text"
    )
    unit = F.struct(
        F.format_string("u%d", "page_no").alias("unit_id"), F.lit("option").alias("kind"), F.lit("A").alias("option"), F.col("title").alias("claim"),
        F.array("doc_id").alias("target_doc_ids"), F.array(evidence).alias("evidence"),
        F.create_map("page_id", F.struct(F.lit("useful").alias("mark"))).alias("evidence_marks"),
        F.when(F.col("page_no") % 5 != 0, F.struct(F.when(F.col("page_no") % 2 == 0, "complete").otherwise("partial").alias("status"))).alias("audit"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.to_json(unit).alias("u")))), lambda x: x["u"])
    units = F.concat(F.lit("["), F.array_join(listed, ",\n"), F.lit("]"))
    logs = pages.groupBy("doc_id").agg(units.alias("units"))
    return logs.select(
        F.concat(F.lit("logs/clean_"), "doc_id", F.lit(".md")).alias("path"),
        F.concat(
            F.lit("# Agent Debug: "), "doc_id", F.lit("\n- answer: `A`\n- token_usage: `{\"prompt_tokens\": 7, \"completion_tokens\": 5, \"total_tokens\": 12}`\n## Detailed Units\n```json\n"),
            "units", F.lit("\n```\n"),
        ).alias("text"),
    )


@query(
    "k6_audit_samples",
    f"""WITH {ORDERS_SQL} SELECT doc_id || ':u' || page_no AS id, doc_id AS qid, 'A' AS final_answer, CAST(12 AS BIGINT) AS total_tokens,
      CASE WHEN page_no % 2 = 0 THEN 'complete' ELSE 'partial' END AS status, page_id AS evidence_id, 'useful' AS mark, text AS evidence_text FROM op WHERE page_no % 5 <> 0""",
)
def k6(spark, d):
    s = V.audit_samples(run_logs(spark, d))
    e = F.col("input.evidence")[0]
    return s.select(
        "id", "source.qid", "source.final_answer", "source.token_usage.total_tokens", "output.status",
        e["evidence_id"].alias("evidence_id"), e["mark"].alias("mark"), e["text"].alias("evidence_text"),
    )


NULLS = ",".join(f'"{c}":null' for c in ("condition_satisfied", "filled", "missing", "evidence_marks", "next_action", "reason"))


@query(
    "k7_to_messages",
    f"""WITH {ORDERS_SQL} SELECT doc_id || ':u' || page_no AS id, 'system,user,assistant' AS roles,
      '{{"kind":"option","option":"A","claim":"' || title || '","option_subject":null,"question_condition":null,"task":null,"target_doc_ids":["' || doc_id || '"],"slots":[],"evidence":[{{"evidence_id":"'
      || page_id || '","doc_id":"' || doc_id || '","heading":"合同 > ' || status || '","source":"initial","mark":"useful","text":"' || text || '"}}],"notes":[]}}' AS user,
      '{{"status":"' || CASE WHEN page_no % 2 = 0 THEN 'complete' ELSE 'partial' END || '",{NULLS}}}' AS assistant FROM op WHERE page_no % 5 <> 0""",
)
def k7(spark, d):
    m = V.to_messages(V.audit_samples(run_logs(spark, d)), "Audit the evidence.")
    roles = F.array_join(F.transform("messages", lambda x: x["role"]), ",")
    return m.select("id", roles.alias("roles"), F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("assistant"))
