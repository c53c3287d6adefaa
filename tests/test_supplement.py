"""Terms, payloads, names, entities, supplementary pages, missing slots and period tables on small tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from leafscan.functions import extract as E
from leafscan.functions import payload as P
from leafscan.functions import text as X
from leafscan.functions.containment import substring_join
from leafscan.operators import audit as A
from leafscan.operators import entities as N
from leafscan.operators import segment as S
from leafscan.operators import supplement as U


def one(spark, column, *values, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_running_sums(spark):
    rows = [[], [5], list(range(1, 70)), [-1] * 33]
    assert one(spark, X.running_sums(F.col("t")), *rows, schema="t array<bigint>") == [[sum(r[: i + 1]) for i in range(len(r))] for r in rows]


def test_packing_takes_many_paragraphs(spark):
    """A text of 30,000 paragraphs: steps must not grow with the square."""
    rng = random.Random(1)
    text = "\n\n".join("y" * rng.choice([1, 5, 30, 90]) for _ in range(30_000))
    got = one(spark, S.pack("t", 100, 10), text)[0]
    cur, want = "", []
    for p in text.split("\n\n"):
        if cur and len(cur) + len(p) + 2 > 100:
            want.append(cur)
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    assert got == [*want, cur]


def test_dotted_markers_of_any_length(spark):
    text = "# H\n" + "1." * 20_000 + "1 x\n正文"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = S.outline(docs, "heading_plus_numbered").orderBy("first_pos").collect()
    assert rows[1]["level"] == 1 + 20_001 and rows[1]["heading_path"][0] == "H"


# --- D22, D23 -------------------------------------------------------------------------


def test_typed_terms(spark):
    parts = ["查询2023年至2024年新能源板块的营业收入", "2022年1-6月 毛利率是多少", "A产品，单价 12 元；B项目的投资金额"]
    got = one(spark, E.typed_terms(F.col("t"), 12), parts, schema="t array<string>")[0]
    assert got[:2] == ["年至新能源板块", "营业收入"] or "新能源板块" in "".join(got)
    assert "毛利率" in got and "A产品" in got and "B项目" in got and "投资金额" in got
    assert not any("多少" in t or t == "2022" for t in got) and len(got) == len(set(got))
    assert one(spark, E.typed_terms(F.col("t")), [], [None], ["的"], schema="t array<string>") == [[], [], []]


def test_json_objects(spark):
    value = {"a": 'brace } and \\" quote "{', "b": {"c": [1, {"d": "}"}]}}
    text = json.dumps(value)
    replies = [text, f"```json\n{text}\n```", f"```\n{text}\n```", f"so: {text} and {{more}} }}", "no object", None, '{"open": 1', '{"a": 1} {"b": 2}']
    got = one(spark, P.json_object(F.col("t")), *replies)
    assert [json.loads(g) for g in got[:4]] == [value] * 4
    assert got[4:7] == [None, None, None] and json.loads(got[7]) == {"a": 1}
    long = '{"x": "' + "ab\\\\" * 50_000 + '"}'
    assert one(spark, P.json_object(F.col("t")), "say " + long) == [long]


# --- G9, G10 ----------------------------------------------------------------------------


def test_substring_join(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(60)]
    terms = ["".join(rng.choices("abc", k=rng.randint(0, 4))) for _ in range(40)]
    found = substring_join(spark.createDataFrame([(t,) for t in texts], "x string"), spark.createDataFrame([(t,) for t in terms], "term string"), "x")
    assert sorted(map(tuple, found.collect())) == sorted({(x, t) for x in texts for t in terms if t and t in x})


def test_identity_match(spark):
    names = [("d1", 0, "华夏光电股份有限公司"), ("d1", 1, "华夏光电集团"), ("d1", 2, "风险提示有限公司"), ("d2", 0, "东海电气有限公司"), ("d3", 0, "Blue Ocean Company"), ("d4", 0, "text12_no_images")]
    claims = [("a", "华夏光电2023年收入增长"), ("b", "华夏光电股份有限公司与东海电气有限公司相比"), ("c", "blue ocean report"), ("e", "毫无关系"), ("f", "光电")]
    candidates = [(q, d, i + 1) for q, _ in claims for i, d in enumerate(["d1", "d2", "d3", "d4"])]
    got = N.identity_match(
        spark.createDataFrame(claims, "qid string, claim string"), spark.createDataFrame(candidates, "qid string, doc_id string, ord int"),
        spark.createDataFrame(names, "doc_id string, pos int, name string"),
    )
    rows = {(r["qid"], r["doc_id"]): r["score"] for r in got.collect()}
    # the second document of b scores 8, less than 0.6 of the first; f is part of a name
    assert set(rows) == {("a", "d1"), ("b", "d1"), ("c", "d3"), ("f", "d1")}
    assert rows[("a", "d1")] == pytest.approx(10 / 1.2 + 8.0)  # the second name is short and takes the floor


def test_entity_docs(spark):
    questions = [("a", "在光模块、激光雷达和硅片领域中，性能的共同规律？", ""), ("b", "在光模块领域中，怎样？", ""), ("c", "在光模块、激光雷达领域中，怎样？", "")]
    profiles = [("d1", "光模块 性能 稳定"), ("d2", "激光雷达 成本"), ("d3", "白酒 行业")]
    candidates = [(q, d, i + 1) for q in "abc" for i, d in enumerate(["d1", "d2", "d3"])]
    got = N.entity_docs(
        spark.createDataFrame(questions, "qid string, question string, claim string"), spark.createDataFrame(candidates, "qid string, doc_id string, ord int"),
        spark.createDataFrame(profiles, "doc_id string, profile string"),
    ).orderBy("qid", "entity_no")
    assert [(r["qid"], r["entity"], r["doc_id"]) for r in got.collect()] == [("a", "光模块", "d1"), ("a", "激光雷达", "d2")]


# --- F31, F32, H17 ------------------------------------------------------------------------

EVIDENCE = "qid string, ord int, evidence_id string, doc_id string, heading_path array<string>, text string, source string"
PAGES = "doc_id string, domain string, page_id string, page_no int, title string, heading_path array<string>, text string"


def test_key_figure_pages(spark):
    body = "本期营业收入为一百亿元，较上年增长。"
    rows = [("d1", "x", f"d1_{i}", i, "t", ["概况"], body) for i in range(1, 5)] + [("d1", "x", "d1_5", 5, "t", ["主要会计数据"], body), ("d1", "x", "d1_6", 6, "t", ["财务指标"], body)]
    rows += [("d2", "x", f"d2_{i}", i, "t", ["概况"], body) for i in range(1, 81)] + [("d2", "x", "d2_81", 81, "t", ["财务指标"], body)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("index_text", F.col("text"))
    requests = spark.createDataFrame([("a", "d1", "营业收入是多少"), ("a", "d2", "营业收入是多少"), ("b", "d1", "地址在哪里")], "qid string, doc_id string, query string")
    assert [(r["qid"], r["evidence_id"]) for r in U.key_figure_pages(requests, pages).collect()] == [("a", "d1_5")]


def test_axis_pages(spark):
    rows = [
        ("d1", "x", "p1", 1, "t", ["概况"], "公司通过新工艺降低成本，同时性能提升明显，客户反馈良好。"),
        ("d1", "x", "p2", 2, "t", ["概况"], "单位成本同步下降，速率与可靠性能提升，良率优化，费用节约显著。"),
        ("d1", "x", "p3", 3, "t", ["概况"], "本页只谈成本与费用，再无其他内容可言，篇幅略长一些。"),
        ("d1", "x", "p4", 4, "t", ["目录"], "成本 性能"),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumn("index_text", F.col("text"))
    requests = spark.createDataFrame([("a", "d1", "降低成本并提升性能"), ("b", "d1", "成本为何下降 核心技术"), ("c", "d1", "地址")], "qid string, doc_id string, query string")
    assert [(r["qid"], r["evidence_id"]) for r in U.axis_pages(requests, pages, "quality", "s").collect() if r["qid"] != "b"] == [("a", "p2")]
    assert {(r["qid"], r["evidence_id"]) for r in U.axis_pages(requests, pages, "mechanism", "s").collect()} == {("b", "p1")}


def test_match_missing(spark):
    evidence = [
        ("q", 1, "e1", "d1", ["合同"], "违约金比例为 3% 按日计收", "initial"),
        ("q", 2, "e2", "d1", ["合同"], "研发投入 100 万元 营业收入 增长", "followup"),
        ("q", 3, "e3", "d2", ["合同"], "违约金比例 3% 营业收入", "initial"),
        ("q", 4, "e4", "d1", ["附录"], "无关内容", "initial"),
        ("r", 1, "e5", "d1", ["合同"], "违约金比例 3%", "initial"),
    ]
    missing = [("q", 1, "违约金比例", "", "3%", ["d1"]), ("q", 2, "营业收入", None, "", []), ("s", 1, "营业收入", "", "", [])]
    got = U.match_missing(
        spark.createDataFrame(missing, "qid string, slot_no int, slot string, followup_query string, query string, target_doc_ids array<string>"), spark.createDataFrame(evidence, EVIDENCE)
    )
    rows = {(r["qid"], r["evidence_id"]): (r["score"], r["rank"]) for r in got.collect()}
    assert set(rows) == {("q", "e1"), ("q", "e2"), ("q", "e3")}
    # 营业收入: the run and its five grams, and the metrics 营业收入 and 收入; the follow-up adds one
    assert rows[("q", "e2")][0] == rows[("q", "e3")][0] + 1


def test_audit_reading(spark):
    evidence = spark.createDataFrame([("q", i, f"e{i}", "d", ["h"], f"内容{i} 违约金比例" if i == 4 else f"内容{i}", "initial") for i in range(1, 9)], EVIDENCE).withColumn("score", F.lit(1.0))
    evidence = evidence.unionByName(evidence.withColumn("qid", F.lit("r")))
    missing = spark.createDataFrame([("q", 1, "违约金比例", "", "", [])], "qid string, slot_no int, slot string, followup_query string, query string, target_doc_ids array<string>")
    lists = spark.createDataFrame([("q", "slot", 1, "e2"), ("q", "new", 1, "e2"), ("q", "new", 2, "e7"), ("r", "new", 1, "e5")], "qid string, kind string, pos int, evidence_id string")
    got = {}
    for r in U.audit_reading(evidence, lists, missing).orderBy("qid", "reading_no").collect():
        got.setdefault(r["qid"], []).append(r["evidence_id"])
    assert got == {"q": ["e7", "e4"], "r": ["e5", "e1", "e2", "e3", "e4", "e6"]}


def test_decisive(spark):
    queries = spark.createDataFrame([("a", "违约 赔偿 期限"), ("b", "违约 仲裁 诉讼"), ("c", "")], "qid string, query string")
    snippets = spark.createDataFrame([(q, "违约的应当赔偿") for q in "abc"], "qid string, text string")
    assert {r["qid"]: r["decisive"] for r in U.decisive(queries, snippets).collect()} == {"a": True, "b": False, "c": False}


# --- H12 ------------------------------------------------------------------------------------


def test_period_tasks(spark):
    schema = (
        "qid string, pos int, task string, task_type string, target_doc_ids array<string>, known_facts array<struct<slot:string,value:string>>, "
        "search_slots array<struct<slot:string,query:string>>"
    )
    def task(q, pos, text, kind="retrieve", docs=("d",)):
        return (q, pos, text, kind, list(docs), [("币种", "人民币")], [("营业收入", "2023年 收入")])

    tasks = [task(q, i, f"查询{2020 + i}年A产品收入") for q in "abc" for i in (1, 2, 3)] + [task("c", 4, "汇总", "summarize"), task("e", 1, "查询2021年收入"), task("e", 2, "查询2022年收入", docs=("x",))]
    questions = [("a", "各年收入", "free"), ("b", "各年收入", "mcq"), ("c", "各年收入", "free"), ("e", "各年收入", "free")]
    got = A.merge_period_tasks(spark.createDataFrame(tasks, schema), spark.createDataFrame(questions, "qid string, question string, answer_format string")).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r["qid"], []).append(r)
    assert {q: len(rows) for q, rows in by_q.items()} == {"a": 1, "b": 3, "c": 4, "e": 2}
    merged = by_q["a"][0]
    assert merged["task"] == A.PERIOD_TASK and len(merged["known_facts"]) == 1
    assert "A产品" in merged["search_slots"][0]["query"] and "2021" not in merged["search_slots"][0]["query"] and "明细" in merged["search_slots"][0]["query"]
