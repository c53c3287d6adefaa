"""Steps shared by several searches: rules run once, tokens are not exchanged, equal hints look once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafscan import session
from leafscan.operators import evidence as V
from leafscan.operators import search as Q
from leafscan.operators import sections as S


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def notes(spark):
    rows = [("m", "d1", "p1", 1, "alpha beta beta 违约金比例"), ("m", "d1", "p2", 2, "beta"), ("m", "d2", "p3", 1, "alpha gamma"), ("m", "d2", "p4", 2, None)]
    rows += [("m", "d1", "p1", 1, "alpha beta beta 违约金比例"), ("m", "d2", "p3", 1, "alpha"), (None, "d3", "p5", 1, "alpha"), ("n", None, "p6", 1, "alpha")]
    pages = spark.createDataFrame(rows, "domain string, doc_id string, page_id string, page_no int, index_text string")
    asked = spark.createDataFrame([("q1", "m", "alpha beta 违约金"), ("q2", "m", "gamma alpha alpha"), ("q3", "n", "alpha")], "qid string, domain string, query string")
    allowed = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q1", "d2"), ("q2", "d2"), ("q3", None)], "qid string, doc_id string")
    return pages, asked, allowed


def scores(df) -> dict:
    return {(r["qid"], r["doc_id"], r["page_id"], r["page_no"]): round(r["score"], 9) for r in df.collect()}


def test_filtered_search_with_many_terms_scores_alike(spark, monkeypatch):
    pages, asked, allowed = notes(spark)
    one = scores(Q.bm25(asked, pages, allowed))
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    called = []
    real = Q.allowed_bm25
    monkeypatch.setattr(Q, "allowed_bm25", lambda *a: called.append(1) or real(*a))
    assert scores(Q.bm25(asked, pages, allowed)) == one
    assert called and ("q2", "d2", "p3", 1) in one and ("q1", "d1", "p2", 2) in one


def test_many_queries_of_few_terms_do_not_exchange_tokens(spark, monkeypatch):
    pages, asked, allowed = notes(spark)
    monkeypatch.setattr(session, "BROADCAST_CHARS", 0)  # as if the batch held millions of characters
    plan = optimized(Q.bm25(asked, pages, allowed))
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("strategy=broadcast" in line for line in semi)


@pytest.mark.parametrize("job", [V.local_subsearch, V.inner_focus])
def test_snippets_are_rated_once(spark, job):
    text = "\n\n".join(f"营业收入同比增长{i}% " + "word " * 40 for i in range(30))
    evidence = spark.createDataFrame([("q", 1, "e", "d", ["h"], text, 1.0, "initial")], "qid string, ord int, evidence_id string, doc_id string, heading_path array<string>, text string, score double, source string")
    found = job(evidence, spark.createDataFrame([("q", "word 营业收入")], "qid string, query string"))
    # the rules that rate a snippet stand once in the plan: in the generator, not again in a filter
    filters = [line for line in optimized(found).splitlines() if "Filter" in line and "score" in line]
    assert filters and not any("array_intersect" in line for line in filters)
    assert found.count() == 3


def headed(spark):
    sections = spark.createDataFrame(
        [("d", "s1", 1, "Alpha", ["Alpha"], ""), ("d", "s2", 2, "Beta", ["Alpha", "Beta"], ""), ("d", "s3", 3, "Alpha two", ["Alpha two"], "")],
        "doc_id string, section_id string, toc_no int, title string, heading_path array<string>, preview string",
    )
    long_ = "alpha words of a page that is long enough {}"
    pages = spark.createDataFrame(
        [("m", "d", f"p{i}", i, "99", ["Alpha"] if i < 4 else ["Other"], long_.format(i), long_.format(i)) for i in range(1, 6)],
        "domain string, doc_id string, page_id string, page_no int, title string, heading_path array<string>, text string, index_text string",
    )
    bridge = spark.createDataFrame([("s1", "d", f"p{i}", i) for i in (1, 2, 3)], "section_id string, doc_id string, page_id string, page_no int")
    return sections, bridge, pages


def test_only_pages_of_chosen_sections_are_cut(spark, monkeypatch):
    sections, bridge, pages = headed(spark)
    chosen = spark.createDataFrame([("q", "s1", "words 2")], "qid string, section_id string, query string")
    assert [r["page_id"] for r in S.section_pages_ranked(chosen, sections, bridge, pages).orderBy("rank").collect()] == ["p2", "p1"]
    monkeypatch.setattr(S, "cut_lineage", lambda df: df)
    lines = optimized(S.section_pages_ranked(chosen, sections, bridge, pages)).splitlines()
    kept = next((i for i, line in enumerate(lines) if "LeftSemi" in line), None)
    assert kept is not None and any("Generate" in line for line in lines[:kept])  # rules and tokens come behind the join


def test_equal_hints_of_a_document_look_once(spark, monkeypatch):
    sections, bridge, pages = headed(spark)
    rows = [("q1", "m", "d", "Alpha", ""), ("q2", "m", "d", "alpha", ""), ("q3", "m", "d", "zzqq", "long"), ("q4", "m", None, "Alpha", ""), ("q5", "m", "d", "Other", "")]
    hints = spark.createDataFrame(rows, "qid string, domain string, doc_id string, hint string, query string")
    kept, real = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: kept.append(real(df)) or kept[-1])
    found = {}
    for r in S.hint_search(hints, sections, bridge, pages).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append((r["evidence_id"], r["tier"]))
    assert kept[0].count() == 4  # five hints, two of them with one key
    assert found["q1"] == found["q2"] and [t for _, t in found["q1"]] == [1, 1, 1]
    assert found["q3"] and {t for _, t in found["q3"]} == {3} and found["q5"] == [("p4", 2), ("p5", 2)] and "q4" not in found


def test_sections_are_scored_without_a_row_per_token(spark):
    """Token sets meet by document: no step makes a row of each token, and repeats count as often as before."""
    sections, _, pages = headed(spark)
    rows = [("q1", "d", "alpha two words"), ("q1", "d", "alpha two words"), ("q2", "d", "nothing here"), ("q3", None, "alpha"), ("q4", "d", None)]
    requests = spark.createDataFrame(rows, "qid string, doc_id string, query string")
    found = S.section_score(requests, sections)
    assert {(r["qid"], r["section_id"]): r["score"] for r in found.collect()} == {("q1", "s1"): 8.0, ("q1", "s2"): 8.0, ("q1", "s3"): 16.0}
    assert "explode(concat" not in optimized(found) and "explode(flatten" not in optimized(found)
    groups = S.heading_sections(pages)
    assert {r["section_id"]: (r["toc_no"], r["sample"].count("page")) for r in groups.collect()} == {"Alpha": (1, 3), "Other": (4, 2)}
    lines = optimized(groups).splitlines()
    window = next(i for i, line in enumerate(lines) if "Window " in line)
    assert any("substring" in line for line in lines[window:])  # texts are cut before they are exchanged


def test_notes_are_rated_once_and_queries_read_once(spark):
    evidence = spark.createDataFrame(
        [("q", 1, "e1", "d", ["h"], "费用应当由客户支付。是的。违约金比例为3%，按合同。"), ("q", 2, "e2", "d", ["h"], None), ("q2", 1, "e3", "d", ["h"], "费用。")],
        "qid string, ord int, evidence_id string, doc_id string, heading_path array<string>, text string",
    )
    tasks = spark.createDataFrame([("q", "是否约定违约金比例为3%的费用"), ("q2", None)], "qid string, query string")
    found = V.evidence_notes(evidence, tasks)
    notes = {(r["source_evidence_id"], r["note"]) for r in found.collect()}
    assert {("e1", "费用应当由客户支付。"), ("e1", "违约金比例为3%，按合同。")} <= notes and "e2" not in {e for e, _ in notes}
    plan = optimized(found)
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert not any("array_intersect" in line for line in filters)
    lines = plan.splitlines()
    joined = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert any("AS asked" in line for line in lines[joined:])  # what a query asks for is found before it meets its evidence


def test_overlap_with_text_counts_what_token_sets_share(spark):
    from leafscan.functions import text as X

    texts = ["违约金比例为3%的营业收入", "违约 金比例", "abc 违约金 x.y 比例为", "违约金比例", "", None, "金", "ab 违约金\n比例a收入"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    both = pairs.select(X.overlap(X.token_set("a"), X.token_set("b")).alias("want"), X.overlap_with_text(X.token_set("a"), "b").alias("got"))
    assert all(r["want"] == r["got"] for r in both.collect())


def test_review_reads_the_query_before_it_meets_the_sources(spark):
    sources = spark.createDataFrame(
        [("q", i, f"e{i}", ["h"], t, False) for i, t in enumerate(["违约金比例为3%", "无关", "违约金", "合同违约金比例", None])] + [("x", 1, "e", ["h"], "无关", None)],
        "qid string, ord int, evidence_id string, heading_path array<string>, text string, remembered boolean",
    )
    missing = spark.createDataFrame([("q", "违约金比例", ["违约金", None, ""])], "qid string, query string, key_terms array<string>")
    found = V.review_sources(sources, missing)
    assert [(r["qid"], r["evidence_id"], r["rank"]) for r in found.orderBy("qid", "rank").collect()] == [("q", "e0", 1), ("q", "e3", 2), ("q", "e2", 3), ("x", "e", 1)]
    lines = optimized(found).splitlines()
    joined = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert any("_words" in line and "regexp_extract_all" in line for line in lines[joined:])


def test_typed_terms_pass_the_rules_as_one_text(spark):
    from leafscan.functions import extract as E

    rows = spark.createDataFrame([(["查找2019-2020年的营业收入、成本率。确定2020年1-6月业务收入额", "多少钱 净利润率（2018至2019年度）公司产品"],)], "t array<string>")
    plan = rows.select(E.typed_terms(F.col("t"), 30).alias("x"))
    assert plan.first()["x"] == rows.select(E.typed_terms(F.col("t"), 30)).first()[0]
    assert "2019-2020年" not in "".join(plan.first()["x"]) and not any("多少" in t for t in plan.first()["x"])
    text = optimized(plan)
    assert text.count("regexp_replace") <= 9 and "(?m)^" in text  # a rule for all terms, not one for each
